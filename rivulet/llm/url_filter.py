"""Weighted URL vocabulary: one Aho-Corasick pass counts strict and soft terms, host rules come first.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed; an empty table gives an empty
result; repeated rows are judged one by one; other columns of the input are kept unless their name clashes with a result
column, in which case the result column wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Host rules of the contract (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# The vocabulary, terms with their weights. A term of weight 1 or more is strict and rejects alone; others are soft and reject only together, if they weigh enough.
VOCABULARY = {
    "porn": 1.0, "xxx": 1.0, "sex-cams": 1.0, "hentai": 1.0, "casino-bonus": 1.0, "spam-farm": 1.0, "malware": 1.0, "warez": 1.0, "phishing": 1.0, "camgirls": 1.0, "keygen": 1.0, "ransomware": 1.0,
    "adult": 0.6, "bet": 0.5, "betting": 0.6, "bonus": 0.5, "casino": 0.7, "cheap": 0.3, "click": 0.3, "coupon": 0.3, "crack": 0.7, "dating": 0.6, "escort": 0.7, "free": 0.5, "jackpot": 0.6, "loan": 0.4, "lottery": 0.6, "nude": 0.7,
    "payday": 0.5, "pills": 0.6, "poker": 0.6, "prize": 0.5, "replica": 0.6, "sexy": 0.7, "slots": 0.6, "spam": 0.6, "torrent": 0.7, "viagra": 0.7, "win": 0.5,
}
#: Distinct soft terms, and their summed weight, from which a url is rejected.
SOFT_LIMIT, SOFT_WEIGHT = 2, 1.0

ADDED = T.StructType(
    [
        T.StructField("strict_hits", T.IntegerType()),
        T.StructField("soft_hits", T.IntegerType()),
        T.StructField("soft_distinct", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


def vocabulary_of(terms: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """A vocabulary from a table, which every task holds whole: A-Z lower-cased, null and empty terms and those without a weight left out, of several weights the highest."""
    rows = terms.select(F.translate(term, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"), F.col(weight).cast("double").alias("w")).where("t <> '' and w is not null")
    return {r.t: r.w for r in rows.groupBy("t").agg(F.max("w").alias("w")).orderBy("t").collect()}


def _automaton(vocabulary: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term, (int(weight >= 1), term, weight))
    found.make_automaton()
    return found


def _edge(url: str, at: int) -> bool:
    """Whether no ASCII letter or digit stands at ``at``: terms count only between such edges."""
    return not (0 <= at < len(url) and url[at] in "abcdefghijklmnopqrstuvwxyz0123456789")


def count_terms(df: DataFrame, url: str = "url", vocabulary: dict[str, float] = VOCABULARY) -> DataFrame:
    """``df`` with strict_hits, soft_hits, soft_distinct and the summed weight of the url's distinct terms (A-Z lower-cased) in one automaton pass."""
    kept = [c for c in df.columns if c not in ADDED.fieldNames()]
    schema = T.StructType([df.schema[c] for c in kept] + ADDED.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        machine = _automaton(vocabulary) if vocabulary else None
        for batch in batches:
            rows: list[tuple[int, int, int, float]] = []
            for text in batch.column(url).to_pylist():
                low = (text or "").translate(table)
                hits = [h for end, h in machine.iter(low) if _edge(low, end - len(h[1])) and _edge(low, end + 1)] if low and machine else []
                strict, distinct = sum(h[0] for h in hits), set(hits)
                rows.append((strict, len(hits) - strict, sum(1 - h[0] for h in distinct), round(sum(h[2] for h in distinct), 6)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], names=[*kept, *ADDED.fieldNames()])

    return df.select(*kept).mapInArrow(scan, schema)


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT, vocabulary: dict[str, float] = VOCABULARY) -> DataFrame:
    """Adds host, path, rule and verdict. The longest fitting host rule decides, else the vocabulary: one strict hit blocks, or ``soft_limit`` distinct soft ones that weigh ``soft_weight``."""
    address = F.coalesce(F.col(url), F.lit(""))
    has = F.instr(address, "://") > 0
    rest = F.when(has, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    df = count_terms(df, url, vocabulary).withColumns({"host": host, "path": path})
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is laid over the others
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(F.col("path"), F.lit(start))
        rule, action = F.when(fits, name + start).otherwise(rule), F.when(fits, verdict).otherwise(action)
    method = F.when((F.col("strict_hits") > 0) | ((F.col("soft_distinct") >= soft_limit) & (F.col("weight") >= soft_weight)), "block").otherwise("allow")
    return df.withColumns({"rule": rule, "verdict": F.coalesce(action, method)})


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, "pages", sf_dir).select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_distinct", "weight")


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    # A term may occur several times, neighbours sharing one edge: both edges are doubled before counting.
    count = lambda term: f"len(regexp_extract_all(wide, '[^a-z0-9]{term}[^a-z0-9]'))"
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2])))
    rule, action = (cases.format(*values) for values in ([h + p for _, h, p in RULES], [a for a, _, _ in RULES]))
    return f"""
WITH a AS (
  SELECT page_id, {low} AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id, low, ' ' || regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS wide,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
c AS (
  SELECT *, CAST({" + ".join(count(t.replace("-", "--")) for t, w in VOCABULARY.items() if w >= 1)} AS INTEGER) AS strict_hits,
         CAST({" + ".join(f"CAST({hit(t)} AS INTEGER)" for t, w in VOCABULARY.items() if w < 1)} AS INTEGER) AS soft_distinct,
         round({" + ".join(f"CAST({hit(t)} AS INTEGER) * {w}::DOUBLE" for t, w in VOCABULARY.items())}, 6) AS weight,
         CASE {rule} END AS rule, CASE {action} END AS action
  FROM b)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN strict_hits > 0 OR (soft_distinct >= {SOFT_LIMIT} AND weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_distinct, weight
FROM c"""


SQL = _sql()
