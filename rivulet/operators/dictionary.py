"""Many fixed terms found in texts in one pass, with places (N15, N33, X28). A text costs the same whether there are ten terms or a hundred thousand.

Terms make one automaton, which each task builds from a broadcast table of at most MOST terms and uses on Arrow batches; more terms are an error, not a slower plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms that a task may hold, and their characters.
MOST, MOST_CHARS = 1_000_000, 20_000_000
#: Texts that a task holds as Python objects at a time, and matches, about, of a batch that leaves it.
ROWS, MATCHES = 64, 20_000


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def mentions(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", longest: bool = True, edges: bool = False, keep: str = "all") -> DataFrame:
    """(key, start, end, term): where terms stand in the texts, places from 0 in code points, end behind the last.

    With ``longest`` matches don't overlap: the leftmost counts, of those the longest, and the search goes on behind it; else every occurrence counts. With ``edges`` a
    term must stand between characters that belong to no word. Null texts, and null or empty terms, match nothing. Keys need not be unique. ``keep`` is what leaves a task of
    the matches of one text: "all", the "last" to end (of those that end together the longest), or the first of each "term"; a task holds the matches of few texts at a time.
    """
    held = terms.select(F.col(term).alias("t")).where("t <> ''").distinct()
    n, chars = held.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if n > MOST or chars > MOST_CHARS:
        raise ValueError(f"{n} terms of {chars} characters are more than a task may hold")
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in held.collect()))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick  # only tasks need it

        machine = ahocorasick.Automaton()
        for t in sent.value:
            machine.add_word(t, t)
        machine.make_automaton()
        if not len(machine):
            return
        names = [key, "start", "end", "term"]

        def each(s: str) -> Iterator[tuple[int, int, str]]:
            for e, t in machine.iter(s):
                a, b = e - len(t) + 1, e + 1
                if not edges or (not (a and _inside(s[a - 1])) and not (b < len(s) and _inside(s[b]))):
                    yield a, b, t

        def kept(s: str) -> Iterable[tuple[int, int, str]]:
            if not longest and keep == "last":
                end, term = -1, ""
                for _, b, t in each(s) if edges else ((0, e + 1, t) for e, t in machine.iter(s)):
                    if b > end or (b == end and len(t) > len(term)):
                        end, term = b, t
                return [(end - len(term), end, term)] if term else []
            if not longest and keep == "term":
                first: dict[str, int] = {}
                for b, t in ((b, t) for _, b, t in each(s)) if edges else ((e + 1, t) for e, t in machine.iter(s)):
                    if t not in first:
                        first[t] = b
                return [(b - len(t), b, t) for t, b in first.items()]
            hits = sorted(each(s), key=lambda h: (h[0], -h[1]))
            if not longest:
                return hits
            out, upto = [], 0
            for h in hits:
                if h[0] >= upto:
                    out.append(h)
                    upto = h[1]
            return out

        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                row, start, end, found = [], [], [], []
                for i, s in enumerate(batch.column(1)):
                    if not (s := s.as_py()):
                        continue
                    for a, b, t in kept(s):
                        row.append(i)
                        start.append(a)
                        end.append(b)
                        found.append(t)
                    if len(row) >= MATCHES:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.string())], names=names)
                        row, start, end, found = [], [], [], []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.string())], names=names)

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, start int, end int, term string")


def longest_title(texts: DataFrame, key: str, text: str, titles: DataFrame) -> DataFrame:
    """(key, title, layer): of the titles in a text the longest decides, ties by the first in order (N15). titles: (title, layer); keys are unique."""
    found = mentions(texts, key, text, titles, "title", longest=False, keep="term").groupBy(key).agg(F.min(F.struct((-F.length("term")).alias("n"), "term")).alias("b"))
    layers = titles.groupBy(F.col("title").alias("t")).agg(F.min("layer").alias("layer"))
    return found.join(layers, F.col("b.term") == F.col("t")).select(key, F.col("t").alias("title"), "layer")


def last_mention(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", edges: bool = True) -> DataFrame:
    """(key, start, end, term): the rightmost mention of each text, of those that end together the longest (X28). Keys are unique."""
    found = mentions(texts, key, text, terms, term, longest=False, edges=edges, keep="last")
    w = Window.partitionBy(key).orderBy(F.desc("end"), "start")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def labels(texts: DataFrame, key: str, text: str, terms: DataFrame, edges: bool = True) -> DataFrame:
    """(key, labels): the sorted distinct labels of all terms that stand in a text (N33). terms: (term, label); texts without any give no row."""
    found = mentions(texts, key, text, terms, "term", longest=False, edges=edges, keep="term").select(key, "term")
    return found.join(terms.select("term", "label").distinct(), "term").groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
