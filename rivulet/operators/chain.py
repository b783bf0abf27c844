"""Chains of names: parsing, links, lifetimes, gaps, anonymous links and grades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scoring import weakest_link
from .windows import gap_severity

# Words that hand a report on, words of speech that end a chain, words that close a name.
CONNECTORS = ("عن", "حدثني", "حدثنا", "اخبرنا", "اخبرني", "سمعت", "انبانا", "منهم")
SPEECH = ("قال", "يقول", "قلت", "فقال")
HONORIFICS = r"\((?:ع|ص|رض|عليه السلام|عليها السلام|عليهما السلام|عليهم السلام|صلى الله عليه واله)\)"

# Rewrites of a chain's whole text, in order. Each is a pattern and what takes its place; "|" parts names.
_END = r"(?![\p{L}\p{N}_])"
REWRITES = (
    (r"^[0-9٠-٩]+\s*[-\s]\s*", ""),
    (HONORIFICS, " "),
    (r"^(?:اخبرنا|حدثنا)\s+ابو جعفر محمد بن يعقوب\s*(?:الكليني\s*)?قال حدثني\s+", ""),
    (rf"(?:^|\s)(?:و\s*)?(?:باسناده|بسنده|بهذا\s+الاسناد){_END}", " "),
    (r"(?:^|\s)و?\s*عنه[ا]?(?:\s+عن)?\s+", " "),  # back to the one before, who is not named again
    (r"\s(?:ورواه|وروى)\s+عن\s+", " عن "),
    (r"قال\s*:", "قال "),
    (rf"([ب-ي])بن{_END}", "$1 بن"),
    (rf"\s[و]?(?:قال|يقول)\s+(?=(?:{'|'.join(CONNECTORS[1:7])}|سالت|قلت)\s)", " "),
    (r"(?:^|\s)(?:سالت|قلت)\s+(?=اب[اي]\s)", " عن "),
    (rf"\s*(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(SPEECH)}){_END}.*$", ""),
    (rf"(?<![\p{{L}}\p{{N}}_])و?(?:{'|'.join(CONNECTORS)}|روى){_END}", "|"),
    (r"[،,؛;:.\n]+", "|"),
)
# Given names and by-names before which "and" begins another person.
BESIDE = (
    "محمد", "احمد", "علي", "حسن", "حسين", "الحسين", "عبد", "موسى", "يونس", "صفوان", "زرارة", "بريد",
    "حريز", "جعفر", "الفضل", "الفضيل", "الحسن", "العباس", "يحيى", "عمر", "عمرو", "سعد", "صالح", "عيسى",
    "سليمان", "داود", "ابراهيم", "هشام", "حنان", "اسماعيل", "الريان", "ابن", "علا", "جميل", "حماد", "بكير",
    "حميد", "سهل", "فضل", "نضر", "عبيد", "معاوية", "خالد", "زيد",
)
BESIDE_ALONE = ("الحجال", "ابو علي الاشعري", "ابي علي الاشعري", "ابي ايوب", "ابو ايوب", "عبد الله", "ابو العباس", "ابي العباس", "حماد", "جميل", "الرزاز", "ابن محبوب", "ابن رئاب", "ابن فضال", "ابن سنان", "ابن عمار", "ابن مسلم", "ابن بكير", "ابن ابي عمير", "ابن المغيرة")
GROUPS_OF = r"(?:عدة|جماعة|غير\s+واحد)\s+من\s+اصحابنا"
# What is cut from a name's end and start, in order.
TAILS = (
    rf"\s*[(\[]?\s*(?:عليه|عليها|عليهما|عليهم)\s+(?:السلام|السلم){_END}.*$", rf"\s*[(\[]?\s*(?:صلى|صلوات)\s+الله\s+عليه{_END}.*$", r"\s+[(\[]?\s*[عصج]{1,3}\s*[)\]]?\s*$", r"\s+و\s*غيرهم?(?:\s+من\s+اصحابنا)?\s*$",
    rf"\s+(?:انه|كتب|يساله|سئل|عند|ان|ابني|مثله|رفعه|اني|او|يرويان|يرويون|وهو|وكان|ويكنى|سالت){_END}.*$", rf"\s+في\s+(?:قول\s+الله|رجل){_END}.*$", r"\s+(?:قالوا|جميعا|معا)\s*$", r"[\[\]]|\s*[(]+\s*$",
)
STARTS = ((r"^لل", "ال"), (r"^(?:سالت|قلت|جده|اخيه)\s+(?=\S)", ""), (rf"^و(?!هب{_END})(?=[ا-ي])", ""), (r"^ل(?!ل)(?=[ا-ي])", ""))
# Where one segment holds two links.
TWO = ((r"\s+عمن\s+(?:رواه|ذكره).*$", "|عمن رواه"), (r"^(ابيه|ابوه)\s+و\s+", "$1|"), (r"^ابيه\s+(?=(?:محمد|احمد|علي|حسن|عيسى|يحيى|موسى)\s+بن\s)", "ابيه|"))
# Words that no name holds, of reports that run on into their matter; and segments that are none.
MATTER = (
    "الحلال", "الحرام", "قيامة", "النار", "فاجاب", "فقلت", "اكان", "شهادتهم", "شهادتهن", "ايمانهم", "شمائلهم", "الفقاع",
    "يطلق", "تعتد", "تبيت", "الجفر", "ربك", "الجري", "المارماهي", "الطافي", "الطحال", "الهدهد", "الزمير", "الحرير",
    "البنفسج", "اريد", "الفهود",
)
MATTER_PHRASES = ("الف مسال", "عز و?جل", "عز و جل", "رايك في", "قد علمه", "يقول من رايي", "توفى زوجها", "حيث شاء", "لا باس", "المراة تموت", "تزوج امراة", "قد روي فيه", "الحمام يفرخ", "يتزوج الطير", "يسال ابا", "يسلم في", "سباع الطير", "طيبة نفس", "يلتمس التجارة", "بعض موالي")
NO_NAMES = ("ذلك", "بيتها", "بيته", "فقال", "نعم", "لا", "رجاله", "رجله", "ابائك", "اباءك")
NO_STARTS = rf"^(?:مسال[ةه]|رجلا|رجل|ذلك|الرجل\s+(?:يسلم|يسال|يريد)){_END}"

#: Ages in years that a listener must have, and years of contact that make a link certain.
READY, SHORT, COMFORTABLE = 10, 5, 10


def parse(c: Column) -> Column:
    """Names of a chain's text, first to last, each once (C5): rewrites in a fixed order, one split, and cleaning of each part. An empty text has none."""
    n = tx.normalize(c)
    for pattern, to in REWRITES:
        n = F.regexp_replace(n, pattern, to)
    beside = rf"\s+و\s*(?=(?:{'|'.join(BESIDE)})\s+(?:بن|ابي|العجلي|الله\s+بن){_END}|(?:{'|'.join(BESIDE_ALONE)}){_END}|{GROUPS_OF})"
    n = F.regexp_replace(n, beside, "|")

    def clean(x: Column) -> Column:
        for pattern, to in STARTS[:2]:
            x = F.regexp_replace(tx.one_space(x), pattern, to)
        for pattern, to in TWO:
            x = F.regexp_replace(x, pattern, to)
        return x

    def trimmed(x: Column) -> Column:
        for pattern in TAILS:
            x = F.regexp_replace(x, pattern, "")
        for pattern, to in STARTS[1:]:
            x = F.regexp_replace(tx.one_space(x), pattern, to)
        return tx.one_space(F.regexp_replace(x, r"\s+ابن\s+", " بن "))

    parts = F.flatten(F.transform(F.transform(F.split(n, r"\|"), clean), lambda x: F.split(x, r"\|")))
    matter = tx.word("|".join(MATTER)) + "|" + "|".join(p.replace(" ", r"\s+") for p in MATTER_PHRASES)
    names = F.filter(F.transform(parts, trimmed), lambda x: (F.length(x) > 1) & ~x.rlike(r"^[0-9٠-٩\s]*$") & ~x.rlike(matter) & ~x.rlike(NO_STARTS) & ~x.isin(*NO_NAMES))
    return F.array_distinct(names)


def links(chains: DataFrame, chain_id: str, names: str) -> DataFrame:
    """(chain_id, pos, name, prev_name, next_name) of every link."""
    w = Window.partitionBy(chain_id).orderBy("pos")
    return chains.select(chain_id, F.posexplode(names).alias("pos", "name")).withColumns({"prev_name": F.lag("name").over(w), "next_name": F.lead("name").over(w)})


def lifetime(birth: Column, death: Column, birth_window: Column, death_window: Column) -> Column:
    """Bounds of a life and where they come from (C8): explicit years win over windows."""
    known = lambda year, window: (F.coalesce(year, F.get(window, 0)), F.coalesce(year, F.get(window, 1)))
    (b0, b1), (d0, d1) = known(birth, birth_window), known(death, death_window)
    windows = (F.coalesce(F.size(birth_window), F.lit(0)) > 0) | (F.coalesce(F.size(death_window), F.lit(0)) > 0)
    source = F.when(birth.isNotNull() & death.isNotNull(), "explicit").when(birth.isNotNull() | death.isNotNull(), "explicit+window").when(windows, "tabaqah_window").otherwise("unknown")
    return F.struct(b0.alias("birth_low"), b1.alias("birth_high"), d0.alias("death_low"), d1.alias("death_high"), source.alias("source"))


def transmission(teacher: Column, student: Column, ready: int = READY, short: int = SHORT, comfortable: int = COMFORTABLE) -> Column:
    """(verdict, overlap) of two lifetimes (C8, J20). Below ``short`` years of contact it is impossible, from ``comfortable`` on certain."""
    last, first = teacher["death_high"], student["birth_low"]
    years = last - (first + ready)
    unknown = (teacher["source"] == "unknown") | (student["source"] == "unknown") | last.isNull() | first.isNull()
    verdict = F.when(F.coalesce(unknown, F.lit(True)), "unknown").when((first > last) | (years < short), "impossible").when(years < comfortable, "possible").otherwise("certain")
    return F.struct(verdict.alias("verdict"), F.when(verdict != "unknown", years).alias("overlap"))


def annotate(resolved: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Adds gap, severity, verdict and overlap of each link with the next one (C9, W2). resolved: chain_id, pos, tabaqah, life (of ``lifetime``)."""
    w = Window.partitionBy(chain_id).orderBy("pos")
    out = resolved.withColumns({"next_tabaqah": F.lead("tabaqah").over(w), "next_life": F.lead("life").over(w)})
    gap = F.col("tabaqah") - F.col("next_tabaqah")
    # Chains run from the author's side to the source's, so the next link is the teacher.
    met = F.when(F.col("next_life").isNotNull(), transmission(F.col("next_life"), F.col("life")))
    return out.withColumns({"gap": gap, "severity": gap_severity(gap), "link": met}).select(*resolved.columns, "gap", "severity", "link.verdict", "link.overlap")


def tadlis_flags(annotated: DataFrame) -> DataFrame:
    """(…, flag, level): one row a flag (C9): impossible contact, or a possible one over a gap of layers."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("verdict") == "impossible", F.struct(F.lit("lifetime_gap").alias("flag"), F.lit("high").alias("level"))),
            F.when((F.col("verdict") == "possible") & (F.col("gap") >= 2), F.struct(F.lit("skipped_intermediary").alias("flag"), F.lit("medium").alias("level"))),
        )
    )
    return annotated.withColumn("__f", F.explode(flags)).select(*annotated.columns, "__f.flag", "__f.level")


# Anonymous links, in the order in which they are tried: pattern, type, severity.
ANONYMOUS = (
    ("عمن رواه$", "MURSAL", "critical"),
    ("عمن ذكره$", "MURSAL", "critical"),
    ("عن رجل", "MURSAL", "critical"),
    ("عن شيخ", "MURSAL", "critical"),
    ("عن بعض شيوخه", "MURSAL", "major"),
    ("عن فلان", "MURSAL", "critical"),
    ("عن فلانة", "MURSAL", "critical"),
    ("عن امراة", "MURSAL", "critical"),
    ("عن جماعة$", "MURSAL", "major"),
    ("عن قوم", "MURSAL", "major"),
    ("عن ناس", "MURSAL", "major"),
    ("عن اثنين", "MURSAL", "major"),
    ("عن ثلاثة", "MURSAL", "major"),
    ("عن رجال", "MURSAL", "critical"),
    ("عن اخر", "MUBHAM", "minor"),
    ("عن غير واحد", "MUBHAM", "minor"),
)
SEVERITY = {"critical": 3, "major": 2, "minor": 1}


def anonymous(segment: Column) -> Column:
    """(type, severity) of the first pattern that a segment begins with, null if none does (C10). The leading word may have been stripped."""
    heads = []
    for p, kind, severity in ANONYMOUS:
        body, end = (p[:-1], r"\s*$") if p.endswith("$") else (p, r"(?![\p{L}\p{N}_])")
        heads.append((body.replace("عن ", r"(?:عن\s+)?", 1).replace(" ", r"\s+") + end, kind, severity))

    def first(n: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,severity:string>")
        for head, kind, severity in reversed(heads):
            out = F.when(n.rlike(rf"^\s*{head}"), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))).otherwise(out)
        # Most segments are names: one pattern says so.
        return F.when(n.rlike(rf"^\s*(?:{'|'.join(head for head, _, _ in heads)})"), out)

    return tx.bound(tx.normalize(segment), first)


def irsal(chains: DataFrame, chain_id: str = "chain_id", segments: str = "segments") -> DataFrame:
    """(chain_id, has_irsal, irsal_type, findings): consecutive anonymous links become MUDAL; the gravest finding names the chain (C10, W4). One row a chain, which needs no order of rows."""
    links = F.transform(F.coalesce(F.col(segments), F.array().cast("array<string>")), lambda s: F.struct(s.alias("segment"), anonymous(s).alias("f")))
    rows = chains.select(chain_id, links.alias("l"))

    def finding(x: Column, i: Column) -> Column:
        beside = F.coalesce(F.get(F.col("l"), i - 1)["f"].isNotNull(), F.lit(False)) | F.coalesce(F.get(F.col("l"), i + 1)["f"].isNotNull(), F.lit(False))
        up = (x["f"]["kind"] == "MURSAL") & beside
        kind, severity = F.when(up, "MUDAL").otherwise(x["f"]["kind"]), F.when(up, "critical").otherwise(x["f"]["severity"])
        return F.when(x["f"].isNotNull(), F.struct(i.alias("index"), x["segment"].alias("segment"), kind.alias("type"), severity.alias("severity")))

    found = rows.select(chain_id, F.array_compact(F.transform("l", finding)).alias("findings"))
    weight = lambda s: F.coalesce(*[F.when(s == name, v) for name, v in SEVERITY.items()], F.lit(0))
    gravest = F.array_min(F.transform("findings", lambda f: F.struct((-weight(f["severity"])).alias("w"), f["index"].alias("i"), f["type"].alias("t"))))
    return found.select(chain_id, (F.size("findings") > 0).alias("has_irsal"), gravest["t"].alias("irsal_type"), "findings")


# Sects that make a reliable person a non-partisan one.
OTHER_SECTS = ("عامي", "فطحي", "واقفي", "زيدي")


def grade(resolved: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """(chain_id, n_links, grade): the weakest link decides (A24). resolved: chain_id, name, status (null: unresolved), hadith_count, sect.

    Segments longer than a name or that hold speech are no links (P9).
    """
    kept = resolved.where(tx.is_link(F.col("name"), SPEECH))
    status = F.col("status")
    sect = F.lit(False)
    for s in OTHER_SECTS:
        sect = sect | F.contains(F.coalesce("sect", F.lit("")), F.lit(s))
    flags = {
        "unresolved": status.isNull(),
        "weak": status == "daif",
        "unknown": (status == "majhul") | ((status == "unspecified") & (F.coalesce("hadith_count", F.lit(0)) < 100)),
        "other": (status == "muwaththaq") | ((status != "thiqah") & sect),
        "praised": status.isin("mamduh", "hasan"),
    }
    return weakest_link(kept, chain_id, flags, [("unresolved", "Undetermined"), ("weak", "Da'if"), ("unknown", "Majhul"), ("other", "Muwaththaq"), ("praised", "Hasan")], "Sahih")


def downgrade(graded: DataFrame, annotated: DataFrame, irsals: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Adds ``final``: impossible links and anonymous ones mark a grade, the latter only where it is Sahih (C7f, C10)."""
    bad = annotated.groupBy(chain_id).agg(F.bool_or(F.col("verdict") == "impossible").alias("impossible"))
    out = graded.join(bad, chain_id, "left").join(irsals.select(chain_id, "has_irsal", "irsal_type"), chain_id, "left")
    first = F.when(F.coalesce("has_irsal", F.lit(False)) & (F.col("grade") == "Sahih"), F.concat("grade", F.lit(" -> "), "irsal_type")).otherwise(F.col("grade"))
    return out.withColumn("final", F.when(F.coalesce("impossible", F.lit(False)), F.concat(first, F.lit(" -> impossible link"))).otherwise(first)).drop("impossible", "has_irsal", "irsal_type")


def expected_range(prev_layer: Column, next_layer: Column) -> Column:
    """(low, high) of a link's layer from its neighbours."""
    return (
        F.when(prev_layer.isNotNull() & next_layer.isNotNull(), F.struct(F.least(prev_layer, next_layer).alias("low"), F.greatest(prev_layer, next_layer).alias("high")))
        .when(prev_layer.isNotNull(), F.struct(F.greatest(F.lit(1), prev_layer - 2).alias("low"), prev_layer.alias("high")))
        .when(next_layer.isNotNull(), F.struct(next_layer.alias("low"), F.least(F.lit(12), next_layer + 2).alias("high")))
    )


def fathers(resolved: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Adds ``asked``: for "his father" and "his grandfather" the name that the last resolved link before gives."""
    w = Window.partitionBy(chain_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(~F.coalesce("virtual", F.lit(False)) & F.col("entry_key").isNotNull(), F.struct("father", "grandfather")), ignorenulls=True).over(w)
    n = tx.normalize(F.col("name"))
    asked = F.when(n.isin("ابيه", "ابوه"), F.col("__a.father")).when(n == "جده", F.col("__a.grandfather")).otherwise(F.col("name"))
    return resolved.withColumn("__a", anchor).withColumn("asked", asked).drop("__a")


KINDS = (("punct", r"[،,؛;:.]"), ("connector", "|".join(CONNECTORS)), ("speech", "|".join(SPEECH)), ("group", r"عدة\s+من\s+اصحابنا|جماعة"), ("father", "ابيه|جده|ابوه"), ("honorific", HONORIFICS))


def tokenize(chains: DataFrame, chain_id: str, text: str) -> DataFrame:
    """(chain_id, pos, kind, token) by a lexer: runs of words between other tokens are one name. ``grammar.segments`` reads chains by their grammar."""
    import re

    kinds = [(k, re.compile(rf"(?:{p})(?=\s|$|[،,؛;:.])" if k not in ("punct", "honorific") else p)) for k, p in KINDS]
    id_type = chains.schema[chain_id].dataType.simpleString()

    def read(source: str) -> list[tuple[str, str]]:
        out, at, name = [], 0, []
        while at < len(source):
            if source[at].isspace():
                at += 1
                continue
            for kind, p in kinds:
                if m := p.match(source, at):
                    if name:
                        out.append(("name", " ".join(name)))
                        name = []
                    out.append((kind, m[0]))
                    at = m.end()
                    break
            else:
                m = re.compile(r"[^\s،,؛;:.]+").match(source, at)
                name.append(m[0])
                at = m.end()
        return out + ([("name", " ".join(name))] if name else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, k, t) for i, s in zip(b["id"], b["text"], strict=True) for p, (k, t) in enumerate(read(s or ""))]
            yield pd.DataFrame(rows, columns=[chain_id, "pos", "kind", "token"])

    return chains.select(F.col(chain_id).alias("id"), tx.normalize(F.col(text)).alias("text")).mapInPandas(run, f"{chain_id} {id_type}, pos int, kind string, token string")


def names_of_tokens(tokens: DataFrame, chain_id: str) -> DataFrame:
    """(chain_id, names): names, groups and relatives, in order."""
    kept = tokens.where(F.col("kind").isin("name", "group", "father"))
    return kept.groupBy(chain_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("names"))


def gap_alternatives(gaps: DataFrame, alternatives: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Near alternatives of a link whose layer closes its gap (C12). alternatives: chain_id, pos, entry_key, alt_tabaqah."""
    return gaps.where("severity is not null").join(alternatives, [chain_id, "pos"]).where(F.abs(F.col("alt_tabaqah") - (F.col("tabaqah") - F.col("gap"))) <= 1)
