"""Books by lines, and grades held against another grader's.

Lines are (file, line_no, line) as ``readers.lines`` gives them; what a line belongs to is carried over ranges of lines, so files may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import chain as ch
from . import scan
from .analysis import analyse_chains
from .extract import ALONE, DERIVED, NEGATIONS, PRAISED, _any, _phrase, chain_part, edition_numbers
from .joins import containment_join

# Phrases of reliability with how the verdict is then told, in order; where no words are given, the phrase itself.
RELIABLE_DETAILS = (
    ("ثقة ثقة", None), ("ثقة عين صحيح الحديث", None), ("ثقة عين نقي الحديث", None), ("ثقة عين كثير الرواية", None), ("ثقة عين", None), ("ثقة وجه", None), ("ثقة عدل", None), ("ثقة صدوق", None), ("ثقة صحيح", None),
    ("ثقة ثبت", None), ("ثقة جليل", None), ("ثقة معتمد", None), ("ثقة واقفي", "ثقة"), ("ثقة فطحي", "ثقة"), ("فهو ثقة", "ثقة"), ("وهو ثقة", "ثقة"), ("الثقة الآتي", "ثقة"), ("الثقة المتقدم", "ثقة"),
)
WEAK_DETAILS = (("ضعيف جدا", "ضعيف جداً"), ("ضعيف في نفسه", "ضعيف في نفسه"))
DERIVED_DETAILS = (("ثقة (تفسير القمي)", "علي بن إبراهيم"), ("ثقة (مشايخ ابن قولويه)", "ابن قولويه"), ("ثقة (مشايخ النجاشي)", "النجاشي"))
# Who is cited for a verdict, by the words that cite them, in order.
CITATIONS = (
    (r"وثقه\s+النجاشي", "النجاشي"), (r"قاله?\s+النجاشي", "النجاشي"), (r"وثقه\s+الشيخ", "الشيخ الطوسي"), (r"قاله?\s+الشيخ\s+منتجب\s+الدين", "الشيخ منتجب الدين"), (r"قاله?\s+الشيخ\s+الحر", "الشيخ الحر"),
    (r"قاله?\s+الشيخ", "الشيخ الطوسي"), (r"وثقه\s+المفيد", "الشيخ المفيد"), (r"قاله?\s+المفيد", "الشيخ المفيد"), (r"وثقه\s+البرقي", "البرقي"), (r"قاله?\s+البرقي", "البرقي"), (r"وثقه\s+الصدوق", "الصدوق"),
    (r"وثقه\s+الكشي", "الكشي"), (r"قاله?\s+الكشي", "الكشي"), (r"قاله?\s+الوحيد", "الوحيد"), (r"نص\s+(?:أحد\s+)?المعصومين", "نص المعصومين"), (r"وثقه\s+ابن\s+شهرآشوب", "ابن شهرآشوب"),
)


def cited(c: Column) -> Column:
    """Who is cited for a verdict, each once, in a fixed order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c.rlike(p), who) for p, who in CITATIONS])))


def verdict_fields(c: Column) -> Column:
    """status, detail and sources of an entry's text (X7): the ranks of ``extract.verdict``, with the words of the rule that decided. A derived verdict has a source of its own."""
    negated = c.rlike(_any(NEGATIONS, edges=False))
    before = F.regexp_extract(c, r"(?s)^(.*?)(?:^|[\s\-:])ضعيف(?:[\s\-,.]|$)", 1)
    sources = cited(c)
    rule = lambda when, status, detail, own=None: (when, F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"), (sources if own is None else F.array(F.lit(own))).alias("sources")))
    rules = [rule(c.rlike(tx.word(_phrase(p))) & ~negated, "thiqah", told or p) for p, told in RELIABLE_DETAILS]
    rules.append(rule(c.rlike(ALONE.format("ثقة")) & ~negated, "thiqah", "ثقة"))
    rules.append(rule(c.rlike(r"متحد\s+مع\s+.*?\s+الثقة|وهو\s+\S+.*?\s+الثقة") & ~negated, "thiqah", "ثقة (متحد)"))
    rules += [rule(c.rlike(tx.word(_phrase(p))), "daif", told) for p, told in WEAK_DETAILS]
    rules.append(rule(c.rlike(ALONE.format("ضعيف")) & ~F.right(before, F.lit(60)).rlike("طريق|طرق"), "daif", "ضعيف"))
    rules.append(rule(c.rlike(tx.word("موثق")), "muwaththaq", "موثق"))
    rules += [rule(c.rlike(tx.word(_phrase(p))), status, p) for p, status in PRAISED]
    rules.append(rule(c.rlike(r"[-:\s]حسن[-:\s,.]") & ~c.rlike(r"(?:أبو|بن|بنت)\s+حسن"), "hasan", "حسن"))
    rules.append(rule(c.rlike(tx.word("مجهول")), "majhul", "مجهول"))
    rules += [rule(c.rlike(p), "thiqah", told, who) for p, (told, who) in zip(DERIVED, DERIVED_DETAILS, strict=True)]
    out = F.struct(F.lit("unspecified").alias("status"), F.lit(None).cast("string").alias("detail"), sources.alias("sources"))
    for when, what in reversed(rules):
        out = F.when(when, what).otherwise(out)
    return F.when(c.isNotNull(), out)


# Lines that start an entry of the summary book, and those of pages and notes.
SUMMARY_HEADER = r"^\s*(?:ج‍?\s*24\s*[-.]?\s*)?[0-9٠-٩]+\s*-\s*(?:[0-9٠-٩]+)?\s*-?\s*(?:[0-9٠-٩]+)?\s*-\s*\S|^\s*[0-9٠-٩]{1,5}\s*[-–]\s*[0-9٠-٩]{1,5}\s*[-–]\s*[0-9٠-٩]{1,5}\s*[-–]"
ASIDE = r"^\s*(?:#|>|---)"


def summary_entries(lines: DataFrame, begin: Column | None = None, rows: int = scan.ROWS) -> DataFrame:
    """(file, najaf, beirut, tehran, name, text) of the summary book (X5): a header with its numbers starts an entry, the name is what stands before its colon; pages, notes and blank lines go, and so does all before the first line for which ``begin`` holds. Of entries with one number the last counts."""
    kept = lines.where(~F.coalesce(F.col("line").rlike(ASIDE), F.lit(False)) & (tx.strip(F.coalesce("line", F.lit(""))) != ""))
    if begin is not None:
        p = scan.running(scan.parts(kept.withColumn("__b", F.coalesce(begin, F.lit(False))), ["file"], ["line_no"], rows), ["file"], {"__begun": F.col("__b").cast("long")})
        kept = p.where((F.col("__begun") > 0) | F.col("__b")).select("file", "line_no", "line")
    entries = scan.assemble(kept, "file", "line_no", "line", F.col("line").rlike(SUMMARY_HEADER), rows=rows)
    head, text = F.split_part("text", F.lit("\n"), F.lit(1)), F.regexp_replace("text", r"\s*\n\s*", " ")
    n, rest = edition_numbers(head), F.regexp_replace(head, r"^\s*(?:ج‍?\s*24\s*[-.]?\s*)?(?:[0-9٠-٩]+\s*[-–]\s*){1,3}(?:[-–]\s*)?", "")
    one = entries.select("file", "entry", F.coalesce(n["n1"], F.regexp_extract(head, "([0-9٠-٩]+)", 1)).alias("najaf"), n["n2"].alias("beirut"), n["n3"].alias("tehran"), tx.strip(F.split_part(rest, F.lit(":"), F.lit(1))).alias("name"), text.alias("text"))
    last = one.groupBy("file", "najaf").agg(F.max("entry").alias("entry"))
    return one.join(last, ["file", "najaf", "entry"]).drop("entry").select("file", "najaf", "beirut", "tehran", "name", "text")


OCR_HEADER = r"^\s*([٠-٩]+)\s*[-–]\s*(.+?)(?:\s*:\s*(.+?))?\s*$"


def ocr_entries(lines: DataFrame, rows: int = scan.ROWS) -> DataFrame:
    """(file, number, name, grade_text, raw) of recognised pages (X9): a number starts an entry, further lines are a continuation of its name; raw is all of it in one line."""
    kept = lines.where(tx.strip(F.coalesce("line", F.lit(""))) != "").withColumn("line", tx.strip(F.col("line")))
    entries = scan.assemble(kept, "file", "line_no", "line", F.col("line").rlike(OCR_HEADER), rows=rows)
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    more = F.regexp_replace(F.substr("text", F.length(head) + 1), r"\n", " ")
    return entries.select("file", tx.loose_int(F.regexp_extract(head, OCR_HEADER, 1)).alias("number"), F.concat(F.regexp_extract(head, OCR_HEADER, 2), more).alias("name"), F.regexp_extract(head, OCR_HEADER, 3).alias("grade_text"), F.concat(head, more).alias("raw"))


def sections(lines: DataFrame, markers: dict[str, str], rows: int = scan.ROWS) -> DataFrame:
    """(file, line_no, line, section): lines behind a marker, up to the next one; marker lines and those before any go (X27). markers: section by a text that its marker contains."""
    mark = F.lit(None).cast("string")
    for section, text in reversed(markers.items()):
        mark = F.when(F.contains("line", F.lit(text)), section).otherwise(mark)
    p = scan.running(scan.parts(lines.withColumn("__m", mark), ["file"], ["line_no"], rows), ["file"], lasts={"section": F.col("__m")})
    return p.where(F.col("__m").isNull() & F.col("section").isNotNull()).select("file", "line_no", "line", "section")


#: A line of the report of names that found no entry, and the sections of that report.
REPORTED = r"^\[\s*([0-9]+)\]\s+T([0-9]+|None)\s+(.+?)(?:\s+\(best match:.*)?$"
REPORT_SECTIONS = {"no_match": "=== NO CANDIDATES", "ambiguous": "=== AMBIGUOUS"}


def unresolved_report(lines: DataFrame, rows: int = scan.ROWS) -> DataFrame:
    """(section, number, layer, name) of the report (X27): lines without a best match belong to the first section only, those with one to the second."""
    found = sections(lines, REPORT_SECTIONS, rows).where(F.col("line").rlike(REPORTED))
    best = F.contains("line", F.lit("(best match:"))
    found = found.where((F.col("section") == "no_match") | best)
    name = F.when(F.col("section") == "no_match", F.regexp_extract("line", r"^\[\s*[0-9]+\]\s+T(?:[0-9]+|None)\s+(.+)$", 1)).otherwise(F.regexp_extract("line", REPORTED, 3))
    return found.select("section", F.regexp_extract("line", REPORTED, 1).cast("int").alias("number"), F.regexp_extract("line", REPORTED, 2).try_cast("int").alias("layer"), tx.strip(name).alias("name"))


BOOK_HEADER = "^\\s*([0-9]{2,6})\\s*-\\s*([؀-ۿ][^:]*?)\\s*:\\s*$"


def header_index(lines: DataFrame) -> DataFrame:
    """(number, name, form): headers of a book's volumes, numbers from 10, each form of a number once (X26). ``name`` is the first name of the number in the order of files and lines."""
    found = lines.where(F.col("line").rlike(BOOK_HEADER)).select("file", "line_no", F.regexp_extract("line", BOOK_HEADER, 1).cast("long").alias("number"), F.regexp_extract("line", BOOK_HEADER, 2).alias("name")).where("number >= 10")
    first = found.groupBy("number").agg(F.min(F.struct("file", "line_no", "name")).alias("f")).select("number", F.col("f.name").alias("name"))
    return found.select("number", tx.normalize(F.col("name")).alias("form")).distinct().join(first, "number").select("number", "name", "form")


def find_in_books(names: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, number, exact): numbers whose header is the name, else those whose header has all its words, of names of two words or more (X26). names: (query_id, name)."""
    q = names.select("query_id", tx.normalize(F.col("name")).alias("form")).where("form <> ''")
    exact = q.join(index.select("form", "number"), "form").select("query_id", "number", F.lit(True).alias("exact")).distinct()
    rest = q.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", F.array_distinct(tx.words(F.col("form"))).alias("q"), F.size(tx.words(F.col("form"))).alias("n")).where("n >= 2")
    forms = index.select("form").distinct().withColumn("tokens", F.array_distinct(tx.words(F.col("form"))))
    held = containment_join(rest.select("query_id", "q"), forms, "query_id", "q", "form", "tokens")
    return exact.union(held.join(index.select("form", "number"), "form").select("query_id", "number", F.lit(False)).distinct())


# --- The benchmark


# Another grader's words and their categories.
THEIRS = {
    "صحيح": "Sahih", "حسن كالصحيح": "Sahih", "موثق كالصحيح": "Sahih", "حسن": "Hasan", "موثق": "Muwaththaq", "حسن أو موثق": "Hasan", "مجهول كالصحيح": "Majhul", "مجهول": "Majhul",
    "ضعيف": "Daif", "ضعيف على المشهور": "Daif", "مرسل": "Mursal", "مرفوع": "Mursal", "مرسل كالموثق": "Mursal", "مختلف فيه": "Disputed",
}
OURS = (("Sahih", "Sahih"), ("Hasan", "Hasan"), ("Muwaththaq", "Muwaththaq"), ("Da'if", "Daif"), ("Majhul", "Majhul"), ("Undetermined", "Undetermined"))


def their_category(grade: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in THEIRS.items() for x in kv]), tx.strip(F.coalesce(grade, F.lit(""))))


def our_category(grade: Column) -> Column:
    out = F.lit("Other")
    for part, name in reversed(OURS):
        out = F.when(F.contains(grade, F.lit(part)), name).otherwise(out)
    return out


def benchmark(reports: DataFrame, index: DataFrame, entries: DataFrame, virtual: DataFrame, titles: dict[str, int], endings: tuple[str, ...], theirs: str = "Sahih") -> tuple[DataFrame, DataFrame]:
    """((report_id, ours, matches, reason), (name, n)): reports that the other grader puts into ``theirs``, from text to grade: the chain is cut out, parsed, resolved link by link and graded (V4).

    reason says why a report does not match: an unresolved link, a weak or unknown one, or our category (A15). The second table counts the names that found no entry in reports that do not match.
    reports: (report_id, text, grade). A text without any name is Undetermined.
    """
    asked = reports.where(their_category(F.col("grade")) == theirs)
    chains = asked.select(F.col("report_id").alias("chain_id"), ch.parse(chain_part(F.col("text"), endings)).alias("names"))
    links = analyse_chains(chains, index, entries, virtual, titles)
    of = entries.select("entry_key", "status", "hadith_count", *[c for c in ("sect",) if c in entries.columns])
    known = links.join(of, "entry_key", "left").withColumn("status", F.when(F.col("virtual_key").isNotNull(), "thiqah").otherwise(F.col("status")))
    if "sect" not in known.columns:
        known = known.withColumn("sect", F.lit(None).cast("string"))
    graded = ch.grade(known.select("chain_id", "name", "status", "hadith_count", "sect"))
    lost = known.where(F.col("status").isNull() & tx.is_link(F.col("name"), ch.SPEECH)).select("chain_id", "name")
    ours = our_category(F.coalesce("grade", F.lit("Undetermined")))
    out = asked.select("report_id").join(graded.select(F.col("chain_id").alias("report_id"), "grade"), "report_id", "left").withColumn("ours", ours)
    out = out.join(lost.select(F.col("chain_id").alias("report_id")).distinct().withColumn("__lost", F.lit(True)), "report_id", "left")
    reason = F.when(F.col("ours") == theirs, None).when(F.col("__lost"), "unresolved_link").when(F.col("ours") == "Daif", "has_daif_link").when(F.col("ours") == "Majhul", "has_majhul_link").otherwise(F.col("ours"))
    result = out.select("report_id", "ours", (F.col("ours") == theirs).alias("matches"), reason.alias("reason"))
    return result, lost.groupBy("name").agg(F.count("*").alias("n"))


def uplift(entries: DataFrame, anchors: list[str]) -> DataFrame:
    """(vouched, uplifted): entries that one of the anchors narrates from, and how many of these are not reliable by their own status (A23). entries: status, students."""
    vouched = F.exists(F.coalesce("students", F.array().cast("array<string>")), lambda s: tx.normalize(s).isin(*anchors))
    return entries.agg(F.count_if(vouched).alias("vouched"), F.count_if(vouched & ~F.col("status").eqNullSafe("thiqah")).alias("uplifted"))
