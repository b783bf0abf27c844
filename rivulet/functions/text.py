"""Text normalisation and scalar functions as Column expressions (N1-N35). No Python runs on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and marks of the script.
ALEFS = "أإآٱ"
TATWEEL = "ـ"
MARKS = r"[ً-ٰٟ]"
EASTERN, PERSIAN, WESTERN = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"

# Spelling variants that are folded (from, to).
SPELLINGS = (("نيسابور", "نيشابور"), ("رحمان", "رحمن"))

# Name particles; the forms with a hamza are never met in normalised text, as in the reference data.
PARTICLES = ("بن", "ابن", "بنت", "أبي", "أبو", "ام", "أم")


def word(pattern: str) -> str:
    """A pattern between word edges. Java's own edge fails beside Arabic marks."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def bare(c: Column) -> Column:
    """Without marks and tatweel."""
    return F.regexp_replace(F.translate(c, TATWEEL, ""), MARKS, "")


def normalize(c: Column) -> Column:
    """The canonical form (N1). Null becomes empty."""
    c = F.translate(bare(F.coalesce(c, F.lit(""))), ALEFS, "ا" * len(ALEFS))
    c = F.regexp_replace(c, r"(?U)الل\s+ه(?![\p{L}\p{N}_])", "الله")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return one_space(F.regexp_replace(c, r"(?U)اء(?=\s|$)", "ا"))


def normalize_strict(c: Column) -> Column:
    """The aggressive form (N2): Persian letters, final forms, nothing but Arabic letters and spaces."""
    c = F.translate(F.coalesce(c, F.lit("")), ALEFS + "یکىةهٔ"[:4] + TATWEEL, "ا" * len(ALEFS) + "يكيه")
    return one_space(F.regexp_replace(F.regexp_replace(c, MARKS, ""), r"(?U)[^؀-ۿ\s]", ""))


def without_article(c: Column) -> Column:
    """Normalised, and the article gone from words of more than four letters."""
    ws = F.transform(words(normalize(c)), lambda w: F.when(F.startswith(w, F.lit("ال")) & (F.length(w) > 4), F.substr(w, F.lit(3))).otherwise(w))
    return F.array_join(ws, " ")


def letters_only(c: Column) -> Column:
    """Arabic base letters and single spaces."""
    return one_space(F.regexp_replace(normalize(c), r"[^ا-ي ]", ""))


def for_merge(c: Column) -> Column:
    """Without marks and punctuation; only three alefs are folded."""
    return one_space(F.regexp_replace(F.translate(bare(F.coalesce(c, F.lit(""))), "أإآ", "ااا"), r"[\p{P}]", " "))


def for_search(c: Column) -> Column:
    """Letters folded and name particles gone, so that only what tells people apart is left."""
    c = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, ""), "أإآةى", "اااهي")
    return one_space(F.regexp_replace(c, word("بن|ابن|أبو|ابا|ابي|ال"), ""))


def words(c: Column) -> Column:
    """Words of a text; none of an empty one."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    return words(normalize(c))


def first_words(c: Column, n: int) -> Column:
    """The first n words as a key, null of a text with fewer."""
    ws = words(c)
    return F.when(F.size(ws) >= n, F.array_join(F.slice(ws, 1, n), " "))


def loose_int(c: Column) -> Column:
    """The digits of a text, Eastern or not, as a number; null without any."""
    plain = F.translate(c.cast("string"), EASTERN + PERSIAN, WESTERN * 2)
    return F.regexp_replace(plain, "[^0-9]", "").try_cast("int")


def strict_int(c: Column) -> Column:
    """A number in any digits; null where anything else stands in the text."""
    plain = strip(F.translate(c.cast("string"), EASTERN + PERSIAN, WESTERN * 2))
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("int"))


def to_arabic_digits(c: Column) -> Column:
    """A whole number in Eastern digits; zero for what is not positive."""
    return F.when(c.cast("long") > 0, F.translate(c.cast("string"), WESTERN, EASTERN)).otherwise(F.lit(EASTERN[0]))


def strip_honorific(c: Column) -> Column:
    """Without a closing honorific letter or phrase in its own word or brackets."""
    return strip(F.regexp_replace(normalize(c), r"(?U)\s*(?:\((?:ع|ص|ج|عليه السلام|عليها السلام|عليهم السلام|صلى الله عليه واله)\)|\s(?:ع|ص|ج|عليه السلام))\s*$", ""))


def longest_title(c: Column, titles: dict[str, int]) -> Column:
    """The value of the longest title that the text contains."""
    out = F.lit(None).cast("int")
    for title in sorted(titles, key=lambda t: (len(t), t)):
        out = F.when(F.contains(c, F.lit(title)), titles[title]).otherwise(out)
    return out


def distinct_forms(forms: list[Column], least: int = 3) -> Column:
    """Distinct non-null forms of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.array_compact(F.array(*forms)), lambda f: F.length(f) >= least))


def _drop(text: Column, part: Column) -> Column:
    return F.when(part != "", strip(F.replace(text, part, F.lit("")))).otherwise(text)


def person_forms(name: Column, kunyah: Column, laqab: Column, nisba: Column, father: Column, aliases: Column) -> Column:
    """All forms a chain may use for a person (N18): with and without parts, the first two names, by-names, and aliases."""
    parts = F.struct(*[normalize(c).alias(a) for a, c in (("full", name), ("k", kunyah), ("q", laqab), ("n", nisba), ("f", father))])
    return bound(parts, lambda p: _forms(*(p[a] for a in ("full", "k", "q", "n", "f")), aliases))


def _forms(full: Column, k: Column, q: Column, n: Column, f: Column, aliases: Column) -> Column:
    """``person_forms`` of parts that are normalised."""
    two = bound(F.filter(words(full), lambda w: ~w.isin(*PARTICLES)), lambda c: F.when(F.size(c) >= 2, F.concat(F.get(c, 0), F.lit(" بن "), F.get(c, 1))))
    abi = F.when(F.startswith(k, F.lit("ابو ")), F.replace(k, F.lit("ابو "), F.lit("ابي ")))
    with_part = lambda base, part: F.when((base != "") & (part != ""), F.concat_ws(" ", base, part))
    own = [full, _drop(full, n), _drop(full, q), _drop(_drop(full, n), q), two, F.when(k != "", k), with_part(k, n), with_part(k, q), F.when(f != "", F.concat(F.lit("ابن "), f)), abi, with_part(abi, n), with_part(abi, q)]
    al = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), normalize)
    more = F.flatten(F.transform(al, lambda a: F.array(a, _drop(a, n))))
    forms = F.filter(F.concat(F.array_compact(F.array(*own)), more), lambda x: F.length(x) >= 3)
    return F.when(full != "", F.array_distinct(forms)).otherwise(F.array().cast("array<string>"))


def significant(c: Column, stop: tuple[str, ...] = PARTICLES) -> Column:
    """Distinct words of three letters or more that are no particles."""
    return F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def overlap(a: Column, b: Column) -> Column:
    """Number of shared items."""
    return F.size(F.array_intersect(a, b))


def given_name(c: Column) -> Column:
    """The first personal name; two words if it begins with a servant's name."""
    ws = F.filter(tokens(c), lambda w: ~w.isin(*PARTICLES))
    return F.when(F.get(ws, 0) == "عبد", F.concat_ws(" ", F.get(ws, 0), F.get(ws, 1))).otherwise(F.get(ws, 0))


# Words that hand a report on (those with a hamza are never met in the strict form, as in the reference data), and words that open a section's heading.
HANDING = ("عن", "حدثنا", "حدثني", "أخبرنا", "أخبرني", "قال", "سمعت")
HEADINGS = ("المعمرون", "المدلس", "الضعفاء", "أصحاب", "ذوي", "الأسناد", "الأسانيد")


def by_name(c: Column) -> Column:
    """A by-name in its strict form, without the word that hands the report on."""
    return strip(F.regexp_replace(normalize_strict(c), rf"^(?:{'|'.join(HANDING)})\s+", ""))


def is_heading(c: Column) -> Column:
    """Whether a line is the heading of a section and no person."""
    return c.rlike(rf"[:：]|^(?:{'|'.join(HEADINGS)})")


def word_match(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other and both have three letters."""
    return (a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (F.startswith(a, b) | F.startswith(b, a)))


def name_score(a: Column, b: Column) -> Column:
    """0 unless given names are equal, else the share of a's words that match one of b's."""
    aw, bw = significant(a), significant(b)
    met = F.size(F.filter(aw, lambda x: F.exists(bw, lambda y: word_match(x, y))))
    return F.when((given_name(a) == given_name(b)) & (F.size(aw) > 0), met / F.size(aw)).otherwise(F.lit(0.0))


def in_names(target: Column, names: Column) -> Column:
    """Whether a name is listed, or all its words of three letters occur in one listed name."""
    t = normalize(target)
    long = F.filter(words(t), lambda w: F.length(w) >= 3)
    return F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: (normalize(n) == t) | ((F.size(long) > 0) & F.forall(long, lambda w: F.contains(normalize(n), w))))


def subset_of_any(part: Column, names: Column) -> Column:
    """Whether the words of ``part``, particles aside, all belong to one of the names."""
    content = lambda c: F.filter(tokens(c), lambda w: ~w.isin(*PARTICLES))
    own = content(part)
    return (F.size(own) > 0) & F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.size(F.array_except(own, content(n))) == 0)


def one_edit_variants(c: Column, old: str, new: str) -> Column:
    """The text and, for each word with the letter, the text with the last such letter of that word changed."""
    ws = words(c)
    changed = F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_join(F.transform(ws, lambda w, j: F.when(i == j, F.regexp_replace(w, f"{old}(?=[^{old}]*$)", new)).otherwise(w)), " "))
    return F.when(F.size(ws) > 0, F.array_distinct(F.concat(F.array(c), changed))).otherwise(F.array(c))


def main_text(body: Column, full: Column, markers: tuple[str, ...]) -> Column:
    """The field if it has more than 20 characters, else what follows the last marker in the first 60 % of the full text."""
    out = full
    for m in reversed(markers):
        head = F.substring(full, F.lit(1), F.ceil(F.length(full) * 0.6).cast("int"))
        at = F.length(head) - F.instr(F.reverse(head), m[::-1]) - len(m) + 2
        out = F.when(F.instr(head, m) > 0, strip(F.substr(full, at + len(m)))).otherwise(out)
    return F.when(F.length(body) > 20, body).otherwise(out)


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols])


def labels(c: Column, patterns: dict[str, str]) -> Column:
    """Labels of all patterns that occur."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in patterns.items()]))


def fame(count: Column) -> Column:
    """0.2 * log10(n + 1), nothing without a count."""
    return F.coalesce(F.log10(count.cast("double") + 1) * 0.2, F.lit(0.0))


def plausible_year(c: Column) -> Column:
    """Hijri years 1 to 500."""
    return F.when(c.between(1, 500), c)


def json_of_reply(c: Column) -> Column:
    """The JSON object or array of a model's reply, without thoughts and code fences and with what follows it peeled off (N41); null if nothing parses."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    pieces = F.regexp_extract_all(F.regexp_extract(c, r"(?s)([\[{].*)", 1), F.lit(r"(?s)([^\]}]*[\]}])"), F.lit(1))
    # The text up to each closing bracket, longest first.
    upto = lambda p: F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(p, F.lit(1), i), ""))
    # Spark's parser stops behind the first value, so the text must also be one item of an array and one value of an object.
    whole = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit(",0]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit(',"b":0}'))).isNotNull()
    return bound(pieces, lambda p: F.when(F.size(p) > 0, F.get(F.filter(upto(p), whole), 0)))


#: Characters from which a segment is a report's matter, not a name.
MATTER_LENGTH = 55


def is_link(c: Column, speech: tuple[str, ...] = ("قال", "يقول", "قلت", "فقال")) -> Column:
    """Whether a segment of a chain can be a name: neither as long as matter nor opened by a word of speech."""
    return (F.length(c) <= MATTER_LENGTH) & ~normalize(c).rlike(rf"^(?:{'|'.join(speech)})(?![\p{{L}}])")


def any_contains(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """Rows of which some column contains its part, without regard to case."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(p.lower())) for c, p in zip(columns, parts, strict=True)]))
