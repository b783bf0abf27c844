import pytest
from pyspark.sql import functions as F

from rivulet.functions import text as tx


def one(spark, column, *values, schema="a string"):
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("أنس بن إسرائيل وآدم", "انس بن اسرائيل وادم"),
        ("ٱبن", "ابن"),
        ("سَهْلٌ", "سهل"),
        ("زيـــاد", "زياد"),
        ("رسول الل ه الاكرم", "رسول الله الاكرم"),
        ("سكن نيسابور زمنا", "سكن نيشابور زمنا"),
        ("ذو الرحمان", "ذو الرحمن"),
        ("داود \t بن\n سرحان", "داود بن سرحان"),
        ("البنّاء وشفاء", "البنا وشفا"),
        ("بناءون", "بناءون"),
        ("حَرِيزُ بْنُ أَيُّوب", "حريز بن ايوب"),
        (None, ""),
        ("   ", ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize(F.col("a")), raw) == want


def test_by_names_and_headings(spark):
    assert one(spark, tx.by_name(F.col("a")), "حدثني أبو بكرة") == "ابو بكره" and one(spark, tx.by_name(F.col("a")), "عنبسة") == "عنبسه"
    assert one(spark, tx.is_heading(F.col("a")), "باب: الباء") is True and one(spark, tx.is_heading(F.col("a")), "بكر بن صالح") is False


def test_links_and_matter(spark):
    assert [one(spark, tx.is_link(F.col("a")), x) for x in ("بكر", "قال بكر", "قالون", "ب" * 56)] == [True, False, True, False]


def test_digits(spark):
    row = spark.createDataFrame([("٥٠٩",), ("12a",), (None,), ("ج ۲٤",)], "a string").select(tx.loose_int(F.col("a")).alias("l"), tx.strict_int(F.col("a")).alias("s")).collect()
    assert [(r.l, r.s) for r in row] == [(509, 509), (12, None), (None, None), (24, None)]
    assert one(spark, tx.to_arabic_digits(F.col("a")), 509, schema="a int") == "٥٠٩" and one(spark, tx.to_arabic_digits(F.col("a")), -3, schema="a int") == "٠"


def test_names(spark):
    assert one(spark, tx.without_article(F.col("a")), "الحسين بن الاب") == "حسين بن الاب"
    assert one(spark, tx.strip_honorific(F.col("a")), "أبي عبد الله (ع)") == "ابي عبد الله"
    assert one(spark, tx.longest_title(F.col("a"), {"عبد الله": 1, "ابي عبد الله": 5}), "ابي عبد الله الصادق") == 5
    assert one(spark, tx.given_name(F.col("a")), "عبد الله بن سنان") == "عبد الله"
    assert one(spark, tx.name_score(F.col("a"), F.col("b")), "زرارة بن اعين", "زرارة بن اعين الشيباني", schema="a string, b string") == 1.0
    assert one(spark, tx.in_names(F.col("a"), F.array(F.lit("الحسن بن محبوب السراد"))), "محبوب السراد") is True
    forms = one(spark, tx.person_forms(*[F.col(c) for c in "abcdef"]), "محمد بن مسلم الثقفي", "ابو جعفر", "الطحان", "الثقفي", "مسلم", ["ابن مسلم الثقفي"], schema="a string, b string, c string, d string, e string, f array<string>")
    assert {"محمد بن مسلم الثقفي", "محمد بن مسلم", "ابو جعفر", "ابي جعفر", "ابن مسلم", "ابو جعفر الثقفي", "ابي جعفر الطحان"} <= set(forms) and len(forms) == len(set(forms))
    assert one(spark, tx.person_forms(*[F.col(c) for c in "abcdef"]), *[None] * 6, schema="a string, b string, c string, d string, e string, f array<string>") == []


def test_replies(spark):
    assert one(spark, tx.json_of_reply(F.col("a")), '<think>no</think>```json\n[{"x": 1}]\n``` done') == '[{"x": 1}]'
    assert one(spark, tx.json_of_reply(F.col("a")), "nothing") is None
    assert one(spark, tx.main_text(F.lit("short"), F.col("a"), ("قال:",)), "عن زرارة قال: هذا نص طويل بما يكفي لان يكون متنا للحديث ") == "هذا نص طويل بما يكفي لان يكون متنا للحديث"
