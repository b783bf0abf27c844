"""Books by lines, verdicts in full, versions, and the benchmark."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import books, extract
from rivulet.sources import readers


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("كوفي ثقة عين صحيح الحديث قاله النجاشي", ("thiqah", "ثقة عين صحيح الحديث", ["النجاشي"])),
        ("ثقة فطحي، وثقه الشيخ وقاله الكشي", ("thiqah", "ثقة", ["الشيخ الطوسي", "الكشي"])),
        ("رجل - ثقة - قال الشيخ الحر", ("thiqah", "ثقة", ["الشيخ الحر", "الشيخ الطوسي"])),
        ("متحد مع زيد بن علي الثقة", ("thiqah", "ثقة (متحد)", [])),
        ("لم تثبت وثاقته وهو ثقة", ("unspecified", None, [])),
        ("ضعيف في نفسه", ("daif", "ضعيف في نفسه", [])),
        ("في طريق الصدوق اليه ضعيف ", ("unspecified", None, [])),
        ("جليل القدر", ("mamduh", "جليل القدر", [])),
        ("حاله - حسن .", ("hasan", "حسن", [])),
        ("مجهول", ("majhul", "مجهول", [])),
        ("من مشايخ النجاشي فهو ثقة", ("thiqah", "ثقة", [])),
        (None, None),
    ],
)
def test_verdicts_in_full(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(books.verdict_fields(F.col("t")).alias("v"), extract.verdict(F.col("t")).alias("s")).first()
    assert (row.v and tuple(row.v)) == want and (row.v.status if row.v else None) == row.s


@pytest.mark.parametrize("rows", [3, 10_000])
def test_summary_and_ocr_entries(spark, rows):
    text = "مقدمة 5 - 6 - 7 - لا\n## Page 1\n\n1 - 2 - ٣ - آدم أبو الحسين : روى\nبقية\n> note\nتتمة\n9 - 10 - 11 - زيد : ثقة\n1 - 2 - ٣ - آدم : أخرى"
    got = books.summary_entries(lines(spark, text), F.col("line").rlike("^1 - 2"), rows=rows).orderBy("najaf").collect()
    assert [tuple(r)[1:] for r in got] == [("1", "2", "٣", "آدم", "1 - 2 - ٣ - آدم : أخرى"), ("9", "10", "11", "زيد", "9 - 10 - 11 - زيد : ثقة")]
    pages = "صفحة\n١٢ - زيد بن علي : ثقة\n\n  من أصحابنا \n١٣ – عمرو\n"
    got = books.ocr_entries(lines(spark, pages), rows=rows).orderBy("number").collect()
    assert [tuple(r)[1:] for r in got] == [(12, "زيد بن علي من أصحابنا", "ثقة", "١٢ - زيد بن علي : ثقة من أصحابنا"), (13, "عمرو", "", "١٣ – عمرو")]


@pytest.mark.parametrize("rows", [2, 10_000])
def test_section_report(spark, rows):
    text = "[ 1] T5 before\n=== NO CANDIDATES (2)\n[ 2] T5 زيد بن علي\n[ 3] TNone عمرو\njunk\n=== AMBIGUOUS\n[ 4] T6 بكر (best match: x)\n[ 5] T6 بكر"
    got = sorted(map(tuple, books.unresolved_report(lines(spark, text), rows=rows).collect()), key=lambda r: r[1])
    assert got == [("no_match", 2, 5, "زيد بن علي"), ("no_match", 3, None, "عمرو"), ("ambiguous", 4, 6, "بكر")]


def test_headers_of_books(spark):
    text = "12 - زيد بن علي الكوفي :\n12 - زَيد بن علي:\n7 - قصير :\n130 - أحمد بن محمد:\nكلام : لا\n140 - احمد بن محمد :"
    index = books.header_index(lines(spark, text))
    assert sorted(map(tuple, index.collect())) == [(12, "زيد بن علي الكوفي", "زيد بن علي"), (12, "زيد بن علي الكوفي", "زيد بن علي الكوفي"), (130, "أحمد بن محمد", "احمد بن محمد"), (140, "احمد بن محمد", "احمد بن محمد")]
    names = spark.createDataFrame([(1, "أحمد بن محمد"), (2, "زيد الكوفي"), (3, "زيد"), (4, "")], "query_id int, name string")
    assert sorted(map(tuple, books.find_in_books(names, index).collect())) == [(1, 130, True), (1, 140, True), (2, 12, False)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(ValueError, match="no version"):
        readers.read_version(spark, path)
    for i in (1, 2):
        readers.store_version(spark.range(i), path, i)
    (tmp_path / "v" / "version=000003").mkdir()  # a write that failed
    assert readers.versions(spark, path) == [1, 2] and readers.read_version(spark, path).count() == 2 and readers.read_version(spark, path, 1).count() == 1
    (tmp_path / "v" / "version=000003").rmdir()
    readers.restore(spark, path, 1)
    assert readers.versions(spark, path) == [1, 2, 3] and readers.read_version(spark, path).count() == 1


def test_uplift(spark):
    df = spark.createDataFrame([("thiqah", ["صفوان"]), ("majhul", ["صفوان", "زيد"]), (None, ["صفوان"]), ("daif", ["زيد"]), ("daif", None)], "status string, students array<string>")
    assert tuple(books.uplift(df, ["صفوان"]).first()) == (3, 2)
