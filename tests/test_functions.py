"""Golden cases of the scalar functions."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import geometry, pseudonyms, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text_forms(spark):
    got = one(
        spark,
        text.match_form(F.lit("  A \t b C ")),
        text.extension(F.lit("x.tar.PDF")),
        text.masked_name(F.lit("scan.png")),
        text.config_key(F.lit(" My Config! ")),
        text.display_name(F.lit("my_config-a")),
        text.label_suffix(F.lit(1)),
        text.label_suffix(F.lit(27)),
        text.mirror_case(F.lit("ABC"), F.lit("xyz")),
        text.mirror_case(F.lit("Abc"), F.lit("xYZ")),
        text.mime_type(F.lit("a.jpeg")),
        text.paragraphs(F.lit("a\n \n\nb")),
    )
    assert got == ("a b c", ".pdf", "scan_masked.pdf", "my_config_", "My Config A", "A", "27", "XYZ", "Xyz", "image/jpeg", "a\nb")


@pytest.mark.parametrize(("raw", "want"), [("a ```json\n[1]\n``` b", "[1]"), ("```\n[2]\n```", "[2]"), (" [3] ", "[3]"), ("```json\n[4]", "[4]")])
def test_fences(spark, raw, want):
    assert one(spark, text.without_fence(F.lit(raw))) == (want,)


def test_page_class(spark):
    assert one(spark, text.page_class(F.lit("x" * 50)), text.page_class(F.lit(" " * 60)), text.page_class(F.lit(None).cast("string"))) == ("digital_pdf", "scanned_pdf", "scanned_pdf")


def boxes(*rows):
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def test_lines_are_measured_from_their_first_box(spark):
    merged = lambda *ys: one(spark, F.size(geometry.merge_lines(boxes(*[(0.1 + 0.02 * i, y, 0.01, 0.01) for i, y in enumerate(ys)]))))[0]
    assert merged(0.200, 0.208) == 1
    assert merged(0.200, 0.215) == 2
    assert merged(0.200, 0.208, 0.214) == 2
    row = boxes(*[(0.10 + 0.02 * i, 0.2, 0.01, 0.01) for i in range(5)])
    assert one(spark, F.round(geometry.merge_lines(row)[0][2], 6)) == (0.09,)


def test_box_union_and_polygon(spark):
    u, none, poly, short = one(spark, geometry.union(boxes((0.1, 0.1, 0.1, 0.1), (0.3, 0.2, 0.1, 0.1))), geometry.union(F.array().cast("array<array<double>>")), geometry.from_polygon(F.array(*[F.lit(float(v)) for v in (1, 1, 3, 1, 3, 2, 1, 2)])), geometry.from_polygon(F.array().cast("array<double>")))
    assert [round(v, 6) for v in u] == [0.1, 0.1, 0.3, 0.2]
    assert none is None and list(poly) == [1, 1, 2, 1] and list(short) == [0, 0, 0, 0]


def test_pixels_and_containment(spark):
    px, inside, area0 = one(spark, geometry.to_pixels(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.5), F.lit(0.6)), F.lit(100), F.lit(100)), geometry.contained_share(boxes((0.1, 0.1, 0.1, 0.1))[0], boxes((0.0, 0.0, 1.0, 1.0))[0]), geometry.contained_share(boxes((0.1, 0.1, 0.0, 0.1))[0], boxes((0.5, 0.5, 0.1, 0.1))[0]))
    assert tuple(px) == (0, 48, 52, 100) and round(inside, 6) == 1 and area0 == 1


@pytest.mark.parametrize("value", ["2123 45678 A 1", "123 456 789", "N1234567", "aB-9/x", ""])
def test_scramble_keeps_structure(spark, value):
    got = one(spark, pseudonyms.scramble("s", F.lit("k"), F.lit(value)))[0]
    kind = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    assert kind(got) == kind(value) and (got != value or value == "")


@pytest.mark.parametrize(("original", "shape"), [("15/03/1985", r"\d\d/\d\d/1985"), ("1985-03-15", r"1985-\d\d-\d\d"), ("Mar 5, 1990", r"[A-Z][a-z]{2} \d+, 1990"), ("5 March 1990", r"\d+ [A-Z][a-z]+ 1990"), ("12-25-99", r"\d\d-\d\d-99"), ("no date 1977", r"\d\d/\d\d/1977")])
def test_dates_keep_year_and_form(spark, original, shape):
    day = pseudonyms.date_in_year("s", F.lit("k"), F.lit(original))
    assert re.fullmatch(shape, one(spark, pseudonyms.like_date(day, F.lit(original)))[0])


def test_names_keep_title_suffix_and_count(spark):
    df = spark.createDataFrame([("Mr John Smith-Jones Jr",), ("ANNA",)], "o string")
    a, b = (r[0] for r in df.select(pseudonyms.structured_name("s", F.lit("k"), F.col("o"), F.lit("unknown"))).collect())
    assert re.fullmatch(r"Mr [A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+ Jr", a) and b.isupper()
