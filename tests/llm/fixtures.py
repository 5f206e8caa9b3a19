"""Small tables with the awkward cases every operator must take."""

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 2000
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("word60 ", "other "), None, None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "fr", None),
    (None, "the cat sat on the mat", "en", "a"),
    (None, None, None, None),
    (7, LONG, "en", "c"),
    (8, "Ünï çödé ñ", "de", "c"),
    (9, "one", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that clash with names the operators use.
CLASH = "n int, size int, sig int, node int, _items string, Line string"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", "y") for r in rows], f"{SCHEMA}, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASH}")
