"""Small inputs of the training-data tests: the smallest documents, and rows with nulls, ties, blanks and long texts."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
CLASH = ["id", "n", "h1", "node", "w", "row", "rank", "bin", "pid", "bucket", "pii_text", "pii_base", "mix_p", "mix_weight", "html"]
LONG = " ".join(f"w{i * i % 9973} mail{i}@site.example.org" if i % 500 == 0 else f"w{i * i % 9973}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
EDGES = [
    (-1, None, None, None, None),
    (-2, "", "en", "web", 0),
    (-3, " \n\t ", "en", None, 4),
    (-4, "12 34 !!", None, "web", 8),
    (-5, BASE, "en", "web", 10),
    (-6, BASE, "en", "web", 10),
    (-7, BASE.upper() + " SEVENTEEN", "en", "books", 10),
    (-8, "a b c", "en", "web", 5),
    (-9, "A  b\tc", "en", "web", 6),
    (-10, LONG, "en", "web", len(LONG)),
    (-11, "write to ä.b@c.de.fg, x@y, a@b.c@d.e; call +49 (0) 151 23456789 or +1 2; 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8", "de", "web", 1),
    (-12, "4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123 0000000000000 é 😀 5500005555555559", "fr", "web", 1),
    (-13, "CC BY and cc-by; GENERAL\nPUBLIC license. This work is licensed under the GNU General Public License\ncopyright: all rights reserved", "en", "web", 1),
    (-14, "released under the MIT license\nthis work is in the public domain", "en", "web", 1),
    (None, BASE, "en", "web", 10),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def clashing(df):
    """With further columns whose names the operators use themselves."""
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASH])


def all_rows(spark):
    """The documents and the edge rows, each of those twice over where the id is null."""
    return clashing(documents(spark).unionByName(edges(spark)))
