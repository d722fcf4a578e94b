"""Small tables with the odd cases that every operator has to handle."""

LONG = "longword " * 30_000

DOCS = [
    (1, "The same text here, twice.", "en", "b"),
    (2, "The same text here, twice.", "en", None),
    (3, None, None, "a"),
    (4, "", "en", "a"),
    (5, "   \t\n ", None, None),
    (6, LONG, "en", "a"),
    (7, "Ein anderer Text über Häuser und Straßen.", "de", "b"),
    (7, "Ein anderer Text über Häuser und Straßen.", "de", "b"),
    (None, "no id here", "en", "c"),
    (None, None, None, None),
    (9, "12345 !!! ???", "en", "c"),
    (10, "The same text here, twice.", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that operators use themselves, in other letter case too.
CLASH = "text_sha256 string, KEEP_ID long, kept boolean, h long, size long, pass int, position double, rejected int, score string, fp0 long"


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=DOCS):
    odd = ("x", 1, None, 2, 3, 4, 5.0, 6, "7", 8)
    return spark.createDataFrame([r + odd for r in rows], f"{SCHEMA}, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)
