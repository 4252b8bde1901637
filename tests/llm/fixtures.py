"""Small tables with the cases every operator has to define."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use inside.
CLASHES = "size target copies ticket rank digest kept tokens path rep node root n key score level low high row".split()


def documents(spark, texts, langs=None, sources=None, clashes=False):
    rows = [
        (i, t, langs[i] if langs else "en", sources[i] if sources else "src0", len(t or "")) for i, t in enumerate(texts)
    ]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    if clashes:
        frame = frame.selectExpr("*", *[f"'other' AS `{c}`" for c in CLASHES])
    return frame


def odd_rows(spark):
    """Null and empty texts, null ids, nulls everywhere, repeated rows, white space only."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, words, "en", "a", 9),
        (5, words.replace(" ", "  "), "fr", None, 9), (6, "one", None, "b", 3), (6, "one", None, "b", 3),
        (None, words, "de", "b", 1), (7, "12 34 !?", "en", "b", 1), (8, words + " more", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", *[f"'other' AS `{c}`" for c in CLASHES])


def no_rows(spark):
    return spark.createDataFrame([], DOCUMENTS)
