"""Small tables that every corpus operator must take without a crash."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box quietly near an old stone bridge at dawn "


def odd_docs(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (None, "a row without an id, mail me@example.com", "en", "a", 40),
        (4, "one", "en", "a", 3),
        (5, PROSE * 3000, "en", "a", 0),
        (6, PROSE, "en", "b", 0),
        (6, PROSE, "en", "b", 0),
        (7, PROSE, None, "b", 0),
        (8, "\U0001f600 émoji <|endoftext|> Ünïcödé space\x1cfs  two  spaces \r\n tail ", "de", "c", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns with names that operators might use inside."""
    from pyspark.sql import functions as F

    for c in ("fp", "key", "keys", "part", "seq", "n", "word", "term", "root", "node", "component_id", "start", "n_tokens", "rate"):
        df = df.withColumn(c, F.lit("x"))
    return df
