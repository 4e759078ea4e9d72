r"""Secret scans: patterns find candidates, a random forest tells secrets from look-alikes. DataFrame functions only.

Candidates are runs of at least ``LEAST`` characters that keys and tokens are written with, and any value of ``SHORT`` visible characters or more
that is assigned to a name like token or password. The forest sees a candidate's length, its shares of character classes, changes between classes, how much of
it the corpus' own words cover (four-letter pieces of the words with a share of ``COMMON`` or more of all words), the path and address marks in and
beside it, and the words around it: how many there are, how far the corpus knows them, and how much of the surroundings are marks.

It is trained on labelled findings. Where none are given they come from the corpus by what stands directly beside a candidate: a value assigned in quotes to
a name is a secret, one between two words of prose is none, and most are left open. None of the forest's features looks there: they
are the value itself and words farther away, so that its verdict is a second opinion and may differ from the label.
At most ``MAX_LABELLED`` findings of each kind, the first by a hash, are used.

Defined results: a null or empty text has no candidates; a null ``doc_id`` stays null; repeated rows give repeated findings; values and texts of any
length count whole; an empty table gives no rows; other columns are ignored. Without findings of both kinds no forest can be fitted: the labels
stand, as probabilities 1 and 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_rows, has, text_of, written
from .pii import spans_of

LEAST, SHORT = 16, 6
CANDIDATE = rf"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: Names that secrets are assigned to.
NAMES = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api_?key|access_?key|auth|credential|private_?key|bearer)"
#: A text without any of these has no such name; looking for them first is cheap.
_NEEDS = ("token", "secret", "passw", "pwd", "key", "auth", "credential", "bearer")
ASSIGNED = rf"(?<=(?i:{NAMES})[\"'`\]]{{0,2}}\s{{0,3}}[=:]\s{{0,3}}[\"'`]?)(?<![^\s=:\"'`])[^\s\"'`=:][^\s\"'`]{{{SHORT - 1},}}+"
AROUND = 60
BESIDE = 16  # characters next to a candidate that only the labels look at
COMMON = 1e-6
SALTS = 16
MAX_LABELLED = 4000
TREES, DEPTH = 24, 6
THRESHOLD = 0.5
FEATURES = ("length", "distinct", "digits", "uppers", "vowels", "changes", "hex", "covered", "slashes", "marks", "dots", "path", "words_around", "known_around", "marks_around")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, value, before, after; one row per candidate. A run inside an assigned value is that value's."""
    has(docs, "doc_id", "text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    none = F.array().cast("array<string>")
    low = F.lower("text")
    may = reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in _NEEDS])
    df = df.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("told", F.when(may, F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(0))).otherwise(none))
    df = df.where((F.size("hits") > 0) | (F.size("told") > 0))
    df = df.withColumn("runs", spans_of(F.col("text"), F.lit(CANDIDATE), F.col("hits"), 0, "candidate")).withColumn("values", spans_of(F.col("text"), F.lit(ASSIGNED), F.col("told"), 0, "candidate"))
    apart = F.filter("runs", lambda r: ~F.exists("values", lambda v: (v["start"] < r["end"]) & (r["start"] < v["end"])))
    df = df.withColumn("s", F.explode(F.concat(apart, "values")))
    first = F.greatest(F.col("s.start") - AROUND, F.lit(0))
    return df.select("doc_id", "s.start", "s.end", "s.value", F.substring("text", first + 1, F.col("s.start") - first).alias("before"), F.substring("text", F.col("s.end") + 1, F.lit(AROUND)).alias("after"))


def dictionary_pieces(docs: DataFrame) -> DataFrame:
    """The four-letter pieces of the corpus' common words: at most 26^4, whatever the corpus."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(words.where(F.length("word") < LEAST), "secret-words")
    total = words.agg(F.sum("n").alias("total"))
    common = words.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2.0), COMMON * F.col("total")))  # one row
    return common.select(F.explode(_pieces("word")).alias("piece")).distinct()


def _pieces(column) -> Column:
    return F.regexp_extract_all(column, F.lit("(?=([a-z]{4}))"), F.lit(1))


def _share(value: Column, characters: str) -> Column:
    return F.coalesce(1 - F.length(F.regexp_replace(value, f"[{characters}]", "")) / F.nullif(F.length(value), F.lit(0)), F.lit(0.0))


def _farther(before: Column, after: Column) -> Column:
    """The surroundings without what is next to the candidate, which the labels go by."""
    left = F.substring(before, F.lit(1), F.greatest(F.length(before) - BESIDE, F.lit(0)))
    return F.concat(left, F.lit(" "), F.substring(after, F.lit(BESIDE + 1), F.lit(AROUND)))


def featured(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """The candidates (value, before, after and any other columns) with the columns of ``FEATURES``."""
    rows = found.withColumn("far", _farther(F.col("before"), F.col("after"))).withColumn("salt", F.pmod(F.xxhash64("before", "after"), F.lit(SALTS)))
    known = F.broadcast(pieces.withColumn("hit", F.lit(1.0)))  # at most 26^4 rows

    def cover(what: str, out: str) -> DataFrame:
        """The share of the pieces of each different string that the dictionary has; one string of many rows is dealt to ``SALTS`` places."""
        each = rows.select(what, "salt").distinct().select(what, "salt", F.explode_outer(_pieces(F.lower(what))).alias("piece"))
        return each.join(known, "piece", "left").groupBy(what, "salt").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias(out))

    rows = rows.join(cover("value", "covered"), ["value", "salt"]).join(cover("far", "known_around"), ["far", "salt"])
    v, far = F.col("value"), F.col("far")
    changes = F.length(F.regexp_replace(v, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", "¦")) - F.length(v)
    as_number = lambda c: c.cast("double")
    values = {
        "length": as_number(F.length(v)),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "digits": _share(v, "0-9"),
        "uppers": _share(v, "A-Z"),
        "vowels": _share(v, "aeiouAEIOU"),
        "changes": changes / F.length(v),
        "hex": as_number(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "slashes": _share(v, "/"),
        "marks": _share(v, "_=+-"),
        "dots": _share(v, "."),
        "path": as_number(F.col("before").rlike(r"(?:://\S*|[\\/.@])$") | F.col("after").rlike(r"^[\\/.@]\w")),
        "words_around": as_number(F.size(F.regexp_extract_all(far, F.lit(r"\p{L}{2,}"), F.lit(0)))),
        "marks_around": _share(far, r"^\p{L}\p{N}\s"),
    }
    return rows.withColumns(values)


def labelled_by_context(found: DataFrame) -> DataFrame:
    """``label`` by what is next to a candidate: 1 where it is assigned in quotes to a name, 0 between two words of prose, else null."""
    secret = F.col("before").rlike(rf"(?i){NAMES}[\"'`\]]{{0,2}}\s*[=:]\s*[\"'`]$") & F.col("after").rlike("^[\"'`]")
    plain = F.col("before").rlike(r"(?:^|\s)\p{L}+[,.;!?]?\s$") & F.col("after").rlike(r"^[,.;!?]?\s\p{L}") & ~F.col("before").rlike(rf"(?i){NAMES}\W*$")
    return found.withColumn("label", F.when(secret, 1.0).when(plain, 0.0))


def findings(docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, value, probability, is_secret of every candidate. ``labelled``: value, before, after and label (0 or 1)."""
    pieces = written(dictionary_pieces(docs), "secret-pieces")
    found = written(labelled_by_context(candidates(docs)), "secret-candidates")
    known = found.where("label IS NOT NULL")
    if labelled is not None:
        known = labelled.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("value", "before", "after")], F.col("label").cast("double").alias("label")).where("value <> '' AND label IS NOT NULL")
    order = F.xxhash64("value", "before", "after"), "value", "before", "after"
    sample = reduce(DataFrame.unionByName, [bounded_rows(known.where(F.col("label") == y), max_labelled, *order) for y in (0.0, 1.0)]).select("value", "before", "after", "label")
    sample = written(featured(sample, pieces).select("label", *FEATURES), "secret-sample")
    keep = ["doc_id", "start", "end", "value"]
    if sample.select("label").distinct().count() < 2:
        rated = found.select(*keep, F.coalesce("label", F.lit(0.0)).alias("probability"))
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features").fit(assemble.transform(sample))
        rated = forest.transform(assemble.transform(featured(found, pieces))).select(*keep, vector_to_array("probability")[1].alias("probability"))
    return rated.withColumn("is_secret", F.col("probability") >= threshold)
