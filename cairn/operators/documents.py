"""Documents: registration by content, chunks with exact offsets, claims and the write contract."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .session import with_vocabulary

MIN_CHARS = 200
TARGET, OVERLAP = 2000, 200
MODEL_CAP = 0.79
# Predicates that a found quote is enough for.
PRESENCE = ("MENTIONS",)


def register(documents: DataFrame, tenant: str, text: str = "text") -> DataFrame:
    """One row per content: document_id from tenant and content; a second upload changes nothing."""
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = documents.select(F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(F.lit(tenant + ":"), content), 256), 1, 24)).alias("document_id"), content.alias("content_sha256"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"))
    return rows.dropDuplicates(["document_id"])


def cut_points(page: str) -> tuple[list[int], list[int], list[int]]:
    """Where a page may be cut: after the line feed that ends a blank line, after the white space behind a sentence, after any white space."""
    spaces = [m.end() for m in re.finditer(r"\s", page)]
    sentences = [k for k in spaces if k > 1 and page[k - 2] in ".!?;:"]
    lines = [k for k in spaces if page[k - 1] == "\n"]
    blanks = [b for a, b in zip(lines, lines[1:], strict=False) if not page[a:b].strip()]
    return blanks, sentences, spaces


def chunk_spans(page: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of a page's chunks: each begins at a visible character and ends at the last good cut point within ``target``.

    Paragraphs go before sentences and those before words; a cut must leave ``MIN_CHARS``, else the next kind is tried and at last the limit.
    """
    points, spans = cut_points(page), []
    visible = re.compile(r"\S")
    first = visible.search(page)
    while first:
        start, limit = first.start(), min(first.start() + target, len(page))
        last = [p[k - 1] for p in points if (k := bisect_right(p, limit))] if limit < len(page) else []
        stop = next((c for c in last if c - start >= MIN_CHARS), limit)
        spans.append((start, stop))
        back = stop - overlap if stop - overlap > start else stop
        first = visible.search(page, back) if stop < len(page) else None
    return spans


def chunks(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """A row per chunk: the page's columns, ordinal (in the page), start and end in the whole text, chunk_text, chunk_sha256.

    Each cut depends on the one before, so that the cuts of a page are found in a pandas UDF; text is cut natively.
    """
    if overlap > target * 0.5:
        raise ValueError("overlap is over half of the target")

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def cut(page: pd.Series) -> pd.Series:
        return page.map(lambda p: [{"s": a, "e": b} for a, b in chunk_spans(p or "", target, overlap)])

    rows = pages.select("*", F.posexplode(cut("page_text")).alias("ordinal", "c"))
    body = F.substring(F.col("page_text"), F.col("c.s") + 1, F.col("c.e") - F.col("c.s"))
    return rows.select("*", (F.col("char_start") + F.col("c.s")).alias("start"), (F.col("char_start") + F.col("c.e")).alias("end"), body.alias("chunk_text"), F.sha2(body, 256).alias("chunk_sha256")).drop("c", "page_text")


def misplaced(chunked: DataFrame, text: str = "text") -> DataFrame:
    """Chunks that are not what the whole text holds at their offsets: none, if offsets are right."""
    return chunked.where(F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("chunk_text"))


def review_state(cls: Column, strict: Column, predicate: Column | None = None, governing=()) -> Column:
    """Declared and deterministic rows sign themselves off; a stricter tenant keeps deterministic ones, and governing predicates of any class, for review."""
    own = (cls == "DECLARED") | ((cls == "EXTRACTED_DET") & ~strict)
    held = predicate.isin(*governing) if predicate is not None and governing else F.lit(False)
    return F.when(own & ~held, "AUTO_ASSERTED").otherwise("PENDING")


def contract(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows with ``violations``, in a fixed order; no violation is an accepted row. ``vocabulary``: predicate, domain, range, symmetric.

    The columns premises, method, raw_confidence, quote and premise_confidences are checked where they are there.
    """
    df = with_vocabulary(rows, vocabulary, how="left")
    s, o = F.substring_index("subject_id", ":", 1), F.substring_index("object_id", ":", 1)
    admits = lambda a, b: F.array_contains("domain", a) & F.array_contains("range", b)
    bad_id = lambda c: c.isNull() | c.rlike(r"\s") | ~c.rlike(r"^[a-z][a-z0-9_]*:.+")
    share = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    premises = F.coalesce(F.col("premises"), F.array().cast("array<string>")) if "premises" in rows.columns else F.array().cast("array<string>")
    det, blank = F.col("epistemic_class") == "EXTRACTED_DET", lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = [
        ("tenant", F.col("tenant_id").isNull()),
        ("locator", F.col("document_id").isNull() & (F.col("epistemic_class") != "DECLARED")),
        ("confidence", ~share("confidence")),
        ("subject", bad_id(F.col("subject_id"))),
        ("object", bad_id(F.col("object_id"))),
        ("predicate", F.col("domain").isNull()),
        ("kinds", F.col("domain").isNotNull() & ~(admits(s, o) | (F.col("symmetric") & admits(o, s)))),
        ("deterministic", det & ~F.col("predicate").isin(*PRESENCE)),
        ("premises", (F.col("epistemic_class") == "INFERRED") != (F.size(premises) > 0)),
    ]
    more = {
        "method": lambda: blank(F.col("method")),
        "raw_confidence": lambda: F.col("raw_confidence").isNotNull() & ~share("raw_confidence"),
        "quote": lambda: det & blank(F.col("quote")),
        "premise_confidences": lambda: (F.col("epistemic_class") == "INFERRED") & (F.col("confidence") > F.array_min("premise_confidences")),
    }
    checks += [(n, c()) for n, c in more.items() if n in rows.columns]
    return df.withColumn("violations", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda v: v.isNotNull())).drop("domain", "range", "symmetric")


def validated(claims: DataFrame, vocabulary: DataFrame, kinds, conclusions=()) -> DataFrame:
    """Claims (chunk_text, quote, subject, predicate_said, object, confidence) with canonical ends, quote offsets and ``drop_reason``.

    ``vocabulary``: predicate, label, symmetric, domain, range. The first failing check names the reason; null keeps the claim. A
    presence claim rests on its quote and is deterministic, any other is a model's reading (``epistemic_class``).
    """
    said = F.upper(F.regexp_replace(F.trim("predicate_said"), r"\s+", "_"))
    by_id = vocabulary.select(F.col("predicate").alias("said"), F.col("predicate").alias("p1"))
    by_label = vocabulary.select(F.upper(F.regexp_replace("label", r"\s+", "_")).alias("said"), F.col("predicate").alias("p2")).groupBy("said").agg(F.min("p2").alias("p2"))
    df = with_vocabulary(with_vocabulary(claims.withColumn("said", said), by_id, "said", "left"), by_label, "said", "left").withColumn("predicate", F.coalesce("p1", "p2")).drop("p1", "p2", "said")
    df = with_vocabulary(df, vocabulary.drop("label"), how="left").withColumn("at", T.locate(F.col("chunk_text"), F.col("quote")))
    df = df.withColumn("s", T.canonical(F.col("subject"), kinds)).withColumn("o", T.canonical(F.col("object"), kinds))
    first, second = T.ordered_ends(F.col("s"), F.col("o"), F.coalesce("symmetric", F.lit(False)))
    reason = F.coalesce(
        F.when(F.col("predicate").isNull(), "unknown predicate"),
        F.when(F.col("predicate").isin(*conclusions), "conclusion of a rule") if conclusions else F.lit(None).cast("string"),
        F.when(F.col("at").isNull(), "quote not found"),
        F.when(F.col("s").isNull() | F.col("o").isNull(), "unknown kind"),
        F.when(F.col("s") == F.col("o"), "self edge"),
    )
    return df.select(*[c for c in claims.columns if c not in ("subject", "object")], "predicate", first.alias("subject_id"), second.alias("object_id"), "at", F.when(F.col("predicate").isin(*PRESENCE), "EXTRACTED_DET").otherwise("EXTRACTED_MODEL").alias("epistemic_class"), F.least("confidence", F.lit(MODEL_CAP)).alias("capped"), reason.alias("drop_reason"))


def page_of(pages: Column, at: Column) -> Column:
    """The page (struct page, char_start, char_end) that holds an offset; the last one for offsets beyond all."""
    hit = F.filter(pages, lambda p: (p["char_start"] <= at) & (at < p["char_end"]))
    return F.coalesce(F.get(hit, 0)["page"], F.element_at(pages, -1)["page"])


def enrichment(proposals: DataFrame, columns: DataFrame, synonyms: int = 8, topics: int = 6) -> DataFrame:
    """Proposed catalog claims (node, column_name, kind, value, position) for known columns, capped by kind: PENDING at 0.8, with a shared id per description.

    A value that is proposed more than once stands at its first position.
    """
    from pyspark.sql import Window as W

    known = proposals.join(columns.select("node", "column_name"), ["node", "column_name"], "left_semi")
    n = F.row_number().over(W.partitionBy("node", "column_name", "kind").orderBy("position", "value"))
    kept = known.groupBy("node", "column_name", "kind", "value").agg(F.min("position").alias("position")).withColumn("n", n)
    kept = kept.where((F.col("kind") == "description") | (F.col("kind") == "synonym") & (F.col("n") <= synonyms) | (F.col("kind") == "topic") & (F.col("n") <= topics))
    target = F.when(F.col("kind") == "description", F.concat(F.lit("description:"), F.substring(F.sha2("value", 256), 1, 16))).otherwise(F.concat("kind", F.lit(":"), T.slug(F.col("value"))))
    return kept.select("node", "column_name", "kind", target.alias("object_id"), F.lit("PENDING").alias("review_state"), F.lit(0.8).alias("confidence"))
