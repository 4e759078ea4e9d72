r"""PII: personal data by pattern, and terms that give it away by co-occurrence. DataFrame functions only.

Base findings are the four kinds of ``KINDS``, leftmost and without overlaps per kind. The patterns below accept the same strings as the plain
ones, with possessive repeats and starts at the beginning of a run, so that long texts take linear time.

Protected entities are the found values and, of e-mails and IPs, their domains and networks. The corpus tells how strongly a term
reveals one. Events are documents: n_t of them hold the term, n_c the entity, n_ct the term within ``CONTEXT`` characters of the entity, of N in all;
those in which the surroundings of the entity are the same count once in all four, so that copies are one piece of evidence.
The ratio of the pointwise mutual information to the information content ln(N / n_c) of the entity is 1 + ln P(c | t) / ln(N / n_c). P(c | t) is the shrunken
estimate n_ct / (n_t + PRIOR / n_ct^2): one surrounding is worth little in a small corpus, more in a large one, where a word that is rare
for its size gives the document away. No entity is too rare to be rated. A term at or above ``REMOVE`` is removed from the texts that hold the
entity beside it, one at or above ``GENERALISE`` is replaced by its class. Counts run over all documents.

Defined results: a null text is an empty one without spans; a null ``doc_id`` stays null; repeated rows stay rows and count as documents;
an empty table gives no rows; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from .common import has, text_of, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match; looking for them first is cheap.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CONTEXT = 150
PRIOR = 4.0  # documents with the term and without the entity that a single surrounding is weighed against
GENERALISE, REMOVE = 0.75, 0.9
TERM = r"\p{L}{3,}"
_SPAN = "array<struct<start:int, ord:int, end:int, kind:string, value:string>>"


def spans_of(text: Column, pattern: Column, found: Column, ord_: int, kind: str) -> Column:
    """The matches with their positions: the pieces between them, and they, are laid end to end."""
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, add)["out"]).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _part_ok(p: Column) -> Column:
    value = F.ltrim(p, F.lit("0"))
    return (F.length(value) <= 3) & (F.coalesce(F.when(F.length(value) <= 3, value.try_cast("int")), F.lit(0)) <= 255)


def _luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(span["value"], r"\."), _part_ok)
    number = _digits(span["value"])
    if kind == "card":
        return F.when(F.length(number).between(14, 19), _luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(10, 15)
    return F.lit(True)


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``base``: the spans of personal data by start, then kind."""
    has(docs, "doc_id", "text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(F.contains("text", F.lit(NEEDS[k])), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"hits_{k}") for k in KINDS])
    spans = [F.filter(spans_of(F.col("text"), F.lit(PATTERNS[k]), F.col(f"hits_{k}"), i, k), partial(_valid, k)) for i, k in enumerate(KINDS)]
    some = sum((F.size(f"hits_{k}") for k in KINDS), F.lit(0)) > 0
    return df.select("doc_id", "text", F.when(some, F.array_sort(F.concat(*spans))).otherwise(F.array().cast(_SPAN)).alias("base"))


def _entities(s: Column) -> Column:
    """The value, and what it belongs to: an e-mail's domain, an IP's network of 256."""
    value = F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
    group = F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1))).when(s["kind"] == "ip", F.concat(F.lit("net:"), F.substring_index(value, ".", 3)))
    return F.filter(F.array(F.concat(s["kind"], F.lit(":"), value), group), lambda e: e.isNotNull())


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _beside(text: Column, s: Column) -> Column:
    """The terms within ``CONTEXT`` characters of a span, without cut words and without other findings."""
    first = F.greatest(s["start"] - CONTEXT, F.lit(0))
    left = F.substring(text, first + 1, s["start"] - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    around = F.concat(F.regexp_replace(left, r"\S*$", ""), F.lit(" "), F.regexp_replace(right, r"^\S*", ""))
    return _terms(F.regexp_replace(around, PATTERNS["email"], " "))


def base_findings(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, contexts (entities and the terms beside them) and, where there are any, the text: written once and read by every later step."""
    contexts = F.transform("base", lambda s: F.struct(_entities(s).alias("entities"), _beside(F.col("text"), s).alias("terms")))
    return written(with_base(docs).select("doc_id", F.md5("text").alias("text_key"), "base", contexts.alias("contexts"), F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-base")


def disclosing(docs: DataFrame, narrow: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """The (entity, term, ratio, action) rows of terms that disclose, and the (text_key, entity, term) rows they may be found in."""
    # copies of a text collapse to one row with their number, before anything else is grouped
    seen = narrow.where(F.size("contexts") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("contexts").alias("contexts"))
    around = F.xxhash64(F.array_sort("x.terms"))
    held = seen.select("text_key", "copies", F.explode("contexts").alias("x")).select("text_key", "copies", F.explode("x.entities").alias("entity"), "x.terms", around.alias("around"))
    per_text = held.groupBy("text_key", "entity").agg(F.first("copies").alias("copies"), F.min("around").alias("around"))
    entities = per_text.groupBy("entity", "around").agg(F.sum("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("docs_c"), F.count("*").alias("n_c"))
    told = held.select("text_key", "copies", "entity", "around", F.explode("terms").alias("term"))
    places = written(told.groupBy("text_key", "entity", "term").agg(F.first("copies").alias("copies"), F.min("around").alias("around")), "pii-places")
    pairs = places.groupBy("entity", "term", "around").agg(F.sum("copies").alias("copies")).groupBy("entity", "term").agg(F.sum("copies").alias("docs_ct"), F.count("*").alias("n_ct"))
    terms = docs.select(F.explode(_terms(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("docs_t"))
    total = docs.agg(F.count("*").alias("docs"))
    rated = pairs.join(entities, "entity").join(terms, "term").join(F.broadcast(total))  # one row
    n_t = F.col("docs_t") - F.col("docs_ct") + F.col("n_ct")
    rated = rated.select("entity", "term", "n_c", "n_ct", n_t.alias("n_t"), (F.col("docs") - F.col("docs_c") + F.col("n_c")).alias("n")).where("n_c < n")
    share = F.col("n_ct") / (F.col("n_t") + prior / (F.col("n_ct") * F.col("n_ct")))
    rated = rated.withColumn("ratio", 1 + F.ln(share) / F.ln(F.col("n") / F.col("n_c"))).where(F.col("ratio") >= generalise)
    rules = rated.select("entity", "term", "ratio", F.when(F.col("ratio") >= remove, "removed").otherwise("generalised").alias("action"))
    return written(rules, "pii-rules"), places


def term_spans(narrow: DataFrame, rules: DataFrame, places: DataFrame) -> DataFrame:
    """text_key, more: the spans of disclosing terms in each text that holds one beside its entity."""
    hit = places.join(rules, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("action").alias("action"))  # removed wins
    lists = hit.groupBy("text_key").agg(*[F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("term")))).alias(a) for a in ("generalised", "removed")])
    texts = narrow.where("text IS NOT NULL").groupBy("text_key").agg(F.first("text").alias("text")).join(lists, "text_key")
    out = []
    for i, action in enumerate(("generalised", "removed")):
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(action, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        found = F.when(F.size(action) > 0, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
        texts = texts.withColumn(f"hits_{action}", found)
        out.append(spans_of(F.col("text"), pattern, F.col(f"hits_{action}"), len(KINDS) + i, action))
    return texts.select("text_key", F.concat(*out).alias("more"))


def findings(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_key, base and spans (base ones and disclosing terms beside them, by start)."""
    narrow = base_findings(docs)
    # from a table: AQE deals the copies of one text to several tasks only if both sides of the join are plain shuffles
    more = written(term_spans(narrow, *disclosing(docs, narrow, prior, generalise, remove)), "pii-spans")
    clear = F.filter(F.col("more"), lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return narrow.join(more, "text_key", "left").select("doc_id", "text_key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def how_many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: a finding by its kind, a generalised term by a class, a removed one by nothing. Overlapping spans: the first stays."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        shown = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", F.when(s["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, shown).alias("out")))

    return F.aggregate(spans, zero, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """doc_id and the text without personal data and disclosing terms."""
    spans = findings(docs, **how).groupBy("text_key").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.md5(text_of()).alias("text_key"))
    return rows.join(spans, "text_key").select("doc_id", replaced(F.col("text"), F.col("spans")).alias("text"))
