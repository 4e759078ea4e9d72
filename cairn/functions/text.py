"""Scalar functions as column expressions: ids, labels, terms, quotes, cosines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no meaning in a question.
NOISE = [
    "a", "an", "and", "any", "are", "our", "all", "about", "by", "did", "do", "does", "for", "from", "give", "has", "have", "how", "in",
    "involve", "involved", "involves", "is", "it", "list", "many", "me", "much", "of", "on", "or", "show", "that", "their", "the", "to",
    "us", "was", "we", "what", "when", "where", "which", "who", "whom", "with", "you",
]
# Time words and the grain they ask for.
GRAIN_WORDS = {"daily": "day", "day": "day", "weekly": "week", "week": "week", "monthly": "month", "month": "month", "quarterly": "quarter", "quarter": "quarter", "yearly": "year", "annual": "year", "annually": "year", "year": "year"}
COMPANY_FORMS = ("ltd", "limited", "gmbh", "ag")


def content_id(*parts: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, length)


def kind(entity: Column) -> Column:
    return F.lower(F.substring_index(entity, ":", 1))


def local(entity: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.substr(entity, F.instr(entity, ":") + 1)


def label(entity: Column) -> Column:
    return F.translate(local(entity), "-_", "  ")


def canonical(entity: Column, kinds, external=()) -> Column:
    """``kind:slug`` in lower case; ids of external kinds as they are; null for unknown kinds and empty slugs."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(local(entity)), r"(?U)[\W_]+", "-"), "^-+|-+$", "")
    made = F.when(F.length(slug) > 0, F.concat(kind(entity), F.lit(":"), slug))
    return F.when(kind(entity).isin(*external), entity).when(kind(entity).isin(*kinds), made) if external else F.when(kind(entity).isin(*kinds), made)


def blocking_keys(entity: Column, kinds, external=(), forms=COMPANY_FORMS) -> Column:
    """At most two keys under which spellings of an id meet: ``kind:`` and its canonical name without dashes, and the same without
    company forms at the name's end; the last word stays. None for external and unknown kinds."""

    def of_words(head: Column, words: Column) -> Column:
        name = lambda n: F.concat(head, F.lit(":"), F.array_join(F.slice(words, F.lit(1), n), ""))
        # the shortest beginning after which only company forms follow
        bare = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: F.forall(F.slice(words, k + 1, F.size(words)), lambda w: w.isin(*forms)))
        return F.array_sort(F.array_distinct(F.array(name(F.size(words)), name(bare[0]))))

    # a transform over one element names a value that is used several times: it is computed once
    words = lambda id_: F.filter(F.split(local(id_), "-"), lambda w: F.length(w) > 0)
    made = F.transform(F.array(canonical(entity, kinds)), lambda id_: F.transform(F.array(F.struct(kind(id_).alias("head"), words(id_).alias("words"))), lambda x: of_words(x["head"], x["words"]))[0])[0]
    known = kind(entity).isin(*kinds) & ~kind(entity).isin(*external) if external else kind(entity).isin(*kinds)
    named = F.length(F.regexp_replace(local(entity), r"(?U)[\W_]+", "")) > 0
    return F.when(known & named, made).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Lower-cased words without noise and single characters, in order, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9'&.-]*)"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*NOISE) & (F.length(t) > 1))


def singular(words: Column) -> Column:
    """The words, and those of over three letters without their final s."""
    return F.array_union(words, F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.regexp_replace(w, "s+$", "")))


def slug(text: Column, words: int = 40) -> Column:
    cut = F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")
    return F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shortened(text: Column, words: int = 40) -> Column:
    """The first words, single-spaced; an ellipsis tells that there were more."""
    all_ = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)
    return F.concat(F.array_join(F.slice(all_, 1, words), " "), F.when(F.size(all_) > words, "…").otherwise(""))


def deduped(values: Column, most: int) -> Column:
    """The first values with different slugs, trimmed, at most ``most``; values without a slug are left out."""
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, v: Column) -> Column:
        s = slug(v, 1_000_000)
        new = (s != "") & ~F.array_contains(acc["seen"], s)
        return F.when(new, F.struct(F.concat(acc["seen"], F.array(s)).alias("seen"), F.concat(acc["out"], F.array(F.trim(v))).alias("out"))).otherwise(acc)

    return F.slice(F.aggregate(F.filter(values, lambda v: v.isNotNull()), zero, add)["out"], 1, most)


def node_parts(node: Column) -> Column:
    """Type, source, table and column of a catalog node id; the source may hold colons. Null where the name has not exactly the parts of its type."""
    head = F.substring_index(node, ":", 1)
    rest = local(node)
    source = F.when(head == "source", rest).otherwise(F.regexp_extract(rest, "^(.*):[^:]*$", 1))
    dots = F.split(F.substring_index(rest, ":", -1), r"\.")
    fits = (head == "source") & (F.length(rest) > 0) & F.contains(node, F.lit(":")) | F.contains(rest, F.lit(":")) & ((head == "table") & (F.size(dots) == 2) | (head == "column") & (F.size(dots) == 3))
    parts = F.struct(head.alias("type"), source.alias("source"), F.when(head != "source", F.concat_ws(".", dots[0], F.get(dots, 1))).alias("table"), F.when(head == "column", F.get(dots, 2)).alias("column"))
    return F.when(fits, parts)


def both_forms(entity: Column) -> Column:
    return F.array_distinct(F.array(entity, local(entity)))


def locate(text: Column, quote: Column) -> Column:
    """Start (from 0) and end of a quote, found as it is, else with any white space between its words; null if absent or blank."""
    exact = F.instr(text, quote)
    words = F.filter(F.split(F.trim(quote), r"\s+"), lambda w: F.length(w) > 0)
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")
    hit = F.regexp_substr(text, pattern)
    loose = F.instr(text, hit)
    found = F.when(F.size(words) == 0, F.lit(None)).when(exact > 0, F.struct((exact - 1).alias("start"), (exact - 1 + F.length(quote)).alias("end")))
    return found.when(loose > 0, F.struct((loose - 1).alias("start"), (loose - 1 + F.length(hit)).alias("end")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def score_to_cosine(score: Column) -> Column:
    return F.when(score <= 0, F.lit(-1.0)).otherwise(2 - 1 / score)


def approved_confidence(raw: Column, descriptive: Column) -> Column:
    """What a signed-off claim's confidence becomes; descriptive predicates get the floor of 0.8."""
    return F.when(descriptive, F.lit(0.8)).otherwise(F.lit(0.8) + raw * 0.2)


def asked_grain(words: Column, declared: Column) -> Column:
    """The first time word's grain that the metric declares."""
    table = F.create_map(*[F.lit(x) for kv in GRAIN_WORDS.items() for x in kv])
    grains = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda g: g.isNotNull())
    return F.get(F.filter(grains, lambda g: F.array_contains(declared, g)), 0)


def ordered_ends(subject: Column, object_: Column, symmetric: Column) -> tuple[Column, Column]:
    return F.when(symmetric, F.least(subject, object_)).otherwise(subject), F.when(symmetric, F.greatest(subject, object_)).otherwise(object_)


def described(*parts: Column) -> Column:
    """Routing text: the parts that say something, as sentences."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.length(F.trim(p)) > 0)), ". ")


def layer_reason(layer: Column, hits: Column, selected: Column) -> Column:
    """Why a layer was or wasn't chosen, as a sentence."""
    many = F.when(hits == 1, "hit").otherwise("hits")
    return F.concat(layer.cast("string"), F.lit(": "), hits.cast("string"), F.lit(" "), many, F.when(selected, ", near the best layer").otherwise(", behind the best layer"))


def block_reason(predicate: Column, other: Column, said: Column | None = None) -> Column:
    """A refusal as a sentence: the predicate's label, or its words, and the other end as it is written, so that it can be looked up."""
    words = F.lower(F.regexp_replace(predicate, "_", " "))
    words = F.coalesce(said, words) if said is not None else words
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)), F.lit(" involving "), other, F.lit("."))


def class_reason(cls: Column) -> Column:
    """What stands behind a fact of a class."""
    return F.when(cls == "DECLARED", "stated by a system of record or a person").when(cls == "EXTRACTED_DET", "found by a fixed rule").when(cls == "EXTRACTED_MODEL", "read by a model").when(cls == "INFERRED", "derived by a rule").when(cls == "PREDICTED", "a prediction").otherwise("unknown")
