"""Row-level scope: tenants and matters, trust, transaction time, access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .session import small

# The classes from the strongest to the weakest, and the states that a person or a system of record has signed off.
STRENGTH = {"DECLARED": 0, "EXTRACTED_DET": 1, "EXTRACTED_MODEL": 2, "INFERRED": 3, "PREDICTED": 4}
SIGNED_OFF = ("AUTO_ASSERTED", "APPROVED")


def in_scope(tenant: str, allow=None, deny=()) -> Column:
    """Rows of the tenant that are unfiled or in an allowed matter; a denied matter always loses. No allow list allows all, an empty one only unfiled rows."""
    m = F.col("matter_id")
    allowed = F.lit(True) if allow is None else m.isNull() | (m.isin(list(allow)) if allow else F.lit(False))
    return (F.col("tenant_id") == tenant) & allowed & (m.isNull() | ~m.isin(list(deny)) if deny else F.lit(True))


def scoped_by_table(facts: DataFrame, tenant: str, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """The same wall for grants of any size: ``allow`` and ``deny`` have a column matter_id."""
    own = facts.where(F.col("tenant_id") == tenant)
    filed = own.where("matter_id IS NOT NULL").join(allow.select("matter_id").distinct(), "matter_id", "left_semi").join(deny.select("matter_id").distinct(), "matter_id", "left_anti")
    return own.where("matter_id IS NULL").unionByName(filed.select(own.columns))


def trusted(floor: float, classes=("DECLARED", "EXTRACTED_DET", "EXTRACTED_MODEL", "INFERRED"), include_pending: bool = False, predicted: bool = False) -> Column:
    """Signed-off rows of these classes at or above the confidence floor; predictions only when they are opted in."""
    wanted = [c for c in classes if c != "PREDICTED" or predicted] + (["PREDICTED"] if predicted and "PREDICTED" not in classes else [])
    state = F.col("review_state").isin(*SIGNED_OFF, *(["PENDING"] if include_pending else []))
    return F.col("epistemic_class").isin(wanted) & (F.col("confidence") >= floor) & state


def current(as_of: str | None = None) -> Column:
    """Rows that hold now, or did at a moment of transaction time."""
    if as_of is None:
        return F.col("superseded_at").isNull()
    t = F.lit(as_of).cast("timestamp")
    return (F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t))


def raised_floor(floor: float, asked: Column) -> Column:
    """A request may raise the confidence floor, never lower it."""
    return F.least(F.greatest(F.lit(floor), F.coalesce(asked, F.lit(floor))), F.lit(1.0))


def strength(cls: Column) -> Column:
    """Rank of a class; an unknown one is treated as the strictest floor."""
    ranks = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, cls), F.lit(0))


def access(requests: DataFrame, assignments: DataFrame, screens: DataFrame) -> DataFrame:
    """Requests (user_id, matter_id, is_admin) with decision and explanation. Only rows in force count: revoked_at, lifted_at null."""
    held = assignments.where("revoked_at IS NULL").select("user_id", "matter_id").distinct().withColumn("held", F.lit(True))
    kept_out = screens.where("lifted_at IS NULL").groupBy("user_id", "matter_id").agg(F.min("reason").alias("screen_reason"))
    df = requests.join(kept_out, ["user_id", "matter_id"], "left").join(held, ["user_id", "matter_id"], "left")
    decision = F.when(F.col("screen_reason").isNotNull(), "SCREENED").when(F.col("is_admin"), "PLATFORM_ADMIN").when(F.col("held"), "ALLOWED").otherwise("NOT_ASSIGNED")
    says = F.when(decision == "SCREENED", F.concat_ws("", F.lit("screened from "), "matter_id", F.lit(": "), "screen_reason"))
    says = says.when(decision == "PLATFORM_ADMIN", F.lit("a platform administrator")).when(decision == "ALLOWED", F.concat(F.lit("assigned to "), "matter_id"))
    return df.select("user_id", "matter_id", decision.alias("decision"), says.otherwise(F.concat(F.lit("not assigned to "), "matter_id")).alias("explanation"))


def grants(assignments: DataFrame, screens: DataFrame) -> DataFrame:
    """Per user the matters that active assignments and screens name, sorted."""
    a = assignments.where("revoked_at IS NULL").groupBy("user_id").agg(F.array_sort(F.collect_set("matter_id")).alias("allow"))
    s = screens.where("lifted_at IS NULL").groupBy("user_id").agg(F.array_sort(F.collect_set("matter_id")).alias("deny"))
    none = F.array().cast("array<string>")
    return a.join(s, "user_id", "full").select("user_id", F.coalesce("allow", none).alias("allow"), F.coalesce("deny", none).alias("deny"))


def visible_documents(attempts: DataFrame, readable: DataFrame) -> DataFrame:
    """Documents none of whose attempts carries a matter that is not readable."""
    hidden = attempts.where("matter_id IS NOT NULL").join(readable, "matter_id", "left_anti").select("document_id").distinct()
    return attempts.select("document_id").distinct().join(hidden, "document_id", "left_anti")


def in_layer(edges: DataFrame, layers: DataFrame, layer: str) -> DataFrame:
    """Edges with either end's kind in the layer. ``layers``: kind, layer (one row per kind of the vocabulary)."""
    kinds = layers.where(F.col("layer") == layer).select("kind")
    kinds = small(kinds)  # by such a key edges would be shuffled to as many tasks as there are kinds
    s, o = kinds.select(F.col("kind").alias("s_kind"), F.lit(True).alias("s_in")), kinds.select(F.col("kind").alias("o_kind"), F.lit(True).alias("o_in"))
    df = edges.withColumn("s_kind", F.substring_index("subject_id", ":", 1)).withColumn("o_kind", F.substring_index("object_id", ":", 1))
    return df.join(s, "s_kind", "left").join(o, "o_kind", "left").where("s_in OR o_in").select(edges.columns)


def source_status(scanned_at: Column, errors: Column, tables: Column) -> Column:
    """NOT_SCANNED, ERROR (errors and no tables), PARTIAL (errors and tables) or CONNECTED."""
    return F.when(scanned_at.isNull(), "NOT_SCANNED").when((errors > 0) & (tables == 0), "ERROR").when(errors > 0, "PARTIAL").otherwise("CONNECTED")


def catalog_claim() -> Column:
    """Facts about the catalog: descriptions and synonyms, and topics of tables."""
    return F.col("predicate").isin("DESCRIBED_AS", "HAS_SYNONYM") | ((F.col("predicate") == "CONCERNS_TOPIC") & F.col("subject_id").startswith("table:"))


def withheld(screens: DataFrame) -> DataFrame:
    """The screens in force, by name, with reason and contact: shown beside results, never among them."""
    return screens.where("lifted_at IS NULL").select("user_id", "matter_id", "reason", *[c for c in ("contact",) if c in screens.columns]).orderBy("user_id", "matter_id")


def access_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments and screens as rows with an end, from events (user_id, matter_id, event, at, seq, reason, contact): assign, revoke, screen, lift.

    Of each user and matter the last of assign and revoke stands, and the last of screen and lift.
    """
    when = F.struct("at", "seq")

    def last(start: str, end: str, closed: str, *more: str) -> DataFrame:
        rows = events.where(F.col("event").isin(start, end))
        of = rows.groupBy("user_id", "matter_id").agg(F.max_by(F.struct("event", "at"), when).alias("x"), F.max_by(F.struct(*more), F.when(F.col("event") == start, when)).alias("first") if more else F.lit(None).alias("first"))
        shown = [F.col(f"first.{c}").alias(c) for c in more]
        return of.select("user_id", "matter_id", *shown, F.when(F.col("x.event") == end, F.col("x.at")).alias(closed))

    return last("assign", "revoke", "revoked_at"), last("screen", "lift", "lifted_at", "reason", "contact")


def listed(facts: DataFrame, review_state: str | None = None, cls: str | None = None, matter: str | None = None, limit: int = 100) -> DataFrame:
    """The facts that are asked for, the least certain first, at most ``limit``, each with the total before the limit."""
    asked = {"review_state": review_state, "epistemic_class": cls, "matter_id": matter}
    for column, value in asked.items():
        facts = facts.where(F.col(column) == value) if value is not None else facts
    total = facts.agg(F.count("*").alias("total"))  # one row
    return facts.orderBy("confidence", "assertion_id").limit(limit).crossJoin(F.broadcast(total))


def dashboard(facts: DataFrame) -> DataFrame:
    """measure, name, n: current facts by class and by review state, zero where there are none, and what waits, is retracted, and the matters named."""
    now = F.col("superseded_at").isNull()
    waits = now & (F.col("review_state") == "PENDING")
    counts = {("class", c): now & (F.col("epistemic_class") == c) for c in STRENGTH} | {("state", s): now & (F.col("review_state") == s) for s in ("AUTO_ASSERTED", "PENDING", "APPROVED", "REJECTED")}
    counts |= {("pending", "review"): waits & ~catalog_claim(), ("pending", "catalog"): waits & catalog_claim(), ("retracted", "facts"): ~now}
    row = facts.agg(*[F.count_if(c).alias(f"{m}/{n}") for (m, n), c in counts.items()], F.count_distinct("matter_id").alias("named/matters"))  # one row
    names = [f"{m}/{n}" for m, n in counts] + ["named/matters"]
    pairs = F.array(*[F.struct(F.lit(x.split("/")[0]).alias("measure"), F.lit(x.split("/")[1]).alias("name"), F.col(f"`{x}`").alias("n")) for x in names])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def answer_roll_up(parts: DataFrame) -> DataFrame:
    """Per answer (answer_id, assertion_ids, tier, deterministic, label): distinct ids sorted, the highest tier, whether all are deterministic, and the labels as ``a + b``."""
    ids = parts.select("answer_id", F.explode_outer("assertion_ids").alias("id")).groupBy("answer_id").agg(F.array_sort(F.collect_set("id")).alias("assertion_ids"))
    rest = parts.groupBy("answer_id").agg(F.max("tier").alias("tier"), F.bool_and("deterministic").alias("deterministic"), F.array_join(F.array_sort(F.collect_set("label")), " + ").alias("label"))
    return ids.join(rest, "answer_id")
