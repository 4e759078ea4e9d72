"""Lifecycle on an append-only event log: every change is an event, the state is a fold over them up to a moment.

Events: assertion_id, event (approve, reject, promote, supersede, refile, merge ...), at, seq, and the values that they set. Nothing is updated in place, so
that review state and matter can be read as of any moment too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import scans
from ..functions.text import approved_confidence, content_id
from .session import checkpoints, small

# The moves that a document's job may make, and how far each state is (a failure is one below the state it ended).
LEGAL = [
    ("REGISTERED", "FETCHING"),
    ("REGISTERED", "FETCH_FAILED"),
    ("FETCHING", "PARSING"),
    ("FETCHING", "FETCH_FAILED"),
    ("PARSING", "CHUNKING"),
    ("PARSING", "PARSE_FAILED"),
    ("CHUNKING", "EXTRACTING"),
    ("CHUNKING", "CHUNK_FAILED"),
    ("EXTRACTING", "EMBEDDING"),
    ("EXTRACTING", "EXTRACT_FAILED"),
    ("EMBEDDING", "GRAPH_STAGED"),
    ("EMBEDDING", "EMBED_FAILED"),
    ("EMBEDDING", "STAGE_FAILED"),
    ("GRAPH_STAGED", "PENDING_REVIEW"),
    ("GRAPH_STAGED", "STAGE_FAILED"),
    ("PENDING_REVIEW", "APPROVED"),
    ("APPROVED", "LIVE"),
    ("APPROVED", "PROMOTE_FAILED"),
    ("FETCH_FAILED", "FETCHING"),
    ("PARSE_FAILED", "PARSING"),
    ("CHUNK_FAILED", "CHUNKING"),
    ("EXTRACT_FAILED", "EXTRACTING"),
    ("EMBED_FAILED", "EMBEDDING"),
    ("STAGE_FAILED", "EXTRACTING"),
    ("PROMOTE_FAILED", "APPROVED"),
]
PROGRESS = {
    "REGISTERED": 0,
    "FETCHING": 2,
    "PARSING": 4,
    "CHUNKING": 6,
    "EXTRACTING": 8,
    "EMBEDDING": 10,
    "GRAPH_STAGED": 12,
    "PENDING_REVIEW": 14,
    "APPROVED": 16,
    "LIVE": 18,
    "FETCH_FAILED": 1,
    "PARSE_FAILED": 3,
    "CHUNK_FAILED": 5,
    "EXTRACT_FAILED": 7,
    "EMBED_FAILED": 9,
    "STAGE_FAILED": 11,
    "PROMOTE_FAILED": 15,
}
STATES = tuple(PROGRESS)


def fold(facts: DataFrame, events: DataFrame, as_of: str | None = None) -> DataFrame:
    """The facts with review_state, matter_id, confidence, raw_confidence, superseded_at and lifecycle as the events up to ``as_of`` leave them.

    ``events``: assertion_id, event, at, seq, matter_id (of refile), descriptive. Decisions apply once: the first of approve and reject on a pending fact.
    """
    e = events if as_of is None else events.where(F.col("at") <= F.lit(as_of).cast("timestamp"))
    return applied(facts, event_states(e))


def event_states(events: DataFrame) -> DataFrame:
    """assertion_id and what its events come to: the first decision, whether any approval was of a descriptive row, the first end, the last filing. States of two stretches of time can be merged."""
    return merged_states(_each_state(events))


def _each_state(events: DataFrame) -> DataFrame:
    """What each event alone comes to."""
    is_ = lambda *names: F.col("event").isin(*names)
    return events.select(
        "assertion_id",
        F.when(is_("approve", "reject"), F.struct("at", "seq", "event")).alias("decided"),
        F.when(is_("approve"), F.coalesce("descriptive", F.lit(False))).alias("descriptive"),
        F.when(is_("supersede", "retract"), F.col("at")).alias("closed_at"),
        F.when(is_("refile"), F.struct("at", "seq", F.col("matter_id").alias("m"))).alias("refiled"),
    )


def merged_states(*states: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("assertion_id").agg(F.min("decided").alias("decided"), F.max("descriptive").alias("descriptive"), F.min("closed_at").alias("closed_at"), F.max("refiled").alias("refiled"))


def applied(facts: DataFrame, state: DataFrame) -> DataFrame:
    """The facts as the event states leave them."""
    df = facts.drop("raw_confidence", "lifecycle").join(state, "assertion_id", "left")
    pending = F.col("review_state") == "PENDING"
    approved = pending & (F.coalesce("decided.event", F.lit("")) == "approve")
    rejected = pending & (F.coalesce("decided.event", F.lit("")) == "reject")
    review = F.when(approved, "APPROVED").when(rejected, "REJECTED").otherwise(F.col("review_state"))
    keep = [c for c in facts.columns if c not in ("review_state", "matter_id", "confidence", "superseded_at", "raw_confidence", "lifecycle")]
    out = df.select(
        *keep,
        F.when(F.col("refiled").isNotNull(), F.col("refiled.m")).otherwise(F.col("matter_id")).alias("matter_id"),
        review.alias("review_state"),
        F.when(approved, approved_confidence(F.col("confidence"), F.coalesce("descriptive", F.lit(False)))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(approved, F.col("confidence")).alias("raw_confidence"),
        F.least("superseded_at", "closed_at").alias("superseded_at"),
    )
    live = F.when(F.col("review_state") == "PENDING", "STAGED").when(F.col("review_state") == "REJECTED", "DISCARDED").otherwise("LIVE")
    return out.withColumn("lifecycle", live)


def _packed(id_: Column) -> Column:
    """An id of hex digits in half its bytes, any other as it is; the first byte tells which."""
    hexed = id_.rlike("^([0-9a-f]{2})+$")
    return F.when(hexed, F.concat(F.lit(bytearray(b"\1")), F.unhex(id_))).otherwise(F.concat(F.lit(bytearray(b"\0")), F.encode(id_, "utf-8")))


def _unpacked(id_: Column) -> Column:
    rest = F.substring(id_, 2, 2**31 - 1)
    return F.when(F.substring(id_, 1, 1) == F.lit(bytearray(b"\1")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


class EventLog:
    """Events in folders by day, and snapshots of what they come to at some moments: a state at a later moment reads a snapshot and the days since.

    An id is most of a row: its files and shuffles have it packed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, events: DataFrame) -> None:
        # ranges by day and id: a large day is several files, a small one isn't many
        rows = events.withColumns({"day": F.to_date("at"), "assertion_id": _packed(F.col("assertion_id"))})
        rows.repartitionByRange("day", "assertion_id").write.mode("append").partitionBy("day").parquet(f"{self.root}/events")

    def _since(self, after: str | None, until: str) -> DataFrame:
        t = lambda x: F.lit(x).cast("timestamp")
        e = self.spark.read.parquet(f"{self.root}/events").where((F.col("day") <= t(until).cast("date")) & (F.col("at") <= t(until)))
        return e if after is None else e.where((F.col("day") >= t(after).cast("date")) & (F.col("at") > t(after)))

    def _snapshots(self) -> dict[str, str]:
        """Moment to folder: as many as have been taken."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return {n.replace("_", " ").replace(".", ":"): f"{self.root}/snapshots/{n}" for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots/{n}/_SUCCESS"))}

    def _states(self, until: str) -> DataFrame:
        taken = max((m for m in self._snapshots() if m <= until), default=None)
        before = [] if taken is None else [self.spark.read.parquet(self._snapshots()[taken])]
        # events meet the snapshot as they are: grouped before, they would be shuffled twice
        return before[0] if taken == until else merged_states(*before, _each_state(self._since(taken, until)))

    def states(self, until: str) -> DataFrame:
        """What all events up to a moment (``2024-01-31 12:00:00``) come to."""
        return self._states(until).withColumn("assertion_id", _unpacked(F.col("assertion_id")))

    def snapshot(self, at: str) -> None:
        """Writes the states at a moment, from the snapshot before it. Events up to it must not be appended any more: it would not hold them."""
        self._states(at).write.mode("overwrite").parquet(f"{self.root}/snapshots/{at.replace(' ', '_').replace(':', '.')}")

    def fold(self, facts: DataFrame, until: str) -> DataFrame:
        rows = applied(facts.withColumn("assertion_id", _packed(F.col("assertion_id"))), self._states(until))
        return rows.withColumn("assertion_id", _unpacked(F.col("assertion_id")))


def stage(batch: DataFrame, stored: DataFrame, tenant: str, readable: Column) -> tuple[DataFrame, int]:
    """New rows to append, and how many rows of the batch are not admissible; with any of those nothing is staged.

    Rows that are stored and decided are left alone, pending ones are refreshed.
    """
    bad = batch.where((F.col("tenant_id") != tenant) | F.col("tenant_id").isNull() | (F.col("matter_id").isNotNull() & ~readable)).count()
    decided = stored.where("review_state <> 'PENDING'").select("assertion_id")
    # few rows are left to be told apart where most are decided
    fresh = batch.join(decided, "assertion_id", "left_anti").dropDuplicates(["assertion_id"]).withColumn("review_state", F.lit("PENDING"))
    return (fresh if not bad else fresh.limit(0)), bad


def decide(facts: DataFrame, ids: DataFrame, event: str, at: Column, reason: str | None = None) -> DataFrame:
    """Approve, reject or promote events for those of the ids that may take them."""
    if event == "reject" and not (reason or "").strip():
        raise ValueError("a rejection needs a reason")
    may = {"approve": "review_state = 'PENDING' AND superseded_at IS NULL", "reject": "review_state = 'PENDING'", "promote": "lifecycle = 'STAGED' AND superseded_at IS NULL AND review_state IN ('AUTO_ASSERTED', 'APPROVED')"}[event]
    return facts.where(may).join(ids.select("assertion_id").distinct(), "assertion_id", "left_semi").select("assertion_id", F.lit(event).alias("event"), at.alias("at"), F.lit(reason).cast("string").alias("reason"))


def cascade(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """assertion_id, level and root (the first by name of those that reach it soonest) of the current roots and of everything current that rests on them.

    Superseded facts stop a branch. ``facts``: assertion_id, premises, superseded_at. It ends when a level reaches nothing new, however deep.
    """
    checkpoints(facts.sparkSession)
    live = facts.where("superseded_at IS NULL")
    rests = live.where(F.size("premises") > 0).select(F.col("assertion_id").alias("child"), F.explode("premises").alias("premise"))
    # facts are looked up in the roots, which are few: no fact is shuffled
    roots = roots.select("assertion_id").distinct().checkpoint()
    front = live.select("assertion_id").join(small(roots), "assertion_id", "left_semi").distinct().checkpoint().select("assertion_id", F.lit(0).alias("level"), F.col("assertion_id").alias("root"))
    reached, level = front, 0
    while True:
        level += 1
        front = rests.join(front.select(F.col("assertion_id").alias("premise"), "root"), "premise").groupBy(F.col("child").alias("assertion_id")).agg(F.min("root").alias("root"))
        front = front.join(reached.select("assertion_id"), "assertion_id", "left_anti").select("assertion_id", F.lit(level).alias("level"), "root").checkpoint()
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if level % 20 == 0:  # the plan would name every level
            reached = reached.checkpoint()


def retraction(facts: DataFrame, roots: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The events of a retraction with its cascade, each with its own reason, and the rules (rule_id) that lose a conclusion by it.

    Nothing is written: the events are the dry run's answer, and appended they are the retraction. A root that is closed already has no event.
    """
    if not reason.strip():
        raise ValueError("a retraction needs a reason")
    closed = cascade(facts, roots)
    why = F.when(F.col("level") == 0, F.lit(reason)).otherwise(F.concat(F.lit("premise "), "root", F.lit(f" retracted: {reason}")))
    events = closed.select("assertion_id", F.lit("retract").alias("event"), at.alias("at"), "level", why.alias("reason"))
    orphaned = facts.where("rule_id IS NOT NULL").join(closed.where("level > 0").select("assertion_id"), "assertion_id", "left_semi").select("rule_id").distinct()
    return events, orphaned


def _named(facts: DataFrame, entity: str) -> DataFrame:
    return facts.where(((F.col("subject_id") == entity) | (F.col("object_id") == entity)) & F.col("superseded_at").isNull())


def merge_plan(facts: DataFrame, loser: str) -> DataFrame:
    """assertion_id and part of what a merge touches: affected (names the loser) or cascaded (rests on those without naming it)."""
    affected = _named(facts, loser).select("assertion_id")
    cascaded = cascade(facts, affected).select("assertion_id").join(affected, "assertion_id", "left_anti")
    return affected.withColumn("part", F.lit("affected")).unionByName(cascaded.withColumn("part", F.lit("cascaded")))


def merged(facts: DataFrame, loser: str, winner: str, canonical=None) -> tuple[DataFrame, DataFrame]:
    """Restated facts of the loser under the winner's name with new ids, and the ids to close.

    Refuses other kinds, the same id and, with ``canonical`` (a function of a column), ids that are not in normal form.
    """
    if loser == winner or loser.lower().split(":", 1)[0] != winner.lower().split(":", 1)[0] or ":" not in winner:
        raise ValueError("only two ids of one kind can be merged")
    if canonical is not None:
        ids = facts.sparkSession.createDataFrame([(loser,), (winner,)], "id string")
        if ids.where(~F.col("id").eqNullSafe(canonical(F.col("id")))).count():
            raise ValueError("an id is not in normal form: the merge would make a fork")
    old = _named(facts, loser)
    to = lambda c: F.when(F.col(c) == loser, winner).otherwise(F.col(c)).alias(c)
    new = old.select(*[to(c) if c in ("subject_id", "object_id") else F.col(c) for c in facts.columns if c != "assertion_id"]).where("subject_id <> object_id")
    return new.withColumn("assertion_id", content_id(F.col("tenant_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id"))).select(facts.columns), old.select("assertion_id")


def wiped(facts: DataFrame, where: Column, at: Column) -> DataFrame:
    """Supersede events, without a cascade, for the current facts of a document or a matter."""
    return facts.where(where & F.col("superseded_at").isNull()).select("assertion_id", F.lit("supersede").alias("event"), at.alias("at"))


def wipe(facts: DataFrame, vectors: DataFrame, jobs: DataFrame, where: Column, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A wipe of documents or a matter (``where`` over document_id and matter_id): events, the vectors and jobs that stay, and an audit row of counts."""
    gone = F.coalesce(where, F.lit(False))
    events = wiped(facts, gone, at)
    count = lambda df, n: df.agg(F.count("*").alias(n))
    audit = count(events, "facts").crossJoin(count(vectors.where(gone), "vectors")).crossJoin(count(jobs.where(gone), "jobs"))  # one row each
    return events, vectors.where(~gone), jobs.where(~gone), audit


def filings(events: DataFrame) -> DataFrame:
    """Filing events (document_id, matter_id, at, seq) with the matter before: the last one that was named."""
    return scans.previous(events, "document_id", ["at", "seq"], "matter_id", "previous", skip_nulls=True)


def settled(documents: DataFrame, staged: DataFrame) -> DataFrame:
    """Documents in review none of whose own facts is pending: they go live. Own are those of their ``staged_ids`` (matched with assertion_id) or, without that column, of document_id."""
    open_ = staged.where("review_state = 'PENDING'")
    if "staged_ids" in documents.columns:
        open_ = documents.select("document_id", F.explode("staged_ids").alias("assertion_id")).join(open_.select("assertion_id"), "assertion_id", "left_semi")
    open_ = open_.select("document_id").distinct()
    return documents.where("state = 'PENDING_REVIEW'").join(open_, "document_id", "left_anti")


def illegal_moves(attempts: DataFrame, key: str = "document_id") -> DataFrame:
    """State changes that the job's table of legal moves doesn't have."""
    moves = scans.previous(attempts, key, ["created_at", "seq"], "state", "before").where("before IS NOT NULL")
    legal = attempts.sparkSession.createDataFrame(LEGAL, "before string, state string")
    return moves.join(F.broadcast(legal), ["before", "state"], "left_anti")


def progress(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv]), state)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of each document the attempt that came furthest; of those the newest."""
    rows = attempts.withColumn("progress", progress(F.col("state")))
    rest = [c for c in rows.columns if c != "document_id"]
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("progress", "created_at", "seq")).alias("x")).select("document_id", "x.*")


def without(df: DataFrame, tenant: str) -> DataFrame:
    """A table without a tenant's rows: the purge of one partition."""
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def refused(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows that an insert-only table must refuse: their key is there already, or another row of the batch has it."""
    again = new.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return new.join(old.select(key).unionByName(again).distinct(), key, "left_semi")


def append_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows to append: new keys only, each once, so that a rerun converges."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def duplicates(entities: DataFrame, keys: Column) -> DataFrame:
    """key and the sorted ids that share it, for keys with several ids."""
    rows = entities.select("entity_id", F.explode(keys).alias("key")).distinct()
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).where(F.size("ids") > 1)


def near_duplicates(batch: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """assertion_id and the sorted stored ids that its ends may be other spellings of; rows without any are left out. ``keys``: blocking keys of an id column.

    Ids that the batch itself names are no duplicates. The batch is staged all the same: a reviewer is asked.
    """
    both = lambda df, *more: df.select(F.explode(F.array("subject_id", "object_id")).alias("id"), *more).where("id IS NOT NULL")
    own = both(batch, "assertion_id").distinct()
    other = both(stored).distinct().join(own.select("id").distinct(), "id", "left_anti")
    keyed = lambda df: df.select(*df.columns, F.explode(keys(F.col("id"))).alias("key"))
    hits = keyed(own).select("assertion_id", "key").distinct().join(keyed(other), "key")
    return hits.groupBy("assertion_id").agg(F.array_sort(F.collect_set("id")).alias("near_duplicates"))


def retract_document(facts: DataFrame, document: Column) -> DataFrame:
    """The cascade from a document's own current facts, derived ones aside. ``facts`` also has document_id."""
    return cascade(facts, facts.where(document & F.col("superseded_at").isNull() & (F.size("premises") == 0)))


def corrected(facts: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared facts at 0.98 in place of others, with ``corrects``, and the ids to close. ``corrections``: assertion_id, subject_id, predicate, object_id; one that changes nothing is dropped."""
    old = facts.select("assertion_id", "tenant_id", F.col("subject_id").alias("s0"), F.col("predicate").alias("p0"), F.col("object_id").alias("o0"), "matter_id")
    df = old.join(corrections, "assertion_id").where("NOT (s0 = subject_id AND p0 = predicate AND o0 = object_id)")
    new = df.select("tenant_id", "subject_id", "predicate", "object_id", "matter_id", F.lit("DECLARED").alias("epistemic_class"), F.lit(0.98).alias("confidence"), F.col("assertion_id").alias("corrects"))
    return new.withColumn("assertion_id", content_id(F.col("tenant_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id"))), df.select("assertion_id")


def refile_events(facts: DataFrame, documents: DataFrame, at: Column) -> DataFrame:
    """Refile events for all facts of the documents (document_id, matter_id), with the matter before; ids stay."""
    rows = facts.where("document_id IS NOT NULL").withColumnRenamed("matter_id", "previous").join(documents, "document_id")
    return rows.where("NOT (previous <=> matter_id)").select("assertion_id", F.lit("refile").alias("event"), at.alias("at"), "matter_id", "previous")


def refile(facts: DataFrame, chunks: DataFrame, jobs: DataFrame, documents: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (document_id, matter_id) move to a matter: events for their facts, the chunks and jobs with their new matter, and an audit row of counts. Ids stay."""
    events = refile_events(facts, documents, at)
    to = documents.select("document_id", F.struct("matter_id").alias("_to"))

    def moved(df: DataFrame) -> DataFrame:
        rows = df.join(to, "document_id", "left")
        return rows.withColumn("matter_id", F.when(F.col("_to").isNotNull(), F.col("_to.matter_id")).otherwise(F.col("matter_id"))).select(df.columns)

    named = documents.select("document_id")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    audit = count(events, "facts").crossJoin(count(chunks.join(named, "document_id", "left_semi"), "chunks")).crossJoin(count(jobs.join(named, "document_id", "left_semi"), "jobs"))  # one row each
    return events, moved(chunks), moved(jobs), audit


def resolved_filing(requests: DataFrame, events: DataFrame) -> DataFrame:
    """The matter of each request (document_id, matter_id): the one it names, else the newest that any filing named."""
    prior = events.where("matter_id IS NOT NULL").groupBy("document_id").agg(F.max_by("matter_id", F.struct("at", "seq")).alias("prior"))
    return requests.join(prior, "document_id", "left").select("document_id", F.coalesce("matter_id", "prior").alias("matter_id"))


def reset(tables: dict[str, DataFrame], tenant: str, layers: set[str], authored: bool = False) -> dict[str, DataFrame]:
    """The tables without a tenant's rows in the chosen layers; metrics, which people wrote, only with ``authored``."""
    return {n: without(df, tenant) if n in layers and (n != "metrics" or authored) else df for n, df in tables.items()}
