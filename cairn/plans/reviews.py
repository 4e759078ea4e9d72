"""Queries over review and access: screening, staging and decisions, retraction and merge plans, rules on made roles, catalog words, streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import catalog as C, documents as D, graph as G, lifecycle as L, metrics as M, rules as R, scope as P, vectors as V
from ..operators.partitions import PartitionedTable, reset
from ..operators.session import checkpoints
from ..sources import derived, tables as S
from ..streaming import ingest as I
from . import facts as FA, texts as TX
from .facts import _FOUND, _LADDER, RULE, WITH, effects, facts, ladder, seeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Screening

_SCREEN = f"""{_FOUND.replace("found AS (", "found AS MATERIALIZED (")},
seeds AS MATERIALIZED (SELECT c_nationkey AS question_id, 'customer:' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
walls AS (SELECT DISTINCT question_id, 'M-' || r_regionkey AS subject, 'M-' || r_regionkey AS matter_id, 'withhold' AS effect FROM seeds, region WHERE r_name IN ('ASIA', 'EUROPE')),
blocks AS MATERIALIZED (SELECT * FROM walls UNION ALL SELECT DISTINCT question_id, tainted, NULL, effect FROM seeds JOIN found ON node = tainted),
rws AS MATERIALIZED (SELECT DISTINCT question_id, assertion_id, subject_id, object_id, document_id, matter_id FROM facts JOIN seeds ON node = subject_id OR node = object_id),
hold AS MATERIALIZED (SELECT * FROM blocks WHERE effect = 'withhold'),
kept AS MATERIALIZED (SELECT * FROM rws r WHERE NOT EXISTS (SELECT 1 FROM hold h WHERE h.question_id = r.question_id AND (h.subject = r.subject_id OR h.subject = r.object_id OR h.subject = r.document_id OR h.matter_id = r.matter_id)))"""


def _screening(spark, folder):
    f = facts(spark, folder)
    asked = S.read(spark, folder, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select(F.col("c_nationkey").alias("question_id"), F.concat(F.lit("customer:"), "c_custkey").alias("node"))
    matter = F.concat(F.lit("M-"), "r_regionkey").alias("matter_id")
    screens = S.read(spark, folder, "region").where("r_name IN ('ASIA', 'EUROPE')").select(matter, F.lit(None).cast("string").alias("reason"), F.col("r_name").alias("contact"))
    blocks = G.blocks_for(asked, G.findings(f, effects(spark)), screens)
    ends = f.select("assertion_id", "subject_id", "object_id", "document_id", "matter_id", F.explode(F.array("subject_id", "object_id")).alias("node"))
    rows = ends.join(asked, "node").drop("node").distinct()
    return asked, rows, blocks


@query(f"{WITH}, {_SCREEN}, n AS (SELECT question_id, node, max(CASE WHEN b.subject IS NULL THEN 0 ELSE 1 END) AS named FROM seeds LEFT JOIN blocks b USING (question_id) WHERE b.subject = node OR NOT EXISTS (SELECT 1 FROM blocks x WHERE x.question_id = seeds.question_id AND x.subject = node) GROUP BY 1, 2) SELECT question_id, count(DISTINCT node) AS seeds_considered, count(DISTINCT node) FILTER (NOT EXISTS (SELECT 1 FROM blocks x WHERE x.question_id = n.question_id AND x.subject = n.node)) AS cleared, count(DISTINCT node) FILTER (EXISTS (SELECT 1 FROM blocks x WHERE x.question_id = n.question_id AND x.subject = n.node)) AS flagged, (SELECT count(*) FROM rws WHERE rws.question_id = n.question_id) - (SELECT count(*) FROM kept WHERE kept.question_id = n.question_id) AS items_withheld FROM n GROUP BY question_id")
def g14_screen_report(spark, folder):
    return G.screen_report(*_screening(spark, folder)).drop("degraded")


@query(f"{WITH}, {_SCREEN} SELECT question_id, assertion_id FROM kept")
def g14_kept_rows(spark, folder):
    _, rows, blocks = _screening(spark, folder)
    return G.kept_rows(rows, blocks).select("question_id", "assertion_id")


_REACH = _FOUND.replace("effect, 0 AS premise_count", "effect, length(subject_id) % 3 AS premise_count").replace("effect, 0, confidence", "effect, length(subject_id) % 3, confidence").replace("ORDER BY confidence DESC", "ORDER BY premise_count DESC, confidence DESC")


@query(f"{WITH}, {_REACH} SELECT tainted, predicate, other, effect, premise_count::INTEGER AS premise_count, confidence FROM found ORDER BY premise_count DESC, confidence DESC, tainted, predicate, other LIMIT 500")
def l6_findings_in_order(spark, folder):
    """Findings that rest on zero to two facts, the furthest-reaching first."""
    f = facts(spark, folder, *FA.BLOCKING).withColumn("premises", F.array_repeat(F.col("assertion_id"), F.length("subject_id") % 3))
    return G.in_order(G.findings(f, effects(spark))).limit(500)


@query(f"{WITH}, s AS (SELECT c_custkey::VARCHAR AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 UNION SELECT 'M-' || r_regionkey FROM region WHERE r_name = 'ASIA') SELECT assertion_id FROM facts WHERE split_part(subject_id, ':', 2) IN (FROM s) OR split_part(object_id, ':', 2) IN (FROM s) OR matter_id IN (FROM s)")
def g12_touched(spark, folder):
    bare = seeds(spark, folder).select(F.substring_index("node", ":", -1).alias("node"))
    asia = S.read(spark, folder, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("M-"), "r_regionkey").alias("node"))
    return G.touched(facts(spark, folder), bare.unionByName(asia)).select("assertion_id")


# Listing and counts


@query(f"{WITH}, f AS (SELECT * FROM facts WHERE review_state = 'PENDING' AND matter_id = 'M-2') SELECT assertion_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY confidence, assertion_id LIMIT 100")
def p10_listing(spark, folder):
    return P.listed(facts(spark, folder), review_state="PENDING", matter="M-2").select("assertion_id", "total")


_NAMES = [("class", c, f"superseded_at IS NULL AND epistemic_class = '{c}'") for c in P.STRENGTH] + [("state", s, f"superseded_at IS NULL AND review_state = '{s}'") for s in ("AUTO_ASSERTED", "PENDING", "APPROVED", "REJECTED")]
_NAMES += [("pending", "review", "superseded_at IS NULL AND review_state = 'PENDING' AND NOT catalog"), ("pending", "catalog", "superseded_at IS NULL AND review_state = 'PENDING' AND catalog"), ("retracted", "facts", "superseded_at IS NOT NULL")]


@query(f"{WITH}, k AS (SELECT *, predicate IN ('DESCRIBED_AS', 'HAS_SYNONYM') AS catalog FROM (SELECT * REPLACE (CASE predicate WHEN 'SUPPLIED_BY' THEN 'DESCRIBED_AS' ELSE predicate END AS predicate) FROM facts)) " + " UNION ALL ".join(f"SELECT '{m}' AS measure, '{n}' AS name, count(*) FILTER ({w}) AS n FROM k" for m, n, w in _NAMES) + " UNION ALL SELECT 'named', 'matters', count(DISTINCT matter_id) FROM k")
def a5_dashboard(spark, folder):
    """Zero-filled counts; supply facts stand for catalog descriptions."""
    f = facts(spark, folder).withColumn("predicate", F.expr("CASE predicate WHEN 'SUPPLIED_BY' THEN 'DESCRIBED_AS' ELSE predicate END"))
    return P.dashboard(f)


@query("SELECT user_id AS answer_id, string_agg(DISTINCT event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS assertion_ids, max(event_id % 4) AS tier, bool_and(event_id % 5 > 0) AS deterministic, string_agg(DISTINCT event_type, ' + ' ORDER BY event_type) AS label FROM events GROUP BY 1")
def a14_answer_roll_up(spark, folder):
    k = F.col("event_id")
    parts = S.read(spark, folder, "events").select(F.col("user_id").alias("answer_id"), F.array(k.cast("string")).alias("assertion_ids"), (k % 4).alias("tier"), (k % 5 > 0).alias("deterministic"), F.col("event_type").alias("label"))
    return P.answer_roll_up(parts).withColumn("assertion_ids", F.array_join("assertion_ids", ","))


_ACCESS = "ev AS (SELECT user_id, 'M-' || (event_id % 6) AS matter_id, list_extract(['assign', 'revoke', 'screen', 'lift'], (event_id % 4 + 1)::INTEGER) AS event, ts, event_id AS seq, event_type AS reason FROM events)"


@query(f"""WITH {_ACCESS}, a AS (SELECT user_id, matter_id, event, ts, row_number() OVER (PARTITION BY user_id, matter_id ORDER BY ts DESC, seq DESC) AS k FROM ev WHERE event IN ('assign', 'revoke')),
s AS (SELECT user_id, matter_id, event, ts, row_number() OVER (PARTITION BY user_id, matter_id ORDER BY ts DESC, seq DESC) AS k FROM ev WHERE event IN ('screen', 'lift')),
w AS (SELECT user_id, matter_id, arg_max(reason, (ts, seq)) AS reason FROM ev WHERE event = 'screen' GROUP BY 1, 2)
SELECT 'assignment' AS part, user_id, matter_id, NULL AS reason, CASE WHEN event = 'revoke' THEN ts END AS closed_at FROM a WHERE k = 1 UNION ALL SELECT 'screen', s.user_id, s.matter_id, w.reason, CASE WHEN event = 'lift' THEN ts END FROM s LEFT JOIN w USING (user_id, matter_id) WHERE k = 1""")
def r14_access_events(spark, folder):
    k = F.col("event_id")
    names = F.array(*[F.lit(n) for n in ("assign", "revoke", "screen", "lift")])
    e = S.read(spark, folder, "events").select("user_id", F.concat(F.lit("M-"), k % 6).alias("matter_id"), names[(k % 4).cast("int")].alias("event"), F.col("ts").alias("at"), k.alias("seq"), F.col("event_type").alias("reason"), F.lit(None).cast("string").alias("contact"))
    a, s = P.access_rows(e)
    one = a.select(F.lit("assignment").alias("part"), "user_id", "matter_id", F.lit(None).cast("string").alias("reason"), F.col("revoked_at").alias("closed_at"))
    return one.unionByName(s.select(F.lit("screen").alias("part"), "user_id", "matter_id", "reason", F.col("lifted_at").alias("closed_at")))


# Staging and decisions

_DECIDED = "SELECT assertion_id FROM facts WHERE review_state <> 'PENDING'"


@query(f"{WITH} SELECT assertion_id, 'PENDING' AS review_state FROM facts WHERE tenant_id = 't-alpha' AND (matter_id IS NULL OR matter_id <> 'M-5') AND NOT EXISTS (SELECT 1 FROM ({_DECIDED}) d WHERE d.assertion_id = facts.assertion_id)")
def r1_stage(spark, folder):
    """A batch of readable rows of one tenant, staged beside what is stored: decided rows are left alone."""
    f = facts(spark, folder)
    batch = f.where("tenant_id = 't-alpha' AND (matter_id IS NULL OR matter_id <> 'M-5')")
    new, bad = L.stage(batch, f, "t-alpha", F.col("matter_id") != "M-5")
    return new.where(F.lit(bad) == 0).select("assertion_id", "review_state")


@query(f"{WITH} SELECT count(*) FILTER (tenant_id <> 't-alpha' OR matter_id = 'M-5') AS refused, 0 AS staged FROM facts")
def r1_stage_refused(spark, folder):
    """One row of another tenant or of an unreadable matter refuses the whole batch."""
    f = facts(spark, folder)
    new, bad = L.stage(f, f.limit(0), "t-alpha", F.col("matter_id") != "M-5")
    return new.agg(F.lit(bad).cast("long").alias("refused"), F.count("*").cast("int").alias("staged"))


@query(f"{WITH} SELECT DISTINCT assertion_id, 'reject' AS event, 'out of date' AS reason FROM facts WHERE review_state = 'PENDING' AND recorded_at < TIMESTAMP '2024-06-01'")
def r3_reject(spark, folder):
    f = facts(spark, folder)
    return L.decide(f, f.where("recorded_at < '2024-06-01'"), "reject", F.current_timestamp(), "out of date").drop("at")


@query(f"{WITH} SELECT assertion_id, 'promote' AS event FROM facts WHERE superseded_at IS NULL AND review_state IN ('AUTO_ASSERTED', 'APPROVED') AND confidence < 0.9")
def r4_promote(spark, folder):
    """Signed-off rows that are still staged: here those under 0.9."""
    f = facts(spark, folder).withColumn("lifecycle", F.when(F.col("confidence") < 0.9, "STAGED").otherwise("LIVE"))
    return L.decide(f, f, "promote", F.current_timestamp()).select("assertion_id", "event")


@query("SELECT event_id AS audit_id FROM events WHERE event_id < (SELECT count(*) // 2 FROM events)")
def s14_refused_audit_rows(spark, folder):
    """An insert-only log refuses the rows that it has: the older half comes again with the newer one."""
    e = S.read(spark, folder, "events").select(F.col("event_id").alias("audit_id"))
    half = e.count() // 2
    return L.refused(e.where(F.col("audit_id") < half), e, "audit_id")


@query("""WITH b AS (SELECT o_orderkey AS id, 'party:' || c_name || ' Ltd' AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P') SELECT id::VARCHAR AS assertion_id, regexp_replace(s, ' Ltd$', '') AS near FROM b""")
def r1_near_duplicates(spark, folder):
    """Staged claims that name customers with a company form; the stored ones name them without."""
    c = S.read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("party:"), "c_name").alias("name"))
    o = S.read(spark, folder, "orders")
    stored = c.select(F.col("name").alias("subject_id"), F.lit(None).cast("string").alias("object_id"))
    batch = o.where("o_orderstatus = 'P'").join(c, "o_custkey").select(F.col("o_orderkey").cast("string").alias("assertion_id"), F.concat("name", F.lit(" Ltd")).alias("subject_id"), F.concat(F.lit("order:"), "o_orderkey").alias("object_id"))
    found = L.near_duplicates(batch, stored, lambda c: T.blocking_keys(c, ["party", "order"]))
    return found.select("assertion_id", F.explode("near_duplicates").alias("near"))


@query(f"{WITH}, own AS (SELECT document_id, list(assertion_id) AS ids, bool_or(review_state = 'PENDING') AS waits FROM facts WHERE document_id IS NOT NULL AND confidence >= 0.8 GROUP BY 1) SELECT document_id FROM own WHERE NOT waits")
def r12_settled_by_staged_ids(spark, folder):
    """Documents whose own staged rows, here their firm ones, are all decided; weaker rows of theirs don't count."""
    f = facts(spark, folder).where("document_id IS NOT NULL")
    d = f.where("confidence >= 0.8").groupBy("document_id").agg(F.collect_list("assertion_id").alias("staged_ids")).withColumn("state", F.lit("PENDING_REVIEW"))
    return L.settled(d, f.select("assertion_id", "review_state")).select("document_id")


# Retraction and merge

_RETRACTED = f"WITH RECURSIVE {_LADDER}, w AS (SELECT k, 0 AS level, k AS root FROM d WHERE k % 16 = 1 AND NOT closed UNION ALL SELECT d.k, level + 1, root FROM w JOIN d ON d.up = w.k WHERE NOT closed)"


def ruled(spark, folder) -> DataFrame:
    return ladder(spark, folder).withColumn("rule_id", F.when(F.size("premises") > 0, F.concat(F.lit("rule-"), F.col("assertion_id").cast("long") % 5)))


def _retracted(spark, folder):
    f = ruled(spark, folder)
    return L.retraction(f, f.where("CAST(assertion_id AS BIGINT) % 16 = 1"), "wrong source", F.current_timestamp())


@query(f"{_RETRACTED} SELECT k::VARCHAR AS assertion_id, level::INTEGER AS level, CASE WHEN level = 0 THEN 'wrong source' ELSE 'premise ' || root || ' retracted: wrong source' END AS reason FROM w")
def r5_retraction(spark, folder):
    return _retracted(spark, folder)[0].select("assertion_id", "level", "reason")


@query(f"{_RETRACTED} SELECT DISTINCT 'rule-' || (k % 5) AS rule_id FROM w WHERE level > 0")
def r5_orphaned_rules(spark, folder):
    return _retracted(spark, folder)[1]


_NAMED = "l AS (SELECT d.*, o_custkey FROM d JOIN orders ON o_orderkey = k), loser AS (SELECT min(c_custkey) AS c FROM customer WHERE c_mktsegment = 'BUILDING'), hit AS (SELECT k FROM l, loser WHERE o_custkey = c AND NOT closed)"


@query(f"WITH RECURSIVE {_LADDER}, {_NAMED}, w AS (SELECT k FROM hit UNION SELECT d.k FROM w JOIN d ON d.up = w.k WHERE NOT closed) SELECT k::VARCHAR AS assertion_id, CASE WHEN k IN (FROM hit) THEN 'affected' ELSE 'cascaded' END AS part FROM w")
def r8_merge_plan(spark, folder):
    """What the merge of one customer touches: the facts that name it, and those that rest on them without naming it."""
    c = S.read(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").agg(F.min("c_custkey").alias("c")).first().c
    o = S.read(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("assertion_id"), F.concat(F.lit("customer:"), "o_custkey").alias("subject_id"), F.concat(F.lit("order:"), "o_orderkey").alias("object_id"))
    return L.merge_plan(ladder(spark, folder).join(o, "assertion_id"), f"customer:{c}")


@query(f"WITH RECURSIVE {_LADDER}, {_NAMED}, w AS (SELECT k FROM hit UNION SELECT d.k FROM w JOIN d ON d.up = w.k WHERE NOT closed) SELECT k::VARCHAR AS assertion_id FROM w WHERE k NOT IN (FROM hit)")
def u3_cascaded_without_affected(spark, folder):
    return r8_merge_plan(spark, folder).where("part = 'cascaded'").select("assertion_id")


@query(f"{WITH}, v AS (SELECT 'M-' || (vec_id % 7) AS matter_id FROM embeddings WHERE vec_id % 4 <> 0) SELECT (SELECT count(*) FROM facts WHERE matter_id = 'M-3' AND superseded_at IS NULL) AS facts, (SELECT count(*) FROM v WHERE matter_id = 'M-3') AS vectors, (SELECT count(*) FROM events WHERE event_id % 7 = 3) AS jobs, (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM v WHERE matter_id = 'M-3') AS vectors_left")
def r9_wipe_matter_everywhere(spark, folder):
    jobs = S.read(spark, folder, "events").select(F.col("event_id").alias("job_id"), F.concat(F.lit("M-"), F.col("event_id") % 7).alias("matter_id"))
    # one count reads the facts: they are made for it and not stored
    _, left, _, audit = L.wipe(derived.made(spark, folder), TX.vectors(spark, folder), jobs, F.col("matter_id") == "M-3", F.current_timestamp())
    return audit.crossJoin(left.agg(F.count("*").alias("vectors_left")))


_TO = "m AS (SELECT 'doc-' || doc_id AS document_id, 'M-' || (doc_id % 3) AS matter_id FROM documents WHERE n_chars > 300)"


@query(f"WITH {_TO} SELECT vec_id, coalesce(m.matter_id, CASE WHEN vec_id % 4 <> 0 THEN 'M-' || (vec_id % 7) END) AS matter_id FROM embeddings LEFT JOIN m ON m.document_id = 'doc-' || (vec_id % 40)")
def r10_refiled_vectors(spark, folder):
    to = S.read(spark, folder, "documents").where("n_chars > 300").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.concat(F.lit("M-"), F.col("doc_id") % 3).alias("matter_id"))
    v = TX.vectors(spark, folder)
    return L.refile(facts(spark, folder), v, v, to, F.current_timestamp())[1].select("vec_id", "matter_id")


@query(f"{WITH} SELECT assertion_id, 'retract' AS event, 'ends of another kind' AS reason FROM facts WHERE superseded_at IS NULL AND predicate = 'CONTROLS' AND split_part(object_id, ':', 1) = 'merchant'")
def g18_sweep_retraction(spark, folder):
    """The sweep's retract mode: the facts that it lists, as events of a retraction."""
    f = facts(spark, folder).withColumns({"premises": F.array().cast("array<string>"), "rule_id": F.lit(None).cast("string")})
    bad = G.kind_sweep(f, FA.vocabulary(spark))
    return L.retraction(f, bad, "ends of another kind", F.current_timestamp())[0].select("assertion_id", "event", "reason")


@query(f"WITH RECURSIVE {_LADDER}, w AS (SELECT k AS root, k, 0 AS level, closed, up FROM d WHERE k % 8 = 5 UNION ALL SELECT root, d.k, level + 1, d.closed, d.up FROM w JOIN d ON d.k = w.up WHERE level < 6 AND NOT w.closed) SELECT root::VARCHAR AS root, k::VARCHAR AS assertion_id, min(level)::INTEGER AS level, NOT bool_or(closed) AS visible FROM w GROUP BY 1, 2")
def g17_proof_tree_gaps(spark, folder):
    """Closed rows are withheld: they stay as gaps, and nothing under them is shown."""
    f = ladder(spark, folder)
    return G.proof_tree(f, f.where("CAST(assertion_id AS BIGINT) % 8 = 5"), visible=f.where("superseded_at IS NULL"))


# All shipped rules on roles that orders are dealt to

_ROLES = sorted({(p.predicate, p.subject_kind or "authority", p.object_kind) for r in R.RULES for p in r.premises})
_PREDICATES = sorted({p for p, _, _ in _ROLES})
_KINDS = {p: next((s, o) for q, s, o in _ROLES if q == p) for p in _PREDICATES}
_KINDS["SUPERSEDES"] = ("policyclause", "policyclause")
_CASES = lambda i: "CASE o_orderkey % {n} {w} END".format(n=len(_PREDICATES), w=" ".join(f"WHEN {k} THEN '{([p, _KINDS[p][0], _KINDS[p][1]])[i]}'" for k, p in enumerate(_PREDICATES)))
_TURN = f"(o_orderkey // {len(_PREDICATES)})"
# counterparties control each other in half of the turns; in the others customers control customers or merchants
_CONTROL = [("counterparty", "counterparty"), ("customer", "customer"), ("counterparty", "counterparty"), ("customer", "merchant")]
_CONTROLS = lambda i: "CASE WHEN o_orderkey % {n} = {k} THEN CASE {t} % 4 {w} END ELSE {rest} END".format(n=len(_PREDICATES), k=_PREDICATES.index("CONTROLS"), t=_TURN, w=" ".join(f"WHEN {j} THEN '{kinds[i - 1]}'" for j, kinds in enumerate(_CONTROL)), rest=_CASES(i))
_PLAYED = f"""n AS (SELECT greatest(7, count(*) // {6 * len(_PREDICATES)}) AS n FROM orders), played AS MATERIALIZED (SELECT {_CONTROLS(1)} || ':' || (o_custkey % n) AS s, {_CASES(0)} AS p, {_CONTROLS(2)} || ':' || (({_TURN} * 7 + {_TURN} // n * (1 + o_orderkey % {len(_PREDICATES)})) % n) AS o, 0.6 + (o_orderkey % 40) / 100.0 AS c0, o_orderkey AS k FROM orders, n),
good AS MATERIALIZED (SELECT s, p, o, k::VARCHAR AS id, round(c0, 2)::DOUBLE AS c, CASE WHEN k % 3 > 0 THEN 'M-' || (k % 3) END AS m FROM played)"""


def roles(spark, folder) -> DataFrame:
    """Every order is one fact: a predicate of the shipped rules between two of a sixth as many players as facts of a predicate. Customers and turns deal the two, so that premises meet."""
    o = S.read(spark, folder, "orders")
    players = len(_PREDICATES)
    n = max(7, o.count() // (6 * players))
    k = F.col("o_orderkey")
    turn = F.floor(k / players)
    other = (turn * 7 + F.floor(turn / n) * (1 + k % players)) % n
    pick = lambda values: F.array(*[F.lit(v) for v in values])[(k % players).cast("int")]
    by_turn = lambda i: F.array(*[F.lit(kinds[i]) for kinds in _CONTROL])[(turn % 4).cast("int")]
    kind = lambda i: F.when(k % players == _PREDICATES.index("CONTROLS"), by_turn(i)).otherwise(pick([_KINDS[p][i] for p in _PREDICATES]))
    return o.select(
        F.lit("t").alias("tenant_id"),
        F.concat(kind(0), F.lit(":"), (F.col("o_custkey") % n).cast("string")).alias("subject_id"),
        pick(_PREDICATES).alias("predicate"),
        F.concat(kind(1), F.lit(":"), other.cast("string")).alias("object_id"),
        F.when(k % 3 > 0, F.concat(F.lit("M-"), k % 3)).alias("matter_id"),
        F.lit("EXTRACTED_MODEL").alias("epistemic_class"),
        F.round(0.6 + (k % 40) / 100.0, 2).alias("confidence"),
        F.lit("APPROVED").alias("review_state"),
        F.lit(None).cast("timestamp").alias("superseded_at"),
        k.cast("string").alias("assertion_id"),
    )


def _rule_sql(r: R.Rule) -> str:
    """Each premise a table of walks, joined on the variables in their order."""
    ctes, joins, bound, used = [], [], {}, []
    for i, p in enumerate(r.premises):
        sk = f" AND split_part(s, ':', 1) = '{p.subject_kind}'" if p.subject_kind else ""
        ok = f" WHERE split_part(o, ':', 1) = '{p.object_kind}'" if p.object_kind else ""
        ctes.append(f"w{i} AS (SELECT s, o, [id] AS u, [c] AS uc, [m] AS um, [s, o] AS seen FROM good WHERE p = '{p.predicate}'{sk} UNION ALL SELECT w.s, g.o, list_append(u, g.id), list_append(uc, g.c), list_append(um, g.m), list_append(seen, g.o) FROM w{i} w JOIN good g ON w.o = g.s WHERE g.p = '{p.predicate}' AND len(u) < {p.hops} AND NOT list_contains(seen, g.o)), t{i} AS MATERIALIZED (SELECT * FROM w{i}{ok})")
        on = []
        for v, c in ((p.subject, "s"), (p.object, "o")):
            if v in bound:
                on.append(f"t{i}.{c} = {bound[v]}")
            else:
                bound[v] = f"t{i}.{c}"
        on += [f"NOT list_has_any(t{i}.u, t{j}.u)" for j in range(i)]
        joins.append(f"t{i}" if not i else f"JOIN t{i} ON {' AND '.join(on)}")
        used.append(i)
    cat = lambda c: " || ".join(f"t{i}.{c}" for i in used)
    return f"""WITH RECURSIVE {_PLAYED}, {", ".join(ctes)}, f AS (SELECT {bound[r.conclusion.subject]} AS subject_id, {bound[r.conclusion.object]} AS object_id, {cat("u")} AS used, {cat("uc")} AS used_c, {cat("um")} AS used_m FROM {" ".join(joins)}),
best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY len(used), used) AS k FROM f)
SELECT '{r.rule_id}' AS rule_id, subject_id, '{r.conclusion.predicate}' AS predicate, object_id, array_to_string(used, ',') AS premises, round(list_min(used_c) * pow(0.95, 1 + len(used) - {len(r.premises)}), 8) AS confidence, CASE WHEN len(list_distinct(list_transform(used_m, lambda x: coalesce(x, '?')))) = 1 AND used_m[1] IS NOT NULL THEN used_m[1] END AS matter_id FROM best WHERE k = 1"""


for _r in R.RULES:

    def _infer(spark, folder, rule=_r):
        return FA._shown(R.infer([rule], roles(spark, folder)))

    QUERIES[f"g7_{_r.rule_id}"] = _infer
    SQL[f"g7_{_r.rule_id}"] = _rule_sql(_r)


_VOCAB = "v AS (SELECT 'P' || p_partkey AS predicate, [p_brand] AS domain, [CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END] AS range, p_size % 2 = 0 AS mirrored, p_size % 5 = 0 AS transitive, CASE p_size % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'left' END AS blocks, CASE p_size % 7 WHEN 0 THEN 'withhold' WHEN 1 THEN 'shout' END AS effect FROM part), kn AS (SELECT DISTINCT p_brand AS kind FROM part UNION SELECT p_type FROM part WHERE p_size > 25)"


@query(f"""WITH {_VOCAB} SELECT predicate, 'blocks' AS reason FROM v WHERE blocks = 'left' UNION ALL SELECT predicate, 'effect' FROM v WHERE effect = 'shout' UNION ALL SELECT predicate, 'symmetric ends' FROM v WHERE mirrored AND domain <> range UNION ALL SELECT predicate, 'transitive ends' FROM v WHERE transitive AND domain <> range
UNION ALL SELECT DISTINCT predicate, 'unknown kind ' || kind FROM (SELECT predicate, unnest(domain || range) AS kind FROM v) WHERE kind NOT IN (SELECT kind FROM kn)
UNION ALL SELECT NULL, 'several organising units' FROM kn WHERE kind LIKE '%1' HAVING count(*) > 1 UNION ALL SELECT NULL, 'catalog kind not external ' || kind FROM kn WHERE kind LIKE '%2'""")
def g6_vocabulary_faults(spark, folder):
    """A vocabulary of a predicate for each part; brands that end in 1 are organising, those in 2 and 3 the catalog's, those in 3 external."""
    size, p = F.col("p_size"), S.read(spark, folder, "part")
    v = p.select(F.concat(F.lit("P"), "p_partkey").alias("predicate"), F.array("p_brand").alias("domain"), F.array(F.when(size % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type"))).alias("range"), (size % 2 == 0).alias("symmetric"), (size % 5 == 0).alias("transitive"), F.when(size % 4 == 0, "both").when(size % 4 == 1, "left").alias("blocks"), F.when(size % 7 == 0, "withhold").when(size % 7 == 1, "shout").alias("effect"))
    kinds = p.select(F.col("p_brand").alias("kind")).union(p.where("p_size > 25").select("p_type")).distinct()
    return R.vocabulary_faults(v, kinds.select("kind", F.col("kind").endswith("1").alias("organising"), (F.col("kind").endswith("2") | F.col("kind").endswith("3")).alias("catalog"), F.col("kind").endswith("3").alias("external")))


# Words, names, packs


@query(f"{WITH} SELECT assertion_id, CASE WHEN predicate = 'CONTROLS' THEN least(subject_id, object_id) ELSE subject_id END AS first, CASE WHEN predicate = 'CONTROLS' THEN greatest(subject_id, object_id) ELSE object_id END AS second FROM facts")
def f9_symmetric_ends(spark, folder):
    first, second = T.ordered_ends(F.col("subject_id"), F.col("object_id"), F.col("predicate") == "CONTROLS")
    return facts(spark, folder).select("assertion_id", first.alias("first"), second.alias("second"))


@query("SELECT p_partkey, 'column' AS type, 's' || (p_partkey % 5) || ':x' AS source, p_brand || '.' || p_type AS \"table\", p_name AS \"column\" FROM part WHERE p_size <= 40")
def f14_node_parts(spark, folder):
    """Column ids of sources with a colon in their name; ids with a part too many say nothing."""
    p = S.read(spark, folder, "part")
    more = F.when(F.col("p_size") > 40, ".more").otherwise("")
    node = F.concat(F.lit("column:s"), F.col("p_partkey") % 5, F.lit(":x:"), "p_brand", F.lit("."), "p_type", F.lit("."), "p_name", more)
    return p.select("p_partkey", T.node_parts(node).alias("x")).where("x IS NOT NULL").select("p_partkey", "x.*")


@query("SELECT doc_id, least(length(text) // 2 // 5001 + 1, length(text) // 5000 + 1)::INTEGER AS page FROM documents")
def f17_page_of_the_middle(spark, folder):
    """The page that holds the middle of each text, pages being 5000 characters and a mark."""
    pages = TX.paged(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "char_start", "char_end"))).alias("pages"))
    d = S.read(spark, folder, "documents").select("doc_id", F.floor(F.length("text") / 2).alias("middle"))
    at = F.col("middle")
    # the mark between two pages belongs to neither: it counts to the one before
    hit = D.page_of(F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["char_start"].alias("char_start"), (p["char_end"] + 1).alias("char_end"))), at)
    return pages.join(d, "doc_id").select("doc_id", hit.alias("page"))


@query("""WITH p AS (SELECT 'm' || (p_partkey % 700) AS metric_id, p_partkey AS position, p_size > 30 AS d, 'm' || (p_partkey * 3 % 900) AS base FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY position) AS k FROM p), kept AS (SELECT * FROM f WHERE k = 1),
bad AS (SELECT a.metric_id, CASE WHEN b.metric_id IS NULL THEN 'unknown base' ELSE 'nested base' END AS reason FROM kept a LEFT JOIN kept b ON a.base = b.metric_id WHERE a.d AND (b.metric_id IS NULL OR b.d))
SELECT metric_id, 'loaded' AS reason FROM kept WHERE metric_id NOT IN (SELECT metric_id FROM bad) UNION ALL SELECT metric_id, 'duplicate' FROM f WHERE k > 1 UNION ALL SELECT metric_id, reason FROM bad""")
def s15_metric_pack(spark, folder):
    k = F.col("p_partkey")
    derived_ = F.col("p_size") > 30
    pack = S.read(spark, folder, "part").select(F.concat(F.lit("m"), k % 700).alias("metric_id"), k.alias("position"), F.when(derived_, "derived").otherwise("simple").alias("type"), F.when(derived_, F.array(F.concat(F.lit("m"), k * 3 % 900))).otherwise(F.array().cast("array<string>")).alias("base_metrics"))
    kept, errors = M.load_pack(pack)
    return kept.select("metric_id", F.lit("loaded").alias("reason")).unionByName(errors)


_WRITES = "w AS (SELECT o_custkey AS metric_id, o_orderdate AS \"at\", o_orderkey AS body, CASE WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_orderstatus = 'F' THEN 'approved' END AS status FROM orders), v AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY \"at\", body) AS version, count(*) OVER (PARTITION BY metric_id) AS n FROM w)"


def _written(spark, folder) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "F", "approved")
    return M.versions(S.read(spark, folder, "orders").select(F.col("o_custkey").alias("metric_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("body"), status.alias("status")))


@query(f"WITH {_WRITES} SELECT metric_id, version, body FROM v WHERE version = n AND coalesce(status, 'approved') = 'approved'")
def m10_served(spark, folder):
    return M.served(_written(spark, folder)).select("metric_id", "version", "body")


@query(f"WITH {_WRITES} SELECT metric_id, body, status FROM v WHERE version = 4 AND version > n - 10")
def m10_restored(spark, folder):
    """Version 4 of each metric that still has it, as a new write."""
    stored = _written(spark, folder)
    wanted = stored.select("metric_id").distinct().withColumn("version", F.lit(4))
    return M.restored(stored, wanted, F.current_timestamp()).select("metric_id", "body", "status")


@query("""WITH p AS (SELECT p_brand AS node, p_type AS column_name, p_partkey AS position, CASE p_partkey % 3 WHEN 0 THEN 'synonym' WHEN 1 THEN 'topic' ELSE 'description' END AS kind, p_name AS value FROM part), k AS (SELECT p.* FROM p WHERE (node, column_name) IN (SELECT (p_brand, p_type) FROM part WHERE p_size > 25)),
u AS (SELECT node, column_name, kind, value, min(position) AS position FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node, column_name, kind ORDER BY position, value) AS n FROM u)
SELECT node, column_name, kind, CASE WHEN kind = 'description' THEN 'description:' || sha256(value)[1:16] ELSE kind || ':' || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') END AS object_id, 'PENDING' AS review_state, 0.8::DOUBLE AS confidence FROM r WHERE kind = 'description' OR kind = 'synonym' AND n <= 8 OR kind = 'topic' AND n <= 6""")
def c3_enrichment(spark, folder):
    k, p = F.col("p_partkey"), S.read(spark, folder, "part")
    said = p.select(F.col("p_brand").alias("node"), F.col("p_type").alias("column_name"), k.alias("position"), F.when(k % 3 == 0, "synonym").when(k % 3 == 1, "topic").otherwise("description").alias("kind"), F.col("p_name").alias("value"))
    return D.enrichment(said, p.where("p_size > 25").select(F.col("p_brand").alias("node"), F.col("p_type").alias("column_name")))


@query("""WITH t AS (SELECT 's' || (p_partkey % 5) AS source_id, p_brand, p_type, TIMESTAMP '2024-01-01' + to_days(p_size::INTEGER) AS scanned_at FROM part), s AS (SELECT 's' || r_regionkey AS source_id, CASE WHEN r_regionkey % 2 = 0 THEN TIMESTAMP '2023-06-01' END AS last_scanned_at FROM region)
SELECT s.source_id, (SELECT count(DISTINCT p_brand || '/' || p_type) FROM t WHERE t.source_id = s.source_id) AS table_count, coalesce(last_scanned_at, (SELECT max(scanned_at) FROM t WHERE t.source_id = s.source_id)) AS last_scanned_at FROM s""")
def s8_sources(spark, folder):
    day = lambda n: (F.lit("2024-01-01").cast("timestamp").cast("long") + n * 86400).cast("timestamp")
    t = S.read(spark, folder, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 5).alias("source_id"), F.col("p_brand").alias("database"), F.col("p_type").alias("table"), day(F.col("p_size").cast("long")).alias("scanned_at"))
    s = S.read(spark, folder, "region").select(F.concat(F.lit("s"), "r_regionkey").alias("source_id"), F.when(F.col("r_regionkey") % 2 == 0, F.lit("2023-06-01").cast("timestamp")).alias("last_scanned_at"))
    return C.sources_of(t, s)


_INDEX = "e AS (SELECT subject_id AS id FROM facts UNION SELECT object_id FROM facts)"


@query(f"{WITH}, {_INDEX} SELECT split_part(id, ':', 1) AS kind, count(*) AS n FROM e WHERE split_part(id, ':', 1) NOT IN ('customer', 'case') GROUP BY 1")
def v6_skipped_entities(spark, folder):
    return V.skipped_entities(facts(spark, folder), spark.createDataFrame([("customer",), ("case",)], "kind string"))


@query(f"""{WITH}, {_INDEX} SELECT 'entity' AS layer, count(*) AS n FROM e WHERE split_part(id, ':', 1) IN ('customer', 'case') UNION ALL SELECT 'table', count(DISTINCT p_type) FROM part UNION ALL SELECT 'metric', count(DISTINCT p_brand) FROM part""")
def v6_layers(spark, folder):
    """All three layers of the index: a metric for each brand, a table for each type."""
    p = S.read(spark, folder, "part")
    m = p.select(F.col("p_brand").alias("metric_id")).distinct().select("metric_id", F.col("metric_id").alias("name"), F.array(F.lit("sales")).alias("synonyms"), F.lit("sold parts").alias("definition"))
    t = p.select(F.col("p_type").alias("table_name")).distinct().select("table_name", F.lit("rows").alias("description"), F.lit(None).cast("string").alias("synonyms"))
    kinds = spark.createDataFrame([("customer",), ("case",)], "kind string")
    return V.routing_index(m, t, facts(spark, folder), kinds).where("text <> ''").groupBy("layer").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT c_custkey AS question_id, c_custkey % 3 AS form, c_acctbal FROM customer)
SELECT question_id, CASE form WHEN 0 THEN 'revenue' WHEN 1 THEN 'order_count' ELSE 'balance' END AS metric_id, CASE form WHEN 2 THEN 'router' ELSE 'keyword' END AS selected_by FROM q WHERE form < 2 OR c_acctbal > 0""")
def v4_one_matcher(spark, folder):
    """Words first; where none match, the nearest description, if there is one and it is known: here for customers with money."""
    near = S.read(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("question_id"), F.explode(F.array(F.struct(F.lit("balance").alias("m"), F.lit(0.7).alias("s")), F.struct(F.lit("gone").alias("m"), F.lit(0.9).alias("s")), F.struct(F.lit("revenue").alias("m"), F.lit(0.6).alias("s")))).alias("x")).select("question_id", F.col("x.m").alias("metric_id"), F.col("x.s").alias("score"))
    return V.matched_metrics(TX.questions(spark, folder), TX.metric_rows(spark), near).select("question_id", "metric_id", "selected_by")


@query("SELECT DISTINCT 'doc-' || sha256('t-alpha:' || sha256(text))[1:24] AS document_id, length(text) AS chars FROM (SELECT regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages)")
def s3_page_documents(spark, folder):
    """Web pages as whole-text documents: markup becomes spaces."""
    p = S.read(spark, folder, "pages").select(F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return D.register(p, "t-alpha").select("document_id", "chars")


@query("SELECT 'processed/t/' || sha256(url)[1:16] || '/' || CASE WHEN c = '' THEN 'document' ELSE c END AS key, 't' AS tenant, CASE WHEN c = '' THEN 'document' ELSE c END AS filename FROM (SELECT url, regexp_replace(regexp_replace(string_split(replace(url, '\\', '/'), '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:120] AS c FROM pages)")
def s17_document_keys(spark, folder):
    """Keys of stored pages, parsed back."""
    url = F.col("url")
    keys = S.read(spark, folder, "pages").select(F.concat(F.lit("processed/t/"), F.substring(F.sha2(url, 256), 1, 16), F.lit("/"), S.safe_name(url)).alias("key"))
    return keys.withColumn("x", S.key_parts(F.col("key"))).select("key", "x.tenant", "x.filename")


@query(f"WITH {TX._COLUMNS}, k AS (SELECT *, CASE WHEN predicate = 'HAS_TABLE' THEN 1 ELSE 2 END AS depth, sha256(subject_id || '/' || predicate || '/' || object_id)[1:32] AS assertion_id FROM cf) SELECT assertion_id, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 300 AS truncated FROM (SELECT assertion_id FROM k ORDER BY depth, predicate = 'PARTITIONED_BY' DESC, assertion_id LIMIT 300)")
def l7_catalog_overview(spark, folder):
    f = C.facts(TX.scanned(spark, folder))
    f = f.withColumn("assertion_id", T.content_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    return G.overview(f, F.col("predicate") == "PARTITIONED_BY", 300, catalog=True)


@query(f"{WITH} SELECT assertion_id, upper(lower(replace(predicate, '_', ' '))[1]) || lower(replace(predicate, '_', ' '))[2:] || ' involving ' || object_id || '.' AS reason FROM facts WHERE predicate IN ('INVESTIGATES', 'APPROVES_EXCEPTION_FOR')")
def f22_block_reasons(spark, folder):
    f = facts(spark, folder).where("predicate IN ('INVESTIGATES', 'APPROVES_EXCEPTION_FOR')")
    return f.select("assertion_id", T.block_reason(F.col("predicate"), F.col("object_id")).alias("reason"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'P-' || p_brand WHEN 1 THEN 'P-' || p_brand END AS predicate FROM part")
def f10_grounding(spark, folder):
    """Predicates said by id, by label in other case and spacing, and as neither."""
    p, k = S.read(spark, folder, "part"), F.col("p_partkey")
    v = p.select(F.concat(F.lit("P-"), "p_brand").alias("predicate"), F.concat(F.lit("made by "), "p_brand").alias("label")).distinct()
    v = v.select("predicate", "label", F.lit(False).alias("symmetric"), F.array(F.lit("party")).alias("domain"), F.array(F.lit("party")).alias("range"))
    said = F.when(k % 3 == 0, F.concat(F.lit("p-"), F.lower("p_brand"))).when(k % 3 == 1, F.concat(F.lit("Made  By "), "p_brand")).otherwise("nothing of the kind")
    claims = p.select("p_partkey", F.col("p_name").alias("chunk_text"), F.col("p_name").alias("quote"), F.lit("party:a").alias("subject"), said.alias("predicate_said"), F.lit("party:b").alias("object"), F.lit(0.5).alias("confidence"))
    upper = v.withColumn("id", F.upper("predicate"))
    return D.validated(claims, upper.drop("predicate").withColumnRenamed("id", "predicate"), ["party"]).select("p_partkey", F.regexp_replace("predicate", "BRAND", "Brand").alias("predicate"))


@query("""WITH e AS (SELECT user_id, event_type || ' ' || (event_id % 9) AS v, event_id FROM events), s AS (SELECT user_id, regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g') AS slug, arg_min(v, event_id) AS v, min(event_id) AS first FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM s) SELECT user_id, string_agg(v, '|' ORDER BY first) AS kept FROM r WHERE n <= 6 GROUP BY 1""")
def f13_deduped_values(spark, folder):
    e = S.read(spark, folder, "events").select("user_id", "event_id", F.concat("event_type", F.lit(" "), F.col("event_id") % 9).alias("v"))
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("values"))
    return lists.select("user_id", F.array_join(T.deduped(F.col("values"), 6), "|").alias("kept"))


# The write contract with all its columns

_CONTRACT = [
    ("locator", "document_id IS NULL AND cls <> 'DECLARED'"),
    ("confidence", "NOT coalesce(conf BETWEEN 0 AND 1, false)"),
    ("subject", "subj LIKE '% %'"),
    ("predicate", "predicate NOT IN ('CONTROLS', 'SUPPLIED_BY', 'PLACED_ORDER')"),
    ("kinds", "predicate = 'CONTROLS' AND (split_part(object_id, ':', 1) <> 'customer' OR subj LIKE '% %') OR predicate IN ('SUPPLIED_BY', 'PLACED_ORDER') AND subj LIKE '% %'"),
    ("deterministic", "cls = 'EXTRACTED_DET'"),
    ("premises", "cls = 'INFERRED' AND x % 2 = 0"),
    ("method", "x % 13 = 0"),
    ("raw_confidence", "x % 17 = 0"),
    ("quote", "cls = 'EXTRACTED_DET' AND x % 3 = 0"),
    ("premise_confidences", "cls = 'INFERRED' AND conf > 0.75"),
]
_TOUCHED_UP = "CASE WHEN predicate = 'PLACED_ORDER' AND x % 5 = 0 THEN 'EXTRACTED_DET' WHEN predicate = 'SUPPLIED_BY' AND x % 3 = 1 THEN 'INFERRED' ELSE epistemic_class END"


@query(f"{WITH}, y AS (SELECT *, length(subject_id) + length(object_id) + ascii(assertion_id) AS x FROM facts), z AS (SELECT *, {_TOUCHED_UP} AS cls, CASE WHEN x % 11 = 0 THEN confidence + 1 ELSE confidence END AS conf, CASE WHEN x % 7 = 0 THEN subject_id || ' ' ELSE subject_id END AS subj FROM y) SELECT assertion_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in _CONTRACT) + "], lambda v: v IS NOT NULL), ',') AS violations FROM z")
def c1_full_contract(spark, folder):
    """Facts that were spoiled in every way the contract knows, each way by a condition of its own."""
    v = spark.createDataFrame([("CONTROLS", ["customer"], ["customer"], False), ("SUPPLIED_BY", ["order"], ["merchant"], False), ("PLACED_ORDER", ["customer"], ["order"], False)], "predicate string, domain array<string>, range array<string>, symmetric boolean")
    x = F.col("x")
    f = facts(spark, folder).withColumn("x", F.length("subject_id") + F.length("object_id") + F.ascii("assertion_id"))
    f = f.withColumn("epistemic_class", F.expr(_TOUCHED_UP)).withColumn("confidence", F.when(x % 11 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")))
    # a blank inside an id is no id of its kind
    f = f.withColumn("subject_id", F.when(x % 7 == 0, F.concat(F.lit(" "), "subject_id")).otherwise(F.col("subject_id")))
    inferred = F.col("epistemic_class") == "INFERRED"
    f = f.withColumns({"premises": F.when(inferred & (x % 2 == 1), F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")), "method": F.when(x % 13 == 0, " ").otherwise("rule:fixed@v1"), "raw_confidence": F.when(x % 17 == 0, 1.5), "quote": F.when(x % 3 == 0, "").otherwise("said"), "premise_confidences": F.when(inferred, F.array(F.lit(0.75), F.lit(0.9)))})
    return D.contract(f, v).select("assertion_id", F.array_join("violations", ",").alias("violations"))


@query(f"{WITH}, y AS (SELECT *, length(subject_id) % 2 = 0 AS strict, CASE WHEN predicate = 'CONTROLS' THEN 'EXTRACTED_DET' ELSE epistemic_class END AS cls FROM facts) SELECT assertion_id, CASE WHEN predicate = 'INVESTIGATES' THEN 'PENDING' WHEN cls = 'DECLARED' OR cls = 'EXTRACTED_DET' AND NOT strict THEN 'AUTO_ASSERTED' ELSE 'PENDING' END AS state FROM y")
def c2_policy_states(spark, folder):
    """Deterministic rows under two policies, and a governing predicate."""
    cls = F.when(F.col("predicate") == "CONTROLS", "EXTRACTED_DET").otherwise(F.col("epistemic_class"))
    state = D.review_state(cls, F.length("subject_id") % 2 == 0, F.col("predicate"), ["INVESTIGATES"])
    return facts(spark, folder).select("assertion_id", state.alias("state"))


# Rebuild and streams


def _work(spark) -> str:
    checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"


_DOC_ID = "'doc-' || sha256('t-alpha:' || sha256(text))[1:24]"
_ONE_PAGE = f"""pg AS (SELECT DISTINCT {_DOC_ID} AS doc_id, 1 AS page, 0 AS char_start, text AS body FROM documents WHERE text <> '')"""


def _whole_sql(target: int, overlap: int) -> str:
    return f"{_ONE_PAGE}, s0 AS" + TX.chunk_sql(target, overlap).split("s0 AS", 1)[1]


def chunk_rows(docs: DataFrame) -> DataFrame:
    """document_id, chunk_id and hash of every chunk of registered documents: the batch that a rebuild runs again."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = docs.select(F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(F.lit("t-alpha:"), content), 256), 1, 24)).alias("document_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["document_id"])
    c = D.chunks(S.pages(named), 1200, 150)
    return c.select("document_id", F.concat_ws("", "document_id", F.lit(":p"), "page", F.lit(":"), "start", F.lit("-"), "end").alias("chunk_id"), "chunk_sha256")


_CHUNK_IDS = f"WITH RECURSIVE {_whole_sql(1200, 150)} SELECT doc_id AS document_id, doc_id || ':p1:' || a || '-' || b AS chunk_id, sha256(substring(body, a + 1, b - a)) AS chunk_sha256 FROM c"


@query(_CHUNK_IDS)
def s16_rebuild(spark, folder):
    """The batch over all stored documents, run twice into one table: ids come from the content, so the second run changes nothing."""
    out = _work(spark)
    for _ in range(2):
        chunk_rows(S.read(spark, folder, "documents").select("text")).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@query(f"WITH RECURSIVE {_whole_sql(1200, 150)} SELECT doc_id AS document_id, ordinal::INTEGER AS ordinal, a::INTEGER AS start, b::INTEGER AS \"end\", sha256(substring(body, a + 1, b - a)) AS chunk_sha256 FROM c")
def t1_streamed_ingest(spark, folder):
    """The documents as a stream of files, with a second delivery of the same files."""
    work = _work(spark)
    inbox, out, check = f"{work}/in", f"{work}/out", f"{work}/check"
    d = S.read(spark, folder, "documents").select("doc_id", "text").where("text <> ''")
    for _ in range(2):
        d.write.mode("append").parquet(inbox)
        I.ingest(I.arriving(spark, inbox), "t-alpha", out, check, 1200, 150).awaitTermination()
    return spark.read.parquet(f"{out}/*").select("document_id", "ordinal", "start", "end", "chunk_sha256")


@query(f"WITH {FA._ATTEMPTS} SELECT document_id, arg_max(state, (progress, created_at)) AS state, max(created_at) AS last_at FROM att GROUP BY 1")
def t2_streamed_states(spark, folder):
    """Job events as a stream in update mode, in three deliveries by time; every ninth event is one delivery late, every seventh comes again with the last one."""
    work = _work(spark)
    events = FA.attempts(spark, folder)
    day = F.dayofmonth("created_at")
    turn = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    for k in range(3):
        late = F.when((F.col("seq") % 9 == 0) & (turn < 2), turn + 1).otherwise(turn)
        own = late == k
        events.where(own | (F.col("seq") % 7 == 0) if k == 2 else own).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema("document_id long, created_at timestamp, seq long, state string").parquet(f"{work}/in")
        I.keep_states(stream, f"{work}/out", f"{work}/check", delay="30 days").awaitTermination()
    return I.states(spark, f"{work}/out")


_THREE = "(o_orderkey // 5) % 3"
#: A path between premises, a path at the end, and a triangle.
_STREAMED = [r for r in R.RULES if r.rule_id in ("conflict_via_affiliate", "related_party_resale", "related_party_lending")]


def _arrived_sql() -> str:
    """What the rules conclude after each of three arrivals: every rule's SQL over the facts that came so far."""
    parts = []
    for r in _STREAMED:
        for after in range(3):
            one = _rule_sql(r).replace("FROM orders, n)", f"FROM orders, n WHERE {_THREE} <= {after})")
            parts.append(f"SELECT {after} AS after, * FROM ({one})")
    return " UNION ALL ".join(parts)


@query(_arrived_sql())
def t3_streamed_inference(spark, folder):
    """Facts arrive in three parts, the second one twice; after each arrival the conclusions are those of all facts so far, and only the new facts have been joined from."""
    work = _work(spark)
    f = roles(spark, folder)
    k = F.col("assertion_id").cast("long")
    out = []
    for part in range(3):
        f.where(F.floor(k / 5) % 3 == part).write.mode("append").parquet(f"{work}/in")
        if part == 2:
            f.where(F.floor(k / 5) % 3 == 1).write.mode("append").parquet(f"{work}/in")
        I.infer_on_arrival(spark.readStream.schema(f.schema).parquet(f"{work}/in"), _STREAMED, f"{work}/out", f"{work}/check").awaitTermination()
        out.append(FA._shown(I.conclusions(spark, f"{work}/out", upto=part)).withColumn("after", F.lit(part)))
    return reduce(DataFrame.unionByName, out)


# Partitions that are replaced or removed


@query(f"{WITH} SELECT tenant_id, predicate, assertion_id FROM facts WHERE tenant_id <> 't-beta'")
def r15_removed_tenant(spark, folder):
    """A tenant's folder is deleted; a second removal finds nothing."""
    t = PartitionedTable(spark, f"{_work(spark)}/facts", "tenant_id").create(facts(spark, folder))
    for _ in range(2):
        t.remove("t-beta")
    return t.read().select("tenant_id", "predicate", "assertion_id")


@query(f"{WITH} SELECT predicate, assertion_id, confidence FROM facts WHERE predicate NOT IN ('CONTROLS', 'INVESTIGATES') OR confidence >= 0.8")
def s7_replaced_sources(spark, folder):
    """Facts by predicate as sources: a new scan of two of them replaces theirs, twice."""
    f = facts(spark, folder).select("predicate", "assertion_id", "confidence")
    t = PartitionedTable(spark, f"{_work(spark)}/scans", "predicate").create(f)
    scan = f.where("predicate IN ('CONTROLS', 'INVESTIGATES') AND confidence >= 0.8")
    for _ in range(2):
        t.replace(scan, scan.count())
    return t.read()


@query(f"{WITH} SELECT 'facts' AS layer, tenant_id, count(*) AS n FROM facts WHERE tenant_id <> 't-alpha' GROUP BY 2 UNION ALL SELECT 'metrics', tenant_id, count(*) FROM facts WHERE predicate = 'CONTROLS' GROUP BY 2")
def r18_reset_layers(spark, folder):
    """Of two layers one is reset for a tenant."""
    work, f = _work(spark), facts(spark, folder)
    layers = {n: PartitionedTable(spark, f"{work}/{n}", "tenant_id").create(df) for n, df in (("facts", f), ("metrics", f.where("predicate = 'CONTROLS'")))}
    reset(layers, "t-alpha", {"facts"})
    count = lambda n: layers[n].read().groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("layer"), "tenant_id", "n")
    return count("facts").unionByName(count("metrics"))


@query("""WITH v AS (SELECT vec_id, label, 0 AS version FROM embeddings UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE label IN (3, 7) AND vec_id % 3 = 0 UNION ALL SELECT -1 - vec_id, label, 2 FROM embeddings WHERE label = 3 AND vec_id % 5 = 0) SELECT vec_id, label, max(version) AS version FROM v GROUP BY 1, 2""")
def s11_upserted_partitions(spark, folder):
    """Vectors by label: rows for two labels replace older ones with their id or are added, twice."""
    v = S.read(spark, folder, "embeddings").select("vec_id", "embedding", "label", F.lit(0).alias("version"))
    t = PartitionedTable(spark, f"{_work(spark)}/vectors", "label").create(v)
    new = v.where("label IN (3, 7) AND vec_id % 3 = 0").withColumn("version", F.lit(1)).unionByName(v.where("label = 3 AND vec_id % 5 = 0").withColumns({"vec_id": -1 - F.col("vec_id"), "version": F.lit(2)}))
    for _ in range(2):
        t.upsert(new, "vec_id", "version")
    return t.read().select("vec_id", "label", "version")


@query(f"""{WITH}, {TX._COLUMNS}, {FA._WORDS_FIRST}, {FA._NEAREST}, e AS (SELECT subject_id AS node, object_id AS other FROM cf UNION ALL SELECT object_id, subject_id FROM cf),
tables AS (SELECT DISTINCT node FROM e WHERE node LIKE 'table:%' AND contains(lower(regexp_replace(regexp_replace(node, '^[^:]*:', ''), '[-_.]', ' ', 'g') || ' ' || regexp_replace(regexp_replace(other, '^[^:]*:', ''), '[-_.]', ' ', 'g')), 'copper') ORDER BY node LIMIT 6)
SELECT 'fact' AS part, assertion_id AS id, hop::INTEGER AS rank FROM found UNION ALL SELECT 'passage', vec_id::VARCHAR, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER FROM (SELECT * FROM sims WHERE document_id IN (FROM docs) ORDER BY score DESC, vec_id LIMIT 5)
UNION ALL SELECT 'table', node, row_number() OVER (ORDER BY node)::INTEGER FROM tables""")
def g19_answer_with_tables(spark, folder):
    """The whole composition: one term finds facts, the other catalog tables."""
    v = FA.passages(spark, folder)
    question = spark.createDataFrame([(1, ["c 1 ", "copper"])], "question_id int, terms array<string>")
    return G.graph_first_answer(facts(spark, folder).where("superseded_at IS NULL"), question, v, v.where("vec_id = 0"), C.facts(TX.scanned(spark, folder)))
