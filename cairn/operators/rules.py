"""Rules: multi-way joins over trusted facts that derive facts with their premises.

A premise binds two variables; a path premise walks 1 to ``hops`` edges of a transitive predicate. Bindings grow by one premise
after the other, joined on the variables that are bound already. Used facts travel along as an array, so that no fact
stands for two premises and no walk visits a node twice; those are residual conditions of equi joins.

Conclusions ask for the best proof only: fewest facts, then the first by their ids. So a path premise walks from the ends that are bound, or that another
premise can bind, and keeps one walk for each pair of ends and number of hops: a part of a best walk is a best walk itself. Where a premise could share facts with a
path, as both are of one predicate, all walks are kept. New facts are joined from: one plan for each premise with the new facts there and all facts elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import content_id
from .scope import SIGNED_OFF, STRENGTH, strength

MAX_HOPS = 3
DECAY = 0.95
LISTED = 64  # facts of one end in a row
PROVED = ("rule_id", "subject_id", "predicate", "object_id")


@dataclass(frozen=True)
class Premise:
    subject: str  # variables
    predicate: str
    object: str
    subject_kind: str | None = None
    object_kind: str | None = None
    hops: int = 1


@dataclass(frozen=True)
class Rule:
    rule_id: str
    premises: tuple[Premise, ...]
    conclusion: Premise
    floor: str = "EXTRACTED_MODEL"


P = Premise
# The shipped rules.
RULES = (
    Rule("conflict_check", (P("c", "REPRESENTS", "p", "counsel", "party"), P("m", "ADVERSE_TO", "p", "matter", "party")), P("m", "POTENTIAL_CONFLICT", "p")),
    Rule("conflict_via_affiliate", (P("c", "REPRESENTS", "q", "counsel", "party"), P("q", "AFFILIATE_OF", "p", "party", "party", 3), P("m", "ADVERSE_TO", "p", "matter", "party")), P("m", "POTENTIAL_CONFLICT", "q")),
    Rule("authority_stale", (P("d", "CITES", "a", "document", "authority"), P("x", "OVERRULES", "a", "authority", "authority")), P("d", "RELIES_ON_STALE_AUTHORITY", "a")),
    Rule("exception_on_superseded_policy", (P("d", "RELIES_ON", "c", "document", "policyclause"), P("x", "SUPERSEDES", "c", None, "policyclause", 3)), P("d", "RELIES_ON_SUPERSEDED_POLICY", "c")),
    Rule("exception_during_investigation", (P("ca", "INVESTIGATES", "cu", "case", "customer"), P("d", "APPROVES_EXCEPTION_FOR", "cu", "document", "customer")), P("d", "EXCEPTION_AGAINST_OPEN_CASE", "cu")),
    Rule("related_party_resale", (P("ca", "INVESTIGATES", "cu", "case", "customer"), P("cu", "CONTROLS", "mm", "customer", "merchant", 3)), P("ca", "RELATED_PARTY_RESALE", "mm")),
    Rule("group_exposure_via_control", (P("f", "LENDS_TO", "b", "facility", "counterparty"), P("p", "CONTROLS", "b", "counterparty", "counterparty", 3)), P("f", "GROUP_EXPOSURE", "p")),
    Rule("related_party_lending", (P("f", "LENDS_TO", "b", "facility", "counterparty"), P("g", "GUARANTEES", "f", "counterparty", "facility"), P("g", "RELATED_PARTY_OF", "b", "counterparty", "counterparty")), P("f", "UNDISCLOSED_RELATED_LENDING", "b")),
    Rule("contraindication_alert", (P("c", "PRESCRIBED", "m", "clinician", "medication"), P("p", "ALLERGIC_TO", "m", "patient", "medication")), P("p", "CONTRAINDICATION_ALERT", "m")),
    Rule("contraindication_via_ingredient", (P("c", "PRESCRIBED", "m", "clinician", "medication"), P("m", "SAME_INGREDIENT_AS", "a", "medication", "medication"), P("p", "ALLERGIC_TO", "a", "patient", "medication")), P("p", "CONTRAINDICATION_ALERT", "m")),
)


def acceptable(facts: DataFrame, floor: str) -> DataFrame:
    """Signed-off, current facts at least as strong as the floor; an unknown floor is the strictest."""
    return facts.where(F.col("review_state").isin(*SIGNED_OFF) & F.col("superseded_at").isNull() & (strength(F.col("epistemic_class")) <= STRENGTH.get(floor, 0)))


def _kind(column: str, kind: str | None):
    return F.lit(True) if kind is None else F.substring_index(column, ":", 1) == kind


def walk(facts: DataFrame, premise: Premise) -> DataFrame:
    """s, o, used (the facts walked: id, confidence, matter); end kinds apply to the two ends only."""
    edge = facts.where(F.col("predicate") == premise.predicate).select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"), F.struct(F.col("assertion_id").alias("id"), F.col("confidence").alias("confidence"), F.col("matter_id").alias("matter")).alias("f"))
    level = edge.where(_kind("s", premise.subject_kind)).select("s", "o", F.array("f").alias("used"), F.array("s", "o").alias("seen"))
    levels = [level]
    for _ in range(min(premise.hops, MAX_HOPS) - 1):
        step = edge.select(F.col("s").alias("o"), F.col("o").alias("next"), F.col("f"))
        level = level.join(step, "o").where(~F.array_contains("seen", F.col("next"))).select("s", F.col("next").alias("o"), F.concat("used", F.array("f")).alias("used"), F.concat("seen", F.array("next")).alias("seen"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).where(_kind("o", premise.object_kind)).select("s", "o", "used")


def bindings(rule: Rule, facts: DataFrame) -> list[DataFrame]:
    """The bindings after each premise: a column per variable and ``used``."""
    good = acceptable(facts, rule.floor)
    out: list[DataFrame] = []
    for k, p in enumerate(rule.premises):
        step = walk(good, p).select(F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("used").alias("_u"))
        if not out:
            loops = step.where("_s = _o") if p.subject == p.object else step
            out.append(loops.select(F.col("_s").alias(p.subject), *([F.col("_o").alias(p.object)] if p.object != p.subject else []), F.col("_u").alias("used")))
            continue
        left = out[-1]
        on = [left[v] == step[c] for v, c in ((p.subject, "_s"), (p.object, "_o")) if v in left.columns]
        if not on:
            raise ValueError(f"premise {k} of {rule.rule_id} shares no variable with those before it")
        joined = left.join(step, reduce(lambda a, b: a & b, on)).where(~F.arrays_overlap(F.transform("used", lambda x: x["id"]), F.transform("_u", lambda x: x["id"])))
        new = [F.col(c).alias(v) for v, c in ((p.subject, "_s"), (p.object, "_o")) if v not in left.columns]
        out.append(joined.select(*[c for c in left.columns if c != "used"], *new, F.concat("used", "_u").alias("used")))
    return out


def _edges(good: DataFrame, predicate: str) -> DataFrame:
    return good.where(F.col("predicate") == predicate).select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"), F.struct(F.col("assertion_id").alias("id"), F.col("confidence").alias("confidence"), F.col("matter_id").alias("matter")).alias("f"))


def _first(rows: DataFrame, *more: str) -> DataFrame:
    """Of each pair of ends the walk with the fewest facts, then the first by their ids; an aggregate with map-side combine."""
    best = F.min(F.struct(F.size("used").alias("n"), "used", *more)).alias("x")
    return rows.groupBy("s", "o").agg(best).select("s", "o", "x.used", *[f"x.{c}" for c in more])


def reach(edges: DataFrame, starts: DataFrame | None, hops: int, best: bool = True, back: bool = False) -> list[DataFrame]:
    """s, o, used, seen of the walks of 1, 2 ... ``hops`` edges (s, o, f) from the starts (s), or with ``back`` to them. ``best``: one walk a pair and level."""
    step = edges.select(F.col("o").alias("s"), F.col("s").alias("o"), "f") if back else edges
    level = (step if starts is None else step.join(starts, "s", "left_semi")).select("s", "o", F.array("f").alias("used"), F.array("s", "o").alias("seen"))
    level = _first(level, "seen") if best else level
    levels = [level]
    nxt = step.select(F.col("s").alias("o"), F.col("o").alias("to"), "f")
    for _ in range(hops - 1):
        used = F.concat(F.array("f"), "used") if back else F.concat("used", F.array("f"))
        level = level.join(nxt, "o").where(~F.array_contains("seen", F.col("to"))).select("s", F.col("to").alias("o"), used.alias("used"), F.concat("seen", F.array("to")).alias("seen"))
        level = _first(level, "seen") if best else level
        levels.append(level)
    return [x.select(F.col("o").alias("s"), F.col("s").alias("o"), "used", "seen") for x in levels] if back else levels


def directed_walk(good: DataFrame, premise: Premise, starts: DataFrame | None = None, stops: DataFrame | None = None, best: bool = True, back: bool = False) -> DataFrame:
    """As ``walk``, from the ``starts`` (a column s) to the ``stops`` (a column o), either of them None for any; ``back`` walks from the stops."""
    of_kind = lambda d, c, k: d if d is None or k is None else d.where(_kind(c, k))
    starts, stops = of_kind(starts, "s", premise.subject_kind), of_kind(stops, "o", premise.object_kind)
    edges, hops = _edges(good, premise.predicate), min(premise.hops, MAX_HOPS)
    found = reduce(DataFrame.unionByName, reach(edges, stops.withColumnRenamed("o", "s") if back and stops is not None else None if back else starts, hops, best, back))
    found = found.where(_kind("s", premise.subject_kind) & _kind("o", premise.object_kind))
    for end, column in ((starts, "s"), (stops, "o")):
        if end is not None and (column == "s") == back:
            found = found.join(end, column, "left_semi")
    return _first(found) if best else found.select("s", "o", "used")


def _meets_seldom(edges: DataFrame, hops: int) -> bool:
    """Whether the walks from a node are so few beside the nodes that hardly two of them end at one: keeping the best for each pair would shuffle them for nothing."""
    n, nodes = edges.agg(F.count("*"), F.approx_count_distinct("s")).first()
    return (n / max(nodes, 1)) ** hops <= nodes


def walks_through(good: DataFrame, fresh: DataFrame, premise: Premise, best: bool = True, old: DataFrame | None = None) -> DataFrame:
    """As ``walk``, but with a new edge in every walk: from the new edges backwards and forwards. With ``best`` it has the best walk of each pair that has a new edge in it.

    Without, every such walk comes once: it is found from its first new edge, backwards by ``old`` facts (those that are not new) only.
    """
    edges, new, hops = _edges(good, premise.predicate), _edges(fresh, premise.predicate), min(premise.hops, MAX_HOPS)
    found = [new.select("s", "o", F.array("f").alias("used"))]
    if hops > 1 and not best:
        before = _edges(_others(good, fresh) if old is None else old, premise.predicate).select(F.col("s").alias("from"), F.col("o").alias("s"), "f")
        after = edges.select(F.col("s").alias("o"), F.col("o").alias("to"), "f")
        ahead = [new.select("s", "o", F.array("f").alias("used"), F.array("s", "o").alias("seen"))]
        found = []
        for steps in range(1, hops + 1):
            level = ahead[-1]
            found.append(level.select("s", "o", "used"))
            for _ in range(hops - steps):
                level = level.join(after, "o").where(~F.array_contains("seen", F.col("to"))).select("s", F.col("to").alias("o"), F.concat("used", F.array("f")).alias("used"), F.concat("seen", F.array("to")).alias("seen"))
                found.append(level.select("s", "o", "used"))
            ahead.append(ahead[-1].join(before, "s").where(~F.array_contains("seen", F.col("from"))).select(F.col("from").alias("s"), "o", F.concat(F.array("f"), "used").alias("used"), F.concat("seen", F.array("from")).alias("seen")))
    elif hops > 1:
        none = F.array().cast("array<struct<id:string,confidence:double,matter:string>>")
        here = lambda c: new.select(F.col(c).alias("s"), F.col(c).alias("o"), none.alias("used"), F.array(c).alias("seen")).distinct()
        before = reduce(DataFrame.unionByName, [here("s"), *reach(edges, new.select("s"), hops - 1, best, back=True)])
        after = reduce(DataFrame.unionByName, [here("o"), *reach(edges, new.select(F.col("o").alias("s")), hops - 1, best)])
        head = before.select(F.col("s").alias("first"), F.col("o").alias("s"), F.col("used").alias("u0"), F.col("seen").alias("seen0"))
        tail = after.select(F.col("s").alias("o"), F.col("o").alias("last"), F.col("used").alias("u1"), F.col("seen").alias("seen1"))
        rows = new.join(head, "s").where(F.size("u0") < hops).join(tail, "o").where((F.size("u0") + F.size("u1") < hops) & ~F.arrays_overlap("seen0", "seen1") & (F.size("u0") + F.size("u1") > 0))
        found.append(rows.select(F.col("first").alias("s"), F.col("last").alias("o"), F.concat("u0", F.array("f"), "u1").alias("used")))
    out = reduce(DataFrame.unionByName, found).where(_kind("s", premise.subject_kind) & _kind("o", premise.object_kind))
    return _first(out) if best else out


def _others(good: DataFrame, fresh: DataFrame) -> DataFrame:
    return good.join(fresh.select("assertion_id"), "assertion_id", "left_anti")


def _by_connection(rule: Rule, at: int, among: list[int] | None = None) -> list[int]:
    """The premises (or those ``among`` them) from ``at`` on, each sharing a variable with one before it."""
    among = list(range(len(rule.premises))) if among is None else among
    out, bound = [at], {rule.premises[at].subject, rule.premises[at].object}
    while len(out) < len(among):
        k = next((k for k in among if k not in out and bound & {rule.premises[k].subject, rule.premises[k].object}), None)
        if k is None:
            raise ValueError(f"premises of {rule.rule_id} share no variable")
        out.append(k)
        bound |= {rule.premises[k].subject, rule.premises[k].object}
    return out


def _bindable(rule: Rule, k: int, variable: str, column: str, good: DataFrame) -> DataFrame | None:
    """What the other premises of one edge leave of the variable, or None."""
    out = None
    for j, p in enumerate(rule.premises):
        if j == k or p.hops > 1 or variable not in (p.subject, p.object):
            continue
        of_kinds = _edges(good, p.predicate).where(_kind("s", p.subject_kind) & _kind("o", p.object_kind))
        some = of_kinds.select(F.col("s" if p.subject == variable else "o").alias(column))
        out = some if out is None else out.join(some, column, "left_semi")
    return out


def _matches(rule: Rule, k: int, good: DataFrame, left: DataFrame | None, fresh: DataFrame | None) -> DataFrame:
    """s, o, used of what the premise matches: of the new facts, or, for a path, from the ends that ``left`` or other premises bind."""
    p = rule.premises[k]
    alone = all(q.predicate != p.predicate for j, q in enumerate(rule.premises) if j != k)
    if fresh is not None:
        return walks_through(good, fresh, p, best=alone)
    if p.hops == 1:
        return walk(good, p)
    bound = lambda v, c: left.select(F.col(v).alias(c)).distinct() if left is not None and v in left.columns else None
    starts, stops = bound(p.subject, "s"), bound(p.object, "o")
    back = starts is None and stops is not None
    if starts is None and stops is None:
        starts = _bindable(rule, k, p.subject, "s", good)
    if stops is None:
        stops = _bindable(rule, k, p.object, "o", good)
        back = starts is None and stops is not None
    return directed_walk(good, p, starts, stops, alone, back)


def _only_end(rule: Rule, k: int) -> str | None:
    """The end (s or o) that anything else names, where the premise's other variable is its own and no other premise can share a fact with it."""
    p, others = rule.premises[k], [q for j, q in enumerate(rule.premises) if j != k]
    elsewhere = {v for q in [*others, rule.conclusion] for v in (q.subject, q.object)}
    kept = [c for v, c in ((p.subject, "s"), (p.object, "o")) if v in elsewhere]
    return None if p.subject == p.object or len(kept) != 1 or any(q.predicate == p.predicate for q in others) else kept[0]


def _needed(rule: Rule, k: int, step: DataFrame) -> DataFrame:
    """What the premise matches, without a variable that nothing else names: of the values that only it has, the best proof stands.

    A proof is as good as its parts then, as no other premise can share a fact with this one. Otherwise all values are kept.
    """
    kept = _only_end(rule, k)
    if kept is None:
        return step
    best = step.groupBy(kept).agg(F.min(F.struct(F.size("used").alias("n"), "used")).alias("x"))
    return best.select(*[F.col(c) if c == kept else F.lit(None).cast("string").alias(c) for c in ("s", "o")], "x.used")


@dataclass(frozen=True)
class Ending:
    """How a rule's proofs end: the facts of one premise (``last``) are joined as lists by ``by``, and bring the conclusion's variable ``brings``; its other variable ``stays`` deals the proofs
    to tasks. Premises of ``beside`` only add their best proof to that one; ``core``: the rest."""

    last: int
    by: str
    brings: str
    stays: str
    beside: tuple[int, ...]
    core: tuple[int, ...]


def ending(rule: Rule) -> Ending | None:
    """None where no premise of one edge brings just one variable of the conclusion, and the other one by other premises."""
    found = rule.conclusion.subject, rule.conclusion.object
    for k in reversed(range(len(rule.premises))):
        p = rule.premises[k]
        for by, brings in ((p.subject, p.object), (p.object, p.subject)):
            stays = next((v for v in found if v != brings), None)
            if p.hops > 1 or by == brings or brings not in found or stays in (None, by):
                continue
            # a proof that rests on new facts is looked for by its first new premise, so that one of several edges can't stand beside
            beside = [j for j, q in enumerate(rule.premises) if j != k and q.hops == 1 and (c := _only_end(rule, j)) and stays == (q.subject if c == "s" else q.object)]
            core = [j for j in range(len(rule.premises)) if j != k and j not in beside]
            named = {v for j in core for v in (rule.premises[j].subject, rule.premises[j].object)}
            if {by, stays} <= named and brings not in named:
                return Ending(k, by, brings, stays, tuple(beside), tuple(core))
    return None


def _in_lists(step: DataFrame, by: str) -> DataFrame:
    """_by, list (other ends and facts, at most ``LISTED``): the matches of a premise by one end."""
    other = "o" if by == "s" else "s"
    row = F.row_number().over(W.partitionBy("_by").orderBy("to", "f.id"))
    rows = step.select(F.col(by).alias("_by"), F.col(other).alias("to"), F.col("used")[0].alias("f")).withColumn("part", F.floor((row - 1) / LISTED))
    listed = rows.groupBy("_by", "part").agg(F.collect_list(F.struct("to", "f.*")).alias("list"))
    # columns take less than rows
    return listed.select("_by", F.struct(*[F.col(f"list.{c}").alias(c) for c in ("to", "id", "confidence", "matter")]).alias("list"))


def _listed_proofs(rule: Rule, end: Ending, good: DataFrame, new: DataFrame | None) -> DataFrame:
    """As ``proofs``, dealt by the variable that stays: what the last premise brings travels as lists, and meets the parts of the proof where conclusions are compared.

    With new facts, of the premises beside only the best proof counts: where it is new, all proofs of that value are; where it isn't, those are whose first new fact stands elsewhere.
    """
    of = rule.premises
    old = None if new is None else _others(good, new)
    side = None
    for k in end.beside:
        c = _only_end(rule, k)
        one = _needed(rule, k, walk(good, of[k])).select(F.col(c).alias("_v"), F.col("used").alias(f"_u{k}"))
        side = one if side is None else side.join(one, "_v")
    if side is not None and new is not None:
        ids = new.select(F.col("assertion_id").alias("_id"), F.lit(True).alias("_new")).distinct()
        flag = F.lit(False)
        for k in end.beside:
            side = side.withColumn("_id", F.col(f"_u{k}")[0]["id"]).join(ids.withColumnRenamed("_new", f"_new{k}"), "_id", "left").drop("_id")
            flag = flag | F.col(f"_new{k}").isNotNull()
        side = side.withColumn("_first", flag).drop(*[f"_new{k}" for k in end.beside])
    sequence = [*end.core, end.last]
    plans = [None] if new is None else [*([None] if side is not None else []), *sequence]
    rows = []
    for at in plans:
        source = lambda k: good if at is None or k not in sequence else new if k == at else old if sequence.index(k) < sequence.index(at) else good  # noqa: E731, B023
        values = None if side is None else side.where(F.col("_first") == F.lit(at is None)) if new is not None else side

        def bound(k: int, variable: str, column: str, left: DataFrame | None) -> DataFrame | None:
            """What ``left``, the premises beside and others of one edge leave of a path's end."""
            if left is not None and variable in left.columns:
                return left.select(F.col(variable).alias(column)).distinct()
            out = None if values is None or variable != end.stays else values.select(F.col("_v").alias(column))  # noqa: B023
            for j in sequence:
                p = of[j]
                if j == k or p.hops > 1 or variable not in (p.subject, p.object):
                    continue
                some = walk(source(j), p).select(F.col("s" if p.subject == variable else "o").alias(column))  # noqa: B023
                out = some if out is None else out.join(some, column, "left_semi")
            return out

        left = None
        start = at if at in end.core else next((k for k in end.core if end.by in (of[k].subject, of[k].object)), end.core[0])
        for k in _by_connection(rule, start, list(end.core)):
            p = of[k]
            alone = all(q.predicate != p.predicate for j, q in enumerate(of) if j != k)
            best = alone and p.hops > 1 and not _meets_seldom(_edges(good, p.predicate), p.hops)
            if k == at and p.hops > 1:
                step = walks_through(good, new, p, best, old)
            elif p.hops > 1:
                starts, stops = bound(k, p.subject, "s", left), bound(k, p.object, "o", left)
                # new facts of the last premise may be few: walks go from their end then
                back = stops is not None and (starts is None or (at == end.last and p.object == end.by))
                if not back and p.object == end.by:
                    stops = None  # the lists are joined by it
                step = directed_walk(source(k), p, starts, stops, best, back)
            else:
                step = walk(source(k), p)
            step = _needed(rule, k, step).select(F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("used").alias(f"_u{k}"))
            left = _with_step(left, p, step, f"_u{k}")
        lists = _in_lists(walk(source(end.last), of[end.last]), "s" if of[end.last].subject == end.by else "o")
        met = _summed(left, [f"_u{k}" for k in end.core]).join(lists, left[end.by] == lists["_by"])
        rows.append(met.select(F.col(end.stays).alias("_v"), *[f"_u{k}" for k in end.core], "list", F.lit(at is None).alias("_first")))
    met = reduce(DataFrame.unionByName, rows).repartition("_v")
    if side is not None:
        beside = _summed(side, [f"_u{k}" for k in end.beside])
        met = met.join(beside.withColumnRenamed("_first", "_told") if new is not None else beside, "_v")
        # no equality, by which the rows would be dealt once more
        met = met.where("CASE WHEN _first THEN _told ELSE NOT _told END").drop("_told") if new is not None else met
    met = met.select(*[c for c in met.columns if c not in ("list", "_first")], F.explode(F.arrays_zip("list.to", "list.id", "list.confidence", "list.matter")).alias("x"))
    if any(of[k].predicate == of[end.last].predicate for k in range(len(of)) if k != end.last):
        met = met.where(~F.array_contains(F.concat(*[f"_u{k}.ids" for k in range(len(of)) if k != end.last]), F.col("x.id")))
    others = [f"_u{k}" for k in range(len(of)) if k != end.last]
    ids = F.concat(*[F.array("x.id") if k == end.last else F.col(f"_u{k}.ids") for k in range(len(of))])
    least = F.least("x.confidence", *[f"{u}.least" for u in others])
    matters = F.array_distinct(F.concat(F.array("x.matter"), *[f"{u}.matters" for u in others]))
    return met.select(F.col("_v").alias(end.stays), F.col("x.to").alias(end.brings), ids.alias("premises"), least.alias("least"), matters.alias("matters"))


def _summed(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Parts of proofs as their facts' ids, least confidence and different matters."""
    of = lambda u, c: F.transform(u, lambda x: x[c])
    return rows.withColumns({u: F.struct(of(u, "id").alias("ids"), F.array_min(of(u, "confidence")).alias("least"), F.array_distinct(of(u, "matter")).alias("matters")) for u in parts})


def _with_step(left: DataFrame | None, p: Premise, step: DataFrame, used: str) -> DataFrame:
    """The bindings so far joined with what the next premise matches (_s, _o and ``used``), by the variables that both have. No fact stands for two premises."""
    ends = {p.subject: "_s", p.object: "_o"}
    if p.subject == p.object:
        step, ends = step.where("_s = _o"), {p.subject: "_s"}
    if left is None:
        return step.select(*[F.col(c).alias(v) for v, c in ends.items()], used)
    on = [left[v] == step[c] for v, c in ends.items() if v in left.columns]
    spent = [c for c in left.columns if c.startswith("_u")]
    ids = lambda *cs: F.transform(F.concat(*cs), lambda x: x["id"])
    joined = left.join(step, reduce(lambda a, b: a & b, on)).where(~F.arrays_overlap(ids(*spent), ids(used)))
    return joined.select(*left.columns, *[F.col(c).alias(v) for v, c in ends.items() if v not in left.columns], used)


def proofs(rule: Rule, facts: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The conclusion's variables, premises (ids), their least confidence and different matters: for all bindings of them at least their best proof. With ``fresh`` (part of ``facts``) the best of those that rest on one of these, unless better ones were proved without."""
    good = acceptable(facts, rule.floor)
    new = None if fresh is None else acceptable(fresh, rule.floor)
    if end := ending(rule):
        return _listed_proofs(rule, end, good, new)
    plans = []
    for at in [0] if fresh is None else range(len(rule.premises)):
        left = None
        for k in _by_connection(rule, at):
            step = _needed(rule, k, _matches(rule, k, good, left, new if k == at else None)).select(F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("used").alias(f"_u{k}"))
            left = _with_step(left, rule.premises[k], step, f"_u{k}")
        names = dict.fromkeys((rule.conclusion.subject, rule.conclusion.object))
        found = left.select(*names, F.concat(*[f"_u{k}" for k in range(len(rule.premises))]).alias("used"))
        plans.append(_summed(found, ["used"]).select(*names, F.col("used.ids").alias("premises"), "used.least", "used.matters"))
    return reduce(DataFrame.unionByName, plans)


def infer(rules, facts: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """rule_id, subject_id, predicate, object_id, premises, confidence, matter_id: of each conclusion the shortest proof, then the first by its premises.

    With ``fresh``, new facts that ``facts`` holds too: the conclusions of proofs that rest on one of them. The better of these and of what was inferred before (``best_proofs``) is
    what all facts give.
    """
    out = []
    for r in rules:
        decay = F.pow(F.lit(DECAY), F.lit(1) + F.size("premises") - len(r.premises))
        rows = proofs(r, facts, fresh).select(
            F.col(r.conclusion.subject).alias("subject_id"),
            F.col(r.conclusion.object).alias("object_id"),
            "premises",
            (F.col("least") * decay).alias("confidence"),
            F.when(F.size("matters") == 1, F.col("matters")[0]).alias("matter_id"),
        )
        # the rule's names are added to the conclusions, not to every proof
        named = {"rule_id": F.lit(r.rule_id), "predicate": F.lit(r.conclusion.predicate)}
        out.append(best_proofs(rows, "subject_id", "object_id").withColumns(named).select(*PROVED, "premises", "confidence", "matter_id"))
    return reduce(DataFrame.unionByName, out)


def best_proofs(found: DataFrame, *by: str) -> DataFrame:
    """One row for each rule and conclusion, or for each value of some columns: the order's least row is an aggregate with map-side combine, so that no group of proofs meets in one task."""
    best = F.min(F.struct(F.size("premises").alias("n"), "premises", "confidence", "matter_id")).alias("x")
    by = by or PROVED
    return found.groupBy(*by).agg(best).select(*by, "x.premises", "x.confidence", "x.matter_id")


def infer_and_stage(rules, facts: DataFrame, stored: DataFrame) -> DataFrame:
    """The conclusions that are not stored yet as facts of the tenants they rest on: INFERRED, PENDING, with premises, rule_id and an id from their content.

    Pending conclusions are no premises, so that a second run over its own output adds nothing.
    """
    return as_staged(infer(rules, facts), facts).join(stored.select("assertion_id"), "assertion_id", "left_anti")


def as_staged(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Conclusions as staged facts. Two rules with one conclusion give one fact: that of the fewest premises, then the first by premises and by rule."""
    tenant = facts.select(F.col("assertion_id").alias("first"), "tenant_id")
    rows = found.withColumn("first", F.col("premises")[0]).join(tenant, "first").drop("first")
    id_ = content_id(F.col("tenant_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id"))
    best = F.min(F.struct(F.size("premises").alias("n"), "premises", "rule_id", "confidence", "matter_id")).alias("x")
    one = rows.groupBy("tenant_id", "subject_id", "predicate", "object_id").agg(best)
    state = {"epistemic_class": F.lit("INFERRED"), "review_state": F.lit("PENDING"), "superseded_at": F.lit(None).cast("timestamp"), "assertion_id": id_}
    return one.select("x.rule_id", "subject_id", "predicate", "object_id", "x.premises", "x.confidence", "x.matter_id", "tenant_id").withColumns(state)


def refusals(rules, predicates: dict[str, bool], declared: set[str]) -> list[tuple[str, str]]:
    """rule_id and reason of the rules that are not run: skipped for a fault, or refused for a conclusion that the vocabulary doesn't declare."""
    out = []
    for r in rules:
        if r.conclusion.predicate not in declared:
            out.append((r.rule_id, f"refused: {r.conclusion.predicate} is not declared"))
        elif found := faults(r, predicates):
            out.append((r.rule_id, "skipped: " + "; ".join(found)))
    return out


def report(rules, facts: DataFrame) -> DataFrame:
    """Per rule and premise: how many facts could match it, and how many bindings are left after it. Zero bindings starve the rule there."""
    out = []
    for r in rules:
        good = acceptable(facts, r.floor)
        for k, (p, b) in enumerate(zip(r.premises, bindings(r, facts), strict=True)):
            have = good.where(F.col("predicate") == p.predicate).agg(F.count("*").alias("candidates"))
            out.append(b.agg(F.count("*").alias("bindings")).crossJoin(have).select(F.lit(r.rule_id).alias("rule_id"), F.lit(k + 1).alias("premise"), F.lit(p.predicate).alias("predicate"), "candidates", "bindings", (F.col("bindings") == 0).alias("starved")))
    return reduce(DataFrame.unionByName, out)


def faults(rule: Rule, predicates: dict[str, bool]) -> list[str]:
    """What is wrong with a rule. ``predicates``: declared ones, and whether they are transitive."""
    out = []
    if len(rule.premises) < 2:
        out.append("needs two premises")
    groups = [{p.subject, p.object} for p in rule.premises]
    merged = True
    while merged and len(groups) > 1:
        merged = False
        for g in groups[1:]:
            if groups[0] & g:
                groups[0] |= g
                groups.remove(g)
                merged = True
                break
    if len(groups) > 1:
        out.append("premises share no variables")
    bound = {v for p in rule.premises for v in (p.subject, p.object)}
    if not {rule.conclusion.subject, rule.conclusion.object} <= bound:
        out.append("conclusion is not bound")
    if rule.conclusion.hops != 1:
        out.append("conclusion is a path")
    for p in (*rule.premises, rule.conclusion):
        if p.predicate not in predicates:
            out.append(f"{p.predicate} is not declared")
        elif p.hops > 1 and not predicates[p.predicate]:
            out.append(f"{p.predicate} is not transitive")
        if not 1 <= p.hops <= MAX_HOPS:
            out.append(f"{p.predicate} walks {p.hops} hops")
    return out


def vocabulary_faults(predicates: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of ``predicates`` (predicate, domain[], range[], symmetric, transitive, blocks, effect) that break a rule, with the reason.

    ``kinds``: kind, and where they are there organising (at most one) and catalog, external (a catalog's kinds are external).
    """
    checks = {
        "blocks": "blocks IS NOT NULL AND blocks NOT IN ('subject', 'object', 'both')",
        "effect": "effect IS NOT NULL AND effect NOT IN ('withhold', 'notify')",
        "symmetric ends": "symmetric AND array_sort(domain) <> array_sort(range)",
        "transitive ends": "transitive AND NOT arrays_overlap(domain, range)",
    }
    found = [predicates.where(c).select("predicate", F.lit(n).alias("reason")) for n, c in checks.items()]
    if "organising" in kinds.columns:
        many = kinds.where("organising").agg(F.count("*").alias("n")).where("n > 1")
        found.append(many.select(F.lit(None).cast("string").alias("predicate"), F.lit("several organising units").alias("reason")))
    if "catalog" in kinds.columns:
        found.append(kinds.where("catalog AND NOT coalesce(external, false)").select(F.lit(None).cast("string").alias("predicate"), F.concat(F.lit("catalog kind not external "), "kind").alias("reason")))
    named = predicates.select("predicate", F.explode(F.array_union("domain", "range")).alias("kind")).join(kinds.select("kind"), "kind", "left_anti")
    return reduce(DataFrame.unionByName, [*found, named.select("predicate", F.concat(F.lit("unknown kind "), "kind").alias("reason")).distinct()])
