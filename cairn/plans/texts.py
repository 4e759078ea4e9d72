"""Queries over documents, vectors, names and the catalog: scalar functions, registration, chunks, claims, search, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from ..operators import catalog as C, documents as D, graph as G, lifecycle as L, scope as P, vectors as V
from ..sources import derived, tables as S
from ..sources.derived import FACT_SQL
from . import warehouse

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, folder) -> DataFrame:
    return S.read(spark, folder, "documents")


@query("SELECT DISTINCT 'doc-' || sha256('t-alpha:' || sha256(text))[1:24] AS document_id, sha256(text) AS content_sha256, length(text) AS chars FROM documents")
def s13_register(spark, folder):
    d = documents(spark, folder)
    return D.register(d.unionByName(d), "t-alpha")


def paged(spark, folder) -> DataFrame:
    """The documents with a page mark after every 5000 characters."""
    marked = F.regexp_replace("text", "(?s)(.{5000})", "$1\f")
    return S.pages(documents(spark, folder).select("doc_id", marked.alias("text")))


@query("SELECT doc_id, p AS page, (p - 1) * 5001 AS char_start, (p - 1) * 5001 + least(5000, length(text) - (p - 1) * 5000) AS char_end FROM (SELECT doc_id, text, unnest(range(1, length(text) // 5000 + 2)) AS p FROM documents)")
def s4_pages(spark, folder):
    return paged(spark, folder).select("doc_id", "page", "char_start", "char_end")


def chunk_sql(target: int, overlap: int) -> str:
    """CTEs up to ``c``: doc_id, page, ordinal, a and b (the chunk's place in its page), char_start, body. One step of the recursion is one cut."""
    skip = "length({0}) - length(ltrim({0}, E' \\t\\n\\r\\f'))"
    rest = "substring(body, {0} + 1)"
    last = "length(regexp_extract(substring(body, a + 1, {t}), '(?s)^(.*{p})', 1))"
    cut = " ".join(f"WHEN {last.format(t=target, p=p)} >= 200 THEN a + {last.format(t=target, p=p)}" for p in (r"\n\s*\n", r"[.!?;:]\s", r"\s"))
    return f"""pg AS (SELECT doc_id, p AS page, (p - 1) * 5001 AS char_start, substring(text, (p - 1) * 5000 + 1, 5000) AS body FROM (SELECT doc_id, text, unnest(range(1, length(text) // 5000 + 2)) AS p FROM documents)),
s0 AS (SELECT *, {skip.format("body")} AS a FROM pg),
w AS (SELECT doc_id, page, char_start, body, 0 AS ordinal, a, CASE WHEN a + {target} >= length(body) THEN length(body) {cut} ELSE a + {target} END AS b FROM s0 WHERE a < length(body)
UNION ALL SELECT doc_id, page, char_start, body, ordinal, a, CASE WHEN a + {target} >= length(body) THEN length(body) {cut} ELSE a + {target} END AS b FROM (SELECT doc_id, page, char_start, body, ordinal + 1 AS ordinal, n + {skip.format(rest.format("n"))} AS a FROM (SELECT *, CASE WHEN b - {overlap} > a THEN b - {overlap} ELSE b END AS n FROM w WHERE b < length(body))) WHERE a < length(body)),
c AS (SELECT * FROM w)"""


@query(f"WITH RECURSIVE {chunk_sql(1200, 150)} SELECT doc_id, page, ordinal::INTEGER AS ordinal, char_start + a AS start, char_start + b AS \"end\", sha256(substring(body, a + 1, b - a)) AS chunk_sha256 FROM c")
def d1_chunks(spark, folder):
    return D.chunks(paged(spark, folder), 1200, 150).select("doc_id", "page", "ordinal", "start", "end", "chunk_sha256")


@query(f"WITH RECURSIVE {chunk_sql(2000, 200)} SELECT doc_id, page, ordinal::INTEGER AS ordinal FROM c WHERE ordinal = 1 AND substring(body, a + 2, b - a) <> substring(body, a + 1, b - a)")
def d2_offsets_hold(spark, folder):
    """Chunks that are not at their offsets: those that were moved by one character here, and no others."""
    c = D.chunks(paged(spark, folder), 2000, 200)
    by = F.when(F.col("ordinal") == 1, 1).otherwise(0)
    return D.misplaced(c.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})).select("doc_id", "page", "ordinal")


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''&.-]*'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains(['"""
       + "','".join(T.NOISE)
       + r"""'], t)), ' ') AS terms FROM documents""")
def f11_terms(spark, folder):
    return documents(spark, folder).select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


_NAMES = "n AS (SELECT c_custkey, c_name FROM customer), v AS (SELECT c_custkey, 'party:' || c_name AS entity_id FROM n UNION ALL SELECT c_custkey, 'Party:' || upper(c_name) || ' Ltd' FROM n UNION ALL SELECT c_custkey, 'party:' || c_name || '-limited' FROM n)"


def names(spark, folder) -> DataFrame:
    n = F.col("c_name")
    forms = F.array(F.concat(F.lit("party:"), n), F.concat(F.lit("Party:"), F.upper(n), F.lit(" Ltd")), F.concat(F.lit("party:"), n, F.lit("-limited")))
    return S.read(spark, folder, "customer").select("c_custkey", F.explode(forms).alias("entity_id"))


@query(f"WITH {_NAMES} SELECT c_custkey, entity_id, 'party:' || trim(regexp_replace(lower(regexp_replace(entity_id, '^[^:]*:', '')), '[^a-z0-9]+', '-', 'g'), '-') AS canonical FROM v")
def f7_canonical_ids(spark, folder):
    return names(spark, folder).select("c_custkey", "entity_id", T.canonical(F.col("entity_id"), ["party"]).alias("canonical"))


@query(f"""WITH {_NAMES}, c AS (SELECT entity_id, trim(regexp_replace(lower(regexp_replace(entity_id, '^[^:]*:', '')), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM v), k AS (SELECT entity_id, 'party:' || replace(name, '-', '') AS key FROM c UNION SELECT entity_id, 'party:' || replace(regexp_replace(name, '(-(ltd|limited|gmbh|ag))+$', ''), '-', '') FROM c)
SELECT key, string_agg(DISTINCT entity_id, '|' ORDER BY entity_id) AS ids FROM k GROUP BY 1 HAVING count(DISTINCT entity_id) > 1""")
def j16_blocking_keys(spark, folder):
    return L.duplicates(names(spark, folder), T.blocking_keys(F.col("entity_id"), ["party"])).select("key", F.array_join("ids", "|").alias("ids"))


@query(f"WITH {FACT_SQL} SELECT subject_id, split_part(subject_id, ':', 1) AS kind, regexp_replace(split_part(subject_id, ':', 2), '[-_]', ' ', 'g') AS label, split_part(subject_id, ':', 2) AS bare, sha256(subject_id || '/' || object_id)[1:16] AS content_id, assertion_id FROM facts")
def f6_labels_and_ids(spark, folder):
    f = derived.facts(spark, folder)
    s = F.col("subject_id")
    return f.select("subject_id", T.kind(s).alias("kind"), T.label(s).alias("label"), T.both_forms(s)[1].alias("bare"), T.content_id(s, F.col("object_id"), length=16).alias("content_id"), "assertion_id")


@query("SELECT doc_id, trim(regexp_replace(lower(array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:40], ' ')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def f13_slugs(spark, folder):
    return documents(spark, folder).select("doc_id", T.slug(F.regexp_replace("text", r"\s+", " ")).alias("slug"))


@query("""SELECT doc_id, 10 AS start, 10 + length(text[11:60]) AS "end" FROM documents WHERE length(text) > 60 AND instr(text, text[11:60]) = 11""")
def f16_quotes(spark, folder):
    """A quote with doubled spaces is found where the text has single ones."""
    d = documents(spark, folder).where("length(text) > 60").withColumn("q", F.substring("text", 11, 50)).where("instr(text, q) = 11")
    at = T.locate(F.col("text"), F.col("q"))
    return d.select("doc_id", at["start"].alias("start"), at["end"].alias("end"))


@query(None)
def f16_loose_quotes(spark, folder):
    d = documents(spark, folder).where("length(text) > 60").withColumn("q", F.regexp_replace(F.substring("text", 11, 50), " ", "  "))
    at = T.locate(F.col("text"), F.col("q"))
    return d.select("doc_id", at["start"].alias("start"), at["end"].alias("end")).where("start IS NOT NULL")


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0.8 ELSE round(0.8 + (n_chars % 80) / 100.0 * 0.2, 6) END AS approved, least(greatest(0.5, (n_chars % 100) / 100.0), 1.0) AS floor, CASE WHEN n_chars % 50 = 0 THEN -1.0 ELSE round(2 - 1 / ((n_chars % 50) / 50.0), 6) END AS cosine FROM documents")
def f19_confidences(spark, folder):
    n = F.col("n_chars")
    return documents(spark, folder).select("doc_id", F.round(T.approved_confidence((n % 80) / 100.0, n % 3 == 0), 6).alias("approved"), P.raised_floor(0.5, (n % 100) / 100.0).alias("floor"), F.round(T.score_to_cosine((n % 50) / 50.0), 6).alias("cosine"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'NOT_SCANNED' WHEN event_id % 3 > 0 AND event_id % 5 = 0 THEN 'ERROR' WHEN event_id % 3 > 0 THEN 'PARTIAL' ELSE 'CONNECTED' END AS status FROM events")
def p16_source_status(spark, folder):
    e = F.col("event_id")
    return S.read(spark, folder, "events").select("event_id", P.source_status(F.when(e % 4 != 0, F.col("ts")), e % 3, e % 5).alias("status"))


# Claims

_KINDS = ("customer", "merchant", "order")


@query("""WITH c AS (SELECT doc_id, doc_id % 5 = 0 AS loose, doc_id % 7 = 0 AS wrong, doc_id % 11 = 0 AS stray, doc_id % 13 = 0 AS self, length(text) > 80 AND position('  ' IN text[11:60]) = 0 AND trim(text[11:60]) = text[11:60] AS ok FROM documents)
SELECT doc_id, CASE WHEN wrong THEN 'quote not found' WHEN stray THEN 'unknown kind' WHEN self THEN 'self edge' END AS drop_reason FROM c WHERE ok""")
def d3_claims(spark, folder):
    d = documents(spark, folder).where("length(text) > 80 AND instr(substring(text, 11, 50), '  ') = 0 AND trim(substring(text, 11, 50)) = substring(text, 11, 50)")
    k = F.col("doc_id")
    q = F.substring("text", 11, 50)
    quote = F.when(k % 7 == 0, F.concat(F.lit("\u0001"), q)).when(k % 5 == 0, F.regexp_replace(q, " ", "  ")).otherwise(q)
    subject = F.when(k % 11 == 0, F.lit("widget:1")).otherwise(F.lit("Customer:One"))
    object_ = F.when(k % 13 == 0, subject).otherwise(F.lit("merchant:two"))
    claims = d.select("doc_id", F.col("text").alias("chunk_text"), quote.alias("quote"), subject.alias("subject"), F.lit("supplied by").alias("predicate_said"), object_.alias("object"), F.lit(0.9).alias("confidence"))
    vocabulary = spark.createDataFrame([("SUPPLIED_BY", "supplied by", False, ["customer"], ["merchant"])], "predicate string, label string, symmetric boolean, domain array<string>, range array<string>")
    return D.validated(claims, vocabulary, _KINDS).select("doc_id", "drop_reason")


@query(f"""WITH {FACT_SQL} SELECT assertion_id, array_to_string(list_filter([CASE WHEN document_id IS NULL AND epistemic_class <> 'DECLARED' THEN 'locator' END, CASE WHEN predicate NOT IN ('CONTROLS', 'SUPPLIED_BY', 'PLACED_ORDER') THEN 'predicate' END, CASE WHEN predicate = 'CONTROLS' AND split_part(object_id, ':', 1) <> 'customer' THEN 'kinds' END], lambda x: x IS NOT NULL), ',') AS violations FROM facts""")
def c1_write_contract(spark, folder):
    v = spark.createDataFrame([("CONTROLS", ["customer"], ["customer"], False), ("SUPPLIED_BY", ["order"], ["merchant"], False), ("PLACED_ORDER", ["customer"], ["order"], False)], "predicate string, domain array<string>, range array<string>, symmetric boolean")
    return D.contract(derived.facts(spark, folder), v).select("assertion_id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {FACT_SQL} SELECT assertion_id, CASE WHEN epistemic_class = 'DECLARED' THEN 'AUTO_ASSERTED' ELSE 'PENDING' END AS state FROM facts")
def c2_review_states(spark, folder):
    return derived.facts(spark, folder).select("assertion_id", D.review_state(F.col("epistemic_class"), F.lit(False)).alias("state"))


# Vectors

_UNIT = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)"


def vectors(spark, folder) -> DataFrame:
    v = S.read(spark, folder, "embeddings")
    k = F.col("vec_id")
    return v.select("vec_id", "embedding", "label", F.concat(F.lit("doc-"), k % 40).alias("document_id"), F.when(k % 4 != 0, F.concat(F.lit("M-"), k % 7)).alias("matter_id"), F.lit("t-alpha").alias("tenant_id"))


@query(f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM u q, u v WHERE q.vec_id % 50 = 0 AND (v.vec_id % 4 = 0 OR v.vec_id % 7 <> 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def v1_knn(spark, folder):
    v = vectors(spark, folder)
    return V.knn(v.where("vec_id % 50 = 0"), v, 5, P.in_scope("t-alpha", None, ["M-5"]))


@query(None)
def v1_approximate(spark, folder):
    """The same search by random projections, each hit with ``exact``: whether the exact search has it too."""
    v = vectors(spark, folder)
    queries, wall = v.where("vec_id % 50 = 0"), P.in_scope("t-alpha", None, ["M-5"])
    near = V.ProjectionIndex(v).knn(queries, 5, wall)
    exact = V.knn(queries, v, 5, wall).select("query_id", "vec_id", F.lit(True).alias("exact"))
    return near.join(exact, ["query_id", "vec_id"], "left").select("query_id", "vec_id", "score", "rank", F.coalesce("exact", F.lit(False)).alias("exact"))


@query(f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM u q, u v WHERE q.vec_id % 50 = 0 AND v.vec_id % 40 IN (1, 2, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 3""")
def j8_knn_in_documents(spark, folder):
    v = vectors(spark, folder)
    seeds = v.where("document_id IN ('doc-1', 'doc-2', 'doc-3')").select("document_id")
    return V.knn(v.where("vec_id % 50 = 0"), v, 3, seed_documents=seeds)


@query(f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS question_id, v.vec_id, v.label AS layer, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM u q, u v WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s), h AS (SELECT * FROM k WHERE rank <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, layer ORDER BY score DESC, vec_id) AS k FROM h),
p AS (SELECT question_id, layer, avg(score) FILTER (k <= 2 AND score >= 0.3) AS raw, count(*) FILTER (score >= 0.3) AS n, CASE WHEN layer = 3 THEN 0.05 ELSE 0.0 END::DOUBLE AS boost FROM n GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN n > 0 THEN least(1.0, raw + boost) ELSE 0 END::DOUBLE AS sc FROM p), m AS (SELECT *, max(sc) OVER (PARTITION BY question_id) AS best FROM z)
SELECT question_id, layer, round(sc, 4) AS score, round(coalesce(raw, 0), 4) AS raw_score, boost, n, round(CASE WHEN best > 0 THEN sc / best ELSE 0 END, 4) AS relative, sc > 0 AND sc >= best * (1 - 0.15) AS selected FROM m""")
def v3_layer_routing(spark, folder):
    v = vectors(spark, folder)
    hits = V.knn(v.where("vec_id % 50 = 0"), v, 20).join(v.select("vec_id", F.col("label").alias("layer")), "vec_id")
    return V.layer_scores(hits.withColumnRenamed("query_id", "question_id"), boosts={3: 0.05})


@query("""WITH n AS (SELECT vec_id % 100 AS k, vec_id, label FROM embeddings) SELECT k, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY vec_id DESC) AS r FROM n) WHERE r = 1""")
def s11_vector_upsert(spark, folder):
    v = S.read(spark, folder, "embeddings").select((F.col("vec_id") % 100).alias("k"), "vec_id", "label")
    half = F.lit(S.read(spark, folder, "embeddings").count() / 2)
    return V.upsert(v.where(F.col("vec_id") < half), v.where(F.col("vec_id") >= half), "k", "vec_id")


@query("""WITH f AS (SELECT 'doc-' || (event_id % 40) AS document_id, 'M-' || (event_id % 6) AS matter_id, ts, event_id FROM events WHERE event_type <> 'view'), l AS (SELECT document_id, matter_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS k FROM f) WHERE k = 1)
SELECT vec_id, coalesce(l.matter_id, CASE WHEN vec_id % 4 <> 0 THEN 'M-' || (vec_id % 7) END) AS matter_id FROM embeddings LEFT JOIN l ON l.document_id = 'doc-' || (vec_id % 40)""")
def v2_relabel(spark, folder):
    e = S.read(spark, folder, "events").where("event_type <> 'view'")
    filings = e.select(F.concat(F.lit("doc-"), F.col("event_id") % 40).alias("document_id"), F.concat(F.lit("M-"), F.col("event_id") % 6).alias("matter_id"), F.struct("ts", "event_id").alias("at"))
    return V.relabelled(vectors(spark, folder), filings).select("vec_id", "matter_id")


# Matching and the catalog


def metric_rows(spark) -> DataFrame:
    rows = [(m.name, m.name, list(m.synonyms), m.definition, [m.source_table, *(j.table for j in m.joins)], None) for m in warehouse.METRICS.values()]
    return spark.createDataFrame(rows, "metric_id string, name string, synonyms array<string>, definition string, tables array<string>, status string")


def questions(spark, folder) -> DataFrame:
    """One question for each customer, from its segment and nation."""
    c = S.read(spark, folder, "customer")
    words = F.array(F.lit("what is our revenue, the net sales, in "), F.lit("show the number of orders for "), F.lit("list everything about "))
    return c.select(F.col("c_custkey").alias("question_id"), F.concat(words[(F.col("c_custkey") % 3).cast("int")], F.lower("c_mktsegment")).alias("text"))


@query("SELECT c_custkey AS question_id, CASE c_custkey % 3 WHEN 0 THEN 'revenue' ELSE 'order_count' END AS metric_id FROM customer WHERE c_custkey % 3 < 2")
def v4_metric_matching(spark, folder):
    return V.match_metrics(questions(spark, folder), metric_rows(spark)).select("question_id", "metric_id")


@query(None)
def v5_relevant_tables(spark, folder):
    rows = [(n, f"rows of {n}", s) for n, s in (("orders", "purchases"), ("lineitem", "sales revenue items"), ("customer", "buyers"), ("supplier", "merchants"))]
    return V.relevant_tables(questions(spark, folder), spark.createDataFrame(rows, "table_name string, description string, synonyms string"))


@query(f"WITH {FACT_SQL}, e AS (SELECT subject_id AS id, predicate FROM facts UNION SELECT object_id, predicate FROM facts) SELECT id, regexp_replace(split_part(id, ':', 2), '[-_]', ' ', 'g') || '. ' || split_part(id, ':', 1) || '. ' || lower(replace(string_agg(predicate, ', ' ORDER BY predicate), '_', ' ')) AS text FROM e WHERE split_part(id, ':', 1) IN ('customer', 'case') GROUP BY 1")
def v6_routing_index(spark, folder):
    t = spark.createDataFrame([("orders", "rows of orders", "purchases")], "table_name string, description string, synonyms string")
    kinds = spark.createDataFrame([("customer",), ("case",)], "kind string")
    return V.routing_index(metric_rows(spark), t, derived.facts(spark, folder), kinds).where("layer = 'entity'").select("id", "text")


def scanned(spark, folder) -> DataFrame:
    """A scan's rows, one for each part: sources, brands as databases, types as tables, names as columns."""
    p = S.read(spark, folder, "part")
    source = F.concat(F.lit("s"), F.col("p_partkey") % 5)
    node = F.concat(F.lit("column:"), source, F.lit(":"), "p_brand", F.lit("."), "p_type", F.lit("."), "p_name")
    return p.select(source.alias("source_id"), F.col("p_brand").alias("database"), F.col("p_type").alias("table"), F.col("p_size").alias("position"), F.col("p_name").alias("column"), F.lit("string").alias("type"), (F.col("p_size") > 40).alias("is_partition"), node.alias("node_id"))


_COLUMNS = """cols AS (SELECT 'source:s' || (p_partkey % 5) AS src, 'table:s' || (p_partkey % 5) || ':' || p_brand || '.' || p_type AS tab, 'column:s' || (p_partkey % 5) || ':' || p_brand || '.' || p_type || '.' || p_name AS col, p_size > 40 AS part FROM part),
cf AS (SELECT DISTINCT src AS subject_id, 'HAS_TABLE' AS predicate, tab AS object_id FROM cols UNION ALL SELECT DISTINCT tab, 'HAS_COLUMN', col FROM cols UNION ALL SELECT DISTINCT tab, 'PARTITIONED_BY', col FROM cols WHERE part)"""


@query(f"WITH {_COLUMNS} SELECT * FROM cf")
def s5_catalog_facts(spark, folder):
    return C.facts(scanned(spark, folder)).select("subject_id", "predicate", "object_id")


@query("""WITH d AS (SELECT event_id % 60 AS node_id, CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'catalog' ELSE 'model' END AS method, (event_id % 90) / 100.0 AS confidence, 'text ' || (event_id % 11) AS description FROM events WHERE event_id % 5 <> 0),
b AS (SELECT node_id, description, method FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE method WHEN 'human' THEN 0 WHEN 'catalog' THEN 1 ELSE 2 END, confidence DESC, description) AS k FROM d) WHERE k = 1)
SELECT c_custkey AS node_id, description, method FROM customer LEFT JOIN b ON b.node_id = c_custkey""")
def j14_description_precedence(spark, folder):
    e = S.read(spark, folder, "events")
    k = F.col("event_id")
    d = e.select((k % 60).alias("node_id"), F.when(k % 3 == 0, "human").when(k % 3 == 1, "catalog").otherwise("model").alias("method"), ((k % 90) / 100.0).alias("confidence"), F.concat(F.lit("text "), k % 11).alias("description"), F.when(k % 5 == 0, "REJECTED").otherwise("APPROVED").alias("review_state"))
    return C.overlaid(S.read(spark, folder, "customer").select(F.col("c_custkey").alias("node_id")), d)


@query("""WITH c AS (SELECT event_id % 50 AS node_id, CASE WHEN event_id % 2 = 0 THEN 'HAS_SYNONYM' ELSE 'CONCERNS_TOPIC' END AS p, event_type || (event_id % 3) AS v FROM events WHERE event_id % 7 <> 0)
SELECT c_custkey AS node_id, coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'HAS_SYNONYM'), '') AS synonyms, coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'CONCERNS_TOPIC'), '') AS topics FROM customer LEFT JOIN c ON node_id = c_custkey GROUP BY 1""")
def j15_synonyms_and_topics(spark, folder):
    k = F.col("event_id")
    claims = S.read(spark, folder, "events").select((k % 50).alias("node_id"), F.when(k % 2 == 0, "HAS_SYNONYM").otherwise("CONCERNS_TOPIC").alias("predicate"), F.concat("event_type", k % 3).alias("value"), F.when(k % 7 == 0, "PENDING").otherwise("APPROVED").alias("review_state"))
    out = C.words_of(S.read(spark, folder, "customer").select(F.col("c_custkey").alias("node_id")), claims)
    return out.select("node_id", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("topics", ",").alias("topics"))


@query("""WITH n AS (SELECT 't-' || (event_id % 2) AS tenant_id, user_id AS node_id, ts AS "at", event_id AS seq, event_type AS label FROM events) SELECT tenant_id, node_id, "at", seq, label FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, node_id ORDER BY "at" DESC, seq DESC) AS k FROM n) WHERE k = 1""")
def s9_node_upsert(spark, folder):
    k = F.col("event_id")
    return C.newest_nodes(S.read(spark, folder, "events").select(F.concat(F.lit("t-"), k % 2).alias("tenant_id"), F.col("user_id").alias("node_id"), F.col("ts").alias("at"), k.alias("seq"), F.col("event_type").alias("label")))


@query("""WITH r AS (SELECT 's' || (p_partkey % 5) AS source_id, p_brand AS database, p_name AS "table", p_size FROM part) SELECT source_id, database, "table", p_size FROM r WHERE source_id <> 's1' UNION ALL SELECT source_id, database, "table", p_size + 1 FROM r WHERE source_id = 's1' AND p_size > 10""")
def s7_scan_replace(spark, folder):
    r = S.read(spark, folder, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 5).alias("source_id"), F.col("p_brand").alias("database"), F.col("p_name").alias("table"), "p_size")
    new = r.where("source_id = 's1' AND p_size > 10").withColumn("p_size", (F.col("p_size") + 1).cast("int"))
    return C.replaced(r, new)


@query("""WITH r AS (SELECT 's' || (p_partkey % 5) AS source_id, p_brand AS database, p_type AS "table", p_size FROM part), s AS (SELECT * FROM r WHERE p_size > 25) SELECT * FROM s UNION ALL SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = r.source_id AND s.database = r.database AND s."table" = r."table")""")
def s8_hydrate(spark, folder):
    r = S.read(spark, folder, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 5).alias("source_id"), F.col("p_brand").alias("database"), F.col("p_type").alias("table"), "p_size")
    return C.hydrated(r.where("p_size > 25"), r)


@query("SELECT CASE WHEN c = '' THEN 'document' ELSE c END AS filename, url FROM (SELECT url, regexp_replace(regexp_replace(string_split(replace(url, '\\', '/'), '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:120] AS c FROM pages)")
def s17_safe_names(spark, folder):
    return S.read(spark, folder, "pages").select(S.safe_name(F.col("url")).alias("filename"), "url")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def u5_distinct_by_content(spark, folder):
    d = documents(spark, folder)
    return d.withColumn("k", F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))).where("k = 1").select("doc_id", "lang", "source")


@query("SELECT database, count(DISTINCT t)::BIGINT AS tables, count(*) AS columns FROM (SELECT p_brand AS database, p_type AS t FROM part) GROUP BY 1")
def s6_listing(spark, folder):
    return C.listing(S.read(spark, folder, "part").select(F.col("p_brand").alias("database"), F.col("p_type").alias("table")))


@query("""WITH q AS (SELECT user_id AS question_id, event_type AS metric_id, round((event_id % 97) / 97.0, 6) AS score FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, metric_id) AS n, lead(score) OVER (PARTITION BY question_id ORDER BY score DESC, metric_id) AS nxt FROM q)
SELECT question_id, metric_id, score FROM r WHERE n = 1 AND score >= 0.45 AND (nxt IS NULL OR score - nxt >= 0.05)""")
def v4_candidate_matching(spark, folder):
    last = S.read(spark, folder, "events").groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("metric_id")).agg(F.max("event_id").alias("e"))
    return V.match_by_candidate(last.select("question_id", "metric_id", F.round((F.col("e") % 97) / 97.0, 6).alias("score")))


@query(f"""WITH {_COLUMNS}, q(question_id, term) AS (VALUES (1, 'brand#1'), (2, 'copper')), e AS (SELECT subject_id AS node, object_id AS other FROM cf UNION ALL SELECT object_id, subject_id FROM cf)
SELECT DISTINCT question_id, node, 1 AS matched, 1.0 AS confidence FROM e, q WHERE contains(lower(regexp_replace(regexp_replace(node, '^[^:]*:', ''), '[-_.]', ' ', 'g') || ' ' || regexp_replace(regexp_replace(other, '^[^:]*:', ''), '[-_.]', ' ', 'g')), term)""")
def g16_catalog_search(spark, folder):
    q = spark.createDataFrame([(1, ["brand#1"]), (2, ["copper"])], "question_id int, terms array<string>")
    return G.catalog_search(C.facts(scanned(spark, folder)), q)


@query("""WITH m AS (SELECT DISTINCT 'm' || (p_partkey % 500) AS metric_id, unnest([p_type, p_brand]) AS table_name FROM part WHERE p_partkey % 3 < 2) SELECT * FROM m WHERE table_name IN (SELECT p_type FROM part WHERE p_size > 25)""")
def j12_metric_lineage(spark, folder):
    p, k = S.read(spark, folder, "part"), F.col("p_partkey")
    metrics = p.select(F.concat(F.lit("m"), k % 500).alias("metric_id"), F.array("p_type", "p_brand").alias("tables"), F.when(k % 3 == 0, "approved").when(k % 3 == 2, "draft").alias("status"))
    return C.lineage(metrics, p.where("p_size > 25").select(F.col("p_type").alias("table_name")))


@query("""WITH a AS (SELECT user_id AS who, ts AS "when", event_type AS kind, event_id AS audit_id, props FROM events) SELECT audit_id, who, kind, "when" FROM a ORDER BY "when" DESC, audit_id LIMIT 200""")
def l9_newest_audit(spark, folder):
    e = S.read(spark, folder, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("who"), F.col("event_type").alias("kind"), F.col("ts").alias("when"))
    seen = L.append_once(e.limit(0), e.unionByName(e), "audit_id")
    return seen.orderBy(F.desc("when"), "audit_id").limit(200)


@query("SELECT event_id, list_extract(['hour', 'day', 'week', 'month'], (event_id % 4 + 1)::INTEGER) AS asked, CASE WHEN event_id % 4 IN (1, 3) THEN list_extract(['hour', 'day', 'week', 'month'], (event_id % 4 + 1)::INTEGER) END AS grain FROM events")
def f21_asked_grains(spark, folder):
    word = F.array(F.lit("hour"), F.lit("day"), F.lit("week"), F.lit("month"))[(F.col("event_id") % 4).cast("int")]
    return S.read(spark, folder, "events").select("event_id", word.alias("asked"), T.asked_grain(F.array(F.lit("total"), word), F.array(F.lit("day"), F.lit("month"))).alias("grain"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 40 NOT IN (SELECT doc_id FROM documents WHERE n_chars > 300)")
def s12_vector_delete(spark, folder):
    gone = documents(spark, folder).where("n_chars > 300").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    return V.deleted(vectors(spark, folder), gone).select("vec_id")


@query("SELECT label || ': ' || count(*) || CASE WHEN count(*) = 1 THEN ' hit' ELSE ' hits' END || CASE WHEN count(*) > 50 THEN ', near the best layer' ELSE ', behind the best layer' END AS reason FROM embeddings GROUP BY label")
def f22_layer_reasons(spark, folder):
    n = vectors(spark, folder).groupBy("label").agg(F.count("*").alias("n"))
    return n.select(T.layer_reason(F.col("label"), F.col("n"), F.col("n") > 50).alias("reason"))


@query(r"""SELECT url, regexp_extract(url, '^([^:]*):', 1) AS scheme, lower(split_part(url, '/', 3)) AS host FROM pages""")
def f14_page_parts(spark, folder):
    p = S.read(spark, folder, "pages")
    return p.select("url", T.kind(F.col("url")).alias("scheme"), F.lower(F.split("url", "/")[2]).alias("host"))
