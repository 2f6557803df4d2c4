"""SQL twins of the core queries, for the engine that checks them."""

from __future__ import annotations

from tidewell.operators import documents, evaluate, quality_gate
from tidewell.functions import text as X

DAY = 86_400_000
NOW = 1_706_745_600_000
TERMS = ("the", "licensed", "apache", "version")

# Raw shapes that the quality queries mix in.
SUBJECTS = ("", "assistant", "/usr/bin/tool", "deadbeef1", "feature/x", "the assistant", "???", "ent:Acme Corp", "a_b_c_d_e_" + "x" * 70, "I cannot say")
PREDICATES = ("none", "x", "Is-Part:of", "mentions", "has", "system prompt")
OBJECTS = ("", "http://example.com/a", "y" * 170, "aaaa_bbbb_cccc_dddd-eeee.ffff:gggg/hhhh", "z " * 45, "refs/heads/main", "(Acme Corp)", "***", "u_v_w_x_y_z_" + "q" * 80, "plain value")
REASONS = ("assistant_or_tool_chatter", "long_machine_blob", "metadata_subject", "incomplete_shape", "low_confidence", "weak_subject", "invalid_object_kind")

EPISODES = """episodes AS (
  SELECT event_id AS rowid_, 'ev:' || event_id AS memory_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS source_type, event_type || ' ' || props AS content,
         greatest(0.0, least(1.0, value / 100)) AS salience, (event_id % 10) / 10 AS strength, CASE event_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier,
         CASE WHEN event_id % 17 = 0 THEN 'forgotten' ELSE 'active' END AS status, CASE WHEN event_id % 19 <> 0 THEN 'user-' || user_id END AS principal, props AS context_json FROM events)"""

TRIPLES = f"""triples AS (
  SELECT 'p:' || o_orderkey AS triple_id, 'customer-' || o_custkey AS subject_id, 'has_order_priority' AS predicate, o_orderpriority AS object_id, 'literal' AS object_kind, (epoch_us(o_orderdate) // 1000) AS valid_from_ms,
         CASE WHEN o_orderkey % 2 = 0 THEN (epoch_us(o_orderdate) // 1000) + 90 * {DAY}::BIGINT END AS valid_to_ms, 0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence, CASE WHEN o_orderkey % 13 = 0 THEN 'superseded' ELSE 'active' END AS status,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 1000 END AS source_episode_id, 'cl:' || (o_orderkey % 12) AS cluster_id FROM orders
  UNION ALL SELECT 'l:' || c_custkey, 'customer-' || c_custkey, 'located_in', 'nation-' || lower(n_name), 'entity', 788918400000, NULL, 0.9::DOUBLE, 'active', c_custkey % 1000, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'r:' || n_nationkey, 'nation-' || lower(n_name), 'part_of', 'region-' || lower(r_name), 'entity', 788918400000, NULL, 0.95::DOUBLE, 'active', NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c:' || l_orderkey || ':' || l_linenumber, 'order-' || l_orderkey, 'contains', 'part-' || l_partkey, 'entity', (epoch_us(l_shipdate) // 1000), NULL, 0.6::DOUBLE + l_linenumber::DOUBLE / 20, 'active', l_orderkey % 1000, NULL FROM lineitem
  UNION ALL SELECT 'b:' || o_orderkey, 'customer-' || o_custkey, 'placed', 'order-' || o_orderkey, 'entity', (epoch_us(o_orderdate) // 1000), NULL, 0.8::DOUBLE, 'active', o_orderkey % 1000, NULL FROM orders)"""

EDGES = "edges AS (SELECT triple_id AS edge_id, subject_id, predicate, object_id, valid_from_ms, valid_to_ms, confidence, confidence AS strength, 1 AS evidence_count FROM triples WHERE status = 'active' AND object_kind = 'entity')"
CLUSTERS = f"clusters AS (SELECT DISTINCT 'cl:' || label AS cluster_id, 0.5::DOUBLE + (label * 7 % 50)::DOUBLE / 100 AS coherence, {NOW} - label::BIGINT * {DAY} AS created_at_ms FROM embeddings)"
MEMBERS = "members AS (SELECT 'cl:' || label AS cluster_id, 'ev:' || vec_id AS memory_id FROM embeddings)"
ABSTRACTIONS = "abstractions AS (SELECT DISTINCT 'ab:' || label AS abstraction_id, 'cl:' || label AS cluster_id, CASE WHEN label = 4 THEN 'I''m unable to provide assistance with that.' ELSE 'Theme ' || label END AS content FROM embeddings WHERE label % 3 <> 0)"
REFS = """refs AS (
  SELECT subject_id AS entity_id, 1 AS s, 0 AS o, predicate FROM triples WHERE status = 'active'
  UNION ALL SELECT object_id, 0, 1, predicate FROM triples WHERE status = 'active' AND object_kind = 'entity')"""

Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
NEAR = f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) AS distance FROM embeddings"
V2 = f"{NEAR} ORDER BY distance, vec_id LIMIT 10"
V2T = "SELECT vec_id::BIGINT AS id FROM embeddings WHERE vec_id % 10 <> 1 AND (vec_id % 5 <> 0 OR vec_id % 20 = 0)"
V5 = """SELECT query_id, neighbour_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE rank <= 3"""


def bm25(rows: str, terms: tuple[str, ...]) -> str:
    """CTEs ending in scored(id, score) over rows, a SELECT of (id, text)."""
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in n)
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * size / average))" for i in n)
    return rf"""said AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM ({rows})),
  tf AS (SELECT id, len(w)::DOUBLE AS size, {tf} FROM said), totals AS (SELECT count(*)::DOUBLE AS n, avg(size) AS average, {df} FROM tf),
  scored AS (SELECT id, round(-({score}), 6) AS score FROM tf, totals WHERE {" + ".join(f"t{i}" for i in n)} > 0)"""


DOCS = "SELECT doc_id AS id, text FROM documents"
L3 = f"WITH {bm25(DOCS, TERMS)} SELECT * FROM scored ORDER BY score, id LIMIT 50"


def fused(rows: str, terms: tuple[str, ...], budget: int, kind: str = "") -> str:
    near = f"SELECT vec_id::BIGINT AS id, distance, row_number() OVER (ORDER BY distance, vec_id) AS vector_rank FROM ({NEAR} ORDER BY distance, vec_id LIMIT {budget})"
    return f"""{bm25(rows, terms)}, v AS (SELECT * FROM ({near}) {kind}),
  l AS (SELECT id, score, row_number() OVER (ORDER BY score, id) AS lexical_rank FROM (SELECT * FROM scored ORDER BY score, id LIMIT {budget})),
  found AS (SELECT coalesce(v.id, l.id) AS id, distance, score, vector_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS rrf FROM v FULL JOIN l ON v.id = l.id)"""


F1 = f"WITH {fused(DOCS, TERMS, 40)} SELECT id, vector_rank, lexical_rank, round(rrf, 6) AS rrf_score FROM found"
_ACTIVE = "SELECT rowid_ AS id, content AS text FROM episodes WHERE status = 'active'"


def recalled(budget: int, limit: int) -> str:
    words = ("error", "k", "69")
    return f"""WITH {EPISODES}, {fused(_ACTIVE, words, budget, "WHERE id % 5 <> 4")}
SELECT rowid_ AS rowid, memory_id, coalesce(distance, 1.0) AS distance, score,
       round(rrf + least(1, greatest(0, salience)) * 0.012 + least(1, greatest(0, strength)) * 0.008 + CASE tier WHEN 'hot' THEN 0.006 WHEN 'warm' THEN 0.003 ELSE 0 END
         + CASE WHEN {NOW} - ts_ms <= 7 * {DAY}::BIGINT THEN 0.006 WHEN {NOW} - ts_ms <= 30 * {DAY}::BIGINT THEN 0.003 ELSE 0 END
         + CASE WHEN contains(lower(context_json), 'error') OR contains(lower(context_json), 'k') OR contains(lower(context_json), '69') THEN 0.006 ELSE 0 END, 6) AS fused_score
FROM episodes JOIN found ON rowid_ = id WHERE status = 'active' ORDER BY fused_score DESC, distance, rowid LIMIT {limit}"""


F3 = recalled(80, 20)
F6S = f"SELECT * FROM ({recalled(200, 50)}) WHERE rowid % 6 = 0 ORDER BY fused_score DESC, distance, rowid LIMIT 10"
CHUNKS = "chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS doc_id, turn AS chunk_index, text, 'user-' || (conv_id % 20) AS ingested_by FROM conversations)"
_LIVE = "SELECT chunk_id AS id, text FROM chunks WHERE doc_id % 9 <> 8"
F4 = f"""WITH {CHUNKS}, {fused(_LIVE, ("report", "on", "market", "history"), 80, "WHERE (id // 1000) % 5 <> 4").replace("vec_id::BIGINT AS id", "vec_id::BIGINT * 1000 AS id")}
SELECT chunk_id AS id, doc_id, chunk_index, coalesce(distance, 1.0) AS distance, score, round(rrf, 6) AS fused_score
FROM chunks JOIN found ON chunk_id = found.id WHERE doc_id % 9 <> 8 ORDER BY fused_score DESC, distance, chunk_index, id LIMIT 20"""
J1 = f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_index, 'chat ' || doc_id AS source FROM chunks WHERE doc_id % 9 <> 8"
V4 = f"""WITH {EPISODES}, c AS (SELECT conv_id * 1000 + turn AS id, conv_id % 9 <> 8 AS live, conv_id % 5 <> 0 AS held FROM conversations), e AS (SELECT rowid_ AS id, status = 'active' AS live, rowid_ % 7 <> 0 AS held FROM episodes WHERE tier = 'hot'),
  b AS (SELECT 'chunk' AS kind, * FROM c UNION ALL SELECT 'episode', * FROM e)
SELECT kind, count(*) FILTER (live) AS expected, count(*) FILTER (held) AS indexed, count(*) FILTER (live) - count(*) FILTER (held) AS diff, count(*) FILTER (live AND NOT held) AS missing, count(*) FILTER (held AND NOT live) AS stale FROM b WHERE live OR held GROUP BY kind"""
# What the outbox leaves: every document but those of ids ending in 3, of which every second comes back; a third has new texts.
_LEFT = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'The licensed Apache version. ' ELSE '' END || text AS text FROM documents WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3"
S20D = f"WITH {bm25(f'SELECT doc_id AS id, text FROM ({_LEFT})', TERMS)} SELECT id, score FROM scored ORDER BY score, id LIMIT 100"
W7S = f"SELECT doc_id FROM ({_LEFT})"
V4D = f"""WITH i AS (SELECT doc_id AS id FROM ({_LEFT})), e AS (SELECT CASE WHEN doc_id % 10 = 4 THEN -doc_id ELSE doc_id END AS id FROM documents)
SELECT 'document' AS kind, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM e) - (SELECT count(*) FROM i) AS diff, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM i)) AS missing, (SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM e)) AS stale"""
F6 = """SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN true WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN true
  WHEN event_id % 4 = 0 OR event_id % 5 = 0 THEN false ELSE event_id % 3 = 0 END AS inside FROM events"""

_STOP = ", ".join(f"'{w}'" for w in evaluate.STOP_WORDS)
_EVAL = f"""m AS (SELECT conv_id AS case_id, conv_id || ':' || turn AS memory_id, text, CASE WHEN role = 'assistant' THEN 'decision' ELSE 'semantic' END AS tier, turn / 10 AS importance, turn % 5 = 4 AS gone FROM conversations),
  qt AS (SELECT case_id, term, count(*) AS wanted FROM (SELECT conv_id AS case_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM conversations WHERE turn = 0) WHERE term <> '' AND term NOT IN ({_STOP}) GROUP BY ALL),
  mt AS (SELECT case_id, memory_id, term, count(*) AS n FROM (SELECT case_id, memory_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM m WHERE NOT gone) WHERE term <> '' AND term NOT IN ({_STOP}) GROUP BY ALL),
  met AS (SELECT mt.case_id, memory_id, sum(least(n, wanted)) AS overlap, sum(CASE WHEN length(mt.term) >= 6 THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END) AS specificity FROM mt JOIN qt ON mt.case_id = qt.case_id AND mt.term = qt.term GROUP BY ALL),
  tot AS (SELECT case_id, sum(wanted) AS total FROM qt GROUP BY case_id),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, memory_id) AS rank FROM (
    SELECT m.case_id, m.memory_id, round(coalesce(overlap / total, 0) + coalesce(specificity, 0) + CASE tier WHEN 'decision' THEN 0.08 ELSE 0.05 END + least(1.0, importance) * 0.04, 6) AS score
    FROM m LEFT JOIN tot ON m.case_id = tot.case_id LEFT JOIN met ON m.case_id = met.case_id AND m.memory_id = met.memory_id WHERE NOT gone))"""
F7 = f"WITH {_EVAL} SELECT case_id, memory_id, score, rank FROM ranks"
A14S = f"""WITH {_EVAL}, b AS (SELECT case_id, memory_id, CASE WHEN rank <= 3 THEN rank END AS l, CASE WHEN split_part(memory_id, ':', 2)::INT % 2 = 1 THEN split_part(memory_id, ':', 2)::INT + 1 END AS v FROM ranks),
  h AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + v), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 9) DESC, memory_id) AS rank FROM b WHERE l IS NOT NULL OR v IS NOT NULL),
  f AS (SELECT case_id, rank, v, l FROM h WHERE rank <= 2 AND memory_id = case_id || ':1'), w AS (SELECT case_id FROM h WHERE rank = 1 AND memory_id = case_id || ':2'), n AS (SELECT count(*)::DOUBLE AS n FROM conversations WHERE turn = 0)
SELECT round(count(rank) / any_value(n), 6) AS recall_at_k, round(coalesce(sum(1.0::DOUBLE / rank), 0) / any_value(n), 6) AS mrr, count(v)::BIGINT AS vector_supported, count(l)::BIGINT AS lexical_supported, round(1 - (SELECT count(*) FROM w) / any_value(n), 6) AS top_1_safety FROM n LEFT JOIN f ON true"""
A14 = f"""WITH {_EVAL}, e AS (SELECT case_id, memory_id FROM m WHERE NOT gone AND memory_id LIKE '%:1'), c AS (
  SELECT e.case_id, count(*) FILTER (rank <= 2) / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr, CASE WHEN min(rank) = 1 THEN 1 ELSE 0 END AS top FROM e LEFT JOIN ranks r ON e.case_id = r.case_id AND e.memory_id = r.memory_id GROUP BY e.case_id)
SELECT round(avg(recall), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(top), 6) AS top_1 FROM c"""

_COUNTED = "counted AS (SELECT cluster_id, count(*) AS n FROM members m JOIN episodes e ON m.memory_id = e.memory_id WHERE e.status = 'active' GROUP BY cluster_id)"
G1 = f"""WITH {EPISODES}, {CLUSTERS}, {MEMBERS}, {ABSTRACTIONS}, {_COUNTED}
SELECT c.cluster_id, abstraction_id, content AS abstraction_text, coalesce(n, 0)::BIGINT AS episode_count, round(coherence, 6) AS coherence, created_at_ms
FROM clusters c LEFT JOIN abstractions a ON c.cluster_id = a.cluster_id LEFT JOIN counted k ON c.cluster_id = k.cluster_id WHERE created_at_ms >= {NOW} - 8 * {DAY}::BIGINT ORDER BY created_at_ms DESC, c.cluster_id LIMIT 20"""
_FACT = "DISTINCT triple_id, subject_id, predicate, object_id, object_kind, valid_from_ms, valid_to_ms, round(confidence, 6) AS confidence, cluster_id"
G2 = f"WITH {TRIPLES} SELECT {_FACT} FROM triples WHERE status = 'active' AND subject_id = 'customer-7' AND valid_from_ms >= 800000000000 AND (valid_to_ms IS NULL OR valid_to_ms <= 1000000000000) ORDER BY valid_from_ms DESC, triple_id, object_id LIMIT 20"
_USER = "('user', 'nation-nation_3', 'nation-france', 'order-3')"
G2B = f"WITH {TRIPLES} SELECT {_FACT} FROM triples WHERE status = 'active' AND (subject_id IN {_USER} OR object_id IN {_USER}) ORDER BY valid_from_ms DESC, triple_id, object_id LIMIT 50"
G3 = f"""WITH {TRIPLES}, {REFS}
SELECT entity_id, sum(s)::BIGINT AS subject_count, sum(o)::BIGINT AS object_count, count(*) AS fact_count, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates,
       min(CASE WHEN lower(entity_id) = 'customer-1' THEN 0 WHEN lower(entity_id) LIKE 'customer-1%' THEN 1 ELSE 2 END)::BIGINT AS match_score
FROM refs WHERE lower(entity_id) LIKE '%customer-1%' GROUP BY entity_id ORDER BY match_score, fact_count DESC, entity_id LIMIT 50"""
P4 = f"""WITH {TRIPLES}, {REFS}
SELECT entity_id, sum(s)::BIGINT AS subject_count, sum(o)::BIGINT AS object_count, count(*) AS fact_count, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates,
       min(CASE WHEN lower(entity_id) = 'er-_2%5' THEN 0 WHEN lower(entity_id) LIKE 'er-_2%5%' THEN 1 ELSE 2 END)::BIGINT AS match_score
FROM refs WHERE lower(entity_id) LIKE '%er-_2%5%' GROUP BY entity_id ORDER BY match_score, fact_count DESC, entity_id LIMIT 100"""
S23 = f"WITH {TRIPLES}, {REFS} SELECT DISTINCT entity_id FROM refs WHERE entity_id LIKE 'part-1%'"
Q13W = "SELECT 'd' || doc_id AS item_id, CASE WHEN doc_id % 9 <> 4 THEN length(coalesce(text, ''))::VARCHAR END AS value, CASE WHEN doc_id % 9 = 4 THEN 3 ELSE 0 END::BIGINT AS attempts FROM documents"
S19 = f"WITH {EPISODES} SELECT rowid_ AS rowid, ts_ms, principal, source_type FROM episodes"
C19 = """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS shape, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, o_orderpriority AS p FROM orders),
f AS (SELECT 0 AS shape, 0 AS place UNION ALL SELECT 1, 0 UNION ALL SELECT 2, 0 UNION ALL SELECT 2, 1 UNION ALL SELECT 5, 0 UNION ALL SELECT 6, 0 UNION ALL SELECT 6, 1 UNION ALL SELECT 7, 0)
SELECT o_orderkey,
  CASE o.shape WHEN 0 THEN 'About order ' || k WHEN 2 THEN 'Order ' || k || ' has recent work items: Ship it; Bill ' || p || '!.' WHEN 6 THEN 'Recent memories discuss Order ' || k || '.'
    WHEN 7 THEN 'Recent memories include work items: Ask ' || c || '.' WHEN 1 THEN 'Order ' || k WHEN 5 THEN 'Order ' || k END AS content,
  CASE o.shape WHEN 0 THEN 0.9 WHEN 2 THEN 1.0 WHEN 7 THEN 0.0 WHEN 1 THEN 0.6 WHEN 5 THEN 0.6 WHEN 6 THEN 0.6 END::DOUBLE AS confidence, place::BIGINT AS place,
  CASE o.shape WHEN 0 THEN 'customer-' || c WHEN 1 THEN 'customer-' || c WHEN 2 THEN 'order_' || k WHEN 5 THEN 'b' WHEN 6 THEN if(place = 0, 's', 't') WHEN 7 THEN 's' END AS subject_id,
  CASE o.shape WHEN 0 THEN 'placed' WHEN 1 THEN 'has_priority' WHEN 2 THEN 'has_task' WHEN 5 THEN 'p' WHEN 6 THEN 'p' WHEN 7 THEN 'p' END AS predicate,
  CASE o.shape WHEN 0 THEN 'order-' || k WHEN 1 THEN p WHEN 2 THEN if(place = 0, 'ship_it', trim(regexp_replace(lower('bill ' || p), '[^a-z0-9]+', '_', 'g'), '_')) WHEN 5 THEN p WHEN 6 THEN 'o' WHEN 7 THEN 'o' END AS object_id,
  CASE WHEN o.shape = 0 THEN 'entity' WHEN place IS NOT NULL THEN 'literal' END AS object_kind
FROM o LEFT JOIN f ON o.shape = f.shape"""
A2K = 'SELECT kind AS "group", count(*) AS n, count(DISTINCT client_id) AS exact, true AS within FROM clicks GROUP BY kind'
Q17D = """SELECT strftime(ts, '%Y-%m-%d') AS day, kind AS "group", count(*) AS n, count(DISTINCT client_id) AS exact, true AS within FROM clicks
WHERE ts >= DATE '2024-02-01' AND ts < DATE '2024-04-01' GROUP BY ALL"""
M5 = "SELECT DISTINCT click_id AS entry_id FROM clicks"
O5 = f"WITH {TRIPLES}, {REFS} SELECT entity_id, sum(s)::BIGINT AS subjects, sum(o)::BIGINT AS objects FROM refs GROUP BY entity_id"
Q11 = f"""WITH {TRIPLES}, t AS (SELECT * FROM triples WHERE status = 'active')
SELECT a.subject_id, a.predicate, a.triple_id AS a_triple_id, b.triple_id AS b_triple_id, a.object_id AS a_object_id, b.object_id AS b_object_id
FROM t a JOIN t b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.triple_id < b.triple_id AND a.object_id <> b.object_id
 AND a.valid_from_ms <= coalesce(b.valid_to_ms, 9223372036854775807) AND b.valid_from_ms <= coalesce(a.valid_to_ms, 9223372036854775807)"""
_FOUND = """found AS (SELECT o_orderkey AS k, 'p:' || o_orderkey AS a_triple_id, 'p:' || (o_orderkey * 7 + 1) AS b_triple_id, 'temporal' AS kind, (epoch_us(o_orderdate) // 1000) AS detected_at_ms,
  CASE WHEN o_orderkey % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 777 END AS resolved_at_ms FROM orders)"""
G4 = f"""WITH {TRIPLES}, {_FOUND}, t AS (SELECT triple_id, subject_id || ' ' || predicate || ' ' || object_id AS fact FROM triples)
SELECT a_triple_id, b_triple_id, kind, detected_at_ms, a.fact AS a_fact, b.fact AS b_fact FROM found LEFT JOIN t a ON a_triple_id = a.triple_id LEFT JOIN t b ON b_triple_id = b.triple_id ORDER BY detected_at_ms DESC, a_triple_id, b_triple_id LIMIT 30"""
Q15 = f"""WITH {_FOUND} SELECT a_triple_id, b_triple_id, CASE WHEN k % 400 = 0 THEN 'resolved' WHEN k % 200 = 0 THEN 'reopened' ELSE status END AS status,
 CASE WHEN k % 400 = 0 THEN {NOW} WHEN k % 200 = 0 THEN NULL ELSE resolved_at_ms END AS resolved_at_ms FROM found"""
G5 = f"""WITH {EPISODES}, {CLUSTERS}, {MEMBERS}, {ABSTRACTIONS}, i AS (SELECT count(*) AS n, string_agg(e.memory_id, ',' ORDER BY ts_ms, e.memory_id) AS ids FROM members m JOIN episodes e ON m.memory_id = e.memory_id WHERE cluster_id = 'cl:2' AND status = 'active')
SELECT c.cluster_id, a.abstraction_id, n::BIGINT AS n_episodes, ids AS memory_ids FROM clusters c LEFT JOIN abstractions a ON c.cluster_id = a.cluster_id, i WHERE c.cluster_id = 'cl:2'"""


def paths(start: str, end: str | None, hops: int, t: int | None) -> str:
    """end: None for the start's nation, else its region."""
    target = "(SELECT 'nation-' || lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)"
    if end:
        target = "(SELECT 'region-' || lower(r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 1)"
    valid = "" if t is None else f"WHERE valid_from_ms <= {t} AND (valid_to_ms IS NULL OR valid_to_ms > {t})"
    two = f"""UNION ALL SELECT 2, a.edge_id || ' ' || b.edge_id, '{start}>' || a.object_id || '>' || target, sqrt(a.s * b.s) FROM e a JOIN e b ON b.subject_id = a.object_id, target
      WHERE a.subject_id = '{start}' AND b.object_id = target AND a.object_id NOT IN ('{start}', target)"""
    return f"""WITH {TRIPLES}, {EDGES}, e AS (SELECT *, confidence * strength AS s FROM edges {valid}), target AS (SELECT {target} AS target)
SELECT hops, edge_ids, nodes, round(score, 6) AS score FROM (SELECT 1 AS hops, edge_id AS edge_ids, '{start}>' || target AS nodes, s AS score FROM e, target WHERE subject_id = '{start}' AND object_id = target {two if hops > 1 else ""})
ORDER BY round(score, 6) DESC, hops, edge_ids, nodes LIMIT 20"""


def many_paths(t: int | None) -> str:
    valid = "" if t is None else f"WHERE valid_from_ms <= {t} AND (valid_to_ms IS NULL OR valid_to_ms > {t})"
    rows = f"""c_custkey * {DAY}::BIGINT AS valid_from_ms, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey + 400) * {DAY}::BIGINT END AS valid_to_ms"""
    return f"""WITH edges AS (
  SELECT 'h:' || c_custkey AS edge_id, 'nation-' || c_nationkey AS subject_id, 'customer-' || c_custkey AS object_id, {rows}, (0.5::DOUBLE + (c_custkey % 50)::DOUBLE / 100) * (0.3::DOUBLE + (c_custkey % 7)::DOUBLE / 10) AS s FROM customer
  UNION ALL SELECT 's:' || c_custkey, 'customer-' || c_custkey, 'segment-' || lower(c_mktsegment), {rows}, (0.6::DOUBLE + (c_custkey % 40)::DOUBLE / 100) * (0.2::DOUBLE + (c_custkey % 8)::DOUBLE / 10) FROM customer
  UNION ALL SELECT 'd:' || c_custkey, 'nation-' || c_nationkey, 'segment-' || lower(c_mktsegment), {rows}, (c_custkey % 10)::DOUBLE / 10 * 0.4::DOUBLE FROM customer),
e AS (SELECT * FROM edges {valid}), one AS (SELECT 1 AS hops, edge_id AS edge_ids, 'nation-7>segment-building' AS nodes, s AS score FROM e WHERE subject_id = 'nation-7' AND object_id = 'segment-building' ORDER BY s DESC, edge_id LIMIT 20),
two AS (SELECT 2 AS hops, a.edge_id || ' ' || b.edge_id AS edge_ids, 'nation-7>' || a.object_id || '>segment-building' AS nodes, sqrt(a.s * b.s) AS score FROM e a JOIN e b ON b.subject_id = a.object_id
  WHERE a.subject_id = 'nation-7' AND b.object_id = 'segment-building' AND a.object_id NOT IN ('nation-7', 'segment-building') ORDER BY a.s * b.s DESC, a.edge_id, b.edge_id LIMIT 20)
SELECT hops, edge_ids, nodes, round(score, 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY round(score, 6) DESC, hops, edge_ids, nodes LIMIT 20"""


_EVIDENCE = """evidence AS (SELECT 'v:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS evidence_id, 'b:' || l_orderkey AS edge_id, 'ev:' || l_partkey AS memory_id,
  CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 500 END AS source_episode_id, l_discount AS extraction_confidence, (epoch_us(l_shipdate) // 1000) AS created_at_ms FROM lineitem)"""
G7 = f"""WITH {TRIPLES}, {EDGES}, {_EVIDENCE}, best AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY extraction_confidence DESC, created_at_ms DESC, evidence_id, memory_id) AS r FROM evidence)
SELECT e.edge_id, e.subject_id, evidence_id, memory_id FROM edges e LEFT JOIN best b ON b.edge_id = e.edge_id AND r = 1"""
G7P = f"""WITH {EPISODES}, {_EVIDENCE} SELECT evidence_id, edge_id, coalesce(substr(a.content, 1, 240), substr(b.content, 1, 240)) AS preview, round(extraction_confidence, 6) AS extraction_confidence
FROM evidence v LEFT JOIN episodes a ON a.rowid_ = v.source_episode_id LEFT JOIN episodes b ON b.memory_id = v.memory_id WHERE edge_id = 'b:3' ORDER BY round(extraction_confidence, 6) DESC, evidence_id LIMIT 100"""
_SEEDS = "('customer-1', 'customer-2', 'order-3')"
G8 = f"""WITH {TRIPLES}, {EDGES}, e AS (SELECT *, confidence * strength * (1 + 0.05 * ln(1 + least(evidence_count, 10))) AS s FROM edges)
SELECT hops, edge_ids, nodes, score FROM (
  SELECT 1 AS hops, edge_id AS edge_ids, subject_id || '>' || object_id AS nodes, round(s, 6) AS score FROM e WHERE subject_id IN {_SEEDS} AND object_id NOT IN {_SEEDS}
  UNION ALL SELECT 2, a.edge_id || ' ' || b.edge_id, a.subject_id || '>' || a.object_id || '>' || b.object_id, round(sqrt(a.s * b.s), 6) FROM e a JOIN e b ON b.subject_id = a.object_id
  WHERE a.subject_id IN {_SEEDS} AND a.object_id NOT IN {_SEEDS} AND b.object_id NOT IN {_SEEDS}) ORDER BY score DESC, hops, edge_ids, nodes LIMIT 50"""
G9 = f"WITH {TRIPLES}, {EDGES} SELECT edge_id, round(confidence * strength * (1 + 0.05 * ln(1 + least(length(edge_id), 10))), 6) AS score FROM edges"
G14 = f"""WITH {EPISODES}, {CLUSTERS} SELECT kind, id FROM (SELECT 'cluster' AS kind, cluster_id AS id FROM clusters UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents UNION ALL SELECT 'episode', memory_id FROM episodes)
WHERE kind > 'document' OR (kind = 'document' AND id > '5') ORDER BY kind, id LIMIT 200"""

_SEEDS3 = "('customer-1', 'order-3', 'nation-france')"
_WAY = f"CASE WHEN own AND other AND subject_id = object_id THEN 'self' WHEN own AND other THEN 'between_seed_entities' WHEN own THEN 'outgoing' WHEN other THEN 'incoming' ELSE 'related' END"
G8F = f"""WITH {TRIPLES}, f AS (SELECT triple_id AS edge_id, *, subject_id IN {_SEEDS3} AS own, object_kind = 'entity' AND object_id IN {_SEEDS3} AS other FROM triples WHERE status = 'active')
SELECT edge_id, subject_id, predicate, object_id, object_kind, {_WAY} AS direction, round(confidence * confidence * (1 + 0.05 * ln(2)), 6) AS score,
 'query_entity,' || {_WAY} || CASE WHEN object_kind = 'entity' THEN ',graph_neighbor' ELSE ',literal_fact' END || ',evidence_backed' AS reason_codes
FROM f WHERE own OR other ORDER BY object_kind = 'entity' DESC, confidence DESC, edge_id LIMIT 50"""
_EIGHT = "(" + ", ".join(f"'customer-{i}'" for i in range(1, 9)) + ")"
G8A = f"SELECT c_name AS alias, 'customer-' || c_custkey AS canonical_id, upper(c_name) AS display_label, (c_custkey % 10)::DOUBLE / 10 AS confidence FROM customer WHERE 'customer-' || c_custkey IN {_EIGHT} ORDER BY confidence DESC, c_custkey DESC, alias LIMIT 50"
FACT_REVIEWS = """fact_reviews AS (SELECT 'rv:' || o_orderkey AS review_id, 'f' || o_orderkey AS fingerprint, o_orderkey AS k, 'cl:' || o_orderstatus AS cluster_id, 'customer-' || o_custkey AS subject_id, 'placed' AS predicate, 'order-' || o_orderkey AS object_id, 'entity' AS object_kind,
  (o_orderkey % 100)::DOUBLE / 100 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'low_confidence' ELSE 'weak_literal_claim' END AS reason_code, CASE o_orderkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'dismissed' ELSE 'needs_review' END AS status, epoch_us(o_orderdate) // 1000 AS created_at_ms FROM orders)"""
G8W = f"WITH {FACT_REVIEWS} SELECT review_id, reason_code, subject_id, predicate, object_id, object_kind, confidence FROM fact_reviews WHERE status = 'needs_review' AND subject_id IN {_EIGHT} ORDER BY created_at_ms DESC, review_id LIMIT 50"
_GRAPH = f"""{TRIPLES}, {CHUNKS}, {MEMBERS}, ge AS (SELECT 'triple' AS kind, triple_id AS edge_id, subject_id AS source, object_id AS target FROM triples WHERE status = 'active' AND object_kind = 'entity'
  UNION ALL SELECT 'document_chunk', doc_id || ':' || chunk_index, doc_id::VARCHAR, doc_id || ':' || chunk_index FROM chunks UNION ALL SELECT 'cluster_member', cluster_id || ':' || memory_id, cluster_id, memory_id FROM members)"""
G14E = f"WITH {_GRAPH} SELECT * FROM ge WHERE kind > 'document_chunk' OR (kind = 'document_chunk' AND edge_id > '5') ORDER BY kind, edge_id LIMIT 300"
G14N = f"""WITH {_GRAPH} SELECT * FROM (SELECT 'out' AS direction, kind, edge_id, target AS node FROM ge WHERE source = 'customer-2' UNION ALL SELECT 'in', kind, edge_id, source FROM ge WHERE target = 'customer-2' AND source <> 'customer-2')
ORDER BY direction, kind, edge_id, node LIMIT 100"""
G14I = f"""WITH {_GRAPH} SELECT 'order-3' AS node, count(*) FILTER (source = 'order-3') AS n_out, count(*) FILTER (target = 'order-3') AS n_in, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (source = 'order-3'), '') AS out_kinds,
 coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (target = 'order-3'), '') AS in_kinds FROM ge WHERE source = 'order-3' OR target = 'order-3'"""
# Twins of the inbox and of the document listing follow the rules of the interface, not the operator.
_MEMORIES = f"""raw AS (SELECT 'm:' || doc_id AS memory_id, doc_id AS n, text AS content, source AS source_type FROM documents UNION ALL SELECT 't:' || conv_id || ':' || turn, conv_id * 7 + turn, text, role FROM conversations),
  memories AS (SELECT *, {NOW} - (CASE WHEN n % 10 = 0 THEN n - n % 100 ELSE n END) * 1000 AS ts_ms, (n % 100)::DOUBLE / 100 AS salience, CASE WHEN n % 17 = 0 THEN 'forgotten' ELSE 'active' END AS status FROM raw)"""
_SHORT = lambda text, most: f"CASE WHEN length({text}) <= {most} THEN {text} ELSE substr({text}, 1, {most - 3}) || '...' END"
G13 = f"""WITH {_MEMORIES}, lines AS (SELECT *, rtrim(split_part(content, chr(10), 1), chr(13)) AS line FROM memories)
SELECT m.memory_id, {_SHORT("line", 80)} AS label, {_SHORT("content", 200)} AS preview, ts_ms, source_type, salience, status, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'dismissed' END AS review_state,
  {NOW} + doc_id AS reviewed_at_ms, CASE WHEN doc_id % 2 = 0 THEN 'seen ' || doc_id END AS review_note
FROM lines m LEFT JOIN labels ON m.memory_id = 'm:' || doc_id WHERE status = 'active' ORDER BY ts_ms DESC, m.memory_id ASC LIMIT 200"""
G16 = f"WITH {EPISODES} SELECT rowid_ AS rowid, ts_ms, principal, source_type AS operation FROM episodes WHERE source_type = 'error' AND ts_ms >= 1704153600000 ORDER BY ts_ms DESC, rowid_ DESC LIMIT 100"
G17 = f"WITH {EPISODES} SELECT rowid_ AS rowid, ts_ms, source_type, principal FROM episodes WHERE ts_ms >= 1705000000000"
_LOST = "SELECT rowid_ FROM episodes WHERE principal = 'user-8'"
G18 = f"""WITH {EPISODES}, {TRIPLES}, {MEMBERS}, {CHUNKS} SELECT 'episodes' AS what, memory_id AS key FROM episodes WHERE principal IS DISTINCT FROM 'user-8'
UNION ALL SELECT 'facts', triple_id FROM triples WHERE source_episode_id IS NULL OR source_episode_id NOT IN ({_LOST})
UNION ALL SELECT 'members', cluster_id || ' ' || memory_id FROM members WHERE memory_id NOT IN (SELECT memory_id FROM episodes WHERE principal = 'user-8') UNION ALL SELECT 'chunks', chunk_id::VARCHAR FROM chunks WHERE ingested_by <> 'user-8'"""
G19 = f"""WITH {EPISODES}, {TRIPLES}, {MEMBERS}, {CHUNKS}, lost AS (SELECT * FROM triples WHERE source_episode_id IN ({_LOST})), touched AS (SELECT cluster_id FROM members WHERE memory_id IN (SELECT memory_id FROM episodes WHERE principal = 'user-8'))
SELECT (SELECT count(*) FROM ({_LOST})) AS episodes, (SELECT count(*) FROM lost) AS facts, (SELECT count(*) FROM chunks WHERE ingested_by = 'user-8') AS chunks, (SELECT count(*) FROM triples WHERE source_episode_id IS NULL AND cluster_id IN (SELECT cluster_id FROM touched)) AS orphans"""
W4C = f"WITH {EPISODES}, {TRIPLES} SELECT triple_id, predicate, CASE WHEN source_episode_id NOT IN ({_LOST}) THEN source_episode_id END AS source_episode_id FROM triples"
W5 = "SELECT 'clusters' AS what, 0::BIGINT AS n UNION ALL SELECT 'facts', 0 UNION ALL SELECT 'abstractions', 0 UNION ALL SELECT 'episodes', count(*) FROM events"
W6 = f"""WITH {EPISODES}, {CHUNKS}, outbox AS (SELECT event_id AS entry_id, CASE WHEN event_id % 2 = 0 THEN 'episode' ELSE 'chunk' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id * 500 END AS target_id FROM events)
SELECT * FROM outbox WHERE entry_id % 5 <> 0 AND CASE kind WHEN 'episode' THEN target_id IN (SELECT rowid_ FROM episodes WHERE status = 'active') ELSE target_id IN (SELECT chunk_id FROM chunks) END"""
Q16 = """SELECT l_orderkey AS memory_id, op_id, created_at_ms FROM (SELECT l_orderkey, l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::INT AS op_id, epoch_us(l_shipdate) // 1000 AS created_at_ms FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY created_at_ms DESC, op_id DESC) = 1"""
M7 = f"WITH {EPISODES} SELECT rowid_ AS rowid, ts_ms, source_type FROM episodes WHERE ts_ms >= {NOW} - 20 * {DAY}::BIGINT"
A4 = f"WITH {EPISODES} SELECT tier, status, count(*) AS n FROM episodes GROUP BY tier, status"
S2 = f"WITH {EPISODES} SELECT memory_id, ts_ms, content, tier, status FROM episodes WHERE memory_id = 'ev:17'"
W1 = f"""WITH b AS (
  SELECT 0 AS age, 'customer-' || c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'customer-' || c_custkey END AS name, 0.5::DOUBLE AS confidence, c_custkey * {DAY} AS a, c_custkey * {DAY} AS z FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 1, 'customer-' || c_custkey, 'new ' || c_name, (c_custkey % 10) / 10, c_custkey * {DAY} - 5, c_custkey * {DAY} + 5 FROM customer WHERE c_custkey % 3 <> 1)
SELECT entity_id, max(confidence) AS confidence, min(a) AS first_seen_ms, max(z) AS last_seen_ms, coalesce(arg_min(name, age) FILTER (name <> entity_id), entity_id) AS name FROM b GROUP BY entity_id"""
W2 = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'new ' || n_name END AS n_name FROM nation"
W3 = "SELECT o_orderkey, event_id AS source_episode_id FROM orders LEFT JOIN events ON event_id = o_orderkey"
W4 = f"WITH {EPISODES} SELECT memory_id, tier, status FROM episodes WHERE memory_id NOT IN (SELECT 'ev:' || doc_id FROM labels WHERE quality <> 1)"
W7 = f"WITH {TRIPLES}, {EDGES}, {_EVIDENCE} SELECT e.edge_id, count(*) AS evidence_count FROM edges e JOIN evidence v ON e.edge_id = v.edge_id GROUP BY e.edge_id"
W1A = f"""WITH o AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT * FROM customer WHERE c_custkey % 3 <> 1)
SELECT c.c_name AS alias, CASE WHEN n.c_custkey IS NULL THEN '' ELSE 'new-' END || 'customer-' || c.c_custkey AS canonical_id, upper(c.c_name) AS display_label, CASE WHEN o.c_custkey IS NULL THEN 'gate' ELSE 'names' END AS source,
 CASE WHEN n.c_custkey IS NULL THEN (c.c_custkey % 10)::DOUBLE / 10 WHEN o.c_custkey IS NULL THEN 0.45::DOUBLE ELSE greatest((c.c_custkey % 10)::DOUBLE / 10, 0.45::DOUBLE) END AS confidence, CASE WHEN o.c_custkey IS NULL THEN {NOW} ELSE c.c_custkey END AS created_at_ms,
 CASE WHEN n.c_custkey IS NULL THEN c.c_custkey ELSE {NOW} END AS updated_at_ms FROM customer c LEFT JOIN o ON o.c_custkey = c.c_custkey LEFT JOIN n ON n.c_custkey = c.c_custkey WHERE o.c_custkey IS NOT NULL OR n.c_custkey IS NOT NULL"""
W1C = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS old, o_orderkey % 3 <> 1 AS new, o_orderkey % 5 = 0 AS act FROM orders)
SELECT 'f' || k AS fingerprint, CASE WHEN old THEN 'o' ELSE 'n' END || k AS claim_id, CASE WHEN k % 2 = 0 THEN CASE WHEN NOT new THEN 'or' || k WHEN act AND old THEN NULL ELSE 'nr' || k END END AS review_id, CASE WHEN new THEN (k % 10)::DOUBLE / 10 ELSE (k % 7)::DOUBLE / 10 END AS quality_score,
 CASE WHEN new AND act THEN 'active' WHEN old AND (NOT new OR k % 7 = 0) THEN CASE WHEN k % 7 = 0 THEN 'rejected' ELSE 'quarantined' END ELSE 'needs_review' END AS status, (CASE WHEN old AND NOT (new AND act) THEN 2 ELSE 1 END)::BIGINT AS evidence_count,
 old AND k % 7 = 0 AS user_approved, (CASE WHEN old THEN 1 ELSE 2 END)::BIGINT AS created_at_ms, (CASE WHEN new AND act THEN 2 END)::BIGINT AS activated_at_ms FROM k WHERE old OR new"""
W1R = f"""WITH {FACT_REVIEWS} SELECT fingerprint, CASE WHEN k % 3 = 0 THEN 'new-' ELSE '' END || review_id AS review_id, CASE WHEN k % 3 = 0 THEN 'cl:new' ELSE cluster_id END AS cluster_id, CASE WHEN k % 3 <> 1 THEN confidence / 2 ELSE confidence END AS confidence, CASE WHEN k % 3 <> 1 THEN 'again' ELSE reason_code END AS reason_code,
 CASE WHEN k % 3 = 0 THEN 'needs_review' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN {NOW} ELSE created_at_ms END AS created_at_ms FROM fact_reviews WHERE k % 3 <> 0 OR k % 3 <> 1"""
W1E = f"""WITH {TRIPLES}, {EDGES}, e AS (SELECT *, length(edge_id) % 3 <> 0 AS old, length(edge_id) % 3 <> 1 AS new FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY valid_from_ms DESC, object_id DESC) = 1)
SELECT edge_id, subject_id, CASE WHEN new THEN object_id ELSE 'old' END AS object_id, CASE WHEN new THEN round(confidence, 6) ELSE 0.1::DOUBLE END AS confidence, (CASE WHEN old THEN 9 ELSE 1 END)::BIGINT AS evidence_count, CASE WHEN new THEN 'active' ELSE 'superseded' END AS status, (CASE WHEN old THEN 1 ELSE 2 END)::BIGINT AS created_at_ms FROM e WHERE old OR new"""
W1V = f"""WITH {TRIPLES}, e AS (SELECT *, (length(triple_id) % 2 = 0 OR object_kind <> 'entity') AS old, object_kind = 'entity' AS new FROM triples WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY triple_id ORDER BY valid_from_ms DESC, object_id DESC) = 1)
SELECT triple_id, CASE WHEN old THEN 'v-' ELSE '' END || triple_id AS evidence_id, CASE WHEN new THEN source_episode_id ELSE 1 END AS source_episode_id, (CASE WHEN new THEN 2 ELSE 1 END)::BIGINT AS created_at_ms FROM e WHERE old OR new"""
W1S = "SELECT 'customer-' || c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'active' WHEN c_custkey % 2 = 1 THEN 'merged' WHEN c_custkey % 3 <> 1 THEN 'active' ELSE 'candidate' END AS status FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 3 <> 1"
W8 = f"WITH {EPISODES} SELECT memory_id, CASE WHEN rowid_ IN (1, 2, 17) THEN 'forgotten' ELSE status END AS status, tier FROM episodes"


# The quality rules as SQL expressions


def _any(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(e: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(trim({e}), '^["''`\[\]()]+|["''`\[\]()]+$', '', 'g'), '^ent:', ''))"""


def _joined(e: str, dropped: str, runs: str, sep: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace({e}, '{dropped}', '', 'g'), '{runs}', '{sep}', 'g'), '^{sep}+|{sep}+$', '', 'g'))"


def canonical(e: str) -> str:
    return _joined(clean(e), r"[^A-Za-z0-9\s_\-./\\]", r"[\s_\-./\\]+", "-")


def predicate_id(e: str) -> str:
    return _joined(f"trim({e})", r"[^A-Za-z0-9\s\-_:/\\]", r"[\s\-_:/\\]+", "_")


def _n(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, '{pattern}'))"


def _chatter(e: str) -> str:
    low = f"lower({e})"
    has = lambda p: f"contains({low}, {_q(p)})"
    return f"({low} IN ({', '.join(map(_q, X.CHATTER_EXACT))}) OR ({has('assistant')} AND {_any(map(has, X.CHATTER_WITH_ASSISTANT))}) OR {_any(map(has, X.CHATTER_PHRASES))})"


def _blob(e: str) -> str:
    return rf"(length({e}) >= 72 AND {_n(e, '_')} >= 5 AND {_n(e, chr(92) + 's')} <= 2)"


def _metadata(e: str) -> str:
    v, low = f"trim({e})", f"lower(trim({e}))"
    begins = lambda x, ps: _any(f"starts_with({x}, {_q(p)})" for p in ps)
    source = f"(contains({v}, '\\') AND {_any(f'contains({v}, {_q(p)})' for p in (':', '.rs', '.ts'))})"
    path = f"({begins(low, X.URL_PREFIXES)} OR {begins(v, X.PATH_PREFIXES)} OR substr({v}, 2, 2) = ':\\' OR {source})"
    return f"({path} OR regexp_matches({low}, '^(commit[_-])?[0-9a-f]{{7,64}}$') OR {begins(low, X.BRANCH_PREFIXES)})"


def _machine_id(e: str) -> str:
    v, sep = f"trim({e})", _n(f"trim({e})", r"[_\-.]")
    return rf"(regexp_matches({v}, '^[a-z0-9_.\-]+$') AND ((length({v}) >= 24 AND {sep} >= 1) OR {sep} >= 3 OR {_n(v, '[0-9]')} >= 6))"


def _machine_literal(e: str) -> str:
    v = f"trim({e})"
    return rf"(NOT regexp_matches({v}, '\s') AND length({v}) >= 32 AND {_n(v, '[_' + chr(92) + '-.:/]')} >= 2 AND {_n(v, '[A-Za-z0-9]')} >= 12)"


def _start(s: str, p: str, o: str) -> str:
    every = lambda rule: _any(rule(x) for x in (s, p, o))
    return f"""WHEN {s} = '' OR {p} = '' OR {o} = '' THEN 'incomplete_shape' WHEN {every(_chatter)} THEN 'assistant_or_tool_chatter' WHEN confidence < 0.85 THEN 'low_confidence'
    WHEN {every(_blob)} THEN 'long_machine_blob' WHEN {_metadata(s)} THEN 'metadata_subject'"""


def _literal(s: str, p: str, o: str, alone: str) -> str:
    return f"""CASE WHEN {_metadata(o)} THEN NULL WHEN {alone} AND {_machine_id(s)} THEN 'literal_only_machine_entity' WHEN length({o}) > 160 THEN 'long_literal_evidence' WHEN {_machine_literal(o)} THEN 'machine_literal'
      WHEN {p} IN ({', '.join(map(_q, X.WEAK_LITERAL_PREDICATES))}) AND length({o}) > 80 THEN 'weak_literal_claim' END"""


def _pick(values: tuple[str, ...]) -> str:
    return f"([{', '.join(map(_q, values))}])[(o_orderkey % {len(values)})::INT + 1]"


EXTRACTED = f"""extracted AS (SELECT 't:' || o_orderkey AS triple_id, CASE WHEN o_orderkey % 7 = 0 THEN {_pick(SUBJECTS)} ELSE 'Customer ' || o_custkey END AS subject_id,
  CASE WHEN o_orderkey % 5 = 0 THEN {_pick(PREDICATES)} ELSE 'Has Priority' END AS predicate, CASE WHEN o_orderkey % 3 = 0 THEN {_pick(OBJECTS)} ELSE o_orderpriority END AS object_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'literal' END AS object_kind, 0.7::DOUBLE + (o_orderkey % 30)::DOUBLE / 100 AS confidence FROM orders)"""
_USEFUL_P = lambda p: f"(length({p}) BETWEEN 2 AND 64 AND {p} NOT IN ({', '.join(map(_q, X.VAGUE_PREDICATES))}))"
_USEFUL_L = lambda o: f"(length({o}) BETWEEN 1 AND 240 AND NOT {_blob(o)})"
JUDGED = f"""raw AS (SELECT triple_id, {clean('subject_id')} AS s, {clean('predicate')} AS p, {clean('object_id')} AS o, object_kind, confidence FROM extracted),
  kinds AS (SELECT *, {canonical('s')} AS ns, {predicate_id('p')} AS np, CASE WHEN object_kind = 'entity' AND {_metadata('o')} THEN 'literal' ELSE object_kind END AS nk FROM raw),
  made AS (SELECT *, CASE WHEN nk = 'entity' THEN {canonical('o')} ELSE o END AS no FROM kinds),
  judged AS (SELECT triple_id, ns AS subject_id, np AS predicate, no AS object_id, nk AS object_kind, round(confidence, 6) AS confidence,
    CASE {_start('s', 'p', 'o')} WHEN NOT {_USEFUL_P('np')} THEN 'weak_predicate' WHEN ns = '' THEN 'weak_subject' WHEN nk <> 'literal' AND no = '' THEN 'weak_object' WHEN nk = 'literal' AND NOT {_USEFUL_L('no')} THEN 'weak_literal'
      WHEN nk = 'literal' THEN {_literal('ns', 'np', 'no', 'false')} END AS reason_code FROM made)"""
Q3 = f"WITH {EXTRACTED}, {JUDGED} SELECT * FROM judged"
ROLES = ("assistant", "AI Assistant", "chat-assistant", "System", "model", "LLM", "Bob", "", "  ")
CLAIMS = ("can assist", "has_access", "based on", "likes", "Cannot Assist", "", "provider")
ANSWERS = ("true", "False", "I can't do that, sorry", "no access", "unable to", "42", " ")
_COMPACT = lambda e: f"regexp_replace(substr(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '_', 'g'), '^_', ''), 1, 120), '_$', '')"
_SAID = f"""said AS (SELECT triple_id, CASE WHEN k % 2 = 0 THEN ([{', '.join(map(_q, ROLES))}])[(k % {len(ROLES)})::INT + 1] ELSE subject_id END AS s, CASE WHEN k % 3 = 0 THEN ([{', '.join(map(_q, CLAIMS))}])[(k % {len(CLAIMS)})::INT + 1] ELSE predicate END AS p,
  CASE WHEN k % 5 = 0 THEN ([{', '.join(map(_q, ANSWERS))}])[(k % {len(ANSWERS)})::INT + 1] ELSE object_id END AS o, object_kind FROM (SELECT *, substr(triple_id, 3)::BIGINT AS k FROM extracted))"""
Q2 = f"""WITH {EXTRACTED}, {_SAID}, c AS (SELECT *, {_COMPACT('s')} AS cs, {_COMPACT('p')} AS cp, {_COMPACT('o')} AS co FROM said)
SELECT triple_id, CASE WHEN trim(o) = '' THEN 'empty object_id' WHEN trim(s) = '' THEN 'empty subject_id' WHEN trim(p) = '' THEN 'empty predicate' WHEN cs IN ({', '.join(map(_q, X.RUNTIME_ROLES))}) AND cp IN ({', '.join(map(_q, X.RUNTIME_PREDICATES))}) THEN 'runtime metadata'
 WHEN cs IN ({', '.join(map(_q, X.RUNTIME_ROLES))}) AND object_kind = 'literal' AND (co IN ('true', 'false') OR {_any(f"contains(co, {_q(r)})" for r in X.REFUSALS)}) THEN 'refusal or capability literal' END AS reason FROM c"""
C15 = """SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS told, ms AS back, ms - 9000000 AS shifted, NULL::BIGINT AS none,
 CASE event_id % 5 WHEN 0 THEN event_id % 90 WHEN 1 THEN event_id % 90 * 60 WHEN 2 THEN event_id % 90 * 3600 WHEN 3 THEN event_id % 90 * 86400 END AS seconds FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)"""
C20 = "SELECT event_id, event_id % 11 <> 0 AND (event_id % 7 = 0 OR value / 100 BETWEEN 0 AND 1) AS valid FROM events"
_STATUS = "WHEN reason_code IN ('assistant_or_tool_chatter', 'long_machine_blob') THEN 'quarantined' WHEN reason_code IN ('metadata_subject', 'incomplete_shape', 'invalid_object_kind') THEN 'rejected' ELSE 'needs_review' END"


def _penalties(table: dict[str, float], other: float) -> str:
    return "CASE reason_code " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END"


Q6 = f"""WITH {EXTRACTED}, {JUDGED} SELECT triple_id, CASE WHEN reason_code IS NULL THEN 'active' {_STATUS} AS claim_status,
 round(greatest(0, least(1, CASE WHEN reason_code IS NULL THEN confidence * 0.85::DOUBLE + CASE WHEN object_kind = 'entity' THEN 0.08::DOUBLE ELSE 0.04::DOUBLE END ELSE confidence - {_penalties(quality_gate.PENALTIES, 0.15)} END)), 6) AS quality_score FROM judged"""
Q4 = f"""WITH {EXTRACTED}, linked AS (SELECT subject_id AS id FROM extracted WHERE object_kind = 'entity' UNION SELECT object_id FROM extracted WHERE object_kind = 'entity'),
  r AS (SELECT triple_id, {clean('subject_id')} AS s, {clean('predicate')} AS p, {clean('object_id')} AS o, object_kind AS k, confidence, subject_id NOT IN (SELECT id FROM linked) AS alone FROM extracted),
  m AS (SELECT *, {canonical('s')} AS ns, {predicate_id('p')} AS np FROM r)
SELECT triple_id, CASE {_start('s', 'p', 'o')} WHEN ns = '' THEN 'weak_subject' WHEN NOT {_USEFUL_P('np')} THEN 'weak_predicate' WHEN k = 'entity' AND {canonical('o')} = '' THEN 'weak_object' WHEN k = 'literal' AND NOT {_USEFUL_L('o')} THEN 'weak_literal'
  WHEN k = 'literal' THEN {_literal('ns', 'np', 'o', 'alone')} WHEN k <> 'entity' THEN 'invalid_object_kind' END AS reason_code FROM m"""

Q8 = f"""WITH {TRIPLES}, b AS (
  SELECT subject_id AS entity_id, max(confidence) AS c, min(valid_from_ms) AS a, max(coalesce(valid_to_ms, valid_from_ms)) AS z, 0 AS r FROM triples WHERE status = 'active' GROUP BY subject_id
  UNION ALL SELECT object_id, max(confidence), min(valid_from_ms), max(coalesce(valid_to_ms, valid_from_ms)), 1 FROM triples WHERE status = 'active' AND object_kind = 'entity' GROUP BY object_id)
SELECT entity_id, round(c, 6) AS confidence, a AS first_seen_ms, z AS last_seen_ms FROM b QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY r) = 1"""
Q8E = f"""WITH {TRIPLES} SELECT triple_id AS edge_id, subject_id AS subject_entity_id, predicate, CASE WHEN object_kind = 'entity' THEN object_id END AS object_entity_id, CASE WHEN object_kind = 'literal' THEN object_id END AS object_literal,
 object_kind, valid_from_ms, valid_to_ms, round(confidence, 6) AS confidence, round(confidence, 6) AS strength FROM triples WHERE status = 'active'"""
Q8V = f"""WITH {TRIPLES} SELECT triple_id AS evidence_id, triple_id AS edge_id, 'ev:' || event_id AS memory_id, source_episode_id, cluster_id, round(confidence, 6) AS extraction_confidence
FROM triples LEFT JOIN events ON event_id = source_episode_id WHERE status = 'active'"""
Q9 = f"""WITH {TRIPLES}, reviews AS (SELECT 'f' || o_orderkey AS fingerprint, {_pick(REASONS)} AS reason_code, {_pick(("needs_review", "approved", "dismissed", "rewritten", "needs_review"))} AS status, (o_orderkey % 100)::DOUBLE / 100 AS confidence FROM orders)
SELECT 'mc-active-' || triple_id AS claim_id, round(greatest(0, least(1, confidence)), 6) AS quality_score, 'active' AS status FROM triples WHERE status = 'active'
UNION ALL SELECT 'mc-' || fingerprint, round(greatest(0, confidence - {_penalties(quality_gate.OLD_PENALTIES, 0.20)}), 6),
 CASE WHEN status = 'approved' THEN 'active' WHEN status = 'dismissed' THEN 'rejected' WHEN status = 'rewritten' THEN 'superseded' {_STATUS} FROM reviews"""
_NEW = lambda c: f"CASE {c} WHEN 'customer-1' THEN 'customer-2' WHEN 'order-3' THEN 'order-4' ELSE {c} END"
Q14 = f"WITH {TRIPLES}, n AS (SELECT triple_id, subject_id, object_id, {_NEW('subject_id')} AS new_subject_id, CASE WHEN object_kind = 'entity' THEN {_NEW('object_id')} ELSE object_id END AS new_object_id FROM triples) SELECT triple_id, new_subject_id, new_object_id FROM n WHERE new_subject_id <> subject_id OR new_object_id <> object_id"
_PERCENT = lambda a, b: f"(CASE WHEN {b} = 0 THEN 100 ELSE least(100, 100 * {a} // {b}) END)::BIGINT"
Q17 = f"""WITH {EPISODES}, {TRIPLES}, {CLUSTERS}, {MEMBERS}, {ABSTRACTIONS}, r AS (SELECT (SELECT count(*) FROM episodes WHERE status = 'active') AS active_episodes,
  (SELECT count(DISTINCT m.memory_id) FROM members m JOIN episodes e ON m.memory_id = e.memory_id WHERE status = 'active') AS clustered_episodes, (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM abstractions) AS abstractions,
  (SELECT count(DISTINCT cluster_id) FROM abstractions) AS abstraction_covered, (SELECT count(*) FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM abstractions)) AS pending_clusters,
  (SELECT count(*) FROM triples WHERE status = 'active') AS triples, (SELECT count(DISTINCT cluster_id) FROM triples WHERE status = 'active') AS graph_covered)
SELECT *, {_PERCENT('clustered_episodes', 'active_episodes')} AS cluster_percent, {_PERCENT('abstraction_covered', 'clusters')} AS abstraction_percent, {_PERCENT('graph_covered', 'clusters')} AS graph_percent FROM r"""

_KEY = "lower(regexp_replace(entity_id, '[^A-Za-z0-9]', '', 'g'))"
_CUT = lambda e, n: f"(CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n}) || '...' ELSE {e} END)"
_FACT_SAMPLE = f"subject_id || ' --' || predicate || '--> ' || {_CUT('object_id', 120)} || ' [' || object_kind || ' ' || printf('%.2f', confidence) || '] (' || triple_id || ')'"
_CLUSTER_SAMPLE = f"cluster_id || ' coherence=' || printf('%.3f', coherence) || ' episodes=' || n || ' ' || coalesce({_CUT('content', 140)}, 'no abstraction')"
_LOW = _any(f"contains(lower(content), {_q(p)})" for p in X.LOW_SIGNAL)
_TOTALS = f"""live AS (SELECT * FROM triples WHERE status = 'active'), {REFS}, totals AS (SELECT (SELECT count(*) FROM episodes WHERE status = 'active') AS active_episodes, (SELECT count(DISTINCT m.memory_id) FROM members m JOIN episodes e ON m.memory_id = e.memory_id WHERE status = 'active') AS clustered_episodes,
  (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM abstractions) AS abstractions, (SELECT count(*) FROM live) AS active_triples, (SELECT count(*) FROM live WHERE object_kind = 'entity') AS entity_triples, (SELECT count(*) FROM live WHERE object_kind = 'literal') AS literal_triples,
  (SELECT count(*) FROM fact_reviews WHERE status = 'needs_review') AS triple_reviews_needs_review, (SELECT count(DISTINCT entity_id) FROM refs) AS distinct_entities, (SELECT count(*) FROM orders) AS contradictions)"""


def _hits(code: str, table: str, test: str, sample: str, order: str) -> str:
    return f"SELECT '{code}' AS code, {sample} AS sample, row_number() OVER (ORDER BY {order}) AS place FROM {table} WHERE {test}"


_BY_FACT = [("literal_fact_dominance", "object_kind = 'literal'"), ("long_literal_objects", "object_kind = 'literal' AND length(object_id) > 160"), ("low_confidence_facts", "confidence < 0.85"), ("entity_triples_without_source_episode", "object_kind = 'entity' AND source_episode_id IS NULL")]
_BY_LABEL = [("path_like_entities", "contains(entity_id, '/') OR contains(entity_id, '\\')"), ("commit_like_entities", "regexp_matches(lower(entity_id), '^(commit[_-])?[0-9a-f]{6,40}$')"), ("machine_identifier_entities", _machine_id("entity_id"))]
_BY_CLUSTER = [("low_coherence_clusters", "coherence < 0.72"), ("clusters_missing_abstractions", "n > 0 AND content IS NULL"), ("low_signal_abstractions", _LOW)]
_HITS = " UNION ALL ".join([
    *(_hits(c, "live", t, _FACT_SAMPLE, "valid_from_ms DESC, triple_id") for c, t in _BY_FACT), *(_hits(c, "labels", t, "entity_id", "entity_id") for c, t in _BY_LABEL),
    _hits("literal_only_entities", "labels", "NOT linked", "entity_id || ' (' || refs || ' fact refs)'", "entity_id"), _hits("possible_entity_aliases", "aliased", "true", "l", "k"),
    *(_hits(c, "ca", t, _CLUSTER_SAMPLE, "created_at_ms DESC, cluster_id") for c, t in _BY_CLUSTER), _hits("triple_review_queue", "fact_reviews", "status = 'needs_review'", "reason_code || ': ' || subject_id || ' ' || predicate || ' ' || object_id", "created_at_ms DESC, review_id"),
])
_SEVERITY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in quality_gate.SEVERITIES.items()) + " END"
_ISSUES = f"""{EPISODES}, {TRIPLES}, {CLUSTERS}, {MEMBERS}, {ABSTRACTIONS}, {FACT_REVIEWS}, {_COUNTED}, {_TOTALS},
  named AS (SELECT subject_id AS entity_id, object_kind = 'entity' AS edge FROM live UNION ALL SELECT object_id, true FROM live WHERE object_kind = 'entity'), labels AS (SELECT entity_id, count(*) AS refs, bool_or(edge) AS linked FROM named GROUP BY entity_id),
  aliased AS (SELECT {_KEY} AS k, string_agg(entity_id, ' | ' ORDER BY entity_id) AS l FROM labels WHERE {_KEY} <> '' GROUP BY 1 HAVING count(*) > 1),
  ca AS (SELECT c.*, coalesce(k.n, 0) AS n, a.content FROM clusters c LEFT JOIN counted k ON c.cluster_id = k.cluster_id LEFT JOIN abstractions a ON c.cluster_id = a.cluster_id), hits AS ({_HITS}),
  found AS (SELECT code, count(*) AS n, string_agg(sample, chr(10) ORDER BY place) FILTER (place <= 8) AS samples FROM hits GROUP BY code
    UNION ALL SELECT 'no_clusters', active_episodes, '' FROM totals WHERE active_episodes > 0 AND clusters = 0 UNION ALL SELECT 'no_active_triples', 0, '' FROM totals WHERE active_triples = 0
    UNION ALL SELECT 'unclustered_episodes', active_episodes - clustered_episodes, '' FROM totals WHERE active_episodes > clustered_episodes),
  issues AS (SELECT {_SEVERITY} AS severity, code, n, samples FROM found, totals WHERE code <> 'literal_fact_dominance' OR (active_triples >= 10 AND literal_triples >= 0.7 * active_triples))"""
Q18 = f"WITH {_ISSUES} SELECT * FROM issues"
Q18T = f"WITH {EPISODES}, {TRIPLES}, {CLUSTERS}, {MEMBERS}, {ABSTRACTIONS}, {FACT_REVIEWS}, {_TOTALS} SELECT * FROM totals"
Q18H = f"""WITH {_ISSUES}, k AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues),
  s AS (SELECT *, greatest(0, least(100, 100 - critical * 20 - warnings * 7 - infos * 2))::BIGINT AS score FROM k)
SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'needs_review' ELSE 'weak' END AS grade FROM s"""
A13 = """WITH l AS (SELECT p_name AS n FROM part UNION SELECT upper(p_name) FROM part), k AS (SELECT lower(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) AS canonical_key, n FROM l)
SELECT canonical_key, string_agg(n, '|' ORDER BY n) AS labels, count(*) AS n_labels FROM k WHERE canonical_key <> '' GROUP BY canonical_key HAVING count(*) > 1"""
_RAW = "' [ent:' || p_name || '/' || p_type || ']'"
C2 = f"SELECT p_partkey, {canonical(_RAW)} AS entity_id, {predicate_id('p_type')} AS predicate FROM part"
C11 = """SELECT p_partkey, printf('%016x', list_reduce(list_transform(range(1, octet_length(encode(p_name)) + 1), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i - 1, 2))::UTINYINT::HUGEINT),
  lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616, 14695981039346656037::HUGEINT)::UBIGINT) AS fingerprint FROM part"""
C13 = "SELECT doc_id, length(text) // 4 AS tokens, ceil(octet_length(encode(text)) / 2000)::BIGINT AS chunks FROM documents"

_DAYS = "days AS (SELECT vec_id::BIGINT AS id, vec_id % 10 AS day, embedding::DOUBLE[] AS v FROM embeddings)"
_PAIRS = f"{_DAYS}, pairs AS (SELECT a.id AS a, b.id AS b, a.day::BIGINT AS day, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM days a JOIN days b ON a.day = b.day AND a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3)"
K1 = f"WITH {_PAIRS} SELECT * FROM pairs"
K2 = f"""WITH RECURSIVE {_PAIRS}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
  comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id), cut AS (SELECT component, id, (row_number() OVER (PARTITION BY component ORDER BY id) - 1) // 48 AS part FROM comp)
SELECT min(id) OVER (PARTITION BY component, part) AS cluster_id, id FROM cut QUALIFY count(*) OVER (PARTITION BY component, part) >= 2"""
_MADE = f"""{_PAIRS}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
  comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id), cut AS (SELECT component, id, (row_number() OVER (PARTITION BY component ORDER BY id) - 1) // 48 AS part FROM comp),
  made AS (SELECT min(id) OVER (PARTITION BY component, part) AS cluster_id, id FROM cut QUALIFY count(*) OVER (PARTITION BY component, part) >= 2)"""
K6 = f"WITH RECURSIVE {_MADE} SELECT id FROM days WHERE id NOT IN (SELECT id FROM made)"
_PLAN = f"""{_MADE}, pos AS (SELECT cluster_id, p, avg(v[p] / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS x, count(*) AS n FROM made JOIN days ON made.id = days.id, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS p) q GROUP BY ALL),
  cents AS (SELECT cluster_id, max(n) AS n, list(x ORDER BY p) AS v FROM pos GROUP BY cluster_id), near AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM cents a JOIN cents b ON a.cluster_id <> b.cluster_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3),
  grown AS (SELECT DISTINCT a AS id, a AS other FROM near UNION SELECT g.id, n.b FROM grown g JOIN near n ON g.other = n.a), grp AS (SELECT id, min(other) AS component FROM grown GROUP BY id),
  best AS (SELECT component, sum(n) AS total, arg_min(id, (-n, id)) AS survivor FROM grp JOIN cents ON id = cluster_id GROUP BY component),
  plan AS (SELECT survivor, id AS loser FROM grp JOIN best ON grp.component = best.component WHERE total <= 48 AND id <> survivor)"""
K3 = f"WITH RECURSIVE {_PLAN} SELECT * FROM plan"
K5 = f"WITH RECURSIVE {_PLAN} SELECT count(*) AS losers, count(DISTINCT survivor) AS groups FROM plan"
_EMBEDDED = "embedded AS (SELECT vec_id::BIGINT AS rowid_, CASE WHEN vec_id % 4 = 0 THEN 'old' ELSE 'now' END AS embedder FROM embeddings)"
K6S = f"WITH {EPISODES}, {_EMBEDDED} SELECT e.rowid_ AS id, ts_ms FROM episodes e JOIN embedded v ON e.rowid_ = v.rowid_ WHERE tier = 'hot' AND status = 'active' AND embedder = 'now' AND ts_ms >= {NOW} - 30 * {DAY}::BIGINT"
K7 = f"""WITH {EPISODES}, {_EMBEDDED}, b AS (SELECT * FROM embedded UNION ALL SELECT rowid_, 'now' FROM embedded WHERE rowid_ % 8 = 0), live AS (SELECT rowid_ FROM episodes WHERE status = 'active')
SELECT rowid_ AS rowid, embedder FROM b WHERE rowid_ NOT IN (SELECT rowid_ FROM live) UNION ALL SELECT rowid_, embedder FROM b WHERE embedder <> 'now' AND rowid_ IN (SELECT rowid_ FROM live) AND rowid_ IN (SELECT rowid_ FROM b WHERE embedder = 'now')"""
K7E = f"WITH {EPISODES}, {_EMBEDDED} SELECT rowid_ AS rowid, embedder FROM embedded UNION ALL SELECT rowid_, 'now' FROM episodes WHERE status = 'active' AND rowid_ NOT IN (SELECT rowid_ FROM embedded WHERE embedder = 'now')"
_UNIT = """u AS (SELECT label::BIGINT AS cluster_id, pos::BIGINT AS pos, e[pos + 1] / sqrt(list_sum(list_transform(e, lambda y: y * y))) AS x FROM (SELECT label, embedding::DOUBLE[] AS e, unnest(range(len(embedding))) AS pos FROM embeddings))"""
A10 = f"""WITH {_UNIT}, m AS (SELECT cluster_id, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL)
SELECT cluster_id, n, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)), 6) AS x FROM m"""
A11 = """SELECT a.label::BIGINT AS cluster_id, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS coherence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label
UNION ALL SELECT label, 1.0 FROM embeddings GROUP BY label HAVING count(*) = 1"""

A10M = f"""WITH {_UNIT}, m AS (SELECT cluster_id, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL), c AS (SELECT cluster_id, pos, n, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS x FROM m), h AS ({A11}),
  j AS (SELECT c.cluster_id - c.cluster_id % 2 AS g, pos, sum(x * n) AS x, sum(n) AS n, sum(coherence * n) AS s FROM c JOIN h ON c.cluster_id = h.cluster_id GROUP BY ALL), f AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS y FROM j)
SELECT g AS cluster_id, n::BIGINT AS n, round(s / n, 6) AS coherence, round(y, 6) AS first FROM f WHERE pos = 0"""
D2I = """WITH h AS (SELECT doc_id, text, sha256(text) AS content_hash FROM documents), known AS (SELECT content_hash FROM h WHERE octet_length(encode(text)) % 7 = 0), m AS (SELECT content_hash, min(doc_id) AS doc_id FROM h GROUP BY content_hash)
SELECT doc_id, content_hash, octet_length(encode(text)) AS byte_size FROM h JOIN m USING (doc_id, content_hash) WHERE content_hash NOT IN (SELECT content_hash FROM known)"""
D5I = f"""WITH {CHUNKS} SELECT 3::BIGINT AS doc_id, 'chat 3' AS source, (SELECT coalesce(string_agg(substr(text, 1, 200), chr(10) ORDER BY chunk_index), '') FROM chunks WHERE doc_id = 3) AS previews, (SELECT CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END FROM labels WHERE doc_id = 3) AS extraction_status,
 (SELECT CASE WHEN quality <> 1 THEN 'no text' END FROM labels WHERE doc_id = 3) AS extraction_error, (SELECT string_agg(page_id * 2, ',') FROM pages WHERE page_id = 3) AS asset_ids WHERE EXISTS (SELECT 1 FROM conversations WHERE conv_id = 3)"""
S6 = "SELECT 'r' || n_regionkey || '.csv' AS path, string_agg('row ' || (2 * place - 1) || ': ' || n_nationkey || ' | ' || trim(n_name), chr(10) ORDER BY place) AS text, NULL::VARCHAR AS error FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) GROUP BY n_regionkey"
S13 = "SELECT conv_id::VARCHAR AS conv_id, 'A chat' AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE role WHEN 'human' THEN 'user' ELSE coalesce(role, 'unknown') END AS role, text FROM conversations WHERE trim(text) <> ''"
S22 = "SELECT doc_id, text FROM documents WHERE text <> ''"
D2 = "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"


def redactions() -> str:
    """Counts of each pattern on what the ones before have left; card numbers need a Luhn test by digits."""
    steps, before = [], "documents"
    for i, (name, pattern) in enumerate(documents.REDACTIONS.items()):
        found = f"regexp_extract_all(text, '{pattern}')"
        if name == "credit_card":
            digits = "string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), '')"
            luhn = f"list_sum(list_transform({digits}, lambda d, j: CASE WHEN j % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"
            found = f"list_filter({found}, lambda m: {luhn})"
        keep = ", ".join(f"n_{k}" for k in list(documents.REDACTIONS)[:i])
        left = f"list_reduce(list_prepend(text, {found}), lambda t, m: replace(t, m, '[REDACTED:{name}]'))" if name == "credit_card" else f"regexp_replace(text, '{pattern}', '[REDACTED:{name}]', 'g')"
        steps.append(f"r{i} AS (SELECT doc_id, {keep + ', ' if keep else ''}len({found})::BIGINT AS n_{name}, {left} AS text FROM {before})")
        before = f"r{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(f'n_{k}' for k in documents.REDACTIONS)}, sha256(text) AS left_sha256 FROM {before}"


D3 = redactions()
_LISTED = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN 'Document ' || doc_id END AS title, source, CASE WHEN doc_id % 3 = 0 THEN 'text/html' ELSE 'text/plain' END AS mime_type, {NOW} - (doc_id - doc_id % 5) % 1000 * 1000 AS ingested_at_ms,
    ceil(n_chars::DOUBLE / 2000)::BIGINT AS chunk_count, CASE WHEN doc_id % 9 = 8 THEN 'forgotten' ELSE 'active' END AS status FROM documents),
  e AS (SELECT doc_id, k, CASE WHEN k = 1 AND quality = 1 THEN 'done' ELSE 'failed' END AS status, CASE WHEN k <> 1 OR quality <> 1 THEN 'no text in try ' || k END AS error FROM labels, (VALUES (0), (1)) v(k))
SELECT d.doc_id, title, source, mime_type, ingested_at_ms, chunk_count, d.status, (SELECT e.status FROM e WHERE e.doc_id = d.doc_id AND e.k = 1) AS extraction_status, (SELECT e.error FROM e WHERE e.doc_id = d.doc_id AND e.k = 1) AS extraction_error FROM d"""
D5 = f"{_LISTED} WHERE status = 'active' ORDER BY ingested_at_ms DESC, doc_id ASC LIMIT 100 OFFSET 10"
D5A = f"{_LISTED} ORDER BY ingested_at_ms DESC, doc_id ASC LIMIT 100"


def _unescape(e: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


_BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
S7 = f"SELECT page_id, trim(regexp_replace({_unescape(_BARE)}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM pages"
S14 = """SELECT conv_id, count(*) AS n_messages, '# Conversation ' || conv_id || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10)
  || string_agg('### ' || role || chr(10) || chr(10) || trim(text) || chr(10) || chr(10), '' ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"""
S15 = f"""WITH a AS (SELECT page_id, unnest(range(len(l))) AS place, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s+[^>]*>.*?</a>') AS l FROM pages)),
  h AS (SELECT page_id, place, regexp_extract(a, '(?is)href\\s*=\\s*"([^"]*)"', 1) AS href, {_unescape("trim(regexp_replace(regexp_replace(a, '(?is)^<a" + chr(92) + "s+[^>]*>|</a>$', '', 'g'), '(?is)<[^>]+>', '', 'g'))")} AS title FROM a)
SELECT page_id, place, {_unescape('href')} AS url, CASE WHEN title = '' THEN href ELSE title END AS title FROM h WHERE trim(href) <> ''"""

_ASSETS = f"assets AS (SELECT page_id AS asset_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS byte_size, CASE WHEN page_id % 7 = 3 THEN 'deleted' ELSE 'active' END AS status, {NOW} - (page_id - page_id % 4) % 500 AS created_at_ms FROM pages)"
D6L = f"WITH {_ASSETS} SELECT * FROM assets WHERE status = 'active' ORDER BY created_at_ms DESC, asset_id ASC LIMIT 100 OFFSET 5"
D6I = f"""WITH {_ASSETS} SELECT asset_id, sha256, status, 'text 1 9' || chr(10) || 'html 1 5' || chr(10) || 'html 2 5' AS extractions, 'l:7 7 3' AS document_links,
  (SELECT string_agg(event_id || ' ' || event_id % 3, chr(10) ORDER BY event_id % 3 DESC, event_id) FROM events WHERE event_id // 10 = 7) AS memory_attachments FROM assets WHERE asset_id = 7"""
D6 = "SELECT doc_id, source, a.page_id AS asset_id, sha256(a.html) AS sha256, octet_length(encode(a.html))::BIGINT AS byte_size FROM pages p JOIN documents ON doc_id = p.page_id JOIN pages a ON a.page_id = p.page_id * 2"
J15 = """SELECT 'at:' || event_id AS attachment_id, 'ev:' || event_id AS memory_id, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 20 = 0 THEN event_id END AS doc_id, source, CASE WHEN event_id % 20 <> 0 THEN event_id END AS asset_id, sha256(html) AS sha256
FROM events LEFT JOIN documents ON event_id % 20 = 0 AND doc_id = event_id LEFT JOIN pages ON event_id % 20 <> 0 AND page_id = event_id"""
J12 = "SELECT page_id AS asset_id FROM pages WHERE page_id IN (SELECT page_id * 2 FROM pages)"
G22 = f"""WITH {EPISODES} SELECT * FROM (SELECT 'episode' AS kind, memory_id AS id FROM episodes WHERE status = 'active' ORDER BY ts_ms DESC, rowid_ DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'document', doc_id::VARCHAR FROM documents ORDER BY doc_id DESC LIMIT 100) UNION ALL SELECT * FROM (SELECT 'asset', page_id::VARCHAR FROM pages ORDER BY page_id DESC LIMIT 100)"""
C22 = "SELECT event_id, 'WARN token=[redacted] ' || props || ' Bearer [redacted] --password [redacted]' AS line, 'warn' AS level FROM events"
Q13 = f"WITH {CLUSTERS}, {ABSTRACTIONS} SELECT cluster_id FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM abstractions WHERE NOT {_LOW}) ORDER BY cluster_id LIMIT 1000"
G10 = f"""WITH {TRIPLES}, {EDGES}, {REFS}, {FACT_REVIEWS}, live AS (SELECT * FROM triples WHERE status = 'active'),
  ents AS (SELECT entity_id FROM (SELECT entity_id, min(CASE WHEN lower(entity_id) = 'customer-7' THEN 0 WHEN lower(entity_id) LIKE 'customer-7%' THEN 1 ELSE 2 END) AS l, count(*) AS n FROM refs WHERE lower(entity_id) LIKE '%customer-7%' GROUP BY entity_id) ORDER BY l, n DESC, entity_id LIMIT 20),
  seeds AS (SELECT entity_id AS id FROM (SELECT entity_id, min(CASE WHEN lower(entity_id) = 'customer-7' THEN 0 WHEN lower(entity_id) LIKE 'customer-7%' THEN 1 ELSE 2 END) AS l, count(*) AS n FROM refs WHERE lower(entity_id) LIKE '%customer-7%' GROUP BY entity_id) ORDER BY l, n DESC, entity_id LIMIT 8),
  themes AS (SELECT count(*) AS n FROM ({G1})), recalled AS (SELECT memory_id FROM ({F3})),
  facts AS (SELECT least(20, count(*)) AS n FROM (SELECT DISTINCT * FROM live WHERE subject_id = 'customer-7' OR object_id = 'customer-7')), disputes AS (SELECT least(20, count(*)) AS n FROM orders),
  graph AS (SELECT triple_id FROM live WHERE subject_id IN (FROM seeds) OR (object_kind = 'entity' AND object_id IN (FROM seeds)) ORDER BY object_kind = 'entity' DESC, confidence DESC, triple_id LIMIT 20),
  e AS (SELECT *, confidence * strength * (1 + 0.05 * ln(1 + least(evidence_count, 10))) AS s FROM edges),
  paths AS (SELECT * FROM (SELECT 1 AS hops, edge_id AS edge_ids, subject_id || '>' || object_id AS nodes, round(s, 6) AS score FROM e WHERE subject_id IN (FROM seeds) AND object_id NOT IN (FROM seeds)
    UNION ALL SELECT 2, a.edge_id || ' ' || b.edge_id, a.subject_id || '>' || a.object_id || '>' || b.object_id, round(sqrt(a.s * b.s), 6) FROM e a JOIN e b ON b.subject_id = a.object_id WHERE a.subject_id IN (FROM seeds) AND a.object_id NOT IN (FROM seeds) AND b.object_id NOT IN (FROM seeds))
    ORDER BY score DESC, hops, edge_ids, nodes LIMIT 20),
  warns AS (SELECT least(20, count(*)) AS n FROM fact_reviews WHERE status = 'needs_review' AND (subject_id IN (FROM seeds) OR object_id IN (FROM seeds))),
  ids AS (SELECT memory_id AS id FROM recalled UNION SELECT triple_id FROM graph UNION SELECT unnest(string_split(edge_ids, ' ')) FROM paths),
  t AS (SELECT 'recall' AS section, (SELECT count(*) FROM recalled) AS n UNION ALL SELECT 'themes', (SELECT n FROM themes) UNION ALL SELECT 'entities', (SELECT count(*) FROM ents) UNION ALL SELECT 'facts', (SELECT n FROM facts) UNION ALL SELECT 'contradictions', (SELECT n FROM disputes)
    UNION ALL SELECT 'graph', (SELECT count(*) FROM graph) + (SELECT count(*) FROM paths) + (SELECT n FROM warns))
SELECT section, CASE WHEN n > 0 THEN 'ready' ELSE 'empty' END AS state, n FROM t UNION ALL SELECT 'log', 'memory_context,semantic_match,lexical_match,graph_neighbor,subject_fact,recent_theme,contradiction_warning', count(*) FROM ids"""
