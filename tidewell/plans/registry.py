"""Every query of the core library with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.hashing import fnv1a64, hash_embedder
from tidewell.operators import assets, audit, cluster, context, day_counts, documents, evaluate, extraction, facts, graph, knn, lexical, quality_gate, replies, retrieval, trigrams, vector_index, work_queue
from tidewell.plans import sql
from tidewell.sources import model, segments, storage
from tidewell.sources.tables import table
from tidewell.streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = model.DAY_MS
NOW = model.NOW_MS
WORDS = "the licensed apache version"


def query(name: str, twin: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if twin is not None:
            SQL[name] = twin
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Vectors and retrieval


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("v2_knn_exact", sql.V2)
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return knn_exact(spark, d)


@query("v5_knn_per_row", sql.V5)
def knn_per_row(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return knn.nearest_each(rows, rows, 3)


@query("l3_bm25", sql.L3)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best(table(spark, d, "documents"), WORDS, "doc_id", "text", 50)


@query("l2_bm25_stemmed")
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best(table(spark, d, "documents"), "licenses licensing versions", "doc_id", "text", 50, stemmed=True)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth vector is a chunk's, the others are episodes'."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 5 == 4, "chunk").otherwise("episode").alias("kind"), "embedding")


@query("f1_rrf_fuse", sql.F1)
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    vector = retrieval.vector_candidates(_vectors(spark, d), _query_vector(spark, d), 40)
    words = retrieval.lexical_candidates(table(spark, d, "documents"), WORDS, "doc_id", "text", 40)
    return retrieval.fuse(vector, words).select("id", "vector_rank", "lexical_rank", F.round("rrf_score", 6).alias("rrf_score"))


@query("f3_recall", sql.F3)
def recall(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recall(model.episodes(spark, d), _vectors(spark, d), "error k 69", _query_vector(spark, d), 20, NOW)


@query("f4_doc_search", sql.F4)
def doc_search(spark: SparkSession, d: str) -> DataFrame:
    """Over a stored chunk table, of active documents; the vectors' ids stand for chunks in order of their ids."""
    return retrieval.search_chunks(_live_chunks(spark, d), _chunk_vectors(spark, d), "report on market history", _query_vector(spark, d), 20)


def _live_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of active documents."""
    live = model.turn_documents(spark, d).where("status = 'active'").select("doc_id")
    return model.turns_as_chunks(spark, d).join(live, "doc_id").select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", "text")


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each first turn whose conversation's number is a vector's."""
    return table(spark, d, "embeddings").select((F.col("vec_id").cast("long") * 1000).alias("id"), F.when(F.col("vec_id") % 5 == 4, "episode").otherwise("chunk").alias("kind"), "embedding")


@query("f4_chunk_search")
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """Over the chunks that chunking makes of whole documents, without stored vectors."""
    cut = documents.chunks(table(spark, d, "documents")).select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("id"), "doc_id", "chunk_index", F.col("content").alias("text"))
    return retrieval.search_chunks(cut, _vectors(spark, d).limit(0), WORDS, _query_vector(spark, d), 20)


@query("j1_chunk_documents", sql.J1)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    live = model.turn_documents(spark, d).where("status = 'active'")
    return model.turns_as_chunks(spark, d).join(live, "doc_id").select("chunk_id", "doc_id", "chunk_index", "source")


@query("s20_saved_index", sql.L3)
def saved_index(spark: SparkSession, d: str) -> DataFrame:
    """The same answer as l3_bm25, from postings on disk."""
    return lexical.search_index(spark, _index(spark, d), WORDS, 50)


def _index(spark: SparkSession, d: str) -> str:
    path = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lexical.save_index(table(spark, d, "documents"), path, "doc_id", "text")
    return path


def _changed_index(spark: SparkSession, d: str) -> str:
    """An index of all documents, then deltas from an outbox: a third gets another text, one in ten goes, some come back; and a part is new."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lexical.save_index(docs.where("doc_id % 8 <> 1"), path, "doc_id", "text", buckets=16)
    n = F.col("doc_id")
    first = docs.select((n * 2).alias("entry_id"), F.when(n % 10 == 3, "delete").otherwise("upsert").alias("op"), n.alias("id")).where("id % 10 = 3 or id % 8 = 1 or id % 3 = 0")
    then = docs.where(n % 20 == 3).select((n * 2 + 1_000_000_001).alias("entry_id"), F.lit("upsert").alias("op"), n.alias("id"))
    now = _changed_documents(spark, d)
    for outbox in (first, first.unionByName(then), then):  # what was applied is sent again
        lexical.replay_outbox(spark, path, outbox, now, "doc_id", "text")
    return path


def _changed_documents(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, F.concat(F.lit("The licensed Apache version. "), "text")).otherwise(F.col("text")).alias("text"))


@query("s20_index_deltas", sql.S20D)
def index_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Search over a base and its deltas, as of an index built anew from what the outbox left."""
    return lexical.search_index(spark, _changed_index(spark, d), WORDS, 100)


@query("s20_index_compacted", sql.S20D)
def index_compacted(spark: SparkSession, d: str) -> DataFrame:
    path = _changed_index(spark, d)
    lexical.compact_index(spark, path)
    return lexical.search_index(spark, path, WORDS, 100)


@query("w7_index_sync", sql.W7S)
def index_sync(spark: SparkSession, d: str) -> DataFrame:
    """The ids that a synchronised index holds."""
    return lexical.indexed_ids(spark, _changed_index(spark, d)).select(F.col("id").alias("doc_id"))


@query("v4_index_drift", sql.V4)
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """By kind, what one index of episodes and chunks holds against what it should: hot active episodes and chunks of active documents; some rows changed since it was built."""
    episodes = model.episodes(spark, d).where("tier = 'hot'")
    chunks = model.turns_as_chunks(spark, d).join(model.turn_documents(spark, d).select("doc_id", "status"), "doc_id")
    built = episodes.where("rowid % 7 <> 0").select(F.lit("episode").alias("kind"), F.col("rowid").alias("id")).unionByName(chunks.where("doc_id % 5 <> 0").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))
    expected = episodes.where("status = 'active'").select(F.lit("episode").alias("kind"), F.col("rowid").alias("id")).unionByName(chunks.where("status = 'active'").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))
    return segments.drift(expected, built)


@query("v4_document_drift", sql.V4D)
def document_drift(spark: SparkSession, d: str) -> DataFrame:
    """An index with deltas against a table in which some ids have changed."""
    n = F.col("doc_id")
    now = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.when(n % 10 == 4, -n).otherwise(n).alias("id"))
    return lexical.drift(now, _changed_index(spark, d))


def _vector_index(spark: SparkSession, d: str) -> str:
    path = f"{storage.shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(table(spark, d, "embeddings"), path)
    return path


@query("v3_approximate_knn")
def approximate_knn(spark: SparkSession, d: str) -> DataFrame:
    """A saved index of all vectors, searched for every row whose id is divisible by 50."""
    return vector_index.search(_vector_index(spark, d), table(spark, d, "embeddings").where("vec_id % 50 = 0"), 10)


@query("v3_search_cost")
def approximate_cost(spark: SparkSession, d: str) -> DataFrame:
    """What such a search compares and reads."""
    return vector_index.cost(_vector_index(spark, d), table(spark, d, "embeddings").where("vec_id % 50 = 0"), 10)


@query("v2_index_tombstones", sql.V2T)
def index_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a vector index after deletions, replacements and compaction."""
    path, rows = _vector_index(spark, d), table(spark, d, "embeddings")
    n = F.col("vec_id")
    vector_index.update(spark, path, rows.where(n % 10 == 1), rows.where(n % 5 == 0).select("vec_id"))
    vector_index.update(spark, path, rows.where(n % 20 == 0), rows.where(n % 10 == 1).select("vec_id"))
    vector_index.compact(spark, path)
    return vector_index.indexed_ids(spark, path)


@query("f5_hash_embed")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", hash_embedder(16)("text").alias("embedding"))


@query("f6_project_scope", sql.F6)
def project_scope(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    source = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("project:p"), (F.col("event_id") % 3).cast("string"), F.lit(":decision:1")))
    context = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"project_id": "p'), (F.col("event_id") % 2).cast("string"), F.lit('"}'))).otherwise("{}")
    content = F.concat(F.lit("Project decision for x (id: p"), (F.col("event_id") % 3).cast("string"), F.lit("): y"))
    return e.select("event_id", retrieval.project_scope(source, context, content, "p0").alias("inside"))


@query("f7_lexical_eval", sql.F7)
def lexical_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.lexical_ranks(*_eval_tables(spark, d))


@query("f6_project_search", sql.F6S)
def project_search(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("rowid")
    decided = F.when(i % 2 == 0, F.concat(F.lit("project:p"), (i % 3).cast("string"), F.lit(":decision:1")))
    return retrieval.project_search(model.episodes(spark, d).withColumn("source_id", decided), _vectors(spark, d), "error k 69", _query_vector(spark, d), "p0", 10, NOW)


def _eval_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    cases = c.where("turn = 0").select(F.col("conv_id").alias("case_id"), F.col("text").alias("query"))
    memories = c.select(F.col("conv_id").alias("case_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("memory_id"), "text", F.when(F.col("role") == "assistant", "decision").otherwise("semantic").alias("tier"), (F.col("turn") / 10).alias("importance"), F.when(F.col("turn") % 5 == 4, "forgotten").otherwise("active").alias("status"))
    return cases, memories


@query("a14_recall_mrr", sql.A14)
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    cases, memories = _eval_tables(spark, d)
    expected = memories.where("status = 'active' and memory_id like '%:1'").select("case_id", "memory_id")
    return evaluate.metrics(evaluate.lexical_ranks(cases, memories), expected, 2)


@query("a14_support", sql.A14S)
def recall_support(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' lists of a case fused: the lexical one's first three, and memories of every second turn as the vector side's."""
    cases, memories = _eval_tables(spark, d)
    turn = F.substring_index("memory_id", ":", -1).cast("int")
    both = evaluate.lexical_ranks(cases, memories).select("case_id", "memory_id", F.when(F.col("rank") <= 3, F.col("rank")).alias("lexical_rank"), F.when(turn % 2 == 1, turn + 1).alias("vector_rank")).where("lexical_rank is not null or vector_rank is not null")
    fused = F.round(retrieval.reciprocal(F.col("vector_rank")) + retrieval.reciprocal(F.col("lexical_rank")), 9)
    hits = both.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(fused), "memory_id")))
    named = lambda t: memories.where(F.col("memory_id").endswith(f":{t}")).select("case_id", "memory_id")
    return evaluate.support(hits, cases, named(1), named(2), 2)


# Facts and the graph


@query("g1_themes", sql.G1)
def themes(spark: SparkSession, d: str) -> DataFrame:
    return facts.themes(model.clusters(spark, d), model.abstractions(spark, d), model.members(spark, d), model.episodes(spark, d), NOW, 8, 20)


@query("g2_facts_about", sql.G2)
def facts_about(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts_about(model.triples(spark, d), "customer-7", since=800_000_000_000, until=1_000_000_000_000)


@query("g2_facts_both_sides", sql.G2B)
def facts_both_sides(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts_about(model.triples(spark, d), "user", ("nation-nation_3", "nation-france", "order-3"), as_object=True, limit=50)


@query("g3_entities", sql.G3)
def entities(spark: SparkSession, d: str) -> DataFrame:
    return facts.entities(model.triples(spark, d), "customer-1", 50)


def _entity_index(spark: SparkSession, d: str) -> str:
    path = f"{storage.shared_dir(spark)}/entities-{uuid.uuid4().hex}"
    trigrams.build(trigrams.summaries(model.triples(spark, d)), path, buckets=16)
    return path


@query("g3_entities_indexed", sql.G3)
def entities_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same answer as g3_entities, from trigrams."""
    return trigrams.search(spark, _entity_index(spark, d), "customer-1", 50)


@query("p4_wildcards", sql.P4)
def entity_wildcards(spark: SparkSession, d: str) -> DataFrame:
    return trigrams.search(spark, _entity_index(spark, d), " ER-_2%5", 100)


@query("s23_prefix", sql.S23)
def entity_prefix(spark: SparkSession, d: str) -> DataFrame:
    """All ids of a prefix; an id that is meant by its beginning is the only one of these."""
    return trigrams.with_prefix(spark, _entity_index(spark, d), "part-1").select("entity_id")


def _day_counters(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Sketches of all clicks by day and kind, from those that arrived on their day, then the late ones, twice; and the rows."""
    clicks = table(spark, d, "clicks")
    late = F.coalesce(F.col("arrived_at").cast("date") > F.col("ts").cast("date"), F.lit(False))
    rows = clicks.select(day_counts.day_of(F.col("ts")).alias("day"), F.col("kind").alias("group"), F.col("client_id").alias("value"), late.alias("late"))
    path = f"{storage.shared_dir(spark)}/day-counters-{uuid.uuid4().hex}"
    day_counts.add(spark, path, "on time", rows.where(~F.col("late")))
    for _ in range(2):
        day_counts.add(spark, path, "late", rows.where("late"))
    return path, rows


@query("a2_distinct_by_kind", sql.A2K)
def distinct_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Clients by kind over all days from united sketches, beside exact counts."""
    path, rows = _day_counters(spark, d)
    exact = rows.groupBy("group").agg(F.countDistinct("value").alias("exact"))
    return day_counts.held_to(day_counts.counted(day_counts.kept(spark, path), "group"), exact, "group")


@query("q17_day_counters", sql.Q17D)
def day_counters(spark: SparkSession, d: str) -> DataFrame:
    """Clients by day and kind of two months; other days' sketches aren't read."""
    path, rows = _day_counters(spark, d)
    exact = rows.where("day between '2024-02-01' and '2024-03-31'").groupBy("day", "group").agg(F.countDistinct("value").alias("exact"))
    return day_counts.held_to(day_counts.counted(day_counts.kept(spark, path, "2024-02-01", "2024-03-31"), "day", "group"), exact, "day", "group")


@query("o5_entity_refs", sql.O5)
def entity_refs(spark: SparkSession, d: str) -> DataFrame:
    return facts.entity_refs(model.triples(spark, d)).groupBy("entity_id").agg(F.sum("as_subject").alias("subjects"), F.sum("as_object").alias("objects"))


@query("q11_contradiction_candidates", sql.Q11)
def contradiction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return facts.contradiction_candidates(model.triples(spark, d))


def _contradictions(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda c: F.concat(F.lit("p:"), c.cast("string"))
    return o.select(
        text(k).alias("a_triple_id"), text(k * 7 + 1).alias("b_triple_id"), F.lit("temporal").alias("kind"), model.millis(F.col("o_orderdate")).alias("detected_at_ms"),
        F.when(k % 3 == 0, "resolved").otherwise("unresolved").alias("status"), F.when(k % 3 == 0, k + 777).alias("resolved_at_ms"),
    )


@query("g4_contradictions_list", sql.G4)
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return facts.contradictions(_contradictions(spark, d), model.triples(spark, d), 30)


@query("q15_contradiction_settle", sql.Q15)
def contradiction_settle(spark: SparkSession, d: str) -> DataFrame:
    found = _contradictions(spark, d)
    key = F.substring("a_triple_id", 3, 20).cast("long")
    decisions = found.where(key % 200 == 0).select("a_triple_id", "b_triple_id", F.when(key % 400 == 0, "resolved").otherwise("reopened").alias("status"))
    return facts.settle(found, decisions, NOW).select("a_triple_id", "b_triple_id", "status", "resolved_at_ms")


@query("g5_inspect_cluster", sql.G5)
def inspect_cluster(spark: SparkSession, d: str) -> DataFrame:
    return facts.inspect_cluster("cl:2", model.clusters(spark, d), model.abstractions(spark, d), model.members(spark, d), model.episodes(spark, d))


@query("g6_paths_direct", sql.paths("customer-1", None, 1, None))
def paths_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(model.edges(model.triples(spark, d)), "customer-1", _nation_of_one(spark, d), hops=1)


def _nation_of_one(spark: SparkSession, d: str) -> str:
    c = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return "nation-" + (c.select(F.lower("n_name")).first() or [""])[0]


@query("g6_paths_two_hop", sql.paths("customer-1", "region", 2, None))
def paths_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(model.edges(model.triples(spark, d)), "customer-1", _region_of_one(spark, d), hops=2)


def _region_of_one(spark: SparkSession, d: str) -> str:
    c = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return "region-" + (r.select(F.lower("r_name")).first() or [""])[0]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Edges from nations to customers, from customers to market segments, and from some nations straight to a segment."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    begin, end = k * DAY, F.when(k % 3 == 0, (k + 400) * DAY)
    one = c.select(text("h:", k).alias("edge_id"), text("nation-", F.col("c_nationkey")).alias("subject_id"), text("customer-", k).alias("object_id"), begin.alias("valid_from_ms"), end.alias("valid_to_ms"), (F.lit(0.5) + k % 50 / 100).alias("confidence"), (F.lit(0.3) + k % 7 / 10).alias("strength"))
    two = c.select(text("s:", k), text("customer-", k), text("segment-", F.lower("c_mktsegment")), begin, end, (F.lit(0.6) + k % 40 / 100), (F.lit(0.2) + k % 8 / 10))
    three = c.select(text("d:", k), text("nation-", F.col("c_nationkey")), text("segment-", F.lower("c_mktsegment")), begin, end, k % 10 / 10, F.lit(0.4))
    return one.unionByName(two.toDF(*one.columns)).unionByName(three.toDF(*one.columns))


@query("g6_paths_many", sql.many_paths(None))
def paths_many(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(_segments(spark, d), "nation-7", "segment-building", hops=2)


@query("g6_paths_as_of", sql.many_paths(100 * DAY))
def paths_as_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(_segments(spark, d), "nation-7", "segment-building", hops=2, t=100 * DAY)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    order = F.col("l_orderkey").cast("string")
    return line.select(
        F.concat_ws(":", F.lit("v"), order, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("evidence_id"), F.concat(F.lit("b:"), order).alias("edge_id"), F.concat(F.lit("ev:"), F.col("l_partkey").cast("string")).alias("memory_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") % 500).alias("source_episode_id"), F.col("l_discount").alias("extraction_confidence"), model.millis(F.col("l_shipdate")).alias("created_at_ms"),
    )


@query("g7_best_evidence", sql.G7)
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.best_evidence(model.edges(model.triples(spark, d)).select("edge_id", "subject_id"), _evidence(spark, d))


@query("g7_provenance", sql.G7P)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return graph.provenance("b:3", _evidence(spark, d), model.episodes(spark, d))


@query("g8_graph_context", sql.G8)
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.context_paths(model.edges(model.triples(spark, d)), ["customer-1", "customer-2", "order-3"], 50)


@query("g9_edge_score", sql.G9)
def edge_score(spark: SparkSession, d: str) -> DataFrame:
    e = model.edges(model.triples(spark, d)).withColumn("evidence_count", F.length("edge_id"))
    return e.select("edge_id", F.round(graph.edge_score(), 6).alias("score"))


@query("g14_graph_catalog", sql.G14)
def graph_catalog(spark: SparkSession, d: str) -> DataFrame:
    nodes = {"cluster": model.clusters(spark, d).select("cluster_id"), "document": table(spark, d, "documents").select("doc_id"), "episode": model.episodes(spark, d).select("memory_id")}
    return graph.catalogue(nodes, ("document", "5"), 200)


def _graph_facts(spark: SparkSession, d: str) -> DataFrame:
    live = model.triples(spark, d).where("status = 'active'")
    return live.select(F.col("triple_id").alias("edge_id"), "subject_id", "predicate", "object_id", "object_kind", "confidence", F.col("confidence").alias("strength"), F.lit(1).alias("evidence_count"))


@query("g8_graph_facts", sql.G8F)
def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    return graph.context_facts(_graph_facts(spark, d), ["customer-1", "order-3", "nation-france"], 50).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("g8_aliases", sql.G8A)
def graph_aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.context_aliases(model.aliases(spark, d), [f"customer-{i}" for i in range(1, 9)], 50)


@query("g8_review_warnings", sql.G8W)
def graph_warnings(spark: SparkSession, d: str) -> DataFrame:
    return graph.review_warnings(model.fact_reviews(spark, d), [f"customer-{i}" for i in range(1, 9)], 50)


def _graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_edges(model.triples(spark, d), model.members(spark, d), model.turns_as_chunks(spark, d))


@query("g14_graph_edges", sql.G14E)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_page(_graph_edges(spark, d), ("document_chunk", "5"), 300)


@query("g14_neighbours", sql.G14N)
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_graph_edges(spark, d), "customer-2", 100)


@query("g14_inspect", sql.G14I)
def graph_inspect(spark: SparkSession, d: str) -> DataFrame:
    return graph.inspect_node(_graph_edges(spark, d), "order-3")


@query("g15_chunk_fold", None)
def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("end_offset").alias("bytes"))


# Audit, erasure and row changes


def _memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories with texts of several lines, from documents and turns; a tenth comes in groups of the same time."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("m:"), F.col("doc_id").cast("string")).alias("memory_id"), F.col("doc_id").alias("n"), F.col("text").alias("content"), F.col("source").alias("source_type"))
    turns = table(spark, d, "conversations").select(F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("memory_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"), F.col("text").alias("content"), F.col("role").alias("source_type"))
    n = F.col("n")
    ts = F.lit(NOW) - F.when(n % 10 == 0, n - n % 100).otherwise(n) * 1000
    status = F.when(n % 17 == 0, "forgotten").otherwise("active")
    return rows.unionByName(turns).select("memory_id", "n", "content", "source_type", ts.alias("ts_ms"), (n % 100 / 100).alias("salience"), status.alias("status"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of memories: a row for each label, which names a memory by its number."""
    n = F.col("doc_id")
    state = F.when(F.col("quality") == 1, "approved").otherwise("dismissed")
    return table(spark, d, "labels").select(F.concat(F.lit("m:"), n.cast("string")).alias("memory_id"), state.alias("state"), (F.lit(NOW) + n).alias("reviewed_at_ms"), F.when(n % 2 == 0, F.concat(F.lit("seen "), n.cast("string"))).alias("note"))


@query("g13_inbox", sql.G13)
def inbox(spark: SparkSession, d: str) -> DataFrame:
    return audit.inbox(_memories(spark, d), _reviews(spark, d), 200)


@query("g16_audit_list", sql.G16)
def audit_list(spark: SparkSession, d: str) -> DataFrame:
    return audit.listing(model.episodes(spark, d), operation="error", since=1_704_153_600_000, limit=100)


@query("g17_audit_purge", sql.G17)
def audit_purge(spark: SparkSession, d: str) -> DataFrame:
    return audit.purge(model.episodes(spark, d), 1_705_000_000_000).select("rowid", "ts_ms", "source_type", "principal")


@query("g18_erase", sql.G18)
def erase(spark: SparkSession, d: str) -> DataFrame:
    left = audit.erase("user-8", *_erasable(spark, d))
    keys = {"episodes": F.col("memory_id"), "facts": F.col("triple_id"), "members": F.concat_ws(" ", "cluster_id", "memory_id"), "chunks": F.col("chunk_id").cast("string")}
    out = None
    for name, key in keys.items():
        rows = left[name].select(F.lit(name).alias("what"), key.alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _erasable(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return model.episodes(spark, d), model.triples(spark, d), model.members(spark, d), model.turns_as_chunks(spark, d)


@query("g19_erase_estimate", sql.G19)
def erase_estimate(spark: SparkSession, d: str) -> DataFrame:
    return audit.erasure_estimate("user-8", *_erasable(spark, d))


@query("w4_clear_source", sql.W4C)
def clear_source(spark: SparkSession, d: str) -> DataFrame:
    """Facts that outlive their source episode."""
    gone = model.episodes(spark, d).where(F.col("principal") == "user-8").select(F.col("rowid").alias("source_episode_id"))
    return audit.clear_source(model.triples(spark, d), gone).select("triple_id", "predicate", "source_episode_id")


@query("w5_reset_derived", sql.W5)
def reset_derived(spark: SparkSession, d: str) -> DataFrame:
    tables = audit.reset_derived({"clusters": model.clusters(spark, d), "facts": model.triples(spark, d), "abstractions": model.abstractions(spark, d)}) | {"episodes": model.episodes(spark, d)}
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("w6_outbox_purge", sql.W6)
def outbox_purge(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    outbox = table(spark, d, "events").select(i.alias("entry_id"), F.when(i % 2 == 0, "episode").otherwise("chunk").alias("kind"), F.when(i % 2 == 0, i).otherwise(i * 500).alias("target_id"))
    return audit.purge_outbox(outbox, outbox.where("entry_id % 5 = 0"), model.episodes(spark, d), model.turns_as_chunks(spark, d))


@query("q16_latest_reviews", sql.Q16)
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Every line of an order is a review of it; the newest stands."""
    line = table(spark, d, "lineitem")
    ops = line.select(F.col("l_orderkey").alias("memory_id"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("op_id"), model.millis(F.col("l_shipdate")).alias("created_at_ms"))
    return audit.latest(ops, ["memory_id"]).select("memory_id", "op_id", "created_at_ms")


@query("m7_retention", sql.M7)
def retention(spark: SparkSession, d: str) -> DataFrame:
    return audit.retention(model.episodes(spark, d), NOW, 20).select("rowid", "ts_ms", "source_type")


@query("a4_tier_status", sql.A4)
def tier_status(spark: SparkSession, d: str) -> DataFrame:
    return audit.tiers(model.episodes(spark, d))


@query("s2_inspect", sql.S2)
def inspect(spark: SparkSession, d: str) -> DataFrame:
    return audit.inspect(model.episodes(spark, d), "ev:17").select("memory_id", "ts_ms", "content", "tier", "status")


@query("w1_upsert_entities", sql.W1)
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    seen = F.col("c_custkey") * DAY
    old = c.where("c_custkey % 3 <> 0").select(key.alias("entity_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(key).alias("name"), F.lit(0.5).alias("confidence"), seen.alias("first_seen_ms"), seen.alias("last_seen_ms"))
    new = c.where("c_custkey % 3 <> 1").select(key.alias("entity_id"), F.concat(F.lit("new "), "c_name").alias("name"), (F.col("c_custkey") % 10 / 10).alias("confidence"), (seen - 5).alias("first_seen_ms"), (seen + 5).alias("last_seen_ms"))
    return quality_gate.upsert_entities(old, new)


@query("w1_upsert_aliases", sql.W1A)
def upsert_aliases(spark: SparkSession, d: str) -> DataFrame:
    old = model.aliases(spark, d).where(F.col("created_at_ms") % 3 != 0)
    new = model.aliases(spark, d).where(F.col("created_at_ms") % 3 != 1).select("alias", F.concat(F.lit("new-"), "canonical_id").alias("canonical_id"), "display_label", F.lit("gate").alias("source"), F.lit(0.45).alias("confidence"), F.lit(NOW).alias("created_at_ms"), F.lit(NOW).alias("updated_at_ms"))
    return quality_gate.upsert_aliases(old, new)


def _claims(spark: SparkSession, d: str, new: bool) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.where(k % 3 != 1) if new else o.where(k % 3 != 0)
    tag = "n" if new else "o"
    status = F.when(k % 5 == 0, "active").otherwise("needs_review") if new else F.when(k % 7 == 0, "rejected").otherwise("quarantined")
    return rows.select(
        F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), F.concat(F.lit(tag), k.cast("string")).alias("claim_id"), F.when(k % 2 == 0, F.concat(F.lit(tag + "r"), k.cast("string"))).alias("review_id"), (k % (10 if new else 7) / 10).alias("quality_score"),
        status.alias("status"), (F.lit(1 if new else 2)).cast("long").alias("evidence_count"), (F.lit(False) if new else k % 7 == 0).alias("user_approved"), F.lit(2 if new else 1).cast("long").alias("created_at_ms"), F.when(status == "active", F.lit(2).cast("long")).alias("activated_at_ms"),
    )


@query("w1_upsert_claims", sql.W1C)
def upsert_claims(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.upsert_claims(_claims(spark, d, False), _claims(spark, d, True))


@query("w1_upsert_reviews", sql.W1R)
def upsert_reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = model.fact_reviews(spark, d).select("fingerprint", "review_id", "cluster_id", "confidence", "reason_code", "status", "created_at_ms")
    key = F.substring("fingerprint", 2, 20).cast("long")
    new = rows.where(key % 3 != 1).select("fingerprint", F.concat(F.lit("new-"), "review_id").alias("review_id"), F.lit("cl:new").alias("cluster_id"), (F.col("confidence") / 2).alias("confidence"), F.lit("again").alias("reason_code"), F.lit("needs_review").alias("status"), F.lit(NOW).alias("created_at_ms"))
    return quality_gate.upsert_reviews(rows.where(key % 3 != 0), new)


@query("w1_upsert_edges", sql.W1E)
def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    every = model.edges(model.triples(spark, d)).select("edge_id", "subject_id", "object_id", "confidence", "evidence_count", F.lit("active").alias("status"), "valid_from_ms")
    e = audit.latest(every, ["edge_id"], "valid_from_ms", "object_id")
    old = e.select("edge_id", "subject_id", F.lit("old").alias("object_id"), F.lit(0.1).alias("confidence"), F.lit(9).cast("long").alias("evidence_count"), F.lit("superseded").alias("status"), F.lit(1).cast("long").alias("created_at_ms")).where(F.length("edge_id") % 3 != 0)
    new = e.where(F.length("edge_id") % 3 != 1).select(*e.columns[:6], F.lit(2).cast("long").alias("created_at_ms")).withColumn("confidence", F.round("confidence", 6))
    return quality_gate.upsert_edges(old, new)


@query("w1_upsert_evidence", sql.W1V)
def upsert_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = audit.latest(model.triples(spark, d).where("status = 'active'"), ["triple_id"], "valid_from_ms", "object_id")
    old = t.where("length(triple_id) % 2 = 0 or object_kind <> 'entity'").select("triple_id", F.concat(F.lit("v-"), "triple_id").alias("evidence_id"), F.lit(1).cast("long").alias("source_episode_id"), F.lit(1).cast("long").alias("created_at_ms"))
    new = t.where("object_kind = 'entity'").select("triple_id", F.col("triple_id").alias("evidence_id"), "source_episode_id", F.lit(2).cast("long").alias("created_at_ms"))
    return quality_gate.upsert_evidence(old, new)


@query("w1_entity_status", sql.W1S)
def entity_status(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    key = F.concat(F.lit("customer-"), k.cast("string")).alias("entity_id")
    return quality_gate.entity_states(c.where(k % 3 != 0).select(key, F.when(k % 2 == 0, "candidate").otherwise("merged").alias("status")), c.where(k % 3 != 1).select(key))


@query("w2_insert_absent", sql.W2)
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return audit.insert_absent(n.where("n_nationkey % 2 = 0"), n.withColumn("n_name", F.concat(F.lit("new "), "n_name")), ["n_nationkey"])


@query("w3_source_backfill", sql.W3)
def source_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"derived_from": ["ev:'), F.col("o_orderkey").cast("string"), F.lit('"]}')).alias("provenance_json"))
    return audit.source_backfill(rows, model.episodes(spark, d)).select("o_orderkey", "source_episode_id")


@query("w4_delete_where", sql.W4)
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("quality <> 1").select(F.concat(F.lit("ev:"), F.col("doc_id").cast("string")).alias("memory_id"))
    return audit.delete_where(model.episodes(spark, d), gone, ["memory_id"]).select("memory_id", "tier", "status")


@query("w7_evidence_counts", sql.W7)
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    e = model.edges(model.triples(spark, d)).select("edge_id", "evidence_count")
    return audit.evidence_counts(e, _evidence(spark, d)).select("edge_id", "evidence_count")


@query("w8_forget", sql.W8)
def forget(spark: SparkSession, d: str) -> DataFrame:
    return audit.forget(model.episodes(spark, d), ["ev:1", "ev:2", "ev:17"]).select("memory_id", "status", "tier")


# Quality


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """Raw facts of all shapes, by order key."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v)).cast("int") + 1)
    return o.select(
        F.concat(F.lit("t:"), k.cast("string")).alias("triple_id"),
        F.when(k % 7 == 0, pick(*sql.SUBJECTS)).otherwise(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("subject_id"),
        F.when(k % 5 == 0, pick(*sql.PREDICATES)).otherwise(F.lit("Has Priority")).alias("predicate"),
        F.when(k % 3 == 0, pick(*sql.OBJECTS)).otherwise(F.col("o_orderpriority")).alias("object_id"),
        F.when(k % 2 == 0, "entity").otherwise("literal").alias("object_kind"),
        (F.lit(0.7) + k % 30 / 100).alias("confidence"),
    )


@query("q3_quality_gate", sql.Q3)
def quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.judge(_extracted(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("q2_weak_facts", sql.Q2)
def weak_facts(spark: SparkSession, d: str) -> DataFrame:
    """Extracted facts, some of them about the model itself, with the reason to drop them at once."""
    rows = _extracted(spark, d)
    k = F.substring("triple_id", 3, 20).cast("long")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v)).cast("int") + 1)
    said = rows.select("triple_id", F.when(k % 2 == 0, pick(*sql.ROLES)).otherwise(F.col("subject_id")).alias("s"), F.when(k % 3 == 0, pick(*sql.CLAIMS)).otherwise(F.col("predicate")).alias("p"), F.when(k % 5 == 0, pick(*sql.ANSWERS)).otherwise(F.col("object_id")).alias("o"), "object_kind")
    return said.select("triple_id", X.extraction_reason(F.col("s"), F.col("p"), F.col("o"), F.col("object_kind")).alias("reason"))


@query("c15_times", sql.C15)
def times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = model.millis(F.col("ts"))
    told = X.rfc3339_of_millis(ms)
    shifted = F.concat(F.substring(told, 1, 23), F.lit("+02:30"))
    return e.select("event_id", told.alias("told"), X.millis_of_rfc3339(told).alias("back"), X.millis_of_rfc3339(shifted).alias("shifted"), X.millis_of_rfc3339(F.col("event_type")).alias("none"), X.seconds_of_duration(F.concat((F.col("event_id") % 90).cast("string"), F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("h"), F.lit("d"), F.lit("y")), (F.col("event_id") % 5 + 1).cast("int")))).alias("seconds"))


@query("c20_salience", sql.C20)
def salience(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 0, F.col("value") / 100)
    return table(spark, d, "events").select("event_id", X.valid_salience(value).alias("valid"))


@query("q6_claim_scores", sql.Q6)
def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.claims(quality_gate.judge(_extracted(spark, d))).select("triple_id", "claim_status", "quality_score")


@query("q4_rejudge", sql.Q4)
def rejudge(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.rejudge(_extracted(spark, d).withColumn("status", F.lit("active")))


@query("q8_graph_backfill", sql.Q8)
def graph_backfill(spark: SparkSession, d: str) -> DataFrame:
    return graph.backfill_entities(model.triples(spark, d))


@query("q8_edges_backfill", sql.Q8E)
def edges_backfill(spark: SparkSession, d: str) -> DataFrame:
    return graph.backfill_edges(model.triples(spark, d))


@query("q8_evidence_backfill", sql.Q8V)
def evidence_backfill(spark: SparkSession, d: str) -> DataFrame:
    return graph.backfill_evidence(model.triples(spark, d), model.episodes(spark, d))


@query("q9_claims_backfill", sql.Q9)
def claims_backfill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v)).cast("int") + 1)
    reviews = o.select(F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"), pick(*sql.REASONS).alias("reason_code"), pick("needs_review", "approved", "dismissed", "rewritten", "needs_review").alias("status"), (k % 100 / 100).alias("confidence"))
    return quality_gate.backfill_claims(model.triples(spark, d), reviews)


@query("q14_normalize_subjects", sql.Q14)
def normalize_subjects(spark: SparkSession, d: str) -> DataFrame:
    out = facts.rename_subjects(model.triples(spark, d), {"customer-1": "customer-2", "order-3": "order-4"})
    return out.where("changed").select("triple_id", "new_subject_id", "new_object_id")


@query("q17_coverage", sql.Q17)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.coverage(model.episodes(spark, d), model.clusters(spark, d), model.members(spark, d), model.abstractions(spark, d), model.triples(spark, d))


@query("q18_quality_audit", sql.Q18)
def quality_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.audit(*_audited(spark, d)).withColumn("samples", F.array_join("samples", "\n"))


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return model.episodes(spark, d), model.clusters(spark, d), model.members(spark, d), model.abstractions(spark, d), model.triples(spark, d), _contradictions(spark, d), model.fact_reviews(spark, d)


@query("q18_health", sql.Q18H)
def quality_health(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.health(quality_audit(spark, d))


@query("q18_totals", sql.Q18T)
def quality_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality_gate.totals(*_audited(spark, d))


@query("a13_alias_groups", sql.A13)
def aliases(spark: SparkSession, d: str) -> DataFrame:
    return facts.alias_groups(table(spark, d, "part").select(F.col("p_name").alias("entity_id")).unionByName(table(spark, d, "part").select(F.upper("p_name").alias("entity_id"))))


@query("c2_canonical_ids", sql.C2)
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" [ent:"), F.col("p_name"), F.lit("/"), F.col("p_type"), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", X.canonical_entity_id(raw).alias("entity_id"), X.normalize_predicate(F.col("p_type")).alias("predicate"))


@query("c11_fingerprints", sql.C11)
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fnv1a64("p_name").alias("fingerprint"))


@query("c13_estimates", sql.C13)
def estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.chunk_estimate(F.octet_length("text"), 500).alias("chunks"))


# Clusters


def _days(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as episodes of ten days."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (F.col("vec_id") % 10 * DAY + F.col("vec_id")).cast("long").alias("ts_ms"), "embedding")


@query("k1_pairs", sql.K1)
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return cluster.similar_pairs(_days(spark, d).withColumn("day", X.day_bucket(F.col("ts_ms"))).select("id", "day", "embedding"), 0.3)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("m5_replay_stream", sql.M5)
def replay_stream(spark: SparkSession, d: str) -> DataFrame:
    """Clicks, of which many come twice, as outbox entries: streamed, restarted with all of them sent again, each applied once."""
    folder = _new_folder(spark, "replay")
    rows = table(spark, d, "clicks").select(F.col("click_id").alias("entry_id"), "client_id")
    for part in ("entry_id % 3 <> 0", "true"):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        batches.replay(batches.episodes_stream(spark, f"{folder}/in", rows.schema, 4), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("entry_id")


@query("m6_incremental_clusters", sql.K2)
def incremental_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The same answer as k2_components, from rows that come in three batches."""
    folder = _new_folder(spark, "clusters")
    rows = _days(spark, d).select(F.col("id").cast("long").alias("id"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("embedding").cast("array<float>").alias("embedding"))
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    batches.incremental_clusters(batches.episodes_stream(spark, f"{folder}/in", rows.schema), f"{folder}/state", f"{folder}/checkpoint", 0.3).awaitTermination()
    return batches.current_members(spark, f"{folder}/state").select("cluster_id", "id")


@query("s19_export", sql.S19)
def export(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows written as JSON, newest first, and read back."""
    folder = _new_folder(spark, "export")
    events = model.episodes(spark, d).select("rowid", "ts_ms", "principal", "source_type")
    audit.export(events, folder)
    return spark.read.schema(events.schema).json(folder)


@query("k2_components", sql.K2)
def components(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_days(_days(spark, d), 0.3)


def _label_members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").cast("long").alias("id"))


@query("a10_centroid", sql.A10)
def centroid(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.centroids(_label_members(spark, d), _days(spark, d))
    return c.select("cluster_id", "n", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("a11_coherence", sql.A11)
def coherence(spark: SparkSession, d: str) -> DataFrame:
    return cluster.coherence(_label_members(spark, d), _days(spark, d))


@query("k3_merge_plan", sql.K3)
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    members = components(spark, d)
    return cluster.merge_plan(cluster.centroids(members, _days(spark, d)), 0.3)


@query("k4_absorb")
def absorb(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.centroids(components(spark, d), _days(spark, d))
    return cluster.absorb(spark, c.where("cluster_id % 2 = 1"), c.where("cluster_id % 2 = 0"), 0.3)


@query("k5_merge_candidates", sql.K5)
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return merge_plan(spark, d).agg(F.count("*").alias("losers"), F.countDistinct("survivor").alias("groups"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two embedders."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("rowid"), F.when(F.col("vec_id") % 4 == 0, "old").otherwise("now").alias("embedder"), "embedding")


@query("k6_scope", sql.K6S)
def scope(spark: SparkSession, d: str) -> DataFrame:
    return cluster.in_scope(model.episodes(spark, d), _embedded(spark, d), "now", NOW, 30).select("id", "ts_ms")


@query("k6_consolidate")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """A run over all rows, with the clusters of a run over some of them."""
    rows = _days(spark, d)
    return cluster.consolidate(spark, rows, cluster.cluster_days(rows.where("id % 3 <> 0"), 0.3), 0.3)


@query("k7_stale_vectors", sql.K7)
def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    both = _embedded(spark, d).unionByName(_embedded(spark, d).where("rowid % 8 = 0").withColumn("embedder", F.lit("now")))
    return cluster.stale_vectors(both, model.episodes(spark, d), "now")


@query("k7_re_embed", sql.K7E)
def re_embed(spark: SparkSession, d: str) -> DataFrame:
    return cluster.re_embed(_embedded(spark, d), model.episodes(spark, d), "now", hash_embedder(4)).select("rowid", "embedder")


@query("a10_merged_clusters", sql.A10M)
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every label's cluster merged into that of the next even label."""
    c = cluster.centroids(_label_members(spark, d), _days(spark, d)).join(coherence(spark, d), "cluster_id")
    plan = c.where("cluster_id % 2 = 1").select((F.col("cluster_id") - 1).alias("survivor"), F.col("cluster_id").alias("loser"))
    return cluster.merge_summary(c, plan).select("cluster_id", "n", "coherence", F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query("k6_unclustered", sql.K6)
def unclustered(spark: SparkSession, d: str) -> DataFrame:
    return cluster.unclustered(_days(spark, d), components(spark, d)).select("id")


# Documents


@query("d1_chunks")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunks(table(spark, d, "documents"))


@query("d2_dedup", sql.D2)
def dedup(spark: SparkSession, d: str) -> DataFrame:
    return documents.first_of_each(table(spark, d, "documents"))


@query("d3_redact_counts", sql.D3)
def redact_counts(spark: SparkSession, d: str) -> DataFrame:
    done = documents.redact(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[f"n_{k}" for k in documents.REDACTIONS], F.sha2("text", 256).alias("left_sha256"))


def _stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a listing has them: several a moment of ingest, some forgotten, some without a title."""
    n = F.col("doc_id")
    title = F.when(n % 6 != 0, F.concat(F.lit("Document "), n.cast("string")))
    kind = F.when(n % 3 == 0, "text/html").otherwise("text/plain")
    return table(spark, d, "documents").select(
        "doc_id", title.alias("title"), "source", kind.alias("mime_type"), (F.lit(NOW) - (n - n % 5) % 1000 * 1000).alias("ingested_at_ms"), F.ceil(F.col("n_chars") / 2000).alias("chunk_count"), F.when(n % 9 == 8, "forgotten").otherwise("active").alias("status")
    )


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """Two extractions of each labelled document: a failed one, then the one that counts."""
    rows = table(spark, d, "labels").select("doc_id", "quality", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    good = (F.col("k") == 1) & (F.col("quality") == 1)
    return rows.select("doc_id", (F.col("doc_id") * 2 + F.col("k")).alias("extraction_id"), F.col("k").cast("long").alias("created_at_ms"), F.when(good, "done").otherwise("failed").alias("status"), F.when(~good, F.concat(F.lit("no text in try "), F.col("k").cast("string"))).alias("error"))


@query("d5_list_documents", sql.D5)
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.listing(_stored_documents(spark, d), _extractions(spark, d), 100, 10)


@query("d5_list_forgotten_too", sql.D5A)
def list_all_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.listing(_stored_documents(spark, d), _extractions(spark, d), 100, 0, forgotten=True)


@query("d2_ingest", sql.D2I)
def ingest(spark: SparkSession, d: str) -> DataFrame:
    """All documents, of which those of some sizes are known already."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    known = rows.where(F.octet_length("text") % 7 == 0).select(F.sha2("text", 256).alias("content_hash"))
    return documents.ingest(rows, known)[0].drop("chunk_count")


@query("d5_inspect_document", sql.D5I)
def inspect_document(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("extraction_id"), F.lit(1).alias("created_at_ms"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"), F.when(F.col("quality") != 1, "no text").alias("error"))
    parts = model.turns_as_chunks(spark, d).select("doc_id", "chunk_index", F.col("text").alias("content"))
    found = documents.inspect_document(3, model.turn_documents(spark, d), parts, runs, _assets(spark, d)[1])
    return found.withColumn("previews", F.array_join("previews", "\n")).withColumn("asset_ids", F.array_join(F.transform("asset_ids", lambda x: x.cast("string")), ","))


@query("s6_csv_text", sql.S6)
def csv_text(spark: SparkSession, d: str) -> DataFrame:
    """A file a region: a line a nation, with blank lines between."""
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('" '), "n_name", F.lit('"')))
    files = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("lines"))
    rows = files.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), "utf-8").alias("content"))
    return documents.extract_files(rows)


@query("s7_html_text", sql.S7)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", documents.html_text(F.col("html")).alias("text"))


@query("s13_chat_import", sql.S13)
def chat_import(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    told = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("  A  chat ").alias("title"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages")))
    return documents.chat_exports(turns.select(told.alias("json")))


@query("s14_transcript", sql.S14)
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return documents.transcripts(table(spark, d, "conversations"))


@query("s15_bookmarks_html", sql.S15)
def bookmarks_html(spark: SparkSession, d: str) -> DataFrame:
    return documents.bookmarks(table(spark, d, "pages"))


@query("s22_document_text", sql.S22)
def document_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document, cut into overlapping chunks and put together again."""
    return documents.document_texts(documents.chunks(table(spark, d, "documents")))


# Assets, resources, logs, external models


def _assets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An asset for each page; every page's number is a document that links the asset of twice that number."""
    p = table(spark, d, "pages")
    own = p.select(F.col("page_id").alias("asset_id"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("byte_size"))
    return own, p.select(F.col("page_id").alias("doc_id"), (F.col("page_id") * 2).alias("asset_id"))


@query("d6_linked_assets", sql.D6)
def linked_assets(spark: SparkSession, d: str) -> DataFrame:
    own, links = _assets(spark, d)
    return assets.linked(table(spark, d, "documents"), own, links)


def _stored_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets as a listing has them: several a moment, some deleted."""
    n = F.col("asset_id")
    return _assets(spark, d)[0].withColumn("status", F.when(n % 7 == 3, "deleted").otherwise("active")).withColumn("created_at_ms", F.lit(NOW) - (n - n % 4) % 500)


@query("d6_list_assets", sql.D6L)
def list_assets(spark: SparkSession, d: str) -> DataFrame:
    return assets.listing(_stored_assets(spark, d), 100, 5)


@query("d6_inspect_asset", sql.D6I)
def inspect_asset(spark: SparkSession, d: str) -> DataFrame:
    """Every page has three extractions, is linked by the document of its number, and attached to the events of its number's tens."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("asset_id"))
    made = p.select("asset_id", F.explode(F.array(*[F.struct(F.lit(a).alias("extractor_name"), F.lit(v).alias("extractor_version"), F.lit(t).cast("long").alias("created_at_ms")) for a, v, t in (("html", "1", 5), ("html", "2", 5), ("text", "1", 9))])).alias("x")).select("asset_id", "x.*")
    links = p.select("asset_id", F.concat(F.lit("l:"), F.col("asset_id").cast("string")).alias("link_id"), F.col("asset_id").alias("doc_id"), F.lit(3).cast("long").alias("created_at_ms"))
    attached = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("asset_id"), F.col("event_id").alias("attachment_id"), (F.col("event_id") % 3).alias("created_at_ms"))
    found = assets.inspect(7, _stored_assets(spark, d), made, links, attached)
    line = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in (*names, "created_at_ms")])), "\n").alias(c)
    return found.select("asset_id", "sha256", "status", line("extractions", "extractor_name", "extractor_version"), line("document_links", "link_id", "doc_id"), line("memory_attachments", "attachment_id"))


@query("j15_attachments", sql.J15)
def attachments(spark: SparkSession, d: str) -> DataFrame:
    own, _ = _assets(spark, d)
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("at:"), i.cast("string")).alias("attachment_id"), F.concat(F.lit("ev:"), i.cast("string")).alias("memory_id"), F.when(i % 20 == 0, i).alias("doc_id"), F.when(i % 20 != 0, i).alias("asset_id"))
    return assets.attachments(rows, model.episodes(spark, d), table(spark, d, "documents"), own)


@query("j12_referenced_assets", sql.J12)
def referenced_assets(spark: SparkSession, d: str) -> DataFrame:
    return assets.referenced(*_assets(spark, d)).select("asset_id")


@query("g22_resources", sql.G22)
def resources(spark: SparkSession, d: str) -> DataFrame:
    return assets.newest(model.episodes(spark, d), table(spark, d, "documents"), _assets(spark, d)[0])


@query("c22_log_lines", sql.C22)
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("WARN token=abc"), F.col("event_id").cast("string"), F.lit(" "), "props", F.lit(" Bearer x.y --password pw"))
    return table(spark, d, "events").select("event_id", assets.log_line(line).alias("line"), assets.log_level(line).alias("level"))


@query("q1_abstraction_stub")
def abstraction_stub(spark: SparkSession, d: str) -> DataFrame:
    told = model.members(spark, d).join(model.episodes(spark, d), "memory_id").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "content"))), lambda x: x["content"]).alias("texts"))
    wanted = extraction.pending(model.clusters(spark, d), model.abstractions(spark, d), 1000).select("cluster_id")
    return extraction.abstract(told.join(wanted, "cluster_id"), lambda: extraction.stub_client, NOW)


@query("q13_pending_clusters", sql.Q13)
def pending_clusters(spark: SparkSession, d: str) -> DataFrame:
    return extraction.pending(model.clusters(spark, d), model.abstractions(spark, d), 1000).select("cluster_id")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A reply an order, in the shapes that models reply in, by key."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    shapes = [
        ' {"content": " About order %1$d\\n", "confidence": 0.9, "triples": [{"subject_id": "customer-%2$d", "predicate": "placed", "object_id": "order-%1$d", "object_kind": " Entity "}]} ',
        'Sure:\n```json\n{"summary": "Order %1$d", "triples": [{"subject": "customer-%2$d", "predicate": "has_priority", "object": "%3$s"}, {"subject": 5, "predicate": "p", "object": "o"}, 3]}\n```\nDone.',
        '{"project": "Order %1$d", "tasks": ["Ship it", {"title": "Bill %3$s!"}, {"x": 1}, " "], "confidence": 7}',
        '{"content": "Order %1$d", "triples": []}',
        "I can't say much about order %1$d.",
        '{"content": null, "summary": "Order %1$d", "confidence": "0.3", "triples": [{"subject_id": null, "subject": "a", "predicate": "p", "object": "o"}, {"subject": "b", "predicate": "p", "object": "%3$s"}]}',
        '```\n{"project": "Order %1$d", "triples": [{"subject": "s", "predicate": "p", "object": "o"}, {"subject": "t", "predicate": "p", "object": "o"}]}\n```',
        '{"tasks": ["Ask %2$d"], "content": 4, "confidence": -1, "triples": [{"subject": "s", "predicate": "p", "object": "o", "object_kind": 1}]}',
    ]
    reply = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        reply = F.when(k % len(shapes) == i, F.format_string(shape, k, "o_custkey", "o_orderpriority")).otherwise(reply)
    return o.select("o_orderkey", reply.alias("reply"))


@query("c19_replies", sql.C19)
def replies_read(spark: SparkSession, d: str) -> DataFrame:
    """Content, confidence and facts of all replies; those that can't be read have one row of nulls."""
    read = replies.coerced(_replies(spark, d), "reply", "r")
    return read.select("o_orderkey", "r.content", "r.confidence", F.posexplode_outer("r.triples").alias("place", "t")).select("o_orderkey", "content", "confidence", F.col("place").cast("long").alias("place"), "t.*")


@query("q13_work_queue", sql.Q13W)
def queued_work(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lengths by a client that fails for some: a first driver that is lost after some chunks, a second one, and two more runs; then how each document stands."""
    folder = _new_folder(spark, "queue")
    items = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("payload"))

    def client():
        def ask(payload):
            number, size = payload.split(" ")
            if int(number) % 9 == 4:
                raise ValueError("no")
            return size

        return ask

    n = max(1, items.count() // 3)
    work_queue.work(spark, folder, items, client, "one", chunk=n, most_chunks=1)
    for owner in ("two", "two", "three"):
        work_queue.work(spark, folder, items, client, owner, chunk=n)
    return items.select("item_id").join(work_queue.results(spark, folder), "item_id", "left").join(work_queue.parked(spark, folder), "item_id", "left").select("item_id", "value", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


@query("g10_context_bundle", sql.G10)
def context_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a context bundle with their states and row counts, and why it holds what it holds."""
    t, subject = storage.keep(model.triples(spark, d), "context-facts"), "CUSTOMER-7"
    first = context.bundle({"entities": lambda: facts.entities(t, subject.lower(), 20)})
    known = context.resolved_subject(subject, first["entities"])
    starts = context.seeds(known, first["entities"], 20)
    rows = t.where("status = 'active'").select(F.col("triple_id").alias("edge_id"), "subject_id", "predicate", "object_id", "object_kind", "confidence", F.col("confidence").alias("strength"), F.lit(1).alias("evidence_count"))
    found = context.bundle({
        "recall": lambda: retrieval.recall(model.episodes(spark, d), _vectors(spark, d), "error k 69", _query_vector(spark, d), 20, NOW),
        "themes": lambda: themes(spark, d),
        "facts": lambda: facts.facts_about(t, known, as_object=True, limit=20),
        "contradictions": lambda: facts.contradictions(_contradictions(spark, d), t, 20),
        "graph": lambda: graph.context_facts(rows, starts, 20),
        "paths": lambda: graph.context_paths(model.edges(t), starts, 20),
        "warnings": lambda: graph.review_warnings(model.fact_reviews(spark, d), starts, 20),
    }) | first
    counts = {k: None if v is None else v.count() for k, v in found.items()}
    graph_rows = None if any(counts[k] is None for k in ("graph", "paths", "warnings")) else counts["graph"] + counts["paths"] + counts["warnings"]
    sections = {k: counts[k] for k in ("recall", "themes", "entities", "facts", "contradictions")} | {"graph": graph_rows}
    states = context.section_states(sections, coverage(spark, d).first().asDict(), has_model=False, subject=True)
    log = context.retrieval_log(spark, "error k 69", NOW, context.recalled_ids(found), context.reason_codes(found)).first()
    return spark.createDataFrame([*((k, states[k], n) for k, n in sections.items()), ("log", ",".join(log["reason_codes"]), len(log["memory_ids"]))], "section string, state string, n long")
