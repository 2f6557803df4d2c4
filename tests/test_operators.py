"""Small cases of the core operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from tidewell.functions import text as X
from tidewell.functions.hashing import fnv1a64_hex, hash_embedding
from tidewell.functions.stemmer import stem
from tidewell.functions.vectors import cosine, unit
from tidewell.operators import assets, audit, cluster, context, documents, evaluate, extraction, facts, graph, knn, lexical, quality_gate, retrieval
from tidewell.plans import registry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "made"), [(" [ent:Acme Corp] ", "acme-corp"), ("__a..b//c\\d--", "a-b-c-d"), ("Ünï", "n"), ("!!!", ""), ('"quoted"', "quoted"), ("a!_!b", "a-b")])
def test_canonical_ids(spark, raw, made):
    assert one(spark, X.canonical_entity_id(F.col("v")), v=raw) == made


def test_text_rules(spark):
    is_ = lambda rule, v: one(spark, rule(F.col("v")), v=v)
    assert is_(X.path_or_url, "C:\\x") and is_(X.path_or_url, "../a") and not is_(X.path_or_url, "a/b")
    assert is_(X.audit_path_or_url, "a/b") and is_(X.audit_commit, "abcdef") and not is_(X.commit_hash, "abcdef") and is_(X.commit_hash, "commit_abcdef1")
    assert is_(X.chatter, "The Assistant") and is_(X.chatter, "assistant cannot help") and not is_(X.chatter, "assistant manager")
    assert is_(X.machine_identifier, "a_b-c.d") and not is_(X.machine_identifier, "A_b-c.d") and is_(X.machine_identifier, "id123456")
    assert is_(X.luhn_valid, "4799134681044206") and not is_(X.luhn_valid, "4799134681044207")
    assert is_(lambda c: X.ellipsis(c, 5), "abcdefgh") == "abcd…" and is_(lambda c: X.ellipsis(c, 5, "...", False), "abcdefgh") == "abcde..."
    assert is_(X.slug, "  Hello, World! ") == "hello-world" and is_(X.clean_title, " \n ") == "Untitled" and is_(X.day_bucket, -1) == -1
    assert X.query_terms("The the THE a b c d e f g") == ["the", "the", "the", "a", "b", "c", "d", "e"] and X.query_terms("?!") == []


def test_hashes():
    assert fnv1a64_hex("") == "cbf29ce484222325" and fnv1a64_hex("a") == "af63dc4c8601ec8c"
    v = hash_embedding("x", 8)
    assert abs(sum(a * a for a in v) - 1) < 1e-5 and v == hash_embedding("x", 8) != hash_embedding("y", 8)


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("relational", "relat"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("sky", "sky"), ("öl", "öl")])
def test_stemmer(word, root):
    assert stem(word) == root


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert df.select(unit(F.col("a"))).collect()[1][0] == pytest.approx([0.6, 0.8])


def test_knn_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>").repartition(5)
    whole = sorted(map(tuple, knn.nearest_each(rows, rows.where("vec_id < 9"), 4).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, knn.nearest_each(rows, rows.where("vec_id < 9"), 4).collect())) == whole and len(whole) == 36
    assert knn.nearest_each(rows, rows.limit(0), 4).count() == 0


def test_nearest_rows_take_bounded_memory():
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(5)
    v = knn._unit(np.round(r.normal(size=(20_000, 8)), 1))
    v[10_000:12_000] = v[:2000]  # equal distances, settled by id
    ids = r.permutation(len(v)) * 3
    best = knn.KNearest(ids[:2048], v[:2048], 3)
    tracemalloc.start()
    for a in range(0, len(v), 10_000):
        best.add(ids[a : a + 10_000], v[a : a + 10_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak  # one batch against all queries at once takes 164 MB a matrix
    for q in range(0, 2048, 97):
        far = np.round(1 - np.clip(v[q] @ v.T, -1, 1), 6)
        far[q] = np.inf
        order = np.lexsort((ids, far))[:3]
        assert best.id[best.at == q].tolist() == ids[order].tolist() and best.far[best.at == q].tolist() == far[order].tolist()


def test_every_row_asks_for_its_neighbours(spark, data):
    """v5_knn_per_row answers for each row of the table, not for one in fifty."""
    found = registry.queries()["v5_knn_per_row"](spark, data)
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert found.count() == 3 * n and found.select("query_id").distinct().count() == n


@pytest.mark.parametrize("at_once", [2048, 90])
def test_rows_meet_block_by_block_as_in_sql(spark, tmp_path, monkeypatch, at_once):
    """broadcast or in blocks of queries and rows; copies settled by id, rows without direction or vector last, and asking too."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(6)
    v = np.round(r.normal(size=(700, 3)), 1).tolist()
    v[100:400] = v[:100] * 3
    v[450:520] = [v[450]] * 70
    v[7] = v[600] = [0.0, 0.0, 0.0]
    v[8] = v[350] = v[699] = None
    for name, own in (("many", range(700)), ("few", [7, 8, 350, 600, 20])):
        (tmp_path / name).mkdir()
        ids = [i * 3 for i in own]
        pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([v[i] for i in own], pa.list_(pa.float32()))}), f"{tmp_path}/{name}/embeddings.parquet")
        monkeypatch.setattr(knn, "QUERY_BLOCK", at_once if name == "many" else min(at_once, 2))
        found = registry.queries()["v5_knn_per_row"](spark, str(tmp_path / name))
        same(found.toPandas(), connect(tmp_path / name).sql(registry.oracle_sql()["v5_knn_per_row"]).df())
        kinds = {r["query_id"]: r["distance"] for r in found.where("query_id in (21, 24) and rank = 1").collect()}
        assert np.isnan(kinds[21]) and kinds[24] is None


def test_large_groups_of_copies_take_no_more_room():
    """equal distances are settled tile by tile, so copies neither pile up nor change the answer."""
    import tracemalloc

    import numpy as np

    v = np.tile(knn._unit(np.ones((1, 8))), (20_000, 1))
    ids = np.arange(len(v))[::-1].copy()
    best = knn.KNearest(ids[:4096], v[:4096], 3)
    tracemalloc.start()
    for a in range(0, len(v), 10_000):
        best.add(ids[a : a + 10_000], v[a : a + 10_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    assert best.id.reshape(-1, 3).tolist() == [[0, 1, 2]] * 4096 and not best.far.any()


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "Cats and dogs"), (2, "cat cat CAT"), (3, None), (4, "nothing")], "id long, text string")
    assert [r["id"] for r in lexical.best(docs, "cat", "id", "text", 5).collect()] == [2]
    assert [r["id"] for r in lexical.best(docs, "cats", "id", "text", 5, stemmed=True).collect()] == [2, 1]
    assert lexical.best(docs, "???", "id", "text", 5).count() == 0


def test_recall_kinds(spark):
    e = spark.createDataFrame([(1, "m1", 0, "alpha", 0.0, 0.0, "cold", "active", None), (2, "m2", 0, "beta", 0.0, 0.0, "hot", "active", "{}"), (3, "m3", 0, "alpha", 0.0, 0.0, "hot", "forgotten", None)], "rowid long, memory_id string, ts_ms long, content string, salience double, strength double, tier string, status string, context_json string")
    v = spark.createDataFrame([(9, "chunk", [1.0, 0.0]), (2, "episode", [0.9, 0.1]), (3, "episode", [1.0, 0.0])], "id long, kind string, embedding array<float>")
    found = retrieval.recall(e, v, "alpha", [1.0, 0.0], 5, 10**13).collect()
    assert [(r["rowid"], r["distance"] == 1.0, r["score"] is None) for r in found] == [(2, False, True), (1, True, False)]
    assert found[0]["fused_score"] == pytest.approx(1 / 63 + 0.006, abs=1e-6)  # rank 3: the chunk and the forgotten row count
    assert retrieval.candidate_budget(10) == 40 and retrieval.candidate_budget(100) == 200 and retrieval.candidate_budget(300) == 300


FACTS = "triple_id string, subject_id string, predicate string, object_id string, object_kind string, valid_from_ms long, valid_to_ms long, confidence double, status string, source_episode_id long, cluster_id string"


def fact(i, s, p, o, a=0, z=None, kind="literal", status="active"):
    return (i, s, p, o, kind, a, z, 0.9, status, None, None)


def test_facts(spark):
    t = spark.createDataFrame([fact("1", "s", "p", "a", 0, 10), fact("2", "s", "p", "b", 10, 20), fact("3", "s", "p", "a", 5), fact("4", "s", "q", "b", 0), fact("5", "x", "p", "b", 0), fact("6", "s", "p", "c", 21, status="superseded"), fact("7", "user", "p", "user", 1, None, "entity"), fact("8", "100%", "p", "z")], FACTS)
    pairs = {(r["a_triple_id"], r["b_triple_id"]) for r in facts.contradiction_candidates(t).collect()}
    assert pairs == {("1", "2"), ("2", "3")}  # windows that touch meet; equal objects and other subjects don't
    assert [r["triple_id"] for r in facts.facts_about(t, "me", ("me",), as_object=True).collect()] == ["7"]
    assert [r["triple_id"] for r in facts.facts_about(t, "s", until=10).collect()] == ["3", "1", "4"]
    assert {r["entity_id"] for r in facts.entities(t, "%").collect()} >= {"s", "x", "100%"}
    assert t.where(facts.as_of(10)).where("triple_id in ('1', '2')").count() == 1


def test_graph(spark):
    e = spark.createDataFrame([("e1", "a", "p", "b", 0, 10, 0.5, 0.5, 1), ("e2", "b", "p", "c", 0, None, 0.8, 0.5, 1), ("e3", "a", "p", "c", 5, None, 0.1, 0.1, 1), ("e4", "a", "p", "a", 0, None, 0.9, 0.9, 1), ("e5", "c", "p", "c", 0, None, 0.9, 0.9, 1)], "edge_id string, subject_id string, predicate string, object_id string, valid_from_ms long, valid_to_ms long, confidence double, strength double, evidence_count long")
    assert [r["edge_ids"] for r in graph.paths(e, "a", "c").collect()] == ["e1 e2", "e3"]
    assert [r["edge_ids"] for r in graph.paths(e, "a", "c", t=10).collect()] == ["e3"]
    assert [r["edge_ids"] for r in graph.paths(e, "a", "c", hops=1).collect()] == ["e3"]
    assert {r["nodes"] for r in graph.context_paths(e, ["a"]).collect()} == {"a>b", "a>c", "a>b>c", "a>c>c"}
    ev = spark.createDataFrame([("v1", "e1", "m", 0.5, 1), ("v2", "e1", "m", 0.5, 2), ("v0", "e1", "m", 0.4, 9)], "evidence_id string, edge_id string, memory_id string, extraction_confidence double, created_at_ms long")
    assert {r["edge_id"]: r["evidence_id"] for r in graph.best_evidence(e, ev).collect()}["e1"] == "v2"


def test_quality_gate(spark):
    rows = [("1", "", "p q", "o", "literal", 0.9), ("2", "tool", "likes", "o", "literal", 0.9), ("3", "a", "likes", "o", "literal", 0.5), ("4", "/etc", "likes", "o", "literal", 0.9), ("5", "a", "x", "o", "literal", 0.9), ("6", "???", "likes", "o", "literal", 0.9), ("7", "a", "likes", "http://x", "entity", 0.9), ("8", "a", "likes", "!!", "entity", 0.9), ("9", "a", "likes", "z " * 130, "literal", 0.9), ("10", "a", "has", "y" * 90, "literal", 0.9), ("11", "A b", "Likes", "C d", "entity", 0.9), ("12", None, None, None, "entity", 0.9)]
    got = {r["triple_id"]: r for r in quality_gate.judge(spark.createDataFrame(rows, "triple_id string, subject_id string, predicate string, object_id string, object_kind string, confidence double")).collect()}
    assert [got[str(i)]["reason_code"] for i in range(1, 13)] == ["incomplete_shape", "assistant_or_tool_chatter", "low_confidence", "metadata_subject", "weak_predicate", "weak_subject", None, "weak_object", "weak_literal", "weak_literal_claim", None, "incomplete_shape"]
    assert got["7"]["object_kind"] == "literal" and (got["11"]["subject_id"], got["11"]["predicate"], got["11"]["object_id"]) == ("a-b", "likes", "c-d")
    issues = spark.createDataFrame([("critical", "a", 1), ("warning", "b", 1), ("info", "c", 1)], "severity string, code string, n long")
    assert quality_gate.health(issues).first()["score"] == 71 and quality_gate.health(issues.limit(0)).first()["grade"] == "excellent"
    assert quality_gate.needs_catch_up({"active_episodes": 9, "triples": 0, "clusters": 2, "abstractions": 1}, 5)


def test_clusters(spark, monkeypatch):
    day = 86_400_000
    v = {1: [1, 0], 2: [0.9, 0.3], 3: [0.6, 0.7], 4: [0, 1], 5: [1, 0], 6: [0, 0]}
    rows = spark.createDataFrame([(i, (day if i == 5 else 0) + i, [float(x) for x in v[i]]) for i in v], "id long, ts_ms long, embedding array<float>")
    members = sorted(map(tuple, cluster.cluster_days(rows, 0.7).collect()))
    assert members == [(1, 1), (1, 2), (1, 3), (1, 4)]  # a chain; another day and a zero vector stay out
    assert sorted(map(tuple, cluster.cluster_days(rows, 0.7, max_size=3).collect())) == [(1, 1), (1, 2), (1, 3)]
    monkeypatch.setattr(cluster, "BLOCK", 2)
    assert sorted(map(tuple, cluster.cluster_days(rows, 0.7).collect())) == members
    m = spark.createDataFrame([(10, 1), (10, 2), (20, 3), (30, 4)], "cluster_id long, id long")
    c = cluster.centroids(m, rows)
    assert sorted(map(tuple, cluster.merge_plan(c, 0.7).collect())) == [(10, 20), (10, 30)]
    assert cluster.merge_plan(c, 0.7, max_size=3).count() == 0
    assert {r[0] for r in cluster.merge(m, cluster.merge_plan(c, 0.7)).collect()} == {10}
    coherent = {r["cluster_id"]: r["coherence"] for r in cluster.coherence(m, rows).collect()}
    assert coherent[20] == 1.0 and coherent[10] == pytest.approx(0.948683, abs=1e-6)
    old = spark.createDataFrame([(1, 2, [1.0, 0.1]), (2, 9, [0.8, 0.6])], "cluster_id long, n long, centroid array<double>")
    new = spark.createDataFrame([(7, 2, [1.0, 0.2]), (8, 60, [1.0, 0.0])], "cluster_id long, n long, centroid array<double>")
    assert [tuple(r)[:2] for r in cluster.absorb(spark, new, old, 0.55).collect()] == [(7, 1)]
    assert {r["id"] for r in cluster.unclustered(rows, m).collect()} == {5, 6}


def test_similar_links_keep_components_in_bounded_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(6)
    v = [r.normal(size=3).tolist() for _ in range(60)]
    rows = spark.createDataFrame([(i, i % 2, e) for i, e in enumerate(v)] + [(99, 0, None)], "id long, day long, embedding array<double>")
    monkeypatch.setattr(cluster, "BLOCK", 7)
    for threshold in (0.8, 0.95, 0.99):
        pairs, links = cluster.similar_pairs(rows, threshold), cluster.similar_links(rows, threshold)
        assert {tuple(x) for x in links.collect()} <= {tuple(x)[:2] for x in pairs.collect()}
        assert sorted(map(tuple, cluster.components(links).collect())) == sorted(map(tuple, cluster.components(pairs).collect()))
    near = np.ones((4096, 4)) / 2  # copies: all pairs are similar
    tracemalloc.start()
    a, _ = cluster._forest(4096, cluster._near(near, np.arange(4096), np.arange(4096) % 2, True, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 4095 and peak < 60e6, peak  # a block's matrix alone takes 134 MB


def test_rows_without_a_key_are_spread(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        live = spark.range(4000).selectExpr("concat('t', id) triple_id", "'active' status", "if(id % 10 = 0, id % 30, null) source_episode_id", "'c' cluster_id", "0.5D confidence")
        made = graph.backfill_evidence(live, spark.createDataFrame([(0, "ev:0"), (10, "ev:10"), (11, "ev:11")], "rowid long, memory_id string"))
        assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r): r["count"] for r in made.groupBy("memory_id", "source_episode_id").count().collect()} == {(None, None, 3600): 3600, ("ev:0", 0, 134): 134, ("ev:10", 10, 133): 133, (None, 20, 133): 133}
        rows = spark.range(4000).selectExpr("concat('at:', id) attachment_id", "concat('ev:', id) memory_id", "if(id % 50 = 0, id, null) doc_id", "if(id % 50 <> 0, id, null) asset_id")
        met = assets.attachments(rows, spark.range(4000).selectExpr("concat('ev:', id) memory_id", "id ts_ms"), spark.range(2000).selectExpr("id doc_id", "concat('s', id) source"), spark.range(3000).selectExpr("id asset_id", "concat('h', id) sha256"))
        docs = rows.withColumn("asset_id", F.lit(None).cast("long")).withColumn("doc_id", F.lit(None).cast("long"))
        bare = assets.attachments(docs, spark.range(4000).selectExpr("concat('ev:', id) memory_id", "id ts_ms"), spark.range(9).selectExpr("id doc_id", "'s' source"), spark.range(9).selectExpr("id asset_id", "'h' sha256"))
        assert max(r["count"] for r in bare.groupBy(F.spark_partition_id()).count().collect()) < 2000 and bare.count() == 4000
        told = {r["attachment_id"]: (r["doc_id"], r["source"], r["asset_id"], r["sha256"]) for r in met.collect()}
        assert len(told) == 4000 and told["at:50"] == (50, "s50", None, None) and told["at:51"] == (None, None, 51, "h51") and told["at:2050"] == (2050, None, None, None) and told["at:3999"] == (None, None, 3999, None)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_latest_deals_rows_before_it_sorts_them(spark):
    rows = spark.range(5000).selectExpr("if(id < 4000, 'hot', concat('k', id % 10)) k", "id created_at_ms", "concat('o', id) op_id")
    made = audit.latest(rows, ["k"])
    assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {("hot", 3999, "o3999")} | {(f"k{i}", 4990 + i, f"o{4990 + i}") for i in range(10)}


def test_chunks(spark):
    assert documents.chunk("") == [] and documents.chunk("x" * 3003) == [(0, 3003)]
    for text in ("wörter. " * 900, "a" * 9000, "\n\n".join("para graph. " * 40 for _ in range(20)), "x" * 2990 + "\n\n" + "y" * 9000):
        spans = documents.chunk(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) > 1
        for (a, b), (c, d) in zip(spans[:-1], spans[1:], strict=True):
            assert a < c <= b < d
    rows = documents.chunks(spark.createDataFrame([(1, "é" * 4000), (2, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert rows[0]["end_offset"] == 2 * 1999 and rows[-1]["end_offset"] == 8000 and {r["doc_id"] for r in rows} == {1}


def test_redaction(spark):
    text = "a@b.co 123-45-6789 (555) 123-4567 4799 1346 8104 4206 4799134681044207 AKIA" + "A" * 16 + " ghp_" + "b" * 36
    r = documents.redact(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"), extra={"word": "none"}).orderBy("doc_id").collect()
    assert r[0]["text"] == "[REDACTED:email] [REDACTED:ssn] [REDACTED:us_phone] [REDACTED:credit_card] 4799134681044207 [REDACTED:aws_access_key] [REDACTED:github_pat]"
    assert [r[0][f"n_{k}"] for k in documents.REDACTIONS] == [1] * 6 and r[1]["text"] is None and r[2]["text"] == "[REDACTED:word]"


def test_redaction_agrees_with_sql_beside_other_scripts(spark, tmp_path):
    from tests import compare
    from tidewell.plans import registry, sql

    card = "4799134681044206"
    texts = ["\u4e2d123-45-6789\u00e9 \u0663555-123-4567", f"\u4e2d{card}\u3002 \u00e9AKIA{'A' * 16}\u4e2d", f"\u00e9ghp_{'b' * 36}\u4e2d", "(555)\x0b123-4567", f"{card} then 12{card}34", f"{card} {card}", None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["d3_redact_counts"](spark, str(tmp_path)).toPandas()
    told = compare.duckdb.connect()
    told.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compare.same(found, told.execute(sql.D3).df())
    assert found.set_index("doc_id").loc[[0, 1, 2, 3], ["n_ssn", "n_us_phone", "n_credit_card", "n_aws_access_key", "n_github_pat"]].astype(int).to_numpy().tolist() == [[1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0]]


def test_redaction_guards_miss_nothing():
    import random
    import re

    r = random.Random(4)
    pieces = ["a", "Z", "@", "@b.co", ".", "-", " ", "123", "4567", "12", "(555) ", "( 555 )", "AKIA", "A" * 16, "ghp_", "b" * 36, "9", "4799 1346", "8104-4206", "_", "-45-6789", "123-45-", "123-456-", "(555) 123-4567"]
    seen = dict.fromkeys(documents.REDACTIONS, 0)
    for _ in range(40_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 8)))
        for name, pattern in documents.REDACTIONS.items():
            if re.search(pattern, text):
                seen[name] += 1
                assert re.search(documents.GUARDS[name], text), (name, text)
    assert min(seen.values()) > 50


def test_importers(spark):
    gpt = {"id": "g", "title": " My  chat ", "mapping": {"n2": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["two"]}, "create_time": "2"}}, "n1": {"message": {"author": {"role": "human"}, "content": {"parts": ["one"]}, "create_time": "1"}}, "n0": {"message": None}}}
    other = {"uuid": "c", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": " "}]}
    df = spark.createDataFrame([(json.dumps(gpt),), (json.dumps(other),)], "json string")
    got = sorted(map(tuple, documents.chat_exports(df).collect()))
    assert got == [("c", "Untitled conversation", 0, "user", "hi"), ("g", "My chat", 0, "user", "one"), ("g", "My chat", 1, "assistant", "two")]
    assert documents.chat_exports(df, filters=("my chat",)).select("conv_id").distinct().count() == 1
    assert documents.csv_text('a, b\n\n"c,d"\n') == "row 1: a | b\nrow 3: c,d"


def test_extractors(spark):
    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return out.getvalue()

    files = [
        ("a.txt", b"plain"), ("b.txt", b"\xff"), ("c.png", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")), ("d.png", b"no"), ("e.docx", packed({"word/document.xml": "<d xmlns:w='u'><w:t>Hello</w:t></d>"})),
        ("f.zip", packed({"x": "12"})), ("g.exe", b""), ("h.html", b"<p>a<script>b</script> c</p>"), ("i.obj", b"v 1 2 3\nf 1 1 1\n"), ("j.jpg", b"\xff\xd8\xff\xc0\0\x11\x08\0\x02\0\x05" + b"\0" * 9),
    ]
    got = {r["path"]: (r["text"], r["error"]) for r in documents.extract_files(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.txt"] == ("plain", None) and got["b.txt"][0] is None and got["c.png"][0] == "PNG image, 3 x 4" and got["d.png"][1] and got["e.docx"][0] == "Hello"
    assert got["f.zip"][0] == "x (2 bytes)" and got["g.exe"][1] and got["h.html"][0] == "a c" and "1 vertices" in got["i.obj"][0] and got["j.jpg"][0] == "JPEG image, 5 x 2"


def test_audit_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k long, v string")
    assert sorted(map(tuple, audit.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, audit.replace_rows(old, new.limit(2), ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    ids = old.withColumn("id", F.concat(F.lit("abc"), F.col("v")))
    assert audit.by_prefix(ids, "abca", "id") == "abca"
    for bad in ("abc", "nope"):
        with pytest.raises(LookupError):
            audit.by_prefix(ids, bad, "id")
    with pytest.raises(LookupError):
        audit.inspect(ids, "none", "id")


def test_eval_ranks_and_metrics(spark):
    cases = spark.createDataFrame([("tide", "When does the harbour ferry leave on Sundays?"), ("none", "???")], "case_id string, query string")
    memories = spark.createDataFrame([
        ("tide", "late", "On Sundays the harbour ferry leaves at nine.", "semantic", 0.5, "active"), ("tide", "gone", "The harbour ferry leaves on Sundays at seven.", "semantic", 1.0, "forgotten"),
        ("tide", "bread", "Bread is baked at four.", "decision", 0.0, "active"), ("none", "any", "Nothing to see.", "semantic", 0.0, "active"),
    ], "case_id string, memory_id string, text string, tier string, importance double, status string")
    ranks = evaluate.lexical_ranks(cases, memories)
    got = {(r["case_id"], r["memory_id"]): r["rank"] for r in ranks.collect()}
    assert got["tide", "late"] == 1 and got["tide", "bread"] == 2 and ("tide", "gone") not in got
    expected = spark.createDataFrame([("tide", "bread"), ("none", "any")], "case_id string, memory_id string")
    assert tuple(evaluate.metrics(ranks, expected, 1).first()) == (0.5, 0.75, 0.5) and tuple(evaluate.metrics(ranks, expected, 2).first()) == (1.0, 0.75, 0.5)


def test_context(spark):
    df = spark.createDataFrame([("Ada",), ("bo",)], "entity_id string")

    def broken():
        raise ValueError("no")

    found = context.bundle({"good": lambda: df, "empty": lambda: df.limit(0), "bad": broken})
    assert found["good"].count() == 2 and found["empty"].count() == 0 and found["bad"] is None
    assert context.resolved_subject("ADA", df) == "Ada" and context.resolved_subject("x", df) == "Ada" and context.resolved_subject("x", None) == "x" and context.resolved_subject(None, df) is None
    assert context.seeds("bo", df, 5) == ["bo", "Ada"] and context.seeds(None, df, 1) == ["Ada"] and context.seeds(None, None, 5) == []
    none, some = {"active_episodes": 0, "clusters": 0, "pending_clusters": 0}, {"active_episodes": 3, "clusters": 2, "pending_clusters": 1, "triples": 4}
    counts = {"recall": 1, "themes": 0, "entities": 0, "facts": 2, "contradictions": None, "graph": 1}
    assert context.section_states(counts, none, False, True) == {"recall": "ready", "themes": "empty", "entities": "disabled", "facts": "ready", "contradictions": "failed", "graph": "ready"}
    assert context.section_states(counts, some, True, False) == {"recall": "ready", "themes": "empty", "entities": "pending", "facts": "empty", "contradictions": "failed", "graph": "pending"}
    assert context.section_states(counts, some | {"clusters": 0}, False, True)["themes"] == "pending" and context.section_states(counts, some, False, True)["entities"] == "empty"
    recall = spark.createDataFrame([("m1", None), ("m2", -1.0)], "memory_id string, score double")
    paths = spark.createDataFrame([("e1 e2",), ("e2",)], "edge_ids string")
    full = {"recall": recall, "facts": df, "themes": None, "graph": None, "paths": paths, "contradictions": df.limit(0), "warnings": df}
    assert context.reason_codes(full) == ["memory_context", "semantic_match", "lexical_match", "graph_neighbor", "subject_fact", "contradiction_warning"]
    assert context.recalled_ids(full) == ["m1", "m2", "e1", "e2"]
    assert context.retrieval_log(spark, "q", 1, ["a", "b", "a"], ["x", "x"]).first()["memory_ids"] == ["a", "b"]
    assert context.section_health(1, 1, enabled=False) == "disabled"


def test_erasure_spares_rows_without_a_principal(spark):
    e = spark.createDataFrame([(1, "m1", "u"), (2, "m2", "v"), (3, "m3", None)], "rowid long, memory_id string, principal string")
    f = spark.createDataFrame([("a", 1, "c1"), ("b", None, "c1"), ("c", 2, None), ("d", None, "c2")], "triple_id string, source_episode_id long, cluster_id string")
    m = spark.createDataFrame([("c1", "m1"), ("c2", "m3")], "cluster_id string, memory_id string")
    c = spark.createDataFrame([(1, "u"), (2, None), (3, "v")], "chunk_id long, ingested_by string")
    left = audit.erase("u", e, f, m, c)
    ids = {k: sorted(r[0] for r in left[k].select(left[k].columns[i]).collect()) for k, i in (("episodes", 0), ("facts", 1), ("members", 0), ("chunks", 0))}
    assert ids == {"episodes": [2, 3], "facts": ["b", "c", "d"], "members": ["m3"], "chunks": [2, 3]}
    assert tuple(audit.erasure_estimate("u", e, f, m, c).first()) == (1, 1, 1, 1)
    assert tuple(audit.erasure_estimate("nobody", e, f, m, c).first()) == (0, 0, 0, 0)
    kept = {r["triple_id"]: r["source_episode_id"] for r in audit.clear_source(f, e.where("rowid = 1").select(F.col("rowid").alias("source_episode_id"))).collect()}
    assert kept == {"a": None, "b": None, "c": 2, "d": None}
    assert {k: (v.count(), v.columns) for k, v in audit.reset_derived({"m": m}).items()} == {"m": (0, m.columns)}


def test_settle_keeps_earlier_times(spark):
    found = spark.createDataFrame([("a", "b", "resolved", 777), ("c", "d", "resolved", 5), ("e", "f", "unresolved", None)], "a_triple_id string, b_triple_id string, status string, resolved_at_ms long")
    decided = spark.createDataFrame([("c", "d", "reopened"), ("e", "f", "resolved")], "a_triple_id string, b_triple_id string, status string")
    got = {r["a_triple_id"]: (r["status"], r["resolved_at_ms"]) for r in facts.settle(found, decided, 9).collect()}
    assert got == {"a": ("resolved", 777), "c": ("reopened", None), "e": ("resolved", 9)}
    assert {r["resolved_at_ms"] for r in facts.settle(found, decided.limit(0), 9).collect()} == {777, 5, None}


def test_cutoff():
    assert facts.cutoff(10, None) is None and facts.cutoff(86_400_000, 1) == 0 and facts.cutoff(0, 1 << 60) is None and facts.cutoff(0, -(1 << 60)) is None


def test_upserts(spark):
    kind = "fingerprint string, claim_id string, review_id string, status string, user_approved boolean, evidence_count long, created_at_ms long, activated_at_ms long"
    old = spark.createDataFrame([("1", "o1", "r1", "rejected", True, 5, 1, None), ("2", "o2", "r2", "quarantined", False, 5, 1, None), ("3", "o3", None, "rejected", True, 5, 1, None), ("4", "o4", None, "active", False, 5, 1, 1)], kind)
    new = spark.createDataFrame([("1", "n1", "s1", "needs_review", False, 1, 2, None), ("2", "n2", "s2", "active", False, 1, 2, 2), ("3", "n3", "s3", "active", False, 1, 2, 2), ("5", "n5", "s5", "needs_review", False, 1, 2, None)], kind)
    got = {r["fingerprint"]: tuple(r)[1:] for r in quality_gate.upsert_claims(old, new).collect()}
    assert got == {"1": ("o1", "s1", "rejected", True, 5, 1, None), "2": ("o2", None, "active", False, 1, 1, 2), "3": ("o3", None, "active", True, 1, 1, 2), "4": ("o4", None, "active", False, 5, 1, 1), "5": ("n5", "s5", "needs_review", False, 1, 2, None)}
    kind = "alias string, canonical_id string, display_label string, source string, confidence double, created_at_ms long, updated_at_ms long"
    a = quality_gate.upsert_aliases(spark.createDataFrame([("Ada", "a", "A", "old", 0.9, 1, 1)], kind), spark.createDataFrame([(" [Ada] ", "b", "B", "gate", 0.5, 2, 2), ("", "x", "X", "gate", 1.0, 2, 2), ("Bo", "", "X", "gate", 1.0, 2, 2), ("Cy", "c", "C", "gate", 0.1, 2, 2)], kind))
    assert {tuple(r) for r in a.collect()} == {("Ada", "b", "B", "old", 0.9, 1, 2), ("Cy", "c", "C", "gate", 0.1, 2, 2)}
    op, revision = quality_gate.split_request(spark, "o1", "ada", ["x", "y"], 5)
    assert op.first()["op_kind"] == "split" and (revision.first()["previous_id"], "o1" in revision.first()["metadata_json"]) == ("ada", True)
    ops = spark.createDataFrame([("m", "o1", "approve", 1), ("m", "o2", "dismiss", 2), ("m", "o0", "approve", 2), ("n", "o4", "approve", 1)], "memory_id string, op_id string, state string, created_at_ms long")
    assert {r["memory_id"]: r["state"] for r in audit.latest(ops, ["memory_id"]).collect()} == {"m": "dismiss", "n": "approve"}


def test_audit_samples_are_bounded_and_in_order(spark, data):
    from tidewell.plans import registry
    from tidewell.sources import model

    issues = quality_gate.audit(*registry._audited(spark, data)).collect()
    assert all(len(r["samples"]) <= quality_gate.SAMPLES for r in issues) and {r["code"] for r in issues} >= {"triple_review_queue", "low_confidence_facts", "low_signal_abstractions"}
    empty = quality_gate.audit(*[x.limit(0) for x in registry._audited(spark, data)]).collect()
    assert [(r["severity"], r["code"], r["n"]) for r in empty] == [("info", "no_active_triples", 0)]
    none = model.clusters(spark, data).limit(0)
    args = list(registry._audited(spark, data))
    args[1], args[2] = none, args[2].limit(0)
    codes = {r["code"]: r["n"] for r in quality_gate.audit(*args).collect()}
    assert codes["no_clusters"] == codes["unclustered_episodes"] > 0


def test_weak_facts_and_small_checks(spark):
    rows = spark.createDataFrame([("The Assistant", "likes", "x", "entity"), ("assistant", "Can Help!", "x", "entity"), ("LLM", "is", "TRUE", "literal"), ("LLM", "is", "true", "entity"), ("model", "said", "I'm unable", "literal"), (" ", "p", "o", "entity"), ("s", None, "o", "entity"), ("s", "p", "", "entity")], "s string, p string, o string, k string")
    got = [r[0] for r in rows.select(X.extraction_reason(F.col("s"), F.col("p"), F.col("o"), F.col("k"))).collect()]
    assert got == [None, "runtime metadata", "refusal or capability literal", None, "refusal or capability literal", "empty subject_id", "empty predicate", "empty object_id"]
    made = spark.createDataFrame([("c1", "x", "assistant", "can_help", "y", "entity", 1, 0.9, None), ("c1", "x", "a", "b", "c", "entity", 1, 0.9, None), ("c2", "x", "system", "model", "z", "entity", 1, 0.9, None), ("c3", None, None, None, None, None, None, None, "bad")], "cluster_id string, content string, subject_id string, predicate string, object_id string, object_kind string, valid_from_ms long, confidence double, error string")
    assert sorted(tuple(r)[:3] for r in extraction.without_weak_facts(made).collect()) == [("c1", "x", "a"), ("c2", "x", None), ("c3", None, None)]
    for text, ms in (("1970-01-01T00:00:00Z", 0), ("1969-12-31T23:59:59.999Z", -1), ("2024-02-29t12:00:00.5+01:00", 1709204400500), ("2024-02-30T00:00:00Z", None), ("2024-01-01", None), ("x", None)):
        assert one(spark, X.millis_of_rfc3339(F.col("v")), v=text) == ms
    assert one(spark, X.rfc3339_of_millis(F.col("v")), v=-1) == "1969-12-31T23:59:59.999Z"
    assert [one(spark, X.seconds_of_duration(F.col("v")), v=x) for x in ("90s", "2h", "7d", "h", "1.5h")] == [90, 7200, 604800, None, None]
    assert one(spark, X.checked_salience(F.col("v")), v=0.5) == 0.5
    for bad in (1.5, -0.1, float("nan"), float("inf")):
        with pytest.raises(Exception, match="salience"):
            one(spark, X.checked_salience(F.col("v")), v=bad)


def test_words_lose_diacritics(spark):
    assert one(spark, X.words(F.col("v")), v="Émile ÖL naïve Straße 中文") == ["emile", "ol", "naive", "straße", "中文"] and X.query_terms("Ölé") == ["ole"]


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Cats and dogs"), (2, "cat cat CAT"), (3, None), (4, "nothing"), (5, "dogs dogs cat")], "id long, text string")
    path = f"file://{tmp_path}/plain"
    lexical.save_index(docs, path, "id", "text", buckets=3)
    for query in ("cat", "cat dogs", "cat cat", "zebra", "???"):
        assert [tuple(r) for r in lexical.search_index(spark, path, query, 5).collect()] == [tuple(r) for r in lexical.best(docs, query, "id", "text", 5).collect()]
    plan = lexical.search_index(spark, path, "cat", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term" in plan or "EqualTo(term" in plan
    lexical.save_index(docs, f"{path}2", "id", "text", stemmed=True)
    assert [r["id"] for r in lexical.search_index(spark, f"{path}2", "cats", 5).collect()] == [r["id"] for r in lexical.best(docs, "cats", "id", "text", 5, stemmed=True).collect()]
    kind = docs.selectExpr("'document' AS kind", "id")
    assert tuple(lexical.drift(kind, path).first()) == ("document", 5, 5, 0, 0, 0) and tuple(lexical.drift(kind.where("id > 1").selectExpr("kind", "id + 1 AS id"), path).first()) == ("document", 4, 5, -1, 1, 2)


def test_lifecycle(spark):
    day = 86_400_000
    v = {1: [1, 0], 2: [0.9, 0.3], 3: [0.6, 0.7], 4: [0, 1], 5: [1, 0.1], 6: [1, 0.2]}
    rows = spark.createDataFrame([(i, (day if i > 4 else 0) + i, [float(x) for x in v[i]]) for i in v], "id long, ts_ms long, embedding array<float>")
    none = spark.createDataFrame([], "cluster_id long, id long")
    first = cluster.consolidate(spark, rows.where("id <= 4"), none, 0.7)
    assert sorted(map(tuple, first.collect())) == [(1, i) for i in range(1, 5)]
    assert cluster.consolidate(spark, rows.where("id <= 4"), first, 0.7) is first  # nothing new
    second = sorted(map(tuple, cluster.consolidate(spark, rows, first, 0.7).collect()))
    assert second == [(1, i) for i in range(1, 7)]
    episodes = spark.createDataFrame([(1, "hot", "active", 9 * day, "a"), (2, "hot", "active", 0, "b"), (3, "warm", "active", 9 * day, "c"), (4, "hot", "forgotten", 9 * day, "d"), (5, "hot", "active", 9 * day, "e")], "rowid long, tier string, status string, ts_ms long, content string")
    vectors = spark.createDataFrame([(1, "now", [1.0]), (2, "now", [1.0]), (3, "now", [1.0]), (4, "now", [1.0]), (5, "old", [1.0]), (2, "old", [1.0]), (9, "now", [1.0])], "rowid long, embedder string, embedding array<float>")
    assert sorted(r["id"] for r in cluster.in_scope(episodes, vectors, "now", 10 * day).collect()) == [1, 2] and [r["id"] for r in cluster.in_scope(episodes, vectors, "now", 10 * day, 5).collect()] == [1]
    assert sorted(map(tuple, cluster.stale_vectors(vectors, episodes, "now").collect())) == [(2, "old"), (4, "now"), (9, "now")]
    embed = lambda c: F.array(F.length(c).cast("float"))
    assert [r["rowid"] for r in cluster.re_embed(vectors, episodes, "now", embed, dry_run=True).collect()] == [5]
    again = cluster.re_embed(vectors, episodes, "now", embed)
    assert again.count() == 8 and cluster.re_embed(again, episodes, "now", embed).count() == 8
    c = spark.createDataFrame([(1, 3, 0.5, [1.0, 0.0]), (2, 1, 0.9, [0.0, 1.0]), (3, 2, 1.0, [1.0, 0.0])], "cluster_id long, n long, coherence double, centroid array<double>")
    merged = {r["cluster_id"]: r for r in cluster.merge_summary(c, spark.createDataFrame([(1, 2)], "survivor long, loser long")).collect()}
    assert set(merged) == {1, 3} and merged[1]["n"] == 4 and merged[1]["coherence"] == 0.6 and merged[1]["centroid"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_documents_come_back_whole(spark):
    texts = {1: "wörter. " * 900, 2: "a" * 9000, 3: "\n\n".join("pära graph. " * 40 for _ in range(20)), 4: "short", 5: "x" * 2990 + "\n\n" + "é" * 9000}
    docs = spark.createDataFrame([*texts.items(), (6, ""), (7, None)], "doc_id long, text string")
    for overlap in (0, 50, 400):
        parts = documents.chunks(docs, overlap=overlap)
        assert {r["doc_id"]: r["text"] for r in documents.document_texts(parts).collect()} == texts
    assert documents.chunk_of(parts, 4, 0).first()["content"] == "short"
    known = docs.where("doc_id = 4").select(F.sha2("text", 256).alias("content_hash"))
    again = docs.unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(20).cast("long")))
    new, parts = documents.ingest(again, known, lambda c: F.array(F.length(c)))
    got = {r["doc_id"]: r["chunk_count"] for r in new.collect()}
    assert set(got) == {1, 2, 3, 5, 6} and got[6] == 0 and got[2] == parts.where("doc_id = 2").count() and "embedding" in parts.columns


def test_more_formats(spark, tmp_path):
    import struct

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return out.getvalue()

    ns = 'xmlns="u"'
    book = packed({"xl/sharedStrings.xml": f"<sst {ns}><si><t>first</t></si><si><r><t>se</t></r><r><t>cond</t></r></si></sst>", "xl/worksheets/sheet1.xml": f'<w {ns}><row r="2"><c t="s"><v>1</v></c><c><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></w>', "xl/worksheets/sheet2.xml": f"<w {ns}/>"})
    gltf = json.dumps({"asset": {"version": "2.0"}, "meshes": [1, 2], "nodes": [1]}).encode()
    glb = b"glTF" + struct.pack("<II", 2, 20 + len(gltf)) + struct.pack("<I4s", len(gltf), b"JSON") + gltf
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 7) + struct.pack("<HHII", 257, 4, 1, 9)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    want = {"a.xlsx": (book, "sheet 1\nrow 2: second | 5 | in\nsheet 2"), "b.gltf": (gltf, "glTF 2.0 model, 0 scenes, 1 nodes, 2 meshes, 0 materials, 0 textures, 0 animations"), "d.tiff": (tiff, "TIFF image, 7 x 9"), "e.webp": (webp, "WebP image, 100 x 50"), "f.blend": (b"BLENDER-v293rest", "Blender file, version 293, 64 bit, little endian")}
    for name, (content, text) in want.items():
        assert documents.extract(name, content) == text
    assert documents.extract("c.glb", glb) == want["b.gltf"][1]
    with pytest.raises(ValueError, match="no reader"):
        documents.extract("x.pdf", b"%PDF-1.4")
    documents.READERS["pdf"] = lambda b: f"{len(b)} bytes"
    try:
        assert documents.extract("x.pdf", b"%PDF-1.4") == "8 bytes"
    finally:
        documents.READERS.clear()
    with pytest.raises(ValueError, match="rows"):
        documents.csv_text("a\n" * (documents.MOST_ROWS + 1))
    for name, body in (("one.txt", b"1"), ("sub/two.md", b"2"), ("sub/.hidden.txt", b"3"), (".git/four.txt", b"4"), ("five.exe", b"5"), ("bad.png", b"6")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = {r["path"].removeprefix(f"file:{tmp_path}/"): (r["text"], r["error"] is None) for r in documents.import_folder(spark, f"file:{tmp_path}").collect()}
    assert found == {"one.txt": ("1", True), "sub/two.md": ("2", True), "bad.png": (None, False)}
    assert documents.import_folder(spark, f"file:{tmp_path}", most=1).count() == 1 and documents.import_folder(spark, f"file:{tmp_path}", ("md",)).count() == 1


def test_audit_export(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 2, "u") for i in range(50)], "rowid long, ts_ms long, principal string").repartition(5)
    assert audit.export(rows, f"file:{tmp_path}/out") == 50
    told = [json.loads(x)["rowid"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert told == list(range(49, -1, -1))
    assert audit.retention(rows, 86_400_000, 1).count() == 50 and audit.retention(rows, 86_400_000 + 10, 1).count() == 30 and audit.retention(rows, 5, None).count() == 50


def test_graph_facts_and_nodes(spark):
    e = spark.createDataFrame([("e1", "a", "p", "b", "entity", 0.5, 0.9, 2), ("e2", "b", "p", "a", "entity", 0.5, 0.8, 0), ("e3", "a", "p", "a", "entity", 0.5, 0.1, 1), ("e4", "a", "p", "lit", "literal", 0.5, 1.0, 1), ("e5", "c", "p", "a", "literal", 0.5, 1.0, 1), ("e6", "a", "p", "z", "entity", 0.5, 0.7, 1), ("e7", "z", "p", "b", "entity", 0.5, 0.6, 1)], "edge_id string, subject_id string, predicate string, object_id string, object_kind string, confidence double, strength double, evidence_count long")
    got = graph.context_facts(e, ["a", "b"]).collect()
    assert [(r["edge_id"], r["direction"]) for r in got] == [("e1", "between_seed_entities"), ("e2", "between_seed_entities"), ("e6", "outgoing"), ("e7", "incoming"), ("e3", "self"), ("e4", "outgoing")]
    assert got[0]["reason_codes"] == ["query_entity", "between_seed_entities", "graph_neighbor", "evidence_backed"] and "evidence_backed" not in got[1]["reason_codes"] and "literal_fact" in got[5]["reason_codes"]
    assert spark.range(1).select(graph.path_reasons(F.lit(2), F.lit(False))).first()[0] == ["query_entity", "two_hop_relationship_path", "graph_neighbor"]


def test_extraction(spark):
    assert extraction.reply_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and extraction.reply_json("no") is None and extraction.reply_json('so {"a": {"b": 2}}') == {"a": {"b": 2}}
    assert extraction.facts_of({"triples": [{"subject": "a", "predicate": "b", "object": "c"}, {"subject": "a"}, 3]}) == [("a", "b", "c", "literal")]
    rows = spark.createDataFrame([("c1", ["first", "second"]), ("c2", []), ("c3", None)], "cluster_id string, texts array<string>")
    good = {r["cluster_id"]: r for r in extraction.abstract(rows, lambda: extraction.stub_client, 5).collect()}
    assert good["c1"]["content"] == "About: first" and good["c1"]["valid_from_ms"] == 5 and good["c1"]["error"] is None
    bad = extraction.abstract(rows, lambda: lambda prompt: '{"content": "I am unable to provide assistance"}', 5).collect()
    assert {r["error"] for r in bad} == {"no usable content"}
    pairs = spark.createDataFrame([("1", "2", "x", "y"), ("3", "4", "bad", "y"), ("5", "6", "z", "y")], "a_triple_id string, b_triple_id string, a_fact string, b_fact string")
    judge = lambda: lambda p: "oops" if "bad" in p else '{"contradiction": true, "kind": "odd"}' if "x" in p else '{"contradiction": false}'
    assert [tuple(r) for r in extraction.judge(pairs, judge).collect()] == [("1", "2", "other", "x conflicts with y")]


def test_bookmarks_and_logs(spark):
    tree = {"roots": {"bar": {"name": " Bar ", "children": [{"name": "A", "url": "http://a"}, {"title": "Sub", "children": [{"title": "B", "uri": "http://b"}]}]}}}
    df = spark.createDataFrame([(json.dumps(tree),), ("not json",), (None,)], "json string")
    assert sorted(map(tuple, assets.bookmarks(df).collect())) == [("http://a", "A", "Bar"), ("http://b", "B", "Bar/Sub")]
    line = "\u001b[31mERROR\u001b[0m Bearer abc.def api_key: k1, --token t2 ok"
    assert one(spark, assets.log_line(F.col("v")), v=line) == "ERROR Bearer [redacted] api_key: [redacted], --token [redacted] ok"
    assert one(spark, assets.log_level(F.col("v")), v=line) == "error" and one(spark, assets.log_level(F.col("v")), v="x") == "info"


def test_work_queue(spark, tmp_path):
    """Leases keep drivers apart and run out; what a lost driver finished stays; slow and failing calls are retried up to a limit."""
    import time

    from tidewell.operators import work_queue as q

    path, now = f"file://{tmp_path}/q", [1000.0]
    items = spark.createDataFrame([(f"i{k}", "slow" if k == 3 else "bad" if k == 5 else str(k)) for k in range(10)], "item_id string, payload string")

    def client():
        def ask(p):
            if p == "bad":
                raise ValueError("bad")
            if p == "slow":
                time.sleep(5)
            return p * 2

        return ask

    run = lambda owner, **more: q.work(spark, path, items, client, owner, seconds=0.5, lease_ms=60_000, chunk=4, clock=lambda: now[0], **more)
    assert run("one", most_chunks=1) == 1 and sorted(r[0] for r in q.results(spark, path).collect()) == ["i0", "i1", "i2"]
    held = q.claim(spark, path, items, "one", 1_000_001, 60_000, 4)  # then the driver is lost
    assert sorted(r["item_id"] for r in held.collect()) == ["i4", "i5", "i6", "i7"]
    now[0] += 1
    run("two")
    assert sorted(r[0] for r in q.results(spark, path).collect()) == ["i0", "i1", "i2", "i8", "i9"]
    assert q.claim(spark, path, items, "two", 1_002_000, 60_000, 9).where("item_id between 'i4' and 'i7'").count() == 0
    now[0] += 100
    run("two")
    assert {r[0]: r[1] for r in q.results(spark, path).collect()} == {f"i{k}": str(k) * 2 for k in range(10) if k not in (3, 5)}
    for _ in range(3):
        now[0] += 100
        run("three")
    assert sorted(tuple(r) for r in q.parked(spark, path).collect()) == [("i3", 3, "no answer within 0.5 s"), ("i5", 3, "ValueError: bad")]
    assert run("three") == 0
