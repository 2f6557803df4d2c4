"""Saved indexes: deltas, tombstones, crashes, compaction; recall and cost of the vector index."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import facts, knn, lexical, trigrams, vector_index
from tidewell.plans import registry
from tidewell.sources.segments import Store

rng = random.Random(3)


def answers(rows):
    return [tuple(r) for r in rows.collect()]


def texts(spark, held):
    return spark.createDataFrame(sorted(held.items()), "id long, text string")


def test_deltas_equal_a_full_rebuild(spark, tmp_path):
    """Inserts, changes and deletions in turn; after each the index answers as one built anew; so does its compaction."""
    path, held = f"file://{tmp_path}/i", {i: " ".join(rng.choices(("cat", "dog", "bird", "fish", "a"), k=rng.randint(0, 9))) for i in range(60)}
    lexical.save_index(texts(spark, held), path, "id", "text", buckets=4)
    for step in range(3):
        changed = {i: " ".join(rng.choices(("cat", "dog", "ant"), k=rng.randint(0, 6))) for i in rng.sample(range(80), 12)}
        gone = [i for i in rng.sample(range(80), 6) if i not in changed]
        lexical.update_index(spark, path, texts(spark, changed), spark.createDataFrame([(i,) for i in gone], "id long"), "id", "text")
        held = {i: t for i, t in (held | changed).items() if i not in gone}
        for query in ("cat", "cat dog bird", "ant"):
            assert answers(lexical.search_index(spark, path, query, 100)) == answers(lexical.best(texts(spark, held), query, "id", "text", 100))
        assert sorted(r[0] for r in lexical.indexed_ids(spark, path).collect()) == sorted(held)
    before = answers(lexical.search_index(spark, path, "cat dog", 100))
    lexical.compact_index(spark, path)
    store = Store(spark, path)
    assert answers(lexical.search_index(spark, path, "cat dog", 100)) == before and store.latest()["n_dead"] == 0 and len(store.versions()) == 5
    store.vacuum(1)
    assert answers(lexical.search_index(spark, path, "cat dog", 100)) == before and len(store.versions()) == 1


def test_a_write_that_is_killed_leaves_the_old_answer(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    lexical.save_index(texts(spark, {1: "cat", 2: "dog cat"}), path, "id", "text", buckets=2)
    old = answers(lexical.search_index(spark, path, "cat", 9))

    def killed(self, manifest, before):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            lexical.update_index(spark, path, texts(spark, {3: "cat cat"}), texts(spark, {1: ""}).select("id"), "id", "text")
    assert answers(lexical.search_index(spark, path, "cat", 9)) == old
    lexical.update_index(spark, path, texts(spark, {3: "cat cat"}), texts(spark, {1: ""}).select("id"), "id", "text")
    assert {r[0] for r in answers(lexical.search_index(spark, path, "cat", 9))} == {2, 3}
    # A damaged newest version: the one before is in force.
    store = Store(spark, path)
    held = store.latest()["segments"]["postings"][-1]
    (tmp_path / "i" / held / "_SUCCESS").unlink()
    assert answers(lexical.search_index(spark, path, "cat", 9)) == old
    (tmp_path / "i" / "manifests" / "v000000003.json").write_text('{"half')
    assert store.latest()["version"] == 1
    # Two writers: the second one gets an error.
    with pytest.raises(RuntimeError):
        store.publish(store.read(1), {"version": 99})


def test_outbox_applies_once(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    lexical.save_index(texts(spark, {1: "cat", 2: "cat dog"}), path, "id", "text", buckets=2)
    now = texts(spark, {1: "cat cat", 3: "cat"})
    outbox = spark.createDataFrame([(1, "upsert", 1), (2, "delete", 2), (3, "upsert", 3), (4, "delete", 3), (5, "upsert", 3), (6, "upsert", 7)], "entry_id long, op string, id long")
    assert lexical.replay_outbox(spark, path, outbox, now, "id", "text") == 4
    want = answers(lexical.best(now, "cat", "id", "text", 9))
    assert answers(lexical.search_index(spark, path, "cat", 9)) == want
    version = Store(spark, path).latest()["version"]
    assert lexical.replay_outbox(spark, path, outbox, now, "id", "text") == 0 and Store(spark, path).latest()["version"] == version
    assert lexical.replay_outbox(spark, path, outbox.limit(0), now, "id", "text") == 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """200,000 vectors of 32 dimensions around 2000 centres; a twentieth are copies of one."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((2000, 32))
    v = (centres[r.integers(0, 2000, 200_000)] + 0.35 * r.standard_normal((200_000, 32))).astype(np.float32)
    v[np.arange(0, 200_000, 20) + 7] = v[7]
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("planted")
    pq.write_table(pa.table({"vec_id": np.arange(200_000), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 32).cast(pa.list_(pa.float32()))}), f"{at}/v.parquet", row_group_size=20_000)
    rows = spark.read.parquet(f"file://{at}/v.parquet")
    path = f"file://{at}/index"
    return rows, path, vector_index.build(rows, path)


def recall(rows, path, queries, k=10):
    """Share of the exact neighbours found; one as near as the k-th counts as it."""
    exact, got = {}, {}
    for r in knn.nearest_each(rows, queries, k).collect():
        exact.setdefault(r["query_id"], []).append(r["distance"])
    for r in vector_index.search(path, queries, k).collect():
        got.setdefault(r["query_id"], []).append(r["distance"])
    return np.mean([sum(x <= max(d) for x in got.get(q, [])) / len(d) for q, d in exact.items()])


def test_index_reads_little_and_finds_nearly_all(planted):
    rows, path, manifest = planted
    queries = rows.where("vec_id % 50 = 0")
    told = vector_index.cost(path, queries, 10).first()
    assert manifest["n"] == 200_000 and manifest["recall"] >= 0.95
    assert told["codes"] <= 0.1 * 200_000 and told["vectors"] <= 0.01 * 200_000
    assert recall(rows, path, queries.where("vec_id % 1000 = 0")) >= 0.9
    found = vector_index.search(path, queries, 10)
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0 and found.where("query_id = neighbour_id").count() == 0


def test_index_only_reads_the_probed_lists(planted):
    rows, path, manifest = planted
    store = Store(rows.sparkSession, path)
    plan = store.table(manifest, "lists").where(F.col("list").isin([1, 2])).select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "vector" not in plan.split("ReadSchema")[1]


def test_recall_of_the_registered_search(spark, data):
    """Vectors without structure: the measured setting keeps the recall."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    exact = {}
    for r in knn.nearest_each(rows, rows.where("vec_id % 50 = 0"), 10).collect():
        exact.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    got = {}
    for r in registry.queries()["v3_approximate_knn"](spark, data).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    assert np.mean([len(got[q] & x) / len(x) for q, x in exact.items()]) >= 0.9
    told = registry.queries()["v3_search_cost"](spark, data).first()
    assert told["vectors"] < told["n"] / 4


def test_tombstones_and_changes(spark, tmp_path):
    """Rows that are gone are never found, changed ones under their new vector only, and k neighbours still come back."""
    r = np.random.default_rng(2)
    v = r.standard_normal((600, 8))
    make = lambda ids, m: spark.createDataFrame([(int(i), [float(x) for x in m[i]]) for i in ids], "vec_id long, embedding array<float>")
    path = f"file://{tmp_path}/v"
    rows = make(range(600), v)
    vector_index.build(rows, path, lists=8)
    one = rows.where("vec_id = 5")
    near = [x["neighbour_id"] for x in vector_index.search(path, one, 10).orderBy("rank").collect()]
    w = v.copy()
    w[near[5]] = -v[5]
    vector_index.update(spark, path, make([near[5]], w), spark.createDataFrame([(i,) for i in near[:5]], "vec_id long"))
    live = [i for i in range(600) if i not in near[:5]]
    for _ in range(2):
        found = vector_index.search(path, one, 10).orderBy("rank").collect()
        assert len(found) == 10 and not set(near[:6]) & {x["neighbour_id"] for x in found}
        assert recall(make(live, w), path, make(live[:40], w)) >= 0.9
        assert sorted(x[0] for x in vector_index.indexed_ids(spark, path).collect()) == live
        vector_index.compact(spark, path)
    vector_index.update(spark, path, make([near[0]], v), spark.createDataFrame([], "vec_id long"))  # it comes back
    assert near[0] in [x["neighbour_id"] for x in vector_index.search(path, one, 10).collect()]
    assert (vector_index.widened(10), vector_index.widened(100), vector_index.width_for(1), vector_index.width_for(10), vector_index.width_for(90)) == (20, 132, 16, 40, 200)


def test_index_of_odd_rows(spark, tmp_path):
    """No rows; one row; only copies, spread over slices; vectors without direction; nulls."""
    kind = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], kind)
    vector_index.build(none, f"file://{tmp_path}/none")
    assert vector_index.search(f"file://{tmp_path}/none", none, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0])], kind)
    vector_index.build(some, f"file://{tmp_path}/one")
    assert vector_index.search(f"file://{tmp_path}/one", some, 3).count() == 0
    assert [x["neighbour_id"] for x in vector_index.search(f"file://{tmp_path}/one", spark.createDataFrame([(9, [0.0, 0.0])], kind), 3).collect()] == [1]


def test_a_hot_list_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 200)
    monkeypatch.setattr(vector_index, "SLICE_QUERIES", 16)
    r = np.random.default_rng(5)
    v = r.standard_normal((3000, 6)).astype(np.float32)
    v[:2000] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    manifest = vector_index.build(rows, f"file://{tmp_path}/hot", lists=16)
    assert max(manifest["slices"].values()) >= 8
    found = vector_index.search(f"file://{tmp_path}/hot", rows.where("vec_id % 50 = 0"), 10)
    assert found.count() == 600 and found.where("query_id < 2000 and distance > 0.000001").count() == 0


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    """Ids of any length and case, wildcards, queries with and without trigrams, prefixes; only the query's trigrams are read."""
    ids = ["", "a", "ab", "Abc", "abcabc", "customer-1", "Customer-12", "xcustomer-1", "part_1", "part%2", "é-übc", *("".join(rng.choices("abcAB-1", k=rng.randint(1, 9))) for _ in range(150))]
    rows = [(f"t{k}", i, "p" if k % 2 else "q", rng.choice(ids), rng.choice(["entity", "literal"]), "active" if k % 9 else "superseded") for k, i in enumerate(ids * 2)]
    made = spark.createDataFrame(rows, "triple_id string, subject_id string, predicate string, object_id string, object_kind string, status string")
    path = f"file://{tmp_path}/t"
    trigrams.build(trigrams.summaries(made), path, buckets=5)
    for q in ("abc", "customer-1", " CUSTOMER", "a_c", "ab%bc", "b", "", "%", "zzz", "-1", "c-1", "übc", "art_1", "abcabcabc"):
        assert answers(trigrams.search(spark, path, q, 100).select("entity_id", "subject_count", "fact_count", "predicates", "match_score")) == answers(facts.entities(made, q, 100).select("entity_id", "subject_count", "fact_count", "predicates", "match_score")), q
    live = {r["entity_id"] for r in trigrams.summaries(made).collect()}
    for p in ("ab", "Cust", "c", "", "part_", "part%2x"):
        assert {r["entity_id"] for r in trigrams.with_prefix(spark, path, p).collect()} == {i for i in live if i.startswith(p)}
    store = Store(spark, path)
    plan = trigrams._candidates(store, store.latest(), trigrams.grams("customer-1"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") and "In(gram" in plan
    assert trigrams.grams("ab%cde_fghi") == ["cde", "fgh", "ghi"]


def test_stemmed_search_stems_distinct_words_that_begin_like_a_term(spark, monkeypatch):
    """a word that stands a thousand times is stemmed once or not at all; stems begin like their words."""
    from tidewell.functions import stemmer

    called = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(words: pd.Series) -> pd.Series:
        called.add(len(words))
        return words.map(stemmer.stem)

    monkeypatch.setattr(lexical, "stem_udf", counted)
    docs = texts(spark, {i: "licensing a licensed cat and licenses " * 50 for i in range(20)} | {20: None, 21: "", 22: "Versions"})
    found = answers(lexical.best(docs, "licenses version", "id", "text", 50, stemmed=True))
    assert [r[0] for r in found] == [22, *range(20)] and called.value == 4
    plain = {i: " ".join(stemmer.stem(w) for w in (t or "").lower().split()) for i, t in docs.collect()}
    assert found == answers(lexical.best(texts(spark, plain), "licens version", "id", "text", 50))
    ends = ["ational", "ization", "biliti", "iveness", "icate", "ful", "ement", "ion", "ies", "sses", "eed", "ing", "ed", "ably", "y", "e", "ll"]
    made = {"".join(rng.choices("abceioylstz", k=rng.randint(0, 5))) + "".join(rng.choices(ends, k=rng.randint(0, 3))) for _ in range(5000)}
    assert all(w.startswith(stemmer.stem(w)[:-2]) for w in made)


def test_postings_travel_as_lists(spark, tmp_path, monkeypatch):
    """F4 F6 F7 F8 F14: a row a term and block, not one a word; blocks of any size, odd texts, and deltas without texts."""
    path, held = f"file://{tmp_path}/i", {i: "cat dog cat" for i in range(400)} | {400: None, 401: "", 402: "Été--cat"}
    lexical.save_index(texts(spark, held), path, "id", "text", buckets=4)
    store = Store(spark, path)
    rows = store.table(store.latest(), "postings").where("term is not null")
    assert rows.count() <= 3 * 4 and rows.selectExpr("sum(size(ids))").first()[0] == 802
    none = texts(spark, {0: ""}).limit(0)
    for _ in range(2):
        lexical.update_index(spark, path, none, texts(spark, {i: "" for i in range(200)}).select("id"), "id", "text")
        left = texts(spark, {i: t for i, t in held.items() if i >= 200})
        assert answers(lexical.search_index(spark, path, "cat ete", 300)) == answers(lexical.best(left, "cat ete", "id", "text", 300))
        assert lexical.indexed_ids(spark, path).count() == 203
        monkeypatch.setattr(lexical, "MOST_DEAD", 0)
        lexical.compact_index(spark, path)
    made = {i: rng.choices(("a", "bc", "d", "éa"), k=rng.randint(0, 9)) for i in range(30)} | {7: None}
    batch = pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array(list(made.values()), pa.list_(pa.string()))], ["id", "w"])
    want = sorted((t, i, w.count(t), len(w)) for i, w in made.items() if w for t in set(w))
    for most in (1, 7, 1000):
        monkeypatch.setattr(lexical, "BLOCK_WORDS", most)
        found = [r for b in lexical.block_rows(False, iter([batch[3:], batch[:3]])) for r in b.to_pylist()]
        assert sorted((r["term"], *x) for r in found if r["term"] is not None for x in zip(r["ids"], r["tfs"], r["sizes"], strict=True)) == want
        assert sorted(x for r in found if r["term"] is None for x in zip(r["ids"], r["sizes"], strict=True)) == sorted((i, len(w or [])) for i, w in made.items())


def test_trigrams_travel_as_lists(spark, tmp_path):
    """F16 F17 F19: a row a trigram and block of ids, not one an id; summaries count before they list predicates; ids too short for a trigram alone."""
    rows = [(f"t{k}", f"abc{k % 50}", ("q", "p", None)[k % 3], "xyz", "entity", "active") for k in range(300)]
    made = spark.createDataFrame(rows, "triple_id string, subject_id string, predicate string, object_id string, object_kind string, status string")
    path = f"file://{tmp_path}/t"
    trigrams.build(trigrams.summaries(made), path, buckets=3)
    store = Store(spark, path)
    held = store.table(store.latest(), "grams")
    assert held.where("gram = 'abc'").count() <= 4 and held.where("gram = 'abc'").selectExpr("sum(size(ids))").first()[0] == 50
    for q in ("abc1", "xyz", "bc", "c4%"):
        assert answers(trigrams.search(spark, path, q, 100).select("entity_id", "subject_count", "object_count", "fact_count", "predicates", "match_score")) == answers(facts.entities(made, q, 100).select("entity_id", "subject_count", "object_count", "fact_count", "predicates", "match_score"))
    short = made.limit(1).withColumn("subject_id", F.lit("a")).withColumn("object_kind", F.lit("literal"))
    trigrams.build(trigrams.summaries(short), f"{path}2", buckets=3)
    assert trigrams.search(spark, f"{path}2", "abc").count() == 0 and trigrams.search(spark, f"{path}2", "a").count() == 1
