"""Streams: keys once, triggers by tenant, clusters as rows come, restarts."""

import os
import random
import shutil
import time

import pytest

from tidewell.operators import cluster
from tidewell.streaming import batches

DAY = 86_400_000


def put(rows, folder, name):
    """One more file of a source's folder, whole at once."""
    rows.coalesce(1).write.parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(x for x in os.listdir(f"{folder}-{name}") if x.startswith("part"))
    shutil.copy(f"{folder}-{name}/{part}", f"{folder}/.{name}")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def source(spark, folder, schema):
    return batches.episodes_stream(spark, str(folder), schema)


def test_daily_counts(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet")
    assert batches.daily_counts(batches.episodes_stream(spark, data, rows.schema)).isStreaming


@pytest.mark.parametrize("time_col", [None, "ts_ms"])
def test_keys_are_appended_once(spark, tmp_path, time_col):
    """Files bring rows of those before again, also after a restart, and after earlier output is gone: no batch reads it."""
    rows = spark.createDataFrame([(i, 1_700_000_000_000 + i * 1000, "x") for i in range(40)], "entry_id long, ts_ms long, kind string")
    run = lambda: batches.replay(source(spark, tmp_path / "in", rows.schema), str(tmp_path / "out"), str(tmp_path / "c"), time_col).awaitTermination(120)
    for k in range(3):
        put(rows.where(f"entry_id between {k * 10 - 5} and {k * 10 + 9}").unionByName(rows.where(f"entry_id = {k * 10}")), tmp_path / "in", f"f{k}")
    run()
    got = lambda: sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("entry_id").collect())
    assert got() == list(range(30))
    for name in os.listdir(tmp_path / "out"):
        shutil.rmtree(tmp_path / "out" / name)
    put(rows.where("entry_id between 0 and 34"), tmp_path / "in", "f3")
    run()
    assert got() == list(range(30, 35))
    run()  # nothing new
    assert got() == list(range(30, 35))


def test_late_keys_and_null_times(spark, tmp_path):
    """A key is remembered within the horizon; a row older than it is left out; a null time is the present."""
    kind = "entry_id long, ts_ms long"
    now = int(time.time() * 1000)
    run = lambda: batches.append_batches(source(spark, tmp_path / "in", kind), str(tmp_path / "out"), str(tmp_path / "c"), ["entry_id"], None, "ts_ms", "1 day").awaitTermination(120)
    for k, rows in enumerate([[(1, now), (2, None)], [(3, now - 9 * DAY), (2, None), (1, now - DAY // 2)], [(4, now)]]):
        put(spark.createDataFrame(rows, kind), tmp_path / "in", f"f{k}")
        run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("entry_id").collect()) == [1, 2, 4]


def test_audit_rows_and_signals(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(30)], "event_id long, tenant_id string")
    put(rows, tmp_path / "in", "f0")
    put(rows.where("event_id < 20"), tmp_path / "in", "f1")
    stream = lambda: source(spark, tmp_path / "in", rows.schema)
    q = batches.audit_writer(stream(), str(tmp_path / "aud"), str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "aud")).count() == 30
    batches.broadcast_invalidations(stream(), str(tmp_path / "sig"), str(tmp_path / "c2"), "episode", clock=lambda: 2.0).awaitTermination(120)
    assert sorted((r["tenant_id"], r["ts_ms"]) for r in spark.read.parquet(str(tmp_path / "sig")).collect()) == [("x", 2000)] * 2 + [("y", 2000)] * 2
    q = batches.periodic(stream(), str(tmp_path / "c3"), lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/p/batch_id={i}"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50


def test_triggers_by_tenant(spark, tmp_path):
    """By rows, by time without new rows, each tenant on its own, with a restart between; null tenants are one."""
    kind, told = "tenant_id string, x long", []
    rows = lambda **n: spark.createDataFrame([(t or None, i) for t, k in n.items() for i in range(k)], kind)

    def start():
        return batches.run_due(source(spark, tmp_path / "in", kind), str(tmp_path / "c"), lambda due, i: told.extend((r["tenant_id"], r["n"], r["cause"]) for r in due.collect()), rows=10, seconds=12, every="200 milliseconds")

    def wait(q, n):  # timers make batches for ever, so there is no end to wait for
        end = time.time() + 60
        while len(told) < n and time.time() < end:
            assert q.exception() is None
            time.sleep(0.2)
        time.sleep(1)
        q.stop()

    put(rows(a=7, b=12, c=1), tmp_path / "in", "f0")
    wait(start(), 1)
    assert told == [("b", 12, "rows")]
    put(rows(a=4, b=3), tmp_path / "in", "f1")
    wait(start(), 4)  # counters go on
    assert sorted(told[1:]) == [("a", 11, "rows"), ("b", 3, "time"), ("c", 1, "time")]


def planted(seed, n=90):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i, r.randrange(3) * DAY + r.randrange(DAY), [float(x + r.gauss(0, 0.35)) for x in c]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("cuts", [(90,), (1, 40, 49), (30, 30, 30)])
def test_incremental_clusters_equal_a_full_run(spark, tmp_path, cuts):
    """Any split of the rows into batches, components that join later and ones over the largest size included."""
    kind, rows, at = "id long, ts_ms long, embedding array<float>", planted(4), 0
    for k, n in enumerate(cuts):
        put(spark.createDataFrame(rows[at : at + n], kind), tmp_path / "in", f"f{k}")
        at += n
    batches.incremental_clusters(source(spark, tmp_path / "in", kind), str(tmp_path / "state"), str(tmp_path / "c"), 0.8, 2, 5).awaitTermination(300)
    got = sorted((r["cluster_id"], r["id"]) for r in batches.current_members(spark, str(tmp_path / "state")).collect())
    assert got == sorted(map(tuple, cluster.cluster_days(spark.createDataFrame(rows, kind), 0.8, 2, 5).collect())) and len(got) > 40


def test_a_batch_reads_its_own_days(spark, tmp_path):
    """Damaged folders of other days don't matter: they are not read; a replay of a batch changes nothing."""
    kind = "id long, ts_ms long, embedding array<float>"
    put(spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, DAY, [1.0, 0.0])], kind), tmp_path / "in", "f0")
    run = lambda: batches.incremental_clusters(source(spark, tmp_path / "in", kind), str(tmp_path / "state"), str(tmp_path / "c"), 0.7).awaitTermination(120)
    run()
    for name in ("rows", "labels"):
        folder = tmp_path / "state" / name / "day=0"
        for d in os.listdir(folder):
            for x in os.listdir(folder / d):
                (folder / d / x).write_bytes(b"damaged")
    put(spark.createDataFrame([(3, DAY + 5, [0.9, 0.1])], kind), tmp_path / "in", "f1")
    run()
    members = lambda: sorted(tuple(r) for r in batches.current_members(spark, str(tmp_path / "state")).collect())
    assert members() == [(2, 2, 1), (2, 3, 1)]
    for name in ("1", ".1.crc"):  # as if it had died before it committed
        os.remove(tmp_path / "c" / "commits" / name)
    run()
    assert members() == [(2, 2, 1), (2, 3, 1)] and spark.read.parquet(str(tmp_path / "state" / "rows" / "day=1")).count() == 2


def test_pairs_of_new_rows_only(spark):
    rows = spark.createDataFrame([(i, t // DAY, e) for i, t, e in planted(9)], "id long, day long, embedding array<float>")
    every = {tuple(r) for r in cluster.similar_pairs(rows, 0.8).collect()}
    found = cluster.similar_pairs(rows.where("id % 3 = 0"), 0.8, rows.where("id % 3 <> 0")).collect()
    assert sorted(map(tuple, found)) == sorted(p for p in every if p[0] % 3 == 0 or p[1] % 3 == 0) and len(found) > 20


def test_components_beyond_the_broadcast(spark, monkeypatch):
    """A star whose hub has nine tenths of the edges, and a chain: the same labels when nothing is broadcast."""
    pairs = spark.createDataFrame([(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2030)], "a long, b long")
    want = sorted(map(tuple, cluster.components(pairs).collect()))
    monkeypatch.setattr(cluster, "MOST_NODES", 0)
    assert sorted(map(tuple, cluster.components(pairs).collect())) == want
    assert {c for _, c in want} == {0, 2000} and len(want) == 332
