"""Drifted schemas, license scans and ranked search against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import connect, same
from tidewell.llm import licenses, registry, schema_drift, wand

rng = random.Random(17)


# Drifted schemas


def drifted_file(no, rows):
    """(version, columns, n_nulls, rows as text) that file `no` of client rows must end as, by the contract alone."""
    version = zlib.crc32(f"19:{no}".encode()) % 24
    version = version if version < 16 else 0
    names = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
    start = list(names)
    if version & 1:
        start[4], start[5] = "email", "name"
    if version & 4:
        start = [c for c in start if c not in ("nation_id", "segment")]
    if version & 2:
        start = start[:1] + start[:0:-1]
    lines, nulls = [], 0
    for r in rows:
        r = dict(r)
        if version & 4:
            r["nation_id"], r["segment"] = -1, "none"
        if version & 8 and r["balance"] is not None:
            r["balance"] = float(np.float32(r["balance"]))
        nulls += sum(r[c] is None for c in names)
        if r["updated_at"] is not None:
            at = r["updated_at"] - __import__("datetime").datetime(1970, 1, 1)
            r["updated_at"] = (at.days * 86400 + at.seconds) * 1_000_000 + at.microseconds
        if r["balance"] is not None:
            r["balance"] = math.floor(1048576 * r["balance"])
        lines.append("|".join("?" if r[c] is None else str(r[c]) for c in names))
    return version, start, nulls, lines


def test_drift_query(spark, data):
    rows = pq.read_table(f"{data}/clients.parquet").to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    per = 1 + len(rows) // 250
    found = {r["file_no"]: r for r in registry.op11_drift_rewrite(spark, data).collect()}
    assert sorted(found) == list(range(-(-len(rows) // per)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    seen = set()
    for no, r in found.items():
        own = rows[no * per : (no + 1) * per]
        version, start, nulls, lines = drifted_file(no, own)
        seen.add(version)
        assert (r["version"], r["n_rows"], r["n_nulls"], r["rewritten"]) == (version, len(own), nulls, version > 0)
        assert r["ids_sha256"] == sha(",".join(str(x["client_id"]) for x in own)) and r["rows_sha256"] == sha("\n".join(lines))
        assert r["start_columns"] == ",".join(start) and r["columns"] == ",".join(n for n, _ in registry.CLIENTS.columns)
        schema = pq.read_schema(r["path"].removeprefix("file://"))
        assert schema.equals(registry.CLIENTS.schema) and schema_drift.ids_of(schema) == list(range(1, 11))
    assert len(seen) == 16
    folder = os.path.dirname(found[0]["path"].removeprefix("file://"))
    assert sorted(os.listdir(folder)) == sorted(x for p in (r["path"] for r in found.values()) for x in [os.path.basename(p)])


EVOLVED = schema_drift.Evolved((("a", pa.int64()), ("b", pa.string()), ("c", pa.float64())), {2: "new"})


def write(folder, name, schema, rows):
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema), f"{folder}/{name}", row_group_size=3)


def own_field(name, kind, number):
    return schema_drift.with_id(pa.field(name, kind), number)


def test_rewrite_of_any_drift(spark, tmp_path):
    """Every set of bits, files without rows, files in two folders, stale attempts."""
    want = {}
    for bits in range(16):
        fields = [own_field("a", pa.int32() if bits & 8 else pa.int64(), 1), own_field("b", pa.string(), 2), own_field("c", pa.float32() if bits & 8 else pa.float64(), 3)]
        if bits & 1:
            fields[0], fields[2] = own_field("c", fields[0].type, 1), own_field("a", fields[2].type, 3)
        if bits & 4:
            del fields[1]
        if bits & 2:
            fields = fields[::-1]
        rows = [(i if i % 3 else None, f"t{i}" if i % 4 else None, i / 4 if i % 5 else None) for i in range(bits % 3 * 5)]
        folder = tmp_path / f"d{bits % 2}"
        folder.mkdir(exist_ok=True)
        write(folder, f"f{bits}.parquet", pa.schema(fields), [tuple(r[schema_drift.ids_of(pa.schema([f]))[0] - 1] for f in fields) for r in rows])
        want[f"f{bits}"] = (bits, [(a, "new" if bits & 4 else b, c) for a, b, c in rows])
    before = {n: os.stat(f"{tmp_path}/d0/{n}.parquet").st_mtime_ns for n in ("f0",)}
    files = spark.createDataFrame([(f"file://{tmp_path}/d{b % 2}/f{b}.parquet", b) for b in range(16)], "path string, no int")
    found = schema_drift.rewrite(files, EVOLVED).collect()
    assert len(found) == 16 and os.stat(f"{tmp_path}/d0/f0.parquet").st_mtime_ns == before["f0"]
    for r in found:
        bits, rows = want[f"f{r['no']}"]
        table = pq.read_table(r["path"].removeprefix("file://"))
        assert r["drift"] == bits and table.schema.equals(EVOLVED.schema) and [tuple(x.values()) for x in table.to_pylist()] == rows
    assert all("_rewrite" not in x and ("evolved" in x) == (x != "f0.parquet") for d in ("d0", "d1") for x in os.listdir(tmp_path / d))
    # A second run finds nothing to do.
    again = schema_drift.rewrite(spark.createDataFrame([(r["path"], r["no"]) for r in found], "path string, no int"), EVOLVED)
    assert again.where("rewritten or drift <> 0").count() == 0
    assert schema_drift.rewrite(files.limit(0), EVOLVED).count() == 0


@pytest.mark.parametrize("fields", [[own_field("a", pa.int64(), 1), own_field("x", pa.int64(), 9)], [own_field("a", pa.string(), 1)], [pa.field("a", pa.int64())], [own_field("a", pa.int64(), 1), own_field("b", pa.string(), 1)]])
def test_other_drift_is_an_error(fields):
    with pytest.raises(ValueError, match="field"):
        schema_drift.drift_of(pa.schema(fields), EVOLVED)


def test_a_step_that_is_done_again(tmp_path):
    """Publishing twice, and after another attempt was first, leaves one file."""
    from pyarrow import fs

    system = fs.LocalFileSystem()
    for name in ("x", "y"):
        (tmp_path / name).write_text("rows")
    schema_drift.publish(system, f"{tmp_path}/x", f"{tmp_path}/z")
    schema_drift.publish(system, f"{tmp_path}/y", f"{tmp_path}/z")
    schema_drift.publish(system, f"{tmp_path}/x", f"{tmp_path}/z")
    assert os.listdir(tmp_path) == ["z"]


def test_drifted_files_of_odd_rows(spark):
    """Null and equal ids, rows equal in all, one hot id, other columns of clashing names, no rows."""
    made = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 400).otherwise(F.when(F.col("id") % 2 == 0, 7)).alias("a"), F.lit("t").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(1).alias("rank"), F.lit(2).alias("file_no"))
    files = schema_drift.write_drifted(made, EVOLVED, [F.col("a")], 50, "s", missing=(2,), narrow={1: pa.int32()}, swapped=(1, 2)).orderBy("file_no").collect()
    assert [r["file_no"] for r in files] == list(range(50))
    got = []
    for r in files:
        table = pq.read_table(r["path"].removeprefix("file://"))
        at = schema_drift.ids_of(table.schema).index(1)
        got += table.column(at).to_pylist()
        assert table.num_rows == (61 if r["file_no"] < 49 else 11)
    assert got == sorted((r["a"] for r in made.collect()), key=lambda x: (x is not None, x))
    assert schema_drift.write_drifted(made.limit(0), EVOLVED, [F.col("a")], 50, "s", missing=(2,), narrow={}, swapped=(1, 2)).count() == 0
    ranked, n = schema_drift.ranked(made.select("a"), [F.col("a")])
    assert n == 3000 and sorted(r[0] for r in ranked.select("rank").collect()) == list(range(3000))


# License scans


def scanned(text):
    """Every rule over the whole text, without a prefilter; overlaps compared pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    joined = " ".join(words)
    found = [(joined[: m.start()].count(" "), joined[: m.end()].count(" ") + 1, r) for r in licenses.rules() for m in re.finditer(r.pattern.pattern.decode(), joined)]
    # of base phrases every place counts
    places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in ("gnu general public license", "apache license", "cc by", "mit license")}
    base = sorted(i for x in places.values() for i in x)
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and ((e[1] - e[0]) > (d[1] - d[0]) or e[2].place < d[2].place)
    outer, taken = [d for d in found if not any(inside(d, e) for e in found)], []
    for d in sorted(outer, key=lambda d: (d[2].place, d[0])):
        if not any(d[0] < e[1] and e[0] < d[1] for e in taken):
            taken.append(d)
    taken = [d for d in taken if d[2].label]
    labels = {n for p, n in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items() if places[p]}
    weight = max([licenses.WEIGHTS[d[2].kind] for d in taken] + [0.6] * bool(base), default=0.0)
    return len(words), len(base), base[0] if base else None, base[-1] if base else None, sorted(labels), sorted(labels | {d[2].label for d in taken}), weight, sorted((d[0], d[1], d[2].label) for d in taken)


PHRASES = (
    "gnu general public license", "Apache License", "CC-BY", "CC BY", "MIT License", "licensed under the", "version 2.0", "or any later version", "GNU Lesser General Public License", "Creative Commons Attribution",
    "SPDX-License-Identifier: MIT", "under the terms of the", "BSD-3-Clause", "the", "word", "NC", "SA 4.0", "driver license", "public domain", "permit", "http://www.apache.org/licenses/LICENSE-2.0", "not released under the GPL", "Ünï", "\n", "--",
)


def test_license_scan(spark):
    texts = [None, "", " \n", "cc by cc by", "MIT", "x" * 100, "mit license " * 3000, *(" ".join(rng.choice(PHRASES) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "mit license", "x", 1), (5, texts[5], "x", 1), (5, texts[5], "x", 1)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score int").repartition(3)).collect()
    assert len(found) == len(rows)
    want = {i: scanned(t) for i, t, *_ in rows if i != 6}
    for r in found:
        if r["doc_id"] == 6:
            assert (r["n_base"], r["first_word"], r["last_word"], r["labels"], len(r["detections"])) == (3000, 0, 5998, ["mit"], 3000)
        else:
            got = (*(r[c] for c in licenses.ADDED[:7]), sorted((d["first_word"], d["end_word"], d["label"]) for d in r["detections"]))
            assert got == want[r["doc_id"]], (texts[r["doc_id"] or 0], got, want[r["doc_id"]])
    with pytest.raises(ValueError, match="exist already"):
        licenses.scan(spark.createDataFrame([], "doc_id long, text string, labels string"), carry=["labels"])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in registry.op12_license_scan(spark, data).collect():
        n, base, first, last, own, labels, score, _ = scanned(docs[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, base, first, last, ",".join(own), ",".join(labels), score)


@pytest.mark.parametrize("at", range(0, len(licenses.rules()), 4))
@settings(max_examples=15, deadline=None)
@given(st.data())
def test_prefilter_loses_nothing(at, data):
    """Any match of a rule's expression holds the words that the prefilter asks for."""
    for r in licenses.rules()[at : at + 4]:
        made = data.draw(st.from_regex(r.pattern.pattern.decode().removeprefix("(?<![^ ])").removesuffix("(?![^ ])"), fullmatch=True, alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789 ")))
        assert r.needs <= set(made.encode().split(b" "))


# Ranked search


def ranked(docs, queries, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in queries:
        scores = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w in words(text) if w in b)
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    terms = [f"w{i}" for i in range(300)]
    texts = [" ".join(terms[min(299, int(r.paretovariate(0.6)) - 1)] for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "--- \n"), (n + 3, "W1 w7 " * 2000), (n + 4, "w1"), (n + 5, "W1"), (n + 6, "w1"), (None, "w1"), (3, texts[3]), (3, texts[3]), *((n + 10 + i, "w250 w251 copy") for i in range(70))]


@pytest.mark.parametrize(("shard", "block", "most"), [(1 << 14, 128, 4 << 20), (64, 4, 60), (1, 1, 4 << 20), (100, 8, 1)])
def test_ranked_search(spark, monkeypatch, shard, block, most):
    """Shards, posting blocks and query blocks of any size; null and repeated ids, equal scores, unknown terms."""
    for name, x in (("SHARD_DOCS", shard), ("BLOCK", block), ("MOST_TASKS", 3)):
        monkeypatch.setattr(wand, name, x)
    monkeypatch.setattr(wand.query_blocks, "__defaults__", (most,))
    docs = corpus(900 if shard > 1 else 40, 5)
    queries = [(i, " ".join(f"W{rng.randint(0, 299)}" for _ in range(rng.randint(0, 12)))) for i in range(12)] + [(50, "w1 w1 w1 w7"), (50, "w1 w1 w1 w7"), (None, "w250 copy"), (51, None), (52, "unknown"), (53, "")]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    found = wand.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((tuple(r) for r in found), key=repr) == ranked(docs, queries)


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id string, text string, score int")
    asked = spark.createDataFrame([("a", "x")], "item_id string, text string")
    assert wand.search(none, asked).count() == 0 and wand.search(spark.createDataFrame([("d", "x", 1)], none.schema), asked.limit(0)).count() == 0
    assert [tuple(r) for r in wand.search(spark.createDataFrame([("d", "x", 1)], none.schema), asked).collect()] == ranked([("d", "x")], [("a", "x")])


def test_ranked_search_query(spark, data):
    same(registry.op13_lexical_search(spark, data).toPandas(), connect(data).sql(registry.oracle_sql()["op13_lexical_search"]).df())


def test_codec():
    for _ in range(50):
        values = np.array([rng.randrange(1 << rng.randint(1, 34)) for _ in range(rng.randint(1, 300))])
        raw, sizes = wand.pack(values)
        assert sizes.sum() == len(raw) and (wand.unpack(raw) == values).all()


def test_blocks_stay_shut():
    """With a threshold many blocks are never decompressed, and the result is that of all of them."""
    r = np.random.default_rng(4)
    size, posts = 16000, {}
    paces = wand.pace(r.integers(20, 400, size), size, 200 * size)
    docs_of = {0: 9000, 1: 5000, 2: 2500, 3: 900, 4: 300, 5: 80}
    exact = np.zeros(size, np.int64)
    for t, n in docs_of.items():
        docs, tf = np.sort(r.choice(size, n, replace=False)), r.geometric(0.6, n)
        step = np.diff(docs, prepend=-1)
        raw, sizes = wand.pack(np.stack([step, tf], 1).ravel())
        first = np.arange(0, n, wand.BLOCK)
        gained = wand.impacts(tf, paces[docs])
        posts[t] = (wand.Postings(n, docs[np.append(first[1:], n) - 1], np.maximum.reduceat(gained, first), np.add.reduceat(sizes, 2 * first), raw.tobytes()), wand.weight(size, n))
        exact[docs] += posts[t][1] * gained
    order = np.lexsort((np.arange(size), -exact))[:20]
    docs, scores = wand.best_of(list(posts.values()), paces, 20, int(exact[order[-1]]))
    assert docs.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    opened, blocks = (sum(f(p) for p, _ in posts.values()) for f in (lambda p: int(p.opened.sum()), lambda p: len(p.opened)))
    assert opened < blocks * 2 / 3
    assert wand.best_of(list(posts.values()), paces, 20, int(exact.max()) * 9)[0].size == 0
