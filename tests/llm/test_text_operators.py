"""Line dedup, decontamination, quality rules, suffix arrays, near duplicates: against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import decontamination, line_dedup, near_join, quality, suffix_dedup

LONG = "A line that many documents share, 1"
SPACE = "[\x20\x09-\x0d]"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("keys", T.StringType()), T.StructField("c0", T.StringType())])
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, PASSAGE = prose(120), prose(40)


def near(text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


TEXTS = [
    None, "", "   ", "\n\n", "short", LONG, f"x\n  {LONG}\t\ny", f"{LONG.upper()}\n{LONG}\nrest of it", f"tail\n{LONG}", BASE, BASE, near(BASE, 2), near(BASE, 1), near(BASE, 60), f"{prose(30)} {PASSAGE} {prose(30)}",
    f"{prose(20)} {PASSAGE}", PASSAGE, "ab" * 300, prose(3000), "one two three four", "one two three four", "wörter, Öl; ÄÖÜ " * 20, "a b c d e " * 30, "\x1c\x1d \x85 nbsp\xa0x " + prose(50),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), f"k{i}", "c") for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[10], (None, BASE, None, None, 3, None, None), (None, LONG, "en", None, 3, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def told(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r.asDict())
    return out


def line_key(line):
    key = re.sub(f"^{SPACE}+|{SPACE}+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def test_line_dedup(docs, empty):
    holders = defaultdict(set)
    for i, t in enumerate(TEXTS):
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20:
                holders[line_key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert common
    found = told(line_dedup.dedup_lines(docs, counts=True))
    assert len(found[10]) == 3 and len({r["text"] for r in found[10]}) == 1
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        left = [x for x in lines if common.get(line_key(x), i) == i]
        row = found[i][0]
        assert (row["n_lines"], row["n_dropped"], row["text"] or "") == (len(lines), len(lines) - len(left), "\n".join(left)), i
        assert row["keys"] == f"k{i}" and row["c0"] == "c"
    assert found[0][0]["text"] is None
    assert sorted(r["text"] for r in found[None]) == sorted([BASE, LONG])
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_filter_has_no_false_negative():
    import numpy as np

    places = line_dedup._places(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1 << 22)
    assert places.shape == (2, 1000) and int(places.max()) < 1 << 22
    assert (line_dedup._unpack(line_dedup._pack(np.unique(places))) == np.unique(places)).all()
    assert line_dedup.filter_bits(10**15) == line_dedup.MOST_BITS


def test_decontamination(spark, docs, empty):
    short = "wörter öl"
    bench = spark.createDataFrame([(1, PASSAGE), (2, short), (3, None), (None, BASE), (10, "!!"), (4, PASSAGE), (5, "ab" * 300)], "item_id long, text string")
    found = told(decontamination.occurrences(docs.select("doc_id", "text"), bench))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [("1", words(PASSAGE)), ("2", words(short)), ("4", words(PASSAGE)), ("5", words("ab" * 300))]
    hit_somewhere = 0
    for i, t in enumerate(TEXTS):
        w, hit, names = words(t), set(), set()
        for name, own in items:
            n = min(13, len(own))
            for k in range(len(own) - n + 1):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        names.add(name)
        row = found[i][0]
        assert (row["n_words"], row["n_hit"], row["items"]) == (len(w), len(hit), sorted(names)), i
        hit_somewhere += bool(hit)
    assert hit_somewhere >= 4 and len(found[10]) == 3 and len(found[None]) == 2
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 16 not in {r[0] for r in kept.collect()}
    assert decontamination.occurrences(empty.select("doc_id", "text"), bench).count() == 0
    assert decontamination.occurrences(docs.select("doc_id", "text"), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, BASE), (3, "one two three four")], "item_id long, text string")
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", most=10))
    assert len(blocks) == 3 and sum(map(len, blocks)) == 3
    own = docs.select("doc_id", "text")
    whole = sorted(map(tuple, decontamination.occurrences(own, bench).fillna(-1).collect()))
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a: iter(blocks))
    assert sorted(map(tuple, decontamination.occurrences(own, bench).fillna(-1).collect())) == whole


def test_decontamination_passes_leave_one_table_at_a_time(spark, docs, monkeypatch):
    plans = []
    real = decontamination.keep
    monkeypatch.setattr(decontamination, "keep", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString().count("MapInArrow")) or real(df, name))
    monkeypatch.setattr(decontamination, "MOST_BYTES", 10)
    bench = spark.createDataFrame([(1, PASSAGE), (2, BASE), (3, "one two three four"), (4, "ab")], "item_id long, text string")
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", most=10))
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a: iter(blocks))
    left = decontamination.decontaminate(docs, bench)
    # Each pass reads the texts as they came; the last table has the hits alone.
    assert left.columns == docs.columns and plans == [1, 1, 1, 0]
    assert left.count() < docs.count()


def test_decontamination_hits_beyond_the_broadcast(docs, monkeypatch, spark):
    """What blocks before the last found is joined by digest; nine rows in ten have one text, and some have none."""
    many = spark.range(300).select(F.when(F.col("id") % 10 > 0, F.lit("so " + PASSAGE)).when(F.col("id") % 20 == 0, F.lit(BASE)).alias("text"), F.col("id").alias("doc_id"))
    bench = spark.createDataFrame([(1, PASSAGE), (2, BASE), (3, "one two three four")], "item_id long, text string")
    blocks = list(decontamination.item_blocks(bench, "item_id", "text", most=10))
    want = sorted(map(tuple, decontamination.occurrences(many, bench).collect()))
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a: iter(blocks))
    for bound in (100_000, 0):
        monkeypatch.setattr(decontamination, "MOST_HITS", bound)
        assert sorted(map(tuple, decontamination.occurrences(many, bench).collect())) == want
    searcher = decontamination.searcher_of("a", [("1", [b"x"])], 13)
    assert decontamination.searcher_of("a", [], 13) is searcher and decontamination.searcher_of("b", [], 13) is not searcher


def _largest_share(joined, spark):
    """Largest part of the rows behind a join's shuffle, as a share."""
    sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_and_null_keys_are_spread(spark, monkeypatch):
    """Nine rows in ten share a key, rows equal in all included, or have none: the same result beyond the bound, in many tasks."""
    from tidewell.llm import common

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for hot in (F.lit(1), F.lit(None)):
            left = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 10 > 0, hot).otherwise(F.col("id") % 7).cast("long").alias("k"), F.lit("t").alias("t"))
            right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
            near, far = common.spread_join(left, right, "k", 7, 100), common.spread_join(left, right, "k", 7, 0)
            assert sorted(map(str, near.select("k", "t", "v").collect())) == sorted(map(str, far.select("k", "t", "v").collect()))
            assert _largest_share(far, spark) < 0.3
            few = right.select("k").where("k < 3")
            assert common.spread_anti(left, few, "k", 3, 0).count() == common.spread_anti(left, few, "k", 3, 9).count() == left.where("k is null or k >= 3").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bounds_of_zero_change_nothing(spark, monkeypatch):
    """near_join, line_dedup and quality with every broadcast bound at 0, on rows of which nine in ten are one row or have no id."""
    rows = [(i if i % 10 == 0 else (5 if i % 2 else None), BASE if i % 10 else TEXTS[i // 10 % len(TEXTS)], "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    makers = [lambda: near_join.near_duplicates(docs), lambda: near_join.one_of_each(docs), lambda: line_dedup.dedup_lines(docs), lambda: quality.filter_docs(docs), lambda: quality.assess(docs).drop("key", "distance")]
    want = [sorted(map(str, m().collect())) for m in makers]
    for module, names in ((near_join, ["MOST_IDS"]), (line_dedup, ["MOST_ROWS"]), (quality, ["MOST_REJECTED", "MOST_GROUPS"])):
        for name in names:
            monkeypatch.setattr(module, name, 0)
    assert [sorted(map(str, m().collect())) for m in makers] == want


def test_line_dedup_beyond_the_broadcast(docs, monkeypatch):
    few = sorted(map(repr, line_dedup.dedup_lines(docs, counts=True).collect()))
    monkeypatch.setattr(line_dedup, "MOST_ROWS", 0)
    assert sorted(map(repr, line_dedup.dedup_lines(docs, counts=True).collect())) == few


def brute_stats(text):
    words = re.findall(f"[^{SPACE[1:-1]}]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{SPACE[1:-1]}]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_quality_base(docs, empty):
    found = told(quality.assess(docs))
    for i, t in enumerate(TEXTS):
        r, own = found[i][0], brute_stats(t)
        assert tuple(r[c] for c in quality.STATS[:5]) == own, i
        failed = own[0] < 10 or 100 * own[4] > 20 * own[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert len(found[None]) == 2 and len(found[10]) == 3
    assert quality.assess(empty).count() == 0
    assert quality.filter_docs(docs).columns == docs.columns


def test_quality_rejects_outliers(spark):
    r = random.Random(1)
    clean = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(40, 400))), "en", "a" if i % 3 else "b", 0) for i in range(600)]
    junk = [(1000 + i, " ".join(r.choice(WORDS) + "%%%" for _ in range(100)), "en", "a", 0) for i in range(6)]
    rows = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    found = told(quality.assess(rows))
    assert not any(found[1000 + i][0]["kept"] for i in range(6))
    assert sum(found[i][0]["kept"] for i in range(600)) >= 598
    left = quality.filter_docs(rows)
    assert {x[0] for x in left.select("doc_id").collect()} == {i for i, v in found.items() if v[0]["kept"]}


def brute_verdicts(rows):
    """(kept, distance) by row of (text, lang, source): the estimates in plain numpy, group by group."""
    import math

    import numpy as np

    def fixed(x):
        return math.floor(abs(x) * 1000 + 0.5) * (1 if x >= 0 else -1)

    def vector(text):
        n, chars, symbols, lines, repeated = brute_stats(text)
        total = len([x for x in (text or "").split("\n") if re.search(f"[^{SPACE[1:-1]}]", x)])
        share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1))))
        failed = n < 10 or 100 * repeated > 20 * n
        return failed, [fixed(math.log(max(chars, 1) / max(n, 1))), fixed(share(symbols, chars)), fixed(share(lines, total)), fixed(share(repeated, n)), fixed(math.log1p(n))]

    told = [(*vector(t), lang, source) for t, lang, source in rows]
    floors = np.square(quality.FLOORS)
    factor = quality.consistency(quality.SHARE, 5)
    floored = lambda s: s + np.diag(np.maximum(floors - np.diag(s), quality.RIDGE))

    def distance(x, centre, inverse):
        off = x / 1000 - centre
        return np.einsum("ni,ij,nj->n", off, inverse, off)

    def nearest(x, centre, inverse, share):
        bins = np.floor(np.log2(distance(x, centre, inverse) + 2.0**-10) * 32).astype(int)
        last = next(b for b in np.unique(bins) if (bins <= b).sum() >= len(x) * share)
        return x[bins <= last]

    def moments(x):
        x = x / 1000
        return x.mean(0), (x.T @ x) / len(x) - np.outer(x.mean(0), x.mean(0))

    def middle(values):
        return np.sort(values, 0)[math.ceil(len(values) / 2) - 1]

    def mcd(x):
        coarse = x // 10 * 10
        median = middle(coarse)
        mad = middle(np.abs(coarse - median))
        inverse = np.diag(1 / np.square(np.maximum(1.4826 * mad / 1000, quality.FLOORS)))
        found = []
        for k, share in enumerate((quality.SHARE, 0.5, 1.0)):
            centre, scatter = moments(nearest(x, median / 1000, inverse, share))
            for step in range(quality.STEPS):
                before = np.linalg.slogdet(floored(scatter * factor))[1]
                new = moments(nearest(x, centre, np.linalg.inv(floored(scatter * factor)), quality.SHARE))
                if step and np.linalg.slogdet(floored(new[1] * factor))[1] >= before - quality.GAIN:
                    break
                centre, scatter = new
            found.append((np.linalg.slogdet(floored(scatter * factor))[1], k, centre, scatter * factor))
        return min(found, key=lambda f: f[:2])[2:]

    good = [(np.array(v), lang, source) for failed, v, lang, source in told if not failed]
    every = np.array([v for v, *_ in good])
    top = quality.drawn((len(every), *mcd(every)), (mcd(every)[0], np.diag(floors)))
    by_lang = {g: np.array([v for v, a, _ in good if a == g]) for g in {a for _, a, _ in good}}
    by_lang = {g: quality.drawn((len(x), *mcd(x)), top) for g, x in by_lang.items()}
    groups = {g: np.array([v for v, a, b in good if (a, b) == g]) for g in {(a, b) for _, a, b in good}}
    groups = {g: quality.drawn((len(x), *mcd(x)), by_lang[g[0]]) for g, x in groups.items()}
    out = []
    for failed, v, lang, source in told:
        if (lang, source) not in groups:
            out.append((not failed, None))
            continue
        centre, scatter = groups[lang, source]
        d = float(distance(np.array([v]), centre, np.linalg.inv(floored(scatter)))[0])
        out.append((not failed and d <= quality.CUTOFF, d))
    return out


def test_quality_verdicts_against_numpy(spark):
    r = random.Random(12)
    rows = []
    for i in range(500):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(5, 300)))
        if i % 11 == 0:
            text = " | ".join(r.choice(WORDS) for _ in range(60))
        if i % 13 == 0:
            text = "\n".join([prose(8)] * 2 + [prose(30), prose(30)])
        rows.append((i, text, ["en", "de", None][min(i % 10, 2)] if i < 400 else f"l{i % 40}", "null" if i % 4 == 0 else None if i % 4 == 1 else "a"))
    rows += [(500, None, "en", "a"), (501, "", None, None), (502, "one two", "zz", "alone"), rows[3], rows[3]]
    found = told(quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)))
    expected = brute_verdicts([x[1:] for x in rows])
    assert len(found[3]) == 3 and 20 < sum(not k for k, _ in expected) < 250
    for (i, *_), (kept, d) in zip(rows, expected, strict=True):
        got = found[i][0]
        assert (got["distance"] is None) == (d is None) and (d is None or got["distance"] == pytest.approx(d, rel=1e-6, abs=1e-6)), i
        assert got["kept"] == kept, i


def test_quality_start_from_all_rows_alone_would_be_fooled(spark):
    # A third of the group is junk of one kind: the mean and scatter of all rows take it in, the least determinant doesn't.
    r = random.Random(13)
    clean = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(40, 400))), "en", "a") for i in range(160)]
    junk = [(1000 + i, " ".join(r.choice(WORDS) + "%%%" for _ in range(r.randint(60, 100))), "en", "a") for i in range(36)]
    found = told(quality.assess(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")))
    assert not any(found[i][0]["kept"] for i, *_ in junk) and sum(found[i][0]["kept"] for i, *_ in clean) >= 158


def test_consistency_factor():
    assert quality.chi_squared(11.0705, 5) == pytest.approx(0.95, abs=1e-5) and quality.chi_squared(0, 5) == 0
    assert quality.consistency(0.75, 5) == pytest.approx(1.412, abs=1e-3) and 1 - quality.chi_squared(quality.CUTOFF, 5) == pytest.approx(1.5e-7, rel=0.01)


def test_quality_rejects_menus(spark):
    r = random.Random(2)
    word = lambda: r.choice(WORDS)
    clean = [(i, " ".join(word() for _ in range(r.randint(40, 400))), "en", "a") for i in range(300)]
    menus = [(1000 + i, " | ".join(word() + " " + word() for _ in range(r.randint(40, 200))), "en", "a") for i in range(30)]
    found = told(quality.assess(spark.createDataFrame(clean + menus, "doc_id long, text string, lang string, source string")))
    assert not any(found[i][0]["base_failed"] or found[i][0]["kept"] for i, *_ in menus)
    assert sum(found[i][0]["kept"] for i in range(300)) >= 298


def brute_repeats(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        b = texts[i]
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if seen.setdefault(b[k : k + 100], (i, k)) < (i, k):
                gone[k : k + 100] = b"\1" * 100
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_order():
    import numpy as np

    r = np.random.default_rng(2)
    for n in [*range(1, 40), 200, 301]:
        s = r.integers(1, r.integers(2, 6), n)
        assert suffix_dedup.suffix_order(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_dedup(docs, empty, parts):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(parts)
    expected = brute_repeats({i: (t or "").encode() for i, t in enumerate(TEXTS)})
    found = told(suffix_dedup.remove_repeats(own))
    assert sum(v[1] for v in expected.values()) > 500
    for i, e in expected.items():
        r = found[i][0]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == e, i
        assert hashlib.sha256(r["kept"]).hexdigest() == e[3]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_repeated_rows_and_null_ids(docs):
    found = told(suffix_dedup.remove_repeats(docs, texts=False))
    assert len(found[10]) == 3 and len({r["n_removed"] for r in found[10]}) == 1
    assert len(found[None]) == 2 and max(r["n_removed"] for r in found[None]) == len(BASE.encode())


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_dedup_rows_of_one_id(spark, parts):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(1, a), (2, a), (2, b), (2, None), (3, None), (3, b), (3, c), (3, c), (4, f"{c} {prose(5)}"), (None, a), (None, None), (5, "")]
    found = {}
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect():
        found.setdefault((r["doc_id"], r["n_bytes"]), []).append((r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])))
    n = {x: len(x.encode()) for x in (a, b, c)}
    whole = lambda x: (0, 0, hashlib.sha256(x.encode()).hexdigest(), x.encode())
    none = lambda x: (n[x], 1, hashlib.sha256(b"").hexdigest(), b"")
    assert found[1, n[a]] == [whole(a)] and found[2, n[a]] == [none(a)] and found[2, n[b]] == [whole(b)]
    assert found[3, n[b]] == [none(b)] and found[3, n[c]] == [whole(c)] * 2 and found[None, n[a]] == [none(a)]
    assert found[2, 0] == found[3, 0] == found[None, 0] == found[5, 0] == [whole("")]
    assert sum(map(len, found.values())) == len(rows)
    (lost, spans, *_) = next(v[0] for (i, _), v in found.items() if i == 4)
    assert (lost, spans) == (n[c], 1)


def test_suffix_dedup_beyond_the_broadcast(docs, monkeypatch):
    told_by = lambda: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, texts=False).collect())
    few = told_by()
    monkeypatch.setattr(suffix_dedup, "MOST_COPIES", 0)
    assert told_by() == few


def shingles(text):
    words = re.findall(f"[^{SPACE[1:-1]}]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(texts, threshold=0.8):
    sets = {i: shingles(t) for i, t in texts}
    ids = [i for i, _ in texts]
    links, up = Counter(), {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (top(i), links[i]) for i in ids}


def test_near_join(spark, docs, empty):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    expected = brute_near(list(enumerate(TEXTS)))
    found = told(near_join.near_duplicates(own))
    assert {i: (v[0]["class_id"], v[0]["n_links"]) for i, v in found.items()} == expected
    assert expected[12][0] == 9 and expected[20] == (19, 1)
    everything = told(near_join.near_duplicates(docs))
    assert len(everything[10]) == 3 and [(r["class_id"], r["n_links"]) for r in everything[None]] == [(None, 0)] * 2
    left = near_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r[0] for r in left.collect()} == {c for c, _ in expected.values()} | {None}
    assert near_join.near_duplicates(empty).count() == 0


def test_near_join_large_group(spark):
    r = random.Random(3)
    base = [r.choice(WORDS) + str(i) for i in range(150)]
    texts = []
    for i in range(700):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(150)] = f"new{r.random()}"
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, " ".join(f"w{r.random()}" for _ in range(60))) for i in range(100)]
    found = told(near_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(6)))
    expected = brute_near(texts)
    missed = sum(expected[i] != (found[i][0]["class_id"], found[i][0]["n_links"]) for i in expected)
    assert missed == 0


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8, 0.95])
def test_near_join_thresholds(spark, threshold):
    r = random.Random(8)
    texts = []
    for i in range(120):
        words = [f"w{r.randrange(4000)}" for _ in range(60)]
        texts += [(4 * i, " ".join(words))]
        for k in range(1, 4):
            changed = list(words)
            for _ in range(r.randint(0, 6)):
                changed[r.randrange(60)] = f"n{r.random()}"
            texts.append((4 * i + k, " ".join(changed)))
    found = told(near_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), threshold=threshold))
    expected = brute_near(texts, threshold)
    links = sum(n for _, n in expected.values())
    assert links > 100
    assert all(found[i][0]["n_links"] <= n for i, (_, n) in expected.items())
    assert sum(found[i][0]["n_links"] for i in expected) >= 0.98 * links


def test_near_join_hot_prefix_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "EDGE_BLOCK", 3)
    monkeypatch.setattr(near_join, "BLOCK", 16)
    r = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(80)] = f"n{r.random()}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = told(near_join.near_duplicates(docs))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {i: (v[0]["class_id"], v[0]["n_links"]) for i, v in found.items()} == brute_near(texts)


def test_near_shares_follow_the_threshold():
    assert near_join.near_shares(0.8) == pytest.approx((0.55, 0.45), abs=0.01)
    shares = [near_join.near_shares(t) for t in (0.3, 0.4, 0.6, 0.8, 1.0)]
    assert shares == sorted(shares) and near_join.matched_prefix(0.4) < near_join.matched_prefix(0.8) < near_join.matched_prefix(0.99)


def test_components_of_a_star(spark, monkeypatch):
    from tidewell.llm import common

    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, 501), (501, 502), (None, 3), (7, 7)], "a long, b long")
    few = sorted(map(tuple, common.components(edges, "t").collect()))
    monkeypatch.setattr(common, "MOST_NODES", 0)
    assert sorted(map(tuple, common.components(edges, "t").collect())) == few == [(i, 0) for i in range(200)] + [(i, 500) for i in (500, 501, 502)]


def test_taken_names_are_errors(spark, docs):
    from tidewell.llm import byte_bpe

    clash = docs.select("doc_id", "text", F.lit(1).alias("n_words"), F.lit(1).alias("n_lines"), F.lit(1).alias("ids"))
    for run in (lambda: quality.statistics(clash), lambda: line_dedup.dedup_lines(clash, counts=True), lambda: decontamination.occurrences(clash, docs, carry=["n_words"]), lambda: byte_bpe.encode(clash, "x", "y")):
        with pytest.raises(ValueError, match="exist already"):
            run()
    assert line_dedup.dedup_lines(clash).columns == clash.columns


def test_session_settings_stay(spark, docs, empty):
    """Operators leave the session as it was, and frames give the same whichever runs first."""
    before = dict(spark.conf.getAll)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    makers = [lambda: suffix_dedup.remove_repeats(docs, texts=False), lambda: line_dedup.dedup_lines(docs), lambda: decontamination.decontaminate(docs, bench), lambda: near_join.near_duplicates(docs), lambda: quality.assess(docs)]
    frames = [make() for make in makers]
    assert dict(spark.conf.getAll) == before
    rows = lambda df: sorted(map(repr, df.collect()))
    late = [rows(df) for df in reversed(frames)][::-1]
    assert late == [rows(make()) for make in makers] and dict(spark.conf.getAll) == before


def test_batch_limits_nest_and_end(spark):
    import threading

    from tidewell.llm.common import _LIMIT, batches_of

    limit = lambda: spark.conf.getAll.get(_LIMIT)
    before = limit()
    with batches_of(spark, 7):
        with batches_of(spark, 9):
            assert limit() == "7"
        assert limit() == "7"
    assert limit() == before
    spark.conf.set(_LIMIT, "123")
    try:
        with pytest.raises(RuntimeError), batches_of(spark, 5):
            raise RuntimeError
        assert limit() == "123"
        inside, out = threading.Event(), threading.Event()
        other = threading.Thread(target=lambda: [x.__enter__() or inside.set() or out.wait(10) or x.__exit__(None, None, None) for x in [batches_of(spark, 3)]])
        with batches_of(spark, 5):
            other.start()
            inside.wait(10)
        assert limit() == "5"
        out.set()
        other.join(10)
        assert limit() == "123"
    finally:
        spark.conf.unset(_LIMIT)


def test_shared_folder_is_needed_on_a_cluster():
    from tidewell.llm import common

    class Fake:
        def __init__(self, master, folder):
            self.conf = type("C", (), {"get": staticmethod(lambda *a: folder)})
            self.sparkContext = type("S", (), {"master": master})

    assert common.shared_dir(Fake("yarn", "s3a://x/y/")) == "s3a://x/y" and common.shared_dir(Fake("local[4]", None)).startswith("file:")
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://a"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Fake(master, None))


def test_prefix_meets_recall():
    d = near_join.matched_prefix()
    assert 1 - (1 - 0.8**d) ** near_join.TREES >= near_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_join.TREES
