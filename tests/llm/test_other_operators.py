"""Language model, pseudonyms, chat, WARC, BPE, and the pipeline: brute force, round trips, held-out likelihood."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, chat, hmm, pii, warc

rng = random.Random(11)
LANGS = [[f"{p}{i}" for i in range(60)] for p in ("a", "b", "c")]


def told(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def test_hmm_scores(spark):
    texts = {i: " ".join(rng.choice(LANGS[i % 3]) for _ in range(rng.randint(0, 80))) for i in range(400)}
    texts[400], texts[401], texts[402] = None, "", "NEVER seen BEFORE words"
    rows = [(i, t, "x", "y") for i, t in texts.items()] + [(None, "a1 a2", "x", "y"), (7, texts[7], "x", "y")]
    found = told(hmm.score(spark.createDataFrame(rows, "doc_id long, text string, base string, score string").repartition(3), steps=6), "doc_id")
    seen = Counter()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    for i, t, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            seen.update(tokens(t))
    n, v = sum(seen.values()), len(seen)
    held = [0.0, 0.0]
    for i, t in texts.items():
        w, r = tokens(t), found[i][0]
        base = sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["score"] < 0
        if r["held_out"]:
            held[0] += base
            held[1] += r["score"]
    assert held[1] > held[0]
    assert len(found[7]) == 2 and found[None][0]["held_out"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(empty).count() == 0


def dense_scores(texts, states, steps, buckets):
    """log10 likelihoods by a plain Baum-Welch over one dense table, in double precision throughout."""
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    own = {i: tokens(t) for i, t in texts.items()}
    train = {i: w for i, w in own.items() if zlib.crc32(str(i).encode()) % 10}
    seen = Counter(w for x in train.values() for w in x)
    split = {}
    for b in range(buckets):
        words = sorted({w for x in own.values() for w in x if zlib.crc32(w.encode()) % buckets == b})
        split |= dict(zip(words, hmm._first_split(b, len(words), states).astype(float), strict=True))
    ends, n, v = len(train), sum(seen.values()) + len(train), len(seen) + 1
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1))
    end, mass = np.full(states, (ends + 0.1) / states), np.full(states, (n + 0.1 * (v + 1)) / states)
    emit = lambda w: end / mass if w is None else split[w] / split[w].sum() * (seen[w] + 0.1) / mass

    def forward(words):
        rows, logs, ahead = [], 0.0, start
        for w in [*words, None]:
            now = ahead * emit(w)
            logs += math.log10(now.sum())
            rows.append(now / now.sum())
            ahead = rows[-1] @ move
        return rows, logs

    for _ in range(steps):
        first, moves, emitted, at_end = np.zeros(states), np.zeros((states, states)), {w: np.zeros(states) for w in seen}, np.zeros(states)
        for words in train.values():
            alpha, _ = forward(words)
            e = [emit(w) for w in [*words, None]]
            beta = np.ones(states)
            for t in range(len(e) - 1, -1, -1):
                gamma = alpha[t] * beta
                gamma /= gamma.sum()
                if t == len(e) - 1:
                    at_end += gamma
                else:
                    emitted[words[t]] += gamma
                if t == 0:
                    first += gamma
                else:
                    xi = alpha[t - 1][:, None] * move * (e[t] * beta)[None, :]
                    moves += xi / xi.sum()
                    beta = move @ (e[t] * beta)
                    beta /= beta.sum()
        every = sum(emitted.values()) + at_end
        start = (first + 0.1) / (first.sum() + 0.1 * states)
        move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
        share = (every + 0.1) / (every.sum() + 0.1 * states)
        split = {w: (emitted.get(w, 0) + hmm.SHRINK * share) / (seen[w] + hmm.SHRINK) for w in split}
        end = (ends + 0.1) * (at_end + hmm.SHRINK * share) / (ends + hmm.SHRINK)
        mass = sum((seen[w] + 0.1) * split[w] / split[w].sum() for w in seen) + end + 0.1 * share
    return {i: forward(w)[1] for i, w in own.items()}


def test_hmm_training_equals_a_dense_one(spark, monkeypatch):
    """A whole small training: in one block, in many, and by groups of blocks, where no task holds rows of more than a few."""
    texts = {i: " ".join(["all", *(rng.choice(LANGS[i % 3]) for _ in range(rng.randint(0, 30)))]) for i in range(120)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = dense_scores(texts, 3, 3, 12)
    most, real = [], hmm._batch
    for block_bytes, group in ((16 << 20, 256), (400, 256), (400, 4)):
        monkeypatch.setattr(hmm, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(hmm, "GROUP_BLOCKS", group)
        got = {r["doc_id"]: r["score"] for r in hmm.score(docs.repartition(2), states=3, steps=3).collect()}
        assert max(abs(got[i] / want[i] - 1) for i in want) < 0.01
        most.append(got)
    assert real is hmm._batch and max(abs(most[1][i] / most[2][i] - 1) for i in want) < 0.003


def test_hmm_groups_bound_what_a_task_holds(spark, monkeypatch):
    """A word of every block: rows of its bucket stay within a group's blocks a task, over how many there ever are."""
    rows = [(b, 0, zlib.compress(f"all\nw{b}".encode(), 1), np.array([2, 1], np.int32).tobytes()) for b in range(200)]
    sent = spark.createDataFrame(rows, "block long, bucket int, words binary, counts binary")
    own = sent.select("block", "bucket", hmm._grouped(40), "words", "counts")
    assert own.groupBy("bucket", "grp").count().agg(F.max("count")).first()[0] <= 20
    near, far = (sorted((r["block"], np.frombuffer(zlib.decompress(r["counts"]), np.int64).tolist(), np.frombuffer(zlib.decompress(r["places"]), np.int32).tolist(), bytes(r["split"])) for r in hmm.answers(sent, 3, g).where("block is not null").collect()) for g in (1, 40))
    assert near == far and near[5][1][0] == 400
    assert {hmm.answers(sent, 3, g).agg(F.sum("distinct")).first()[0] for g in (1, 40)} == {201}


def test_hmm_recursions_agree_with_enumeration():
    import itertools

    r = np.random.default_rng(3)
    start, move, emit = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T
    seqs = [r.integers(0, 5, n) for n in (1, 4, 6)]
    lengths = np.array([len(s) for s in seqs])
    got = hmm.likelihoods(np.concatenate(seqs), lengths, start, move, emit)
    for s, g in zip(seqs, got, strict=True):
        total = sum(start[p[0]] * emit[s[0], p[0]] * math.prod(move[p[i - 1], p[i]] * emit[s[i], p[i]] for i in range(1, len(s))) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(g, math.log10(total), rel_tol=1e-9)
    # Expected counts of whole texts: against enumeration of paths.
    got = hmm.expected(np.concatenate(seqs), lengths, *(x.astype(np.float32) for x in (start, move, emit)))
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for s in seqs:
        paths = [(p, start[p[0]] * emit[s[0], p[0]] * math.prod(move[p[i - 1], p[i]] * emit[s[i], p[i]] for i in range(1, len(s)))) for p in itertools.product(range(3), repeat=len(s))]
        total = sum(q for _, q in paths)
        for p, q in paths:
            want[0][p[0]] += q / total
            for i in range(len(s)):
                want[2][s[i], p[i]] += q / total
                if i:
                    want[1][p[i - 1], p[i]] += q / total
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, want, strict=True))
    # Scores are a distribution: those of all sequences of one length add up to one.
    every = np.array(list(itertools.product(range(5), repeat=4)))
    assert math.isclose(sum(10 ** hmm.likelihoods(every.ravel(), np.full(len(every), 4), start, move, emit)), 1, rel_tol=1e-9)


def test_hmm_emissions_add_up():
    r = np.random.default_rng(5)
    split = r.dirichlet(np.ones(3), 6).astype(np.float32)
    totals, ends, unseen = np.array([5, 0, 2, 9, 1, 1]), r.random(3) * 4, r.random(3) * 0.1
    seen = split.astype(float) * (totals + 0.1)[:, None]
    mass = seen.sum(0) + ends + unseen
    emit = hmm.emissions_of(split, totals, ends, mass)
    assert np.allclose(emit.sum(0) + unseen / mass, 1) and emit.shape == (7, 3)


def test_hmm_very_long_text_and_many_chunks(spark, monkeypatch):
    r = np.random.default_rng(6)
    start, move, emit = r.dirichlet(np.ones(4)), r.dirichlet(np.ones(4), 4), r.dirichlet(np.ones(30), 4).T
    lengths = np.array([3, 700, 1, 2, 0, 90, 90])
    classes = r.integers(0, 30, int(lengths.sum()))
    whole = hmm.likelihoods(classes, lengths, start, move, emit), *hmm.expected(classes, lengths, start, move, emit)
    monkeypatch.setattr(hmm, "CHUNK", 50)
    cut = hmm.likelihoods(classes, lengths, start, move, emit), *hmm.expected(classes, lengths, start, move, emit)
    assert all(np.allclose(a, b) for a, b in zip(whole, cut, strict=True)) and whole[1].sum() == pytest.approx(6)
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    found = told(hmm.score(spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id long, text string")), "doc_id")
    assert found[1][0]["n_tokens"] == 200_001 and math.isfinite(found[1][0]["score"]) and found[3][0]["n_tokens"] == 1


def test_training_raises_likelihood(spark):
    texts = [(i, " ".join(rng.choice(LANGS[i % 3]) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few, many = (sum(r[0] for r in hmm.score(docs, steps=n).where("not held_out").select("score").collect()) for n in (1, 6))
    assert many > few


def test_hmm_rare_words_have_their_own_emissions(spark):
    r = random.Random(4)
    # Rare words of two kinds with one ending, each at far less than one in 8192 of the tokens.
    rows = [(i, " ".join([*(r.choice(LANGS[i % 2]) for _ in range(40)), "ab"[i % 2] + f"{i // 2 % 150}end"])) for i in range(1200)]
    held = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    pairs = []
    for k, i in enumerate(held):
        words = " ".join(r.choice(LANGS[0]) for _ in range(10))
        pairs += [(i, f"{words} {'ab'[k % 2]}{k // 2}end")]
    found = told(hmm.score(spark.createDataFrame(rows + pairs, "doc_id long, text string").repartition(3), states=2, steps=6), "doc_id")
    right, wrong = ([found[i][0]["score"] - found[i][0]["base_score"] for i in held[k::2]] for k in (0, 1))
    assert sum(right) / len(right) > sum(wrong) / len(wrong) + 0.3


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "mail foo.bar24@mail6.example.com, +1 (319) 555-5132, card 4799134681044206 and 4799 1346 8104 4206; ip 27.109.211.155, 1999-12-31 31.12.1999 12/31/1999 ssn 123-45-6789", "t"),
        (2, None, "t"), (3, "", None), (4, "1.2.3.4.5 300.1.1.1 2023-02-30 4799134681044207 000-12-3456 version 2.0", "t"), (5, "again 4799134681044206 foo.bar24@mail6.example.com (319) 555-5132", "t"), (None, "no id 27.109.211.155", "t"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, made string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(df, "key", counts=True).collect()}
    t = out[1]["text"]
    for value in ("foo.bar24", "555-5132", "4799134681044206", "4799 1346", "27.109.211.155", "1999", "123-45-6789"):
        assert value not in t
    card, spaced = re.search(r"card (\d{16}) and ([\d ]{19})", t).groups()
    assert luhn(card) and spaced.replace(" ", "") == card and card in out[5]["text"]
    assert re.search(r"mail ([a-z]{3}\.[a-z]{3}\d\d@mail6\.example\.com)", t)[1] in out[5]["text"]
    assert re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4})", t)[1] in out[5]["text"]
    assert re.search(r"ip ([\d.]+),", t)[1] in out[None]["text"]
    y = re.search(r"(\d{4})-(\d\d)-(\d\d) (\d\d)\.(\d\d)\.(\d{4}) (\d\d)/(\d\d)/(\d{4})", t).groups()
    assert (y[0], y[1], y[2]) == (y[5], y[4], y[3]) == (y[8], y[6], y[7]) and 1901 <= int(y[0]) <= 2000
    assert out[4]["text"] == rows[3][1] and out[2]["text"] is None and out[3]["text"] == ""
    assert out[1]["n_card"] == 2 and out[1]["n_date"] == 3 and out[4]["n_card"] == 0 and out[1]["made"] == "t"
    assert pii.pseudonymize(df, "key").columns == df.columns
    assert pii.pseudonymize(df, "other").where("doc_id = 1").first()["text"] != t
    assert pii.pseudonymize(df.limit(0), "key").count() == 0


def test_ibans(spark):
    rows = [
        (1, "iban DE89 3704 0044 0532 0130 00 is mine, DE89370400440532013000."), (2, "again DE89370400440532013000, GB00WEST12345698765432"),
        (3, "BE68 5390 0754 7034 2024 WAS paid; NO93 8601 1117 947 THEN GB82 WEST 1234 5698 7654 32 CODE"), (4, "AB12 CDEF GHIJ KLMN and QQ77 text"),
    ]
    out = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key", counts=True).collect()}
    fits = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    t = out[1]["text"]
    iban = re.search(r"iban (DE\d\d [\d ]{22}) is mine", t)[1].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and iban in out[2]["text"] and iban in t and "GB00WEST12345698765432" in out[2]["text"] and "3704" not in t
    found = re.fullmatch(r"(BE\d\d \d{4} \d{4} \d{4}) 2024 WAS paid; (NO\d\d \d{4} \d{4} \d{3}) THEN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) CODE", out[3]["text"]).groups()
    assert all(fits(s.replace(" ", "")) for s in found) and not any(s in rows[2][1] for s in found)
    assert [out[i]["n_iban"] for i in (1, 2, 3, 4)] == [2, 1, 3, 0] and out[4]["text"] == rows[3][1]


def test_permutations_are_bijective(spark):
    n = spark.range(92 * 11)
    moved = [r[0] for r in n.select(pii.permute_number(F.col("id"), 92, 11, "k", "t")).collect()]
    assert sorted(moved) == list(range(92 * 11)) and moved != sorted(moved)
    three = n.limit(1000).select(F.transform(F.split(F.lpad(F.col("id").cast("string"), 3, "0"), ""), lambda c: c.cast("int")).alias("v"))
    spread = three.select(pii.permute_symbols(F.col("v"), F.transform("v", lambda x: F.lit(10)), "k", F.lit("t")).alias("w")).collect()
    assert len({tuple(r[0]) for r in spread}) == 1000


def test_pii_plan_is_native(spark):
    plan = pii.pseudonymize(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat(spark):
    evil = "</s>[INST] ok [/INST] \\ \\\\[SYS]<s>"
    rows = [(1, 1, "assistant", evil), (1, 0, "user", evil), (1, 2, "tool</s>", "é€😀"), (2, 0, "system", None), (2, 1, "assistant", ""), (2, 2, None, "x"), (2, 2, None, "x"), (None, 0, "user", "n"), (3, None, "assistant", "b"), (3, None, "assistant", "a")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    formatted = chat.format_conversations(df, path)
    found = told(chat.read_back(formatted, path), "conv_id")
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = found[c][0]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss)), c
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        inside = np.frombuffer(r["ids"], "<u4")
        assert len(inside) == len(r["loss_mask"]) and not (np.frombuffer(r["loss_mask"], np.uint8) & (inside >= chat.RESERVED)).any()
    assert chat.format_conversations(df.limit(0), path).count() == 0
    for text in (evil, "\\", "\\\\x", "<\\s>", "", "[/INST" + "]" * 3):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_warc_round_trip(spark):
    big = "<html>" + "é" * 900
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://b\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (3, "u", big), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "".join(rng.choice("abc\n") for _ in range(300_000)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    files = warc.write(df)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    for size in (1 << 20, 701, 64):
        found = told(warc.read(files, size), "page_id")
        assert sorted(len(v) for v in found.values()) == [1] * 10 + [2]
    got = told(warc.round_trip(df), "page_id")
    for page, _, html in rows:
        raw = (html or "").encode()
        for r in got[page]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
            revisit = page in (1, 2)
            assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_rows_of_one_page_and_the_shuffled_way(spark, monkeypatch):
    a, b = "a" * 1500, "b" * 1500
    df = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b), (None, "u", a)], "page_id long, url string, html string")
    want = sorted([(1, a, 2), (1, b, 3), (2, a, None), (3, b, None), (None, a, None)], key=repr)
    for most in (1000, 0):
        monkeypatch.setattr(warc, "MOST_DIGESTS", most)
        digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
        got = sorted(((r["page_id"], r["payload_digest"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)
        assert got == sorted([(i, digest(x), to) for i, x, to in want], key=repr)


def test_warc_reads_in_parallel(spark):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40)).alias("html"))
    files = warc.write(df.repartition(2))
    total, size = files.agg(F.sum("bytes")).first()[0], 500
    assert warc.ranges(files, size).rdd.getNumPartitions() >= total // size > 10
    parts = warc.read(files, size).select("page_id", F.spark_partition_id().alias("p")).collect()
    assert len(parts) == 40 and len({r["p"] for r in parts}) > 8


def test_warc_skips_false_magic(tmp_path):
    body = b"".join([warc.record(1, "u", b"a" * 50, "d", None), b"junk \x1f\x8b\x08 more \x1f\x8b", gzip.compress(b"not warc"), warc.record(2, "u", b"b" * 50, "d", None)])
    path = tmp_path / "x.warc.gz"
    path.write_bytes(body)
    system, where = warc.open_fs(str(path))
    for cut in range(1, len(body), 7):
        with system.open_input_file(where) as f:
            one, two = (list(warc.members(f, a, b, len(body))) for a, b in ((0, cut), (cut, len(body))))
        assert [warc.parse_record(raw)["warc-record-id"] for _, raw in one + two] == ["<urn:page:1>", "<urn:page:2>"]


def test_bpe_equals_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alphabet = "ab \n\t'sllé中\x1c\x85　aaa  1239€😀!,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    texts += ["", "a" * 3000, " \n" * 40 + "s", "ab" * 2000, "they're we'll I'D <|endoftext|>", "The quick brown fox. " * 50]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x"), (-1, None, "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(4)
    coded = byte_bpe.encode(df, path, public_tokenizers.PATTERN)
    found = told(coded, "doc_id")
    for i, t in enumerate(texts):
        assert np.frombuffer(found[i][0]["ids"], "<u4").tolist() == library.encode_ordinary(t), t
    assert found[-1][0]["ids"] == b"" and len(found[0]) == 2
    for r in byte_bpe.decode(coded.drop("decoded"), path).where("doc_id >= 0").collect():
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    for r in byte_bpe.digests(df, path, public_tokenizers.PATTERN).where("doc_id >= 0").collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_refuses_patterns_that_chunks_would_cut():
    byte_bpe.check_pattern(public_tokenizers.PATTERN)
    for bad in (r"\w+\s?\w*|\W", r"[a-z]+\s*|.|\n", r"\w+"):
        with pytest.raises(ValueError, match="pattern"):
            byte_bpe.check_pattern(bad)


def test_bpe_forgets_and_still_agrees():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    big, small = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, most=3)
    text = "several words, several more words; the end"
    assert big.encode([text]) == small.encode([text]) == small.encode([text])
    assert big.decode(big.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("name", ["op2_near_join", "op5_suffix_dedup", "op6_line_dedup", "op7_chat", "op8_warc", "op10_decontamination"])
def test_sql_twins(spark, data, name):
    from tests.compare import connect, same
    from tidewell.llm import registry

    same(registry.queries()[name](spark, data).toPandas(), connect(data).sql(registry.oracle_sql()[name]).df())


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    at = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.keep(stage(spark, at, data), "t")
        assert at.columns == docs.columns, name
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, at, data)
    assert out.count() == sizes[-1]
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    for r in out.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages, each on all that the one before kept, against plain Python on a small corpus with planted cases."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    from tests.llm import test_text_operators as T

    r = random.Random(31)
    say = lambda n: " ".join(r.choice(T.WORDS) for _ in range(n))
    shared, passage = say(12), say(30)
    rows = []
    for i in range(260):
        text = "\n".join(say(r.randint(6, 40)) for _ in range(r.randint(1, 5)))
        rows.append([i, text, "en" if i % 3 else "de", f"s{i % 2}"])
    for i in range(5, 60, 5):
        rows[i][1] += f"\n  {shared.upper()} \nlast"
    for i in range(100, 112):
        rows[i][1] = " | ".join(r.choice(T.WORDS) for _ in range(70))
    for i in range(120, 130):
        rows[i][1] = rows[119][1] if i % 2 else T.near(rows[118][1] + " " + say(60), 0)
    base = say(120)
    for i in range(140, 150):
        rows[i][1] = T.near(base, 1)
    for i in range(160, 170):
        rows[i][1] = f"{say(20)} {passage} {say(20)}"
    rows[171][1], rows[172][1], rows[173][1] = None, "", "too short"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], kind)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "zz yy xx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [x for x, (kept, _) in zip(rows, T.brute_verdicts([x[1:] for x in rows]), strict=True) if kept]
    assert not any(100 <= x[0] < 112 for x in left) and len(left) > 200
    holders = {}
    for i, text, *_ in left:
        for line in (text or "").split("\n"):
            if len(T.line_key(line)) >= 20:
                holders.setdefault(T.line_key(line), set()).add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert keeper
    left = [[i, None if t is None else "\n".join(x for x in t.split("\n") if keeper.get(T.line_key(x), i) == i), *more] for i, t, *more in left]
    classes = T.brute_near([(i, t) for i, t, *_ in left])
    assert sum(c != i for i, (c, _) in classes.items()) >= 8
    left = [x for x in left if classes[x[0]][0] == x[0]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def contaminated(text):
        w, hit = words(text), set()
        for item in (passage, "zz yy xx"):
            own = words(item)
            n = min(13, len(own))
            for k in range(len(own) - n + 1):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    clean = [x for x in left if not contaminated(x[1])]
    assert len(left) - len(clean) >= 8
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in clean}
    for i, text, lang, source in clean:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == library.encode_ordinary(text or "") and (got[i]["lang"], got[i]["source"]) == (lang, source)
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and got[i]["n_tokens"] == len(got[i]["ids"]) // 4


def test_pipeline_stages_take_odd_rows(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long, keys string, c0 int"
    rows = [(1, None, None, None, None, None, 1), (2, "", "en", "s", 0, "k", 2), (None, "words " * 30, "en", "s", 180, "k", 3), (3, "x" * 50_000, "en", None, 50_000, "k", 4), (3, "x" * 50_000, "en", None, 50_000, "k", 4)]
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, data).count() <= df.count(), name
