"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, chat, decontamination, hmm, licenses, line_dedup, near_join, pii, quality, schema_drift, suffix_dedup, wand, warc


#: Key of the pseudonyms that the query shows; a deployment passes its own.
PII_KEY = "tidewell"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, counts=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).drop("key", "n_lines")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], told.schema)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(told.unionByName(extra), path), path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.occurrences(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


#: What files of clients shall look like.
CLIENTS = schema_drift.Evolved(
    (
        ("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()),
        ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64()),
    ),
    {8: -1, 9: "none"},
)
CLIENTS_DRIFT = {"missing": (8, 9), "narrow": {8: pa.int32(), 10: pa.float32()}, "swapped": (5, 6)}


def op11_drift_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.crc32(F.col("client_id").cast("string")), F.col("client_id")]
    files = schema_drift.write_drifted(_table(spark, sf_dir, "clients"), CLIENTS, order, 250, "19", **CLIENTS_DRIFT)
    found = schema_drift.digests(schema_drift.rewrite(files, CLIENTS))
    return found.select(
        F.col("file_no").cast("long").alias("file_no"), F.col("drift").cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten"
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hmm_scoring, op2_near_join, op3_pii, op4_quality_rules, op5_suffix_dedup, op6_line_dedup, op7_chat, op8_warc, op9_byte_bpe, op10_decontamination, op11_drift_rewrite, op12_license_scan, op13_lexical_search)}

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN sizes m ON m.doc_id = c.a JOIN sizes n ON n.doc_id = c.b WHERE 5 * c.shared >= 4 * (m.n + n.n - c.shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT r.doc_id, min(r.other) AS class_id, (SELECT count(*) FROM links l WHERE l.a = r.doc_id)::BIGINT AS n_links FROM reach r GROUP BY r.doc_id
"""

_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?(INST|SYS|ROLE)\]|\[/TURN\]')) AS n,
         length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '</?s>|\[/?(INST|SYS|ROLE)\]|\[/TURN\]')) AS r FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 11 ELSE 20 + r END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8 = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN m.top <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top <> d.page_id THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""

_OP6 = r"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line, lower_ascii AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) r,
       LATERAL (SELECT translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) k
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> c.keeper, false) AS lost FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN wins w ON g.n = w.n AND g.s = w.s
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

_OP5 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), blocks AS (
  SELECT doc_id, p, least(512, n - 99 - p) AS most, substr(h, 2 * p + 1, 1222) AS b
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 512)) AS p FROM d)
), grams AS (
  SELECT doc_id, p + i AS i, md5_number(substr(b, 2 * i::BIGINT + 1, 200)) AS g FROM (SELECT doc_id, p, b, unnest(range(0, most)) AS i FROM blocks)
), firsts AS (
  SELECT g, min(doc_id::HUGEINT * 4294967296 + i) AS first FROM grams GROUP BY g HAVING count(*) > 1
), later AS (
  SELECT doc_id, i FROM grams JOIN firsts USING (g) WHERE doc_id::HUGEINT * 4294967296 + i > first
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM later))
  GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d
), kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM cuts
)
SELECT d.doc_id, d.n AS n_bytes, sum(k.b - k.a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
       sha256(unhex(string_agg(substr(d.h, 2 * k.since + 1, 2 * (k.a - k.since)), '' ORDER BY k.a, k.b))) AS kept_sha256
FROM d JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.n
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, totals GROUP BY term, n
), asked AS (
  SELECT q, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT *, row_number() OVER () AS q FROM benchmark)) GROUP BY ALL
), impacts AS (
  SELECT tf.r, tf.term, (1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * len(d.w)::BIGINT * n) // l)) AS impact FROM tf JOIN d ON tf.r = d.r, totals
), scored AS (
  SELECT q, item_id, r, sum(times * weight * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT s.*, d.doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, d.doc_id, s.r) AS rank FROM scored s JOIN d ON s.r = d.r WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_SQL: dict[str, str] = {"op2_near_join": _OP2, "op5_suffix_dedup": _OP5, "op7_chat": _OP7, "op8_warc": _OP8, "op6_line_dedup": _OP6, "op10_decontamination": _OP10, "op13_lexical_search": _OP13}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
