"""Audit listing and retention, erasure, and row changes on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(events: DataFrame, principal: str | None = None, operation: str | None = None, since: int | None = None, limit: int = 100) -> DataFrame:
    """Audit rows, newest first."""
    for column, value in (("principal", principal), ("source_type", operation)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("ts_ms") >= since)
    return events.orderBy(F.desc("ts_ms"), F.desc("rowid")).limit(limit).select("rowid", "ts_ms", "principal", F.col("source_type").alias("operation"))


def purge(events: DataFrame, before: int) -> DataFrame:
    """What is left after rows older than a moment go."""
    return events.where(F.col("ts_ms") >= before)


#: Code points of an inbox row's label and preview.
LABEL_CHARS, PREVIEW_CHARS, MOST_INBOX = 80, 200, 200


def shortened(text: Column, most: int) -> Column:
    """text, or its beginning and three dots within `most` code points."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def inbox(episodes: DataFrame, reviews: DataFrame, limit: int = 50) -> DataFrame:
    """Newest active episodes, ties by memory id, with a label (their first line), a preview and their review (memory_id, state, reviewed_at_ms, note), if any."""
    rows = episodes.where("status = 'active'").orderBy(F.desc("ts_ms"), "memory_id").limit(max(1, min(limit, MOST_INBOX)))
    first_line = F.regexp_replace(F.substring_index("content", "\n", 1), "\r$", "")
    told = reviews.select("memory_id", F.col("state").alias("review_state"), "reviewed_at_ms", F.col("note").alias("review_note"))
    return rows.join(told, "memory_id", "left").select(
        "memory_id", shortened(first_line, LABEL_CHARS).alias("label"), shortened(F.col("content"), PREVIEW_CHARS).alias("preview"), "ts_ms", "source_type", "salience", "status", "review_state", "reviewed_at_ms", "review_note"
    )


def tiers(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("tier", "status").agg(F.count("*").alias("n"))


def erase(principal: str, episodes: DataFrame, facts: DataFrame, members: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What is left after a principal's erasure: facts go with their source episode, memberships with their memory, chunks with who ingested them.

    Rows without a principal or a source stay. Documents stay as well, as others may have ingested chunks of them.
    """
    mine = lambda c: F.col(c).eqNullSafe(principal)
    gone = episodes.where(mine("principal"))
    return {
        "episodes": episodes.where(~mine("principal")),
        "facts": facts.join(gone.select(F.col("rowid").alias("source_episode_id")), "source_episode_id", "left_anti"),
        "members": members.join(gone.select("memory_id"), "memory_id", "left_anti"),
        "chunks": chunks.where(~mine("ingested_by")),
    }


def erasure_estimate(principal: str, episodes: DataFrame, facts: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many episodes, facts and chunks would go, and how many facts without a source the clusters of those episodes hold."""
    gone = episodes.where(F.col("principal") == principal).select(F.col("rowid").alias("source_episode_id"), "memory_id")
    lost = facts.join(gone, "source_episode_id", "left_semi")
    touched = members.join(gone, "memory_id", "left_semi").select("cluster_id").distinct()
    orphans = facts.where("source_episode_id is null").join(touched, "cluster_id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(gone, "episodes").crossJoin(count(lost, "facts")).crossJoin(count(chunks.where(F.col("ingested_by") == principal), "chunks")).crossJoin(count(orphans, "orphans"))  # one row each


def clear_source(rows: DataFrame, gone: DataFrame, key: str = "source_episode_id") -> DataFrame:
    """rows with a key that is gone set to null: what a deletion does to rows that outlive their source."""
    marked = rows.join(gone.select(F.col(key), F.lit(True).alias("lost")).distinct(), key, "left")
    return marked.select(*[F.when(F.col("lost").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in rows.columns])


def reset_derived(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The derived layer emptied: the same columns, no rows. Episodes, documents and reviews aren't part of it."""
    return {name: df.limit(0) for name, df in tables.items()}


def purge_outbox(outbox: DataFrame, done: DataFrame, episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries (entry_id, kind, target_id) still to replay: without those done, and without those whose episode or chunk is gone."""
    left = outbox.join(done.select("entry_id"), "entry_id", "left_anti")
    alive = episodes.where("status = 'active'").select(F.lit("episode").alias("kind"), F.col("rowid").alias("target_id")).unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("target_id")))
    return left.join(alive, ["kind", "target_id"], "left_semi").select(*outbox.columns)


def latest(rows: DataFrame, keys: list[str], time_col: str = "created_at_ms", id_col: str = "op_id") -> DataFrame:
    """The newest row of each key, the largest id among those of one time.

    Rows are dealt by key before they are sorted by it, so that a task sorts its share of a shuffle, not all of a file's
    part; a key of very many rows goes to several tasks.
    """
    others = [c for c in rows.columns if c not in keys]
    return rows.repartition(*keys, F.pmod(F.xxhash64(*others), F.lit(4))).groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time_col, id_col)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in others])


def export(events: DataFrame, path: str, form: str = "json") -> int:
    """Writes all audit rows, newest first, and returns their number: the range sort keeps parts and rows in order."""
    rows = events.orderBy(F.desc("ts_ms"), F.desc("rowid"))
    rows.write.mode("errorifexists").format(form).save(path)
    return events.sparkSession.read.schema(rows.schema).format(form).load(path).count()


def retention(events: DataFrame, now_ms: int, days: int | None) -> DataFrame:
    """What a sweep leaves: rows of the last `days` days; none is no limit."""
    return events if days is None else purge(events, now_ms - days * 86_400_000)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks; the first of equal new keys is the least row."""
    first = new.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns]))).where("place = 1").drop("place")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of equal keys replaced by new's, and new's others added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_where(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def forget(rows: DataFrame, ids: list, id_col: str = "memory_id") -> DataFrame:
    """A soft delete: the rows stay, as forgotten."""
    return rows.withColumn("status", F.when(F.col(id_col).isin(ids), "forgotten").otherwise(F.col("status")))


def evidence_counts(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges with their number of evidence rows; an edge without any goes."""
    return edges.drop("evidence_count").join(evidence.groupBy("edge_id").agg(F.count("*").alias("evidence_count")), "edge_id")


def source_backfill(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """rows (id, provenance_json) with the row id of the first memory they derive from."""
    named = rows.withColumn("memory_id", F.get_json_object("provenance_json", "$.derived_from[0]"))
    return named.join(episodes.select("memory_id", F.col("rowid").alias("source_episode_id")), "memory_id", "left")


def by_prefix(rows: DataFrame, prefix: str, id_col: str) -> str:
    """The one id that starts with prefix; none or several are an error."""
    found = [r[0] for r in rows.where(F.col(id_col).startswith(prefix)).select(id_col).orderBy(id_col).limit(16).collect()]
    if len(found) != 1:
        raise LookupError(f"{len(found)} ids start with {prefix!r}")
    return found[0]


def inspect(rows: DataFrame, key: str, id_col: str = "memory_id") -> DataFrame:
    """The row of an id, whatever its status; a missing one is an error."""
    found = rows.where(F.col(id_col) == key).limit(1)
    if not found.count():
        raise LookupError(f"no {id_col} {key!r}")
    return found
