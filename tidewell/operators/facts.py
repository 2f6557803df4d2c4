"""Facts, entities, themes and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def active(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'active'")


def page(limit: int, most: int = 100) -> int:
    """A page size within its bounds."""
    return max(1, min(limit, most))


def cutoff(now_ms: int, days: int | None) -> int | None:
    """The moment so many days ago; none where there is no window or it reaches past what 64 bits hold."""
    if days is None:
        return None
    at = now_ms - days * DAY_MS
    return at if -(1 << 63) <= days * DAY_MS < 1 << 63 and -(1 << 63) <= at < 1 << 63 else None


def as_of(t: int, prefix: str = "") -> Column:
    """Valid at t: the window holds its begin, not its end; no end is open."""
    begin, end = F.col(f"{prefix}valid_from_ms"), F.col(f"{prefix}valid_to_ms")
    return (begin <= t) & (end.isNull() | (end > t))


def facts_about(facts: DataFrame, subject: str, aliases: tuple[str, ...] = (), as_object: bool = False, predicate: str | None = None, since: int | None = None, until: int | None = None, limit: int = 20) -> DataFrame:
    """Active facts of a subject, newest first. "user" and its aliases are one subject.

    since bounds the begin and until the end of a fact's window; a fact without end passes any until.
    """
    names = [subject]
    if subject == "user" or subject in aliases:
        names = ["user", *[a for a in aliases if a and a != "user"]]
    own = F.col("subject_id").isin(names)
    rows = active(facts).where(own | F.col("object_id").isin(names) if as_object else own)
    if predicate is not None:
        rows = rows.where(F.col("predicate") == predicate)
    if since is not None:
        rows = rows.where(F.col("valid_from_ms") >= since)
    if until is not None:
        rows = rows.where(F.col("valid_to_ms").isNull() | (F.col("valid_to_ms") <= until))
    out = rows.select("triple_id", "subject_id", "predicate", "object_id", "object_kind", "valid_from_ms", "valid_to_ms", F.round("confidence", 6).alias("confidence"), "cluster_id").distinct()
    return out.orderBy(F.desc("valid_from_ms"), "triple_id", "object_id").limit(page(limit))


def entity_refs(facts: DataFrame) -> DataFrame:
    """A row for each mention of an entity as subject or object."""
    live = active(facts)
    subjects = live.select(F.col("subject_id").alias("entity_id"), F.lit(1).alias("as_subject"), F.lit(0).alias("as_object"), "predicate")
    objects = live.where("object_kind = 'entity'").select(F.col("object_id").alias("entity_id"), F.lit(0).alias("as_subject"), F.lit(1).alias("as_object"), "predicate")
    return subjects.unionByName(objects)


def entities(facts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entities whose id holds the query: equal ids first, then prefixes, then the rest. % and _ are wildcards."""
    q = query.strip().lower()
    name = F.lower("entity_id")
    level = F.when(name == q, 0).when(name.like(f"{q}%"), 1).otherwise(2)
    found = entity_refs(facts).where(name.like(f"%{q}%"))
    grouped = found.groupBy("entity_id").agg(
        F.sum("as_subject").alias("subject_count"), F.sum("as_object").alias("object_count"), F.count("*").alias("fact_count"),
        F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"), F.min(level).cast("long").alias("match_score"),
    )
    return grouped.orderBy("match_score", F.desc("fact_count"), "entity_id").limit(page(limit))


def themes(clusters: DataFrame, abstractions: DataFrame, members: DataFrame, episodes: DataFrame, now_ms: int, window_days: int | None = None, limit: int = 20) -> DataFrame:
    """Newest clusters with their abstraction and number of active episodes."""
    since = cutoff(now_ms, window_days)
    if since is not None:
        clusters = clusters.where(F.col("created_at_ms") >= since)
    counted = members.join(active(episodes).select("memory_id"), "memory_id").groupBy("cluster_id").agg(F.count("*").alias("episode_count"))
    rows = clusters.join(abstractions, "cluster_id", "left").join(counted, "cluster_id", "left")
    out = rows.select("cluster_id", "abstraction_id", F.col("content").alias("abstraction_text"), F.coalesce("episode_count", F.lit(0)).alias("episode_count"), F.round("coherence", 6).alias("coherence"), "created_at_ms")
    return out.orderBy(F.desc("created_at_ms"), "cluster_id", "abstraction_id").limit(page(limit))


def contradiction_candidates(facts: DataFrame) -> DataFrame:
    """Pairs of active facts of one subject and predicate with different objects whose closed windows meet.

    An equi-join on subject and predicate; adaptive execution splits hot keys.
    """
    live = active(facts).select("triple_id", "subject_id", "predicate", "object_id", "valid_from_ms", F.coalesce("valid_to_ms", F.lit((1 << 63) - 1)).alias("valid_to"))
    a, b = (live.select("subject_id", "predicate", *[F.col(c).alias(f"{p}_{c}") for c in ("triple_id", "object_id", "valid_from_ms", "valid_to")]) for p in "ab")
    pairs = a.join(b, ["subject_id", "predicate"])
    meet = (F.col("a_valid_from_ms") <= F.col("b_valid_to")) & (F.col("b_valid_from_ms") <= F.col("a_valid_to"))
    return pairs.where((F.col("a_triple_id") < F.col("b_triple_id")) & (F.col("a_object_id") != F.col("b_object_id")) & meet).select("subject_id", "predicate", "a_triple_id", "b_triple_id", "a_object_id", "b_object_id")


def contradictions(found: DataFrame, facts: DataFrame, limit: int = 20) -> DataFrame:
    """Stored contradictions with both facts, newest first; a fact that is gone leaves nulls."""
    def side(p: str) -> DataFrame:
        return facts.select(F.col("triple_id").alias(f"{p}_triple_id"), F.concat_ws(" ", "subject_id", "predicate", "object_id").alias(f"{p}_fact"))

    rows = found.join(side("a"), "a_triple_id", "left").join(side("b"), "b_triple_id", "left")
    return rows.orderBy(F.desc("detected_at_ms"), "a_triple_id", "b_triple_id").limit(page(limit)).select("a_triple_id", "b_triple_id", "kind", "detected_at_ms", "a_fact", "b_fact")


def settle(found: DataFrame, decisions: DataFrame, now_ms: int) -> DataFrame:
    """Contradictions after decisions (a_triple_id, b_triple_id, status): one that is resolved gets a time, one decided otherwise loses it, others keep theirs."""
    rows = found.join(decisions.withColumnRenamed("status", "decided"), ["a_triple_id", "b_triple_id"], "left")
    time = F.when(F.col("decided").isNull(), F.col("resolved_at_ms")).when(F.col("decided") == "resolved", F.lit(now_ms))
    return rows.withColumn("status", F.coalesce("decided", "status")).withColumn("resolved_at_ms", time).drop("decided")


def inspect_cluster(cluster_id: str, clusters: DataFrame, abstractions: DataFrame, members: DataFrame, episodes: DataFrame, full: bool = False) -> DataFrame:
    """One row: the cluster, its newest abstraction and its active members in time order."""
    text = F.col("content") if full else F.substring("content", 1, 200)
    inside = members.where(F.col("cluster_id") == cluster_id).join(active(episodes), "memory_id")
    listed = inside.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "memory_id", text.alias("content")))).alias("episodes"))
    newest = abstractions.where(F.col("cluster_id") == cluster_id).groupBy("cluster_id").agg(F.max("abstraction_id").alias("abstraction_id"))
    return clusters.where(F.col("cluster_id") == cluster_id).join(newest, "cluster_id", "left").join(listed, "cluster_id", "left").select("cluster_id", "abstraction_id", F.coalesce(F.size("episodes"), F.lit(0)).cast("long").alias("n_episodes"), F.array_join(F.transform("episodes", lambda e: e["memory_id"]), ",").alias("memory_ids"))


def alias_groups(labels: DataFrame, label_col: str = "entity_id") -> DataFrame:
    """Keys that more than one label comes down to."""
    from tidewell.functions.text import alias_key

    keyed = labels.select(alias_key(F.col(label_col)).alias("canonical_key"), F.col(label_col).alias("label")).where("canonical_key is not null").distinct()
    return keyed.groupBy("canonical_key").agg(F.array_join(F.sort_array(F.collect_list("label")), "|").alias("labels"), F.count("*").alias("n_labels")).where("n_labels > 1")


def rename_subjects(facts: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """facts with ids replaced on both sides, and whether a row changed."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = lambda c: F.coalesce(F.element_at(table, F.col(c)), F.col(c))
    return facts.withColumn("new_subject_id", new("subject_id")).withColumn("new_object_id", F.when(F.col("object_kind") == "entity", new("object_id")).otherwise(F.col("object_id"))).withColumn("changed", (F.col("new_subject_id") != F.col("subject_id")) | (F.col("new_object_id") != F.col("object_id")))
