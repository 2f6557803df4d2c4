"""The relationship graph: paths, evidence, context, backfill, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.facts import active, as_of, page
from tidewell.sources.storage import keep, spread_join


def edge_score() -> Column:
    """Confidence times strength, raised a little by evidence."""
    return F.col("confidence") * F.col("strength") * (1 + 0.05 * F.log1p(F.least(F.col("evidence_count"), F.lit(10))))


def paths(edges: DataFrame, start: str, end: str, hops: int = 2, t: int | None = None, limit: int = 20) -> DataFrame:
    """Direct and two-hop paths (hops, edge_ids, nodes, score), best first.

    Both ends are filtered before the join, so it joins the edges out of one node with those into another.
    """
    limit = page(limit)
    usable = edges if t is None else edges.where(as_of(t))
    own = F.greatest(F.col("confidence"), F.lit(0.0)) * F.greatest(F.col("strength"), F.lit(0.0))
    out = usable.where(F.col("subject_id") == start).select(F.col("edge_id").alias("e1"), F.col("object_id").alias("middle"), own.alias("s1"))
    direct = out.where(F.col("middle") == end).orderBy(F.desc("s1"), "e1").limit(limit)
    told = direct.select(F.lit(1).alias("hops"), F.col("e1").alias("edge_ids"), F.array_join(F.array(F.lit(start), F.lit(end)), ">").alias("nodes"), F.round("s1", 6).alias("score"))
    if hops >= 2:
        into = usable.where(F.col("object_id") == end).select(F.col("edge_id").alias("e2"), F.col("subject_id").alias("middle"), own.alias("s2"))
        pairs = out.where(~F.col("middle").isin(start, end)).join(into, "middle").orderBy(F.desc(F.col("s1") * F.col("s2")), "e1", "e2").limit(limit)
        told = told.unionByName(pairs.select(F.lit(2).alias("hops"), F.concat_ws(" ", "e1", "e2").alias("edge_ids"), F.concat_ws(">", F.lit(start), "middle", F.lit(end)).alias("nodes"), F.round(F.sqrt(F.col("s1") * F.col("s2")), 6).alias("score")))
    return told.orderBy(F.desc("score"), "hops", "edge_ids", "nodes").limit(limit)


def best_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each edge with its most confident evidence (then newest, then smallest id), if it has any: an aggregation with map-side combine."""
    least = lambda c: F.coalesce(-F.col(c), F.lit(float("inf")))
    best = evidence.groupBy("edge_id").agg(F.min_by(F.struct("evidence_id", "memory_id"), F.struct(least("extraction_confidence"), least("created_at_ms"), "evidence_id", "memory_id")).alias("v"))
    return edges.join(best.select("edge_id", "v.*"), "edge_id", "left")


def provenance(edge_id: str, evidence: DataFrame, episodes: DataFrame, limit: int = 100) -> DataFrame:
    """An edge's evidence with a preview of its episode, found by row id, else by memory id."""
    own = evidence.where(F.col("edge_id") == edge_id)
    preview = F.substring("content", 1, 240)
    by_row = episodes.select(F.col("rowid").alias("source_episode_id"), preview.alias("p1"))
    by_id = episodes.select("memory_id", preview.alias("p2"))
    rows = own.join(by_row, "source_episode_id", "left").join(by_id, "memory_id", "left")
    return rows.select("evidence_id", "edge_id", F.coalesce("p1", "p2").alias("preview"), F.round("extraction_confidence", 6).alias("extraction_confidence")).orderBy(F.desc("extraction_confidence"), "evidence_id").limit(limit)


def context_paths(edges: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """Outgoing one- and two-hop paths of at most eight seeds that don't end in a seed."""
    seeds = list(dict.fromkeys(seeds))[:8]
    scored = edges.select("edge_id", "subject_id", "object_id", edge_score().alias("s"))
    one = scored.where(F.col("subject_id").isin(seeds) & ~F.col("object_id").isin(seeds))
    told = one.select(F.lit(1).alias("hops"), F.col("edge_id").alias("edge_ids"), F.concat_ws(">", "subject_id", "object_id").alias("nodes"), F.round("s", 6).alias("score"))
    second = scored.select(F.col("edge_id").alias("e2"), F.col("subject_id").alias("middle"), F.col("object_id").alias("last"), F.col("s").alias("s2"))
    two = one.select("subject_id", F.col("object_id").alias("middle"), F.col("edge_id").alias("e1"), F.col("s").alias("s1")).join(second, "middle").where(~F.col("last").isin(seeds))
    told = told.unionByName(two.select(F.lit(2).alias("hops"), F.concat_ws(" ", "e1", "e2").alias("edge_ids"), F.concat_ws(">", "subject_id", "middle", "last").alias("nodes"), F.round(F.sqrt(F.col("s1") * F.col("s2")), 6).alias("score")))
    return told.orderBy(F.desc("score"), "hops", "edge_ids", "nodes").limit(page(limit, 50))


def direction(subject: Column, obj: Column, kind: Column, seeds: list[str]) -> Column:
    """How a fact stands to the seeds."""
    own, other = subject.isin(seeds), (kind == "entity") & obj.isin(seeds)
    return F.when(own & other & (subject == obj), "self").when(own & other, "between_seed_entities").when(own, "outgoing").when(other, "incoming").otherwise("related")


def fact_reasons(kind: Column, way: Column, evidence_count: Column) -> Column:
    return F.array_compact(F.array(F.lit("query_entity"), way, F.when(kind == "entity", "graph_neighbor").otherwise("literal_fact"), F.when(evidence_count > 0, "evidence_backed")))


def path_reasons(hops: Column, backed: Column) -> Column:
    return F.array_compact(F.array(F.lit("query_entity"), F.when(hops == 1, "direct_relationship").otherwise("two_hop_relationship_path"), F.lit("graph_neighbor"), F.when(backed, "evidence_backed")))


def context_facts(edges: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """Facts that start or end in a seed, links between entities first, then the strongest, with direction, score and reasons.

    edges: edge_id, subject_id, predicate, object_id, object_kind, confidence, strength, evidence_count.
    """
    seeds = list(dict.fromkeys(seeds))[:8]
    own = edges.where(F.col("subject_id").isin(seeds) | ((F.col("object_kind") == "entity") & F.col("object_id").isin(seeds)))
    best = own.orderBy(F.desc(F.col("object_kind") == "entity"), F.desc("strength"), "edge_id").limit(page(limit, 50))
    way = direction(F.col("subject_id"), F.col("object_id"), F.col("object_kind"), seeds)
    return best.select("edge_id", "subject_id", "predicate", "object_id", "object_kind", way.alias("direction"), F.round(edge_score(), 6).alias("score"), fact_reasons(F.col("object_kind"), way, F.col("evidence_count")).alias("reason_codes"))


def context_aliases(aliases: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """Aliases (alias, canonical_id, display_label, confidence, updated_at_ms) of or named like a seed, most confident first."""
    seeds = list(dict.fromkeys(seeds))[:8]
    own = aliases.where(F.col("canonical_id").isin(seeds) | F.col("alias").isin(seeds))
    return own.orderBy(F.desc("confidence"), F.desc("updated_at_ms"), "alias").limit(page(limit, 50)).select("alias", "canonical_id", "display_label", "confidence")


def review_warnings(reviews: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """Open reviews of facts about a seed, newest first."""
    seeds = list(dict.fromkeys(seeds))[:8]
    own = reviews.where((F.col("status") == "needs_review") & (F.col("subject_id").isin(seeds) | ((F.col("object_kind") == "entity") & F.col("object_id").isin(seeds))))
    return own.orderBy(F.desc("created_at_ms"), "review_id").limit(page(limit, 50)).select("review_id", "reason_code", "subject_id", "predicate", "object_id", "object_kind", "confidence")


def graph_edges(facts: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges (kind, edge_id, source, target) of the explicit graph: facts between entities, chunks of documents, members of clusters."""
    text = lambda *parts: F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    one = active(facts).where("object_kind = 'entity'").select(F.lit("triple").alias("kind"), F.col("triple_id").alias("edge_id"), F.col("subject_id").alias("source"), F.col("object_id").alias("target"))
    two = chunks.select(F.lit("document_chunk").alias("kind"), text("doc_id", "chunk_index").alias("edge_id"), F.col("doc_id").cast("string").alias("source"), text("doc_id", "chunk_index").alias("target"))
    three = members.select(F.lit("cluster_member").alias("kind"), text("cluster_id", "memory_id").alias("edge_id"), F.col("cluster_id").alias("source"), F.col("memory_id").alias("target"))
    return one.unionByName(two).unionByName(three)


def edge_page(edges: DataFrame, after: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
    """Edges in order of (kind, edge_id), from after a cursor on."""
    if after is not None:
        edges = edges.where((F.col("kind") > after[0]) | ((F.col("kind") == after[0]) & (F.col("edge_id") > after[1])))
    return edges.orderBy("kind", "edge_id").limit(limit)


def neighbours(edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """(direction, kind, edge_id, node): what an edge leads to from a node, or comes from."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "kind", "edge_id", F.col("target").alias("node"))
    into = edges.where((F.col("target") == node) & (F.col("source") != node)).select(F.lit("in").alias("direction"), "kind", "edge_id", F.col("source").alias("node"))
    return out.unionByName(into).orderBy("direction", "kind", "edge_id", "node").limit(limit)


def inspect_node(edges: DataFrame, node: str) -> DataFrame:
    """One row: a node's edges in and out, by number and kind."""
    own = edges.where((F.col("source") == node) | (F.col("target") == node))
    kinds = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("kind")))), ",")
    out, into = F.col("source") == node, F.col("target") == node
    return own.agg(F.count_if(out).alias("n_out"), F.count_if(into).alias("n_in"), kinds(out).alias("out_kinds"), kinds(into).alias("in_kinds")).select(F.lit(node).alias("node"), "*")


def backfill_entities(facts: DataFrame) -> DataFrame:
    """An entity for every subject and entity object of active facts; where both name it, the subject's figures stand."""
    live = active(facts)

    def seen(c: str, rank: int) -> DataFrame:
        rows = live if rank == 0 else live.where("object_kind = 'entity'")
        return rows.groupBy(F.col(c).alias("entity_id")).agg(
            F.max("confidence").alias("confidence"), F.min("valid_from_ms").alias("first_seen_ms"), F.max(F.coalesce("valid_to_ms", "valid_from_ms")).alias("last_seen_ms")
        ).withColumn("rank", F.lit(rank))

    both = seen("subject_id", 0).unionByName(seen("object_id", 1))
    first = both.groupBy("entity_id").agg(F.min_by(F.struct("confidence", "first_seen_ms", "last_seen_ms"), "rank").alias("v"))
    return first.select("entity_id", F.round("v.confidence", 6).alias("confidence"), "v.first_seen_ms", "v.last_seen_ms")


def backfill_edges(facts: DataFrame) -> DataFrame:
    """An edge for every active fact; its object is an entity or a literal."""
    kind = F.col("object_kind")
    return active(facts).select(
        F.col("triple_id").alias("edge_id"), F.col("subject_id").alias("subject_entity_id"), "predicate", F.when(kind == "entity", F.col("object_id")).alias("object_entity_id"),
        F.when(kind == "literal", F.col("object_id")).alias("object_literal"), "object_kind", "valid_from_ms", "valid_to_ms", F.round("confidence", 6).alias("confidence"), F.round("confidence", 6).alias("strength"),
    )


#: Episodes that facts name, up to which they are broadcast.
MOST_NAMED = 1_000_000


def backfill_evidence(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Evidence of every active fact, with the memory its source row names, if it is there.

    Facts move to no task by their source, as many have none or the same: the episodes that facts name go to them.
    """
    live = active(facts)
    sources = live.where("source_episode_id is not null").select("source_episode_id").distinct()
    named = keep(episodes.select(F.col("rowid").alias("source_episode_id"), "memory_id").join(sources, "source_episode_id", "left_semi"), "evidence-sources")
    rows = spread_join(live, named, "source_episode_id", named.count(), MOST_NAMED)
    return rows.select(F.col("triple_id").alias("evidence_id"), F.col("triple_id").alias("edge_id"), "memory_id", "source_episode_id", "cluster_id", F.round("confidence", 6).alias("extraction_confidence"))


def catalogue(nodes: dict[str, DataFrame], after: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes (kind, id) of several tables in one order, from after a cursor on."""
    rows = None
    for kind, (df) in nodes.items():
        own = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("id"))
        rows = own if rows is None else rows.unionByName(own)
    if after is not None:
        rows = rows.where((F.col("kind") > after[0]) | ((F.col("kind") == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("kind", "id").limit(limit)
