"""The fact quality gate, claim scores, upserts, readiness and the quality audit."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators.facts import active, alias_groups
from tidewell.sources.storage import keep

MIN_CONFIDENCE = 0.85
# Penalties by reason, at run time and in the backfill of old reviews.
PENALTIES = {
    "assistant_or_tool_chatter": 0.90, "long_machine_blob": 0.80, "metadata_subject": 1.00, "incomplete_shape": 1.00, "invalid_object_kind": 1.00,
    "literal_only_machine_entity": 0.35, "machine_literal": 0.35, "long_literal_evidence": 0.35, "weak_literal_claim": 0.35, "low_confidence": 0.25,
    "weak_predicate": 0.20, "weak_subject": 0.20, "weak_object": 0.20, "weak_literal": 0.20,
}
OLD_PENALTIES = {"assistant_or_tool_chatter": 0.45, "long_machine_blob": 0.40, "metadata_subject": 0.35, "incomplete_shape": 0.35, "invalid_object_kind": 0.35, "low_confidence": 0.25}
QUARANTINED = ("assistant_or_tool_chatter", "long_machine_blob")
REJECTED = ("metadata_subject", "incomplete_shape", "invalid_object_kind")


def _literal_reason(subject: Column, predicate: Column, obj: Column, literal_only: Column) -> Column:
    """Why a literal needs a review, or null."""
    size = F.char_length(obj)
    return (
        F.when(X.metadata_value(obj), F.lit(None).cast("string"))
        .when(literal_only & X.machine_identifier(subject), "literal_only_machine_entity")
        .when(size > 160, "long_literal_evidence")
        .when(X.machine_literal(obj), "machine_literal")
        .when(predicate.isin(*X.WEAK_LITERAL_PREDICATES) & (size > 80), "weak_literal_claim")
    )


def _shared_start(s: Column, p: Column, o: Column, confidence: Column) -> Column:
    every = lambda rule: rule(s) | rule(p) | rule(o)
    return (
        F.when((s == "") | (p == "") | (o == ""), "incomplete_shape")
        .when(every(X.chatter), "assistant_or_tool_chatter")
        .when(confidence < MIN_CONFIDENCE, "low_confidence")
        .when(every(X.underscore_blob), "long_machine_blob")
        .when(X.metadata_value(s), "metadata_subject")
    )


def judge(facts: DataFrame) -> DataFrame:
    """Extracted facts with their clean ids and the first reason to hold them back (null: active).

    facts: triple_id, subject_id, predicate, object_id, object_kind, confidence. Nulls count as empty.
    """
    raw = facts.select("triple_id", *[X.clean_label(F.coalesce(c, F.lit(""))).alias(c) for c in ("subject_id", "predicate", "object_id")], "object_kind", "confidence")
    s, p, o = F.col("subject_id"), F.col("predicate"), F.col("object_id")
    made = raw.withColumn("new_subject", X.canonical_entity_id(s)).withColumn("new_predicate", X.normalize_predicate(p))
    made = made.withColumn("new_kind", F.when((F.col("object_kind") == "entity") & X.metadata_value(o), "literal").otherwise(F.col("object_kind")))
    made = made.withColumn("new_object", F.when(F.col("new_kind") == "entity", X.canonical_entity_id(o)).otherwise(o))
    literal = F.col("new_kind") == "literal"
    reason = (
        _shared_start(s, p, o, F.col("confidence"))
        .when(~X.useful_predicate(F.col("new_predicate")), "weak_predicate")
        .when(F.col("new_subject") == "", "weak_subject")
        .when(~literal & (F.col("new_object") == ""), "weak_object")
        .when(literal & ~X.useful_literal(F.col("new_object")), "weak_literal")
        .when(literal, _literal_reason(F.col("new_subject"), F.col("new_predicate"), F.col("new_object"), F.lit(False)))
    )
    return made.select("triple_id", F.col("new_subject").alias("subject_id"), F.col("new_predicate").alias("predicate"), F.col("new_object").alias("object_id"), F.col("new_kind").alias("object_kind"), "confidence", reason.alias("reason_code"))


def rejudge(facts: DataFrame) -> DataFrame:
    """Active facts judged again (triple_id, reason_code); literal-only subjects are known from all active facts."""
    live = active(facts)
    linked = live.where("object_kind = 'entity'").select(F.explode(F.array("subject_id", "object_id")).alias("subject_id")).distinct().withColumn("linked", F.lit(True))
    rows = live.join(linked, "subject_id", "left")
    rows = rows.select("triple_id", *[X.clean_label(F.coalesce(c, F.lit(""))).alias(c) for c in ("subject_id", "predicate", "object_id")], "object_kind", "confidence", F.col("linked").isNull().alias("alone"))
    s, p, o, kind = (F.col(c) for c in ("subject_id", "predicate", "object_id", "object_kind"))
    rows = rows.withColumn("subject", X.canonical_entity_id(s)).withColumn("said", X.normalize_predicate(p))
    reason = (
        _shared_start(s, p, o, F.col("confidence"))
        .when(F.col("subject") == "", "weak_subject")
        .when(~X.useful_predicate(F.col("said")), "weak_predicate")
        .when((kind == "entity") & (X.canonical_entity_id(o) == ""), "weak_object")
        .when((kind == "literal") & ~X.useful_literal(o), "weak_literal")
        .when(kind == "literal", _literal_reason(F.col("subject"), F.col("said"), o, F.col("alone")))
        .when(kind != "entity", "invalid_object_kind")
    )
    return rows.select("triple_id", reason.alias("reason_code"))


def _penalty(reason: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for code, value in table.items():
        out = F.when(reason == code, value) if out is None else out.when(reason == code, value)
    return out.otherwise(other)


def claim_status(reason: Column) -> Column:
    return F.when(reason.isNull(), "active").when(reason.isin(*QUARANTINED), "quarantined").when(reason.isin(*REJECTED), "rejected").otherwise("needs_review")


def claims(judged: DataFrame) -> DataFrame:
    """Judged facts as claims with status and score."""
    bounded = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    own = F.col("confidence") * 0.85 + F.when(F.col("object_kind") == "entity", 0.08).otherwise(0.04)
    score = F.when(F.col("reason_code").isNull(), bounded(own)).otherwise(bounded(F.col("confidence") - _penalty(F.col("reason_code"), PENALTIES, 0.15)))
    return judged.withColumn("claim_status", claim_status(F.col("reason_code"))).withColumn("quality_score", F.round(score, 6))


def backfill_claims(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims of active facts and of old reviews, which have penalties of their own."""
    bounded = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    one = active(facts).select(F.concat(F.lit("mc-active-"), "triple_id").alias("claim_id"), F.round(bounded(F.col("confidence")), 6).alias("quality_score"), F.lit("active").alias("status"))
    decided = F.col("status")
    status = F.when(decided == "approved", "active").when(decided == "dismissed", "rejected").when(decided == "rewritten", "superseded").otherwise(claim_status(F.col("reason_code")))
    two = reviews.select(F.concat(F.lit("mc-"), "fingerprint").alias("claim_id"), F.round(F.greatest(F.lit(0.0), F.col("confidence") - _penalty(F.col("reason_code"), OLD_PENALTIES, 0.20)), 6).alias("quality_score"), status.alias("status"))
    return one.unionByName(two)


def _merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """old with new rows by key: a row of both follows the rules by column (of the old and the new value); without a rule the new value stands.

    New rows come one a key. Both sides are aggregated by key, so there is one shuffle and no join.
    """
    columns = [c for c in old.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.lit(name).alias("side"), F.struct(*columns).alias("v"))
    both = side(old, "old").unionByName(side(new, "new")).groupBy(*keys).agg(*[F.max(F.when(F.col("side") == name, F.col("v"))).alias(name) for name in ("old", "new")])
    value = lambda c: rules[c](F.col(f"old.{c}"), F.col(f"new.{c}")) if c in rules else F.col(f"new.{c}")
    made = [F.when(F.col("old").isNull(), F.col(f"new.{c}")).when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(value(c)).alias(c) for c in columns]
    return both.select(*keys, *made).select(*old.columns)


_OLD, _MAX, _MIN = (lambda a, b: a), (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases by alias: id and label follow the new row, the best confidence and the first source and time of creation stay. Rows without alias or id are left out."""
    good = new.withColumn("alias", X.clean_label(F.col("alias"))).where((F.col("alias") != "") & (F.col("canonical_id") != ""))
    last = good.groupBy("alias").agg(F.max_by(F.struct(*[c for c in good.columns if c != "alias"]), F.struct("confidence", "canonical_id")).alias("v")).select("alias", "v.*")
    return _merged(old, last.select(*old.columns), ["alias"], {"confidence": _MAX, "source": _OLD, "created_at_ms": _OLD})


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after an upsert: best confidence, widest time span; a name stays unless it was only the id."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    named = F.when(F.col("name") != F.col("entity_id"), F.struct("age", "name"))
    return both.groupBy("entity_id").agg(F.max("confidence").alias("confidence"), F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"), F.coalesce(F.min(named)["name"], F.first("entity_id")).alias("name"))


def entity_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, status) after an upsert: a candidate becomes active, any other status stays."""
    return _merged(old.select("entity_id", "status"), new.select("entity_id", F.lit("active").alias("status")).distinct(), ["entity_id"], {"status": lambda a, b: F.when(a == "candidate", "active").otherwise(a)})


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by id: all follows the new row, which is active; the number of evidence rows and the time of creation stay."""
    return _merged(old, new, ["edge_id"], {"evidence_count": _OLD, "created_at_ms": _OLD, "status": lambda a, b: F.lit("active")})


def upsert_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence by fact: all but the id follows the new row."""
    return _merged(old, new, ["triple_id"], {"evidence_id": _OLD})


def upsert_claims(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims by fingerprint. An active new claim takes over and ends its review; another keeps the status that a user approved.

    claim_id, user_approved, evidence_count, created_at_ms and, of claims that stay inactive, activated_at_ms are the old row's.
    """
    activates = "new.status"
    takes = lambda a, b: F.when(F.col(activates) == "active", b).otherwise(a)
    return _merged(old, new, ["fingerprint"], {
        "claim_id": _OLD, "user_approved": _OLD, "created_at_ms": _OLD, "activated_at_ms": takes, "evidence_count": takes, "review_id": lambda a, b: F.when(F.col(activates) != "active", b),
        "status": lambda a, b: F.when(b == "active", b).when(F.col("old.user_approved"), a).otherwise(b),
    })


def upsert_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews by fingerprint: all follows the new row but the id, the cluster, the time of creation and the status, which a decision keeps for good."""
    return _merged(old, new, ["fingerprint"], {"review_id": _OLD, "cluster_id": _OLD, "created_at_ms": _OLD, "status": _OLD})


def split_request(spark: SparkSession, op_id: str, entity_id: str, parts: list[str], now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The operation and the revision row that a request to split an entity writes."""
    told = json.dumps({"op_id": op_id, "parts": parts})
    op = spark.createDataFrame([(op_id, "split", entity_id, told, now_ms)], "op_id string, op_kind string, entity_id string, payload_json string, created_at_ms long")
    revision = spark.createDataFrame([(f"rev-{op_id}", "entity_split_requested", "entity", entity_id, told, now_ms)], "revision_id string, revision_kind string, target_kind string, previous_id string, metadata_json string, created_at_ms long")
    return op, revision


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(100)).otherwise(F.least(F.lit(100), F.floor(100 * part / whole))).cast("long")


def coverage(episodes: DataFrame, clusters: DataFrame, members: DataFrame, abstractions: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of counters and coverage shares; each table is aggregated once."""
    live = active(episodes)
    one = live.agg(F.count("*").alias("active_episodes"))
    two = members.join(live.select("memory_id"), "memory_id").agg(F.countDistinct("memory_id").alias("clustered_episodes"))
    three = clusters.agg(F.count("*").alias("clusters"))
    four = abstractions.agg(F.count("*").alias("abstractions"), F.countDistinct("cluster_id").alias("abstraction_covered"))
    five = clusters.join(abstractions, "cluster_id", "left_anti").agg(F.count("*").alias("pending_clusters"))
    six = active(facts).agg(F.count("*").alias("triples"), F.countDistinct("cluster_id").alias("graph_covered"))
    row = one.crossJoin(two).crossJoin(three).crossJoin(four).crossJoin(five).crossJoin(six)  # one row each
    return row.withColumn("cluster_percent", percent(F.col("clustered_episodes"), F.col("active_episodes"))).withColumn("abstraction_percent", percent(F.col("abstraction_covered"), F.col("clusters"))).withColumn("graph_percent", percent(F.col("graph_covered"), F.col("clusters")))


def needs_catch_up(row: dict, least: int) -> bool:
    """Whether a start-up should build the derived layers: enough episodes, no facts, clusters or abstractions behind."""
    return row["active_episodes"] >= least and row["triples"] == 0 and (row["clusters"] == 0 or row["abstractions"] < row["clusters"])


SAMPLES = 8


def totals(episodes: DataFrame, clusters: DataFrame, members: DataFrame, abstractions: DataFrame, facts: DataFrame, contradictions: DataFrame, reviews: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: the ten counters of the quality audit; each table is aggregated once. labels: a row an entity that active facts name, if there is such a table already."""
    live = active(episodes)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    kind = lambda k, name: F.count_if(F.col("object_kind") == k).alias(name)
    mentioned = F.explode(F.array_compact(F.array("subject_id", F.when(F.col("object_kind") == "entity", F.col("object_id")))))
    f = active(facts).agg(F.count("*").alias("active_triples"), kind("entity", "entity_triples"), kind("literal", "literal_triples"))
    row = count(live, "active_episodes").crossJoin(members.join(live.select("memory_id"), "memory_id").agg(F.countDistinct("memory_id").alias("clustered_episodes")))
    row = row.crossJoin(count(clusters, "clusters")).crossJoin(count(abstractions, "abstractions")).crossJoin(f).crossJoin(count(reviews.where("status = 'needs_review'"), "triple_reviews_needs_review"))
    named = active(facts).select(mentioned.alias("e")).distinct() if labels is None else labels
    return row.crossJoin(count(named, "distinct_entities")).crossJoin(count(contradictions, "contradictions"))  # one row each


def _fact_sample() -> Column:
    return F.concat(F.col("subject_id"), F.lit(" --"), F.col("predicate"), F.lit("--> "), X.ellipsis(F.col("object_id"), 120, "...", False), F.format_string(" [%s %.2f] (%s)", "object_kind", "confidence", "triple_id"))


def _found(rows: DataFrame, codes: list[tuple[str, Column, Column]], newest: Column, name: Column) -> DataFrame:
    """(code, n, samples): how many rows pass each (code, test, sample), and the first SAMPLES of them in the order newest, name; codes that none passes are left out.

    Rows are counted for all codes at once. The first of a code are a bounded heap a task, so no task sorts what passes.
    """
    told = F.array(*[F.struct(F.lit(code).alias("code"), F.count_if(test).alias("n")) for code, test, _ in codes])
    counts = rows.agg(told.alias("c")).select(F.explode("c").alias("c")).select("c.*").where("n > 0")
    order = [F.desc("newest"), "name", "sample"]
    parts = []
    for code, test, sample in codes:
        first = rows.where(test).select(newest.cast("long").alias("newest"), name.cast("string").alias("name"), sample.alias("sample")).orderBy(*order).limit(SAMPLES)
        few = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(code)).orderBy(*order)))  # at most SAMPLES rows
        parts.append(few.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample"))), lambda x: x["sample"]).alias("samples")).select(F.lit(code).alias("code"), "samples"))
    return counts.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "code")  # a row a code


# Severities of the issue codes.
SEVERITIES = {
    "no_clusters": "warning", "triple_review_queue": "warning", "no_active_triples": "info", "unclustered_episodes": "info", "literal_fact_dominance": "warning", "long_literal_objects": "warning",
    "low_confidence_facts": "warning", "entity_triples_without_source_episode": "warning", "literal_only_entities": "warning", "possible_entity_aliases": "warning", "path_like_entities": "warning",
    "commit_like_entities": "warning", "machine_identifier_entities": "info", "low_coherence_clusters": "warning", "clusters_missing_abstractions": "warning", "low_signal_abstractions": "critical",
}


def audit(episodes: DataFrame, clusters: DataFrame, members: DataFrame, abstractions: DataFrame, facts: DataFrame, contradictions: DataFrame, reviews: DataFrame, low_confidence: float = 0.85, low_coherence: float = 0.72, long_literal: int = 160) -> DataFrame:
    """Issues (severity, code, n, samples) that the stored memory has; codes without findings are left out.

    Active facts are kept once, narrow, and so are the entities they name, alias groups, clusters and the totals; what is found in
    each of them is counted together, and sampled by code.
    """
    long_literal = max(20, min(long_literal, 500))
    live = keep(active(facts).select("triple_id", "subject_id", "predicate", "object_id", "object_kind", "confidence", "valid_from_ms", "source_episode_id", "status"), "audit-facts")
    literal, entity = F.col("object_kind") == "literal", F.col("object_kind") == "entity"
    fact_codes = [("literal_fact_dominance", literal), ("long_literal_objects", literal & (F.char_length("object_id") > long_literal)), ("low_confidence_facts", F.col("confidence") < low_confidence), ("entity_triples_without_source_episode", entity & F.col("source_episode_id").isNull())]
    by_fact = _found(live, [(code, test, _fact_sample()) for code, test in fact_codes], F.col("valid_from_ms"), F.col("triple_id"))
    named = F.explode(F.array_compact(F.array(F.struct(F.col("subject_id").alias("id"), entity.alias("edge")), F.when(entity, F.struct(F.col("object_id").alias("id"), F.lit(True).alias("edge"))))))
    labels = keep(live.select(named.alias("x")).groupBy(F.col("x.id").alias("entity_id")).agg(F.count("*").alias("refs"), F.max("x.edge").alias("linked")), "audit-labels")
    e, none = F.col("entity_id"), F.lit(0)
    label_codes = [("path_like_entities", X.audit_path_or_url(e), e), ("commit_like_entities", X.audit_commit(e), e), ("machine_identifier_entities", X.machine_identifier(e), e), ("literal_only_entities", ~F.col("linked"), F.format_string("%s (%d fact refs)", e, F.col("refs")))]
    by_label = _found(labels, label_codes, none, e)
    aliases = _found(keep(alias_groups(labels), "audit-aliases"), [("possible_entity_aliases", F.lit(True), F.replace("labels", F.lit("|"), F.lit(" | ")))], none, F.col("canonical_key"))
    counted = members.join(active(episodes).select("memory_id"), "memory_id").groupBy("cluster_id").agg(F.count("*").alias("n"))
    c = clusters.join(counted, "cluster_id", "left").join(abstractions.select("cluster_id", "content"), "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = F.concat(F.format_string("%s coherence=%.3f episodes=%d ", "cluster_id", "coherence", "n"), F.coalesce(X.ellipsis(F.col("content"), 140, "...", False), F.lit("no abstraction")))
    cluster_codes = [("low_coherence_clusters", F.col("coherence") < low_coherence), ("clusters_missing_abstractions", (F.col("n") > 0) & F.col("content").isNull()), ("low_signal_abstractions", X.low_signal(F.col("content")))]
    by_cluster = _found(keep(c, "audit-clusters"), [(code, test, told) for code, test in cluster_codes], F.col("created_at_ms"), F.col("cluster_id"))
    waiting = F.concat(F.col("reason_code"), F.lit(": "), F.concat_ws(" ", "subject_id", "predicate", "object_id"))
    queue = _found(reviews.where("status = 'needs_review'"), [("triple_review_queue", F.lit(True), waiting)], F.col("created_at_ms"), F.col("review_id"))
    hits = by_fact
    for more in (by_label, aliases, by_cluster, queue):
        hits = hits.unionByName(more)
    row = keep(totals(episodes, clusters, members, abstractions, live, contradictions, reviews, labels), "audit-totals")
    issue = lambda code, n, test: F.when(test, F.struct(F.lit(code).alias("code"), n.cast("long").alias("n"), F.array().cast("array<string>").alias("samples")))
    rest = F.col("active_episodes") - F.col("clustered_episodes")
    summary = F.array_compact(F.array(issue("no_clusters", F.col("active_episodes"), (F.col("active_episodes") > 0) & (F.col("clusters") == 0)), issue("no_active_triples", F.lit(0), F.col("active_triples") == 0), issue("unclustered_episodes", rest, rest > 0)))
    out = row.select(F.explode(summary).alias("i")).select("i.*").unionByName(hits)
    dominant = (F.col("active_triples") >= 10) & (F.col("literal_triples") >= 0.7 * F.col("active_triples"))
    judged = out.join(F.broadcast(row.select(dominant.alias("dominant"))))  # one row
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.col("code"))
    return judged.where((F.col("code") != "literal_fact_dominance") | F.col("dominant")).select(severity.alias("severity"), "code", "n", "samples")


def health(issues: DataFrame) -> DataFrame:
    """Score and grade of a set of issues."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counted = issues.agg(n("critical").alias("critical"), n("warning").alias("warnings"), n("info").alias("infos"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("critical") * 20 - F.col("warnings") * 7 - F.col("infos") * 2)).cast("long")
    scored = counted.withColumn("score", score)
    return scored.withColumn("grade", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 60, "needs_review").otherwise("weak"))
