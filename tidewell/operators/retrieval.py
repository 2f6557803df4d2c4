"""Hybrid retrieval: vector and lexical candidates merged by reciprocal ranks and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import query_terms
from tidewell.functions.vectors import cosine
from tidewell.operators import lexical

RRF_K = 60
DAY_MS = 86_400_000


def candidate_budget(limit: int) -> int:
    return max(limit, min(4 * limit, 200))


def ranked(candidates: DataFrame, order: list, name: str) -> DataFrame:
    """candidates with their place in the order; they are few, as both lists are cut to a budget."""
    return candidates.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1 / (RRF_K + rank), F.lit(0.0))


def vector_candidates(vectors: DataFrame, query: list[float], budget: int) -> DataFrame:
    """(id, kind, distance, vector_rank) among vectors (id, kind, embedding): ranks count all kinds."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.select("id", "kind", F.round(1 - cosine(F.col("embedding"), q), 6).alias("distance")).orderBy("distance", "id").limit(budget)
    return ranked(near, ["distance", "id"], "vector_rank")


def lexical_candidates(rows: DataFrame, query: str, id_col: str, text_col: str, budget: int, stemmed: bool = False) -> DataFrame:
    return ranked(lexical.best(rows, query, id_col, text_col, budget, stemmed), ["score", "id"], "lexical_rank")


def fuse(vector: DataFrame, words: DataFrame) -> DataFrame:
    """Both lists by id, with rrf_score; a row may be in either or both."""
    both = vector.join(words, "id", "full")
    return both.withColumn("rrf_score", reciprocal(F.col("vector_rank")) + reciprocal(F.col("lexical_rank")))


def signals(query: str, now_ms: int) -> Column:
    """What an episode's own columns add to its score."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    age = F.lit(now_ms) - F.col("ts_ms")
    terms = query_terms(query)
    context = F.lower(F.coalesce("context_json", F.lit("")))
    spoken = F.lit(False)
    for t in terms:
        spoken = spoken | F.contains(context, F.lit(t))
    return (
        unit("salience") * 0.012
        + unit("strength") * 0.008
        + F.when(F.col("tier") == "hot", 0.006).when(F.col("tier") == "warm", 0.003).otherwise(0.0)
        + F.when(age <= 7 * DAY_MS, 0.006).when(age <= 30 * DAY_MS, 0.003).otherwise(0.0)
        + F.when(spoken, 0.006).otherwise(0.0)
    )


def recall(episodes: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int, now_ms: int, stemmed: bool = False) -> DataFrame:
    """Episodes for a query: (rowid, memory_id, distance, score, fused_score), best first.

    Lexical candidates are active before their list is cut, vector candidates are checked after; ranks of
    the vector list count chunks as well, which are dropped then.
    """
    budget = candidate_budget(limit)
    active = episodes.where("status = 'active'")
    by_vector = vector_candidates(vectors, query_vector, budget).where("kind = 'episode'").drop("kind")
    by_words = lexical_candidates(active, query, "rowid", "content", budget, stemmed)
    found = fuse(by_vector, by_words).withColumnRenamed("id", "rowid")
    rows = active.join(F.broadcast(found), "rowid")  # at most twice the budget
    scored = rows.select("rowid", "memory_id", F.coalesce("distance", F.lit(1.0)).alias("distance"), "score", F.round(F.col("rrf_score") + signals(query, now_ms), 6).alias("fused_score"))
    return scored.orderBy(F.desc("fused_score"), "distance", "rowid").limit(limit)


def search_chunks(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int) -> DataFrame:
    """Document chunks (id, doc_id, chunk_index, text) for a query: like recall, without signals."""
    budget = candidate_budget(limit)
    by_vector = vector_candidates(vectors, query_vector, budget).where("kind = 'chunk'").drop("kind")
    by_words = lexical_candidates(chunks, query, "id", "text", budget)
    found = fuse(by_vector, by_words)
    rows = chunks.drop("text").join(F.broadcast(found), "id")
    scored = rows.select("id", "doc_id", "chunk_index", F.coalesce("distance", F.lit(1.0)).alias("distance"), "score", F.round("rrf_score", 6).alias("fused_score"))
    return scored.orderBy(F.desc("fused_score"), "distance", "chunk_index", "id").limit(limit)


def project_search(episodes: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], project: str, limit: int, now_ms: int) -> DataFrame:
    """Recall among a project's decisions: a larger recall, then the scope, then the limit."""
    wide = recall(episodes, vectors, query, query_vector, max(4 * limit, 50), now_ms)
    own = episodes.select("rowid", project_scope(F.col("source_id"), F.col("context_json"), F.col("content"), project).alias("inside"))
    return wide.join(own.where("inside"), "rowid").drop("inside").orderBy(F.desc("fused_score"), "distance", "rowid").limit(limit)


def project_scope(source_id: Column, context_json: Column, content: Column, project: str) -> Column:
    """Whether a decision belongs to a project: by its source id, else its context, else its own words."""
    source = F.coalesce(source_id, F.lit(""))
    named = F.coalesce(F.get_json_object(context_json, "$.extra.project_id"), F.get_json_object(context_json, "$.project_id"))
    structured = (source.startswith("project:") & F.contains(source, F.lit(":decision:"))) | named.isNotNull()
    told = content.startswith("Project decision for ") & (F.contains(content, F.lit(f"(id: {project},")) | F.contains(content, F.lit(f"(id: {project}):")))
    return source.startswith(f"project:{project}:decision:") | F.coalesce(named == project, F.lit(False)) | (~structured & told)
