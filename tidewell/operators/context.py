"""The context bundle: several sections, each on its own, their states, and the log row of a retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections that extraction by a model feeds.
EXTRACTED = ("entities", "facts", "contradictions", "graph")


def section_health(rows: int | None, source: int, enabled: bool = True) -> str:
    """State of a section: rows it gave (None: it failed) and rows of what it is made from."""
    if not enabled:
        return "disabled"
    if rows is None:
        return "failed"
    return "ready" if rows else "pending" if source else "empty"


def section_states(counts: dict[str, int | None], coverage: dict[str, int], has_model: bool, subject: bool) -> dict[str, str]:
    """States of the context's sections, by the rows they gave (None: failed) and the counters of coverage().

    Themes wait for clusters. What a model extracts is off without one, unless something is there already, and
    waits while clusters are pending. Facts are only asked for with a subject.
    """
    plain = lambda n: "ready" if n else "empty"
    known = any(coverage.get(k, 0) for k in ("abstractions", "triples", "contradictions"))
    out = {}
    for name, n in counts.items():
        if n is None:
            out[name] = "failed"
        elif name == "themes":
            out[name] = "empty" if not coverage["active_episodes"] else "pending" if not coverage["clusters"] else plain(n)
        elif name in EXTRACTED:
            if name == "facts" and not subject:
                out[name] = "empty"
            elif not has_model:
                out[name] = plain(n) if known or n else "disabled"
            else:
                out[name] = "pending" if coverage["pending_clusters"] else plain(n)
        else:
            out[name] = plain(n)
    return out


def bundle(sections: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | None]:
    """Sections by name, each a bounded list, read once; one that fails is None and leaves the others whole."""
    found: dict[str, DataFrame | None] = {}
    for name, make in sections.items():
        try:
            df = make()
            found[name] = df.sparkSession.createDataFrame(df.collect(), df.schema)  # every section has a limit
        except Exception:  # noqa: BLE001 - any failure is that section's own
            found[name] = None
    return found


def resolved_subject(subject: str | None, entities: DataFrame | None) -> str | None:
    """The entity that a subject means: the one of its name, whatever the case, else the first found, else itself."""
    if not subject or entities is None:
        return subject
    ids = [r["entity_id"] for r in entities.select("entity_id").collect()]  # a page
    return next((i for i in ids if i.lower() == subject.lower()), ids[0] if ids else subject)


def seeds(subject: str | None, entities: DataFrame | None, limit: int) -> list[str]:
    """Entities that the graph sections start from: the subject, then those found, eight at most."""
    most = max(1, min(limit, 8))
    ids = [] if entities is None else [r["entity_id"] for r in entities.select("entity_id").limit(most).collect()]
    return list(dict.fromkeys([*([subject] if subject else []), *ids]))[:most]


def reason_codes(found: dict[str, DataFrame | None]) -> list[str]:
    """Why a bundle holds what it holds, each code once."""
    some = {k: v is not None and v.limit(1).count() > 0 for k, v in found.items()}
    recall = found.get("recall")
    by_words = some.get("recall", False) and recall.where(F.col("score").isNotNull()).limit(1).count() > 0
    tests = {
        "memory_context": True, "semantic_match": some.get("recall"), "lexical_match": by_words, "graph_neighbor": some.get("graph") or some.get("paths"),
        "subject_fact": some.get("facts"), "recent_theme": some.get("themes"), "contradiction_warning": some.get("contradictions") or some.get("warnings"),
    }
    return [code for code, holds in tests.items() if holds]


def recalled_ids(found: dict[str, DataFrame | None]) -> list[str]:
    """Ids of the memories recalled, then of the facts and of the paths' edges, each once."""
    rows = lambda name, c: [] if found.get(name) is None else [r[c] for r in found[name].select(c).collect()]
    return list(dict.fromkeys([*rows("recall", "memory_id"), *rows("graph", "edge_id"), *[i for e in rows("paths", "edge_ids") for i in e.split(" ")]]))


def retrieval_log(spark: SparkSession, query: str, now_ms: int, memory_ids: list[str], reasons: list[str]) -> DataFrame:
    """A log row: ids and reasons once each, in order of first appearance."""
    row = [(query, now_ms, memory_ids, reasons)]
    df = spark.createDataFrame(row, "query string, ts_ms long, memory_ids array<string>, reason_codes array<string>")
    return df.select("query", "ts_ms", F.array_distinct("memory_ids").alias("memory_ids"), F.array_distinct("reason_codes").alias("reason_codes"))
