"""Abstractions and contradiction verdicts by an external model, which callers inject."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import LOW_SIGNAL, extraction_reason, low_signal

#: Kinds that a verdict may have (fixed values); any other is "other".
KINDS = ("direct", "temporal", "partial", "other")

Client = Callable[[str], str]


def reply_json(reply: str) -> dict | None:
    """The JSON object of a reply, fenced or bare; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.DOTALL)
    bare = re.search(r"\{.*\}", reply, re.DOTALL)
    for found in (fenced and fenced[1], bare and bare[0]):
        if found:
            try:
                value = json.loads(found)
            except ValueError:
                continue
            if isinstance(value, dict):
                return value
    return None


def facts_of(value: dict) -> list[tuple[str, str, str, str]]:
    """Facts of a reply with subject, predicate, object and kind; incomplete ones are left out."""
    out = []
    for t in value.get("triples") or []:
        if not isinstance(t, dict):
            continue
        s, p, o = (str(t.get(k) or t.get(f"{k}_id") or "").strip() for k in ("subject", "predicate", "object"))
        if s and p and o:
            out.append((s, p, o, "entity" if t.get("object_kind") == "entity" else "literal"))
    return out


def stub_client(prompt: str) -> str:
    """A deterministic stand-in for a model: repeats the first line that it is asked about."""
    first = prompt.split("\n")[1] if "\n" in prompt else prompt
    return json.dumps({"content": f"About: {first[:60]}", "triples": [{"subject": "cluster", "predicate": "mentions", "object": first[:40] or "nothing"}]})


def pending(clusters: DataFrame, abstractions: DataFrame, limit: int) -> DataFrame:
    """Clusters without an abstraction, or with one that says nothing; oldest id first."""
    good = abstractions.where(F.col("content").isNotNull() & ~low_signal(F.col("content")))
    return clusters.join(good.select("cluster_id").distinct(), "cluster_id", "left_anti").orderBy("cluster_id").limit(limit)


def abstract(clusters: DataFrame, client: Callable[[], Client], now_ms: int, confidence: float = 0.9) -> DataFrame:
    """(cluster_id, content, subject_id, predicate, object_id, object_kind, valid_from_ms, confidence, error), a row a fact.

    clusters: cluster_id and texts (array). client() makes the model's function on an executor. A reply without
    JSON is asked for once more; content that says nothing is an error. Facts hold from now on, without end.
    """

    def run(batches):
        ask = client()
        for batch in batches:
            rows = []
            for i, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prompt = "Summarise:\n" + "\n".join(t for t in texts or [] if t)
                value = reply_json(ask(prompt)) or reply_json(ask(f"{prompt}\nReply with one JSON object."))
                content = str((value or {}).get("content") or "").strip()
                if not content or any(p in content.lower() for p in LOW_SIGNAL):
                    rows.append((i, None, None, None, None, None, None, None, "no usable content"))
                    continue
                made = facts_of(value) or [(None, None, None, None)]
                rows += [(i, content, *f, now_ms if f[0] else None, confidence if f[0] else None, None) for f in made]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
            names = ["cluster_id", "content", "subject_id", "predicate", "object_id", "object_kind", "valid_from_ms", "confidence", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=names)

    made = clusters.select(F.col("cluster_id").cast("string"), "texts").mapInArrow(run, "cluster_id string, content string, subject_id string, predicate string, object_id string, object_kind string, valid_from_ms long, confidence double, error string")
    return without_weak_facts(made)


def without_weak_facts(made: DataFrame) -> DataFrame:
    """Rows of abstract() without the facts that are dropped at once; a cluster that loses all its facts keeps its content."""
    fact = F.col("subject_id").isNotNull()
    weak = fact & extraction_reason(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("object_kind")).isNotNull()
    parts = ("subject_id", "predicate", "object_id", "object_kind", "valid_from_ms", "confidence")
    bare = made.select("cluster_id", "content", *[F.when(~weak, F.col(c)).alias(c) for c in parts], "error", (fact & ~weak).alias("good"), weak.alias("weak"))
    whole = Window.partitionBy("cluster_id")
    first = F.row_number().over(whole.orderBy("content", "subject_id", "predicate", "object_id"))
    placed = bare.withColumn("any", F.max("good").over(whole)).withColumn("place", first)
    return placed.where(~F.col("weak") | (~F.col("any") & (F.col("place") == 1))).drop("good", "weak", "any", "place")


def judge(pairs: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """(a_triple_id, b_triple_id, kind, explanation) of the candidate pairs that the model calls contradictions.

    A bad reply is no contradiction, an unknown kind is "other", and an empty explanation is filled in.
    """

    def run(batches):
        ask = client()
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = reply_json(ask(f"Do these contradict?\n{x}\n{y}")) or {}
                if value.get("contradiction") is True:
                    kind = value.get("kind") if value.get("kind") in KINDS else "other"
                    rows.append((a, b, kind, str(value.get("explanation") or "").strip() or f"{x} conflicts with {y}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], names=["a_triple_id", "b_triple_id", "kind", "explanation"])

    return pairs.select("a_triple_id", "b_triple_id", "a_fact", "b_fact").mapInArrow(run, "a_triple_id string, b_triple_id string, kind string, explanation string")
