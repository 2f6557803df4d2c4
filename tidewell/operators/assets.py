"""Assets, their links to documents and memories, bookmarks as JSON, and log lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linked(documents: DataFrame, assets: DataFrame, links: DataFrame) -> DataFrame:
    """Documents with each of their assets: links (doc_id, asset_id) join both."""
    return links.join(documents.select("doc_id", "source"), "doc_id").join(assets.select("asset_id", "sha256", "byte_size"), "asset_id").select("doc_id", "source", "asset_id", "sha256", "byte_size")


def listing(assets: DataFrame, limit: int = 20, offset: int = 0, deleted: bool = False) -> DataFrame:
    """Active assets (asset_id, status, created_at_ms, other columns), newest first, ties by asset_id; deleted: all assets."""
    rows = assets if deleted else assets.where("status = 'active'")
    return rows.orderBy(F.desc("created_at_ms"), "asset_id").offset(offset).limit(max(1, min(limit, 100)))


def inspect(asset_id, assets: DataFrame, extractions: DataFrame, links: DataFrame, attached: DataFrame) -> DataFrame:
    """The asset of an id, whatever its status, with its extractions, document links and memory attachments as arrays, newest first; no row if there is none.

    Each table is filtered by the id before it is grouped.
    """
    of = lambda df: df.where(F.col("asset_id") == asset_id)

    def newest_first(df: DataFrame, name: str, ties: list[str]) -> DataFrame:
        others = [c for c in df.columns if c not in ("asset_id", "created_at_ms", *ties)]
        row = F.struct((-F.col("created_at_ms")).alias("age"), *ties, *others)
        plain = lambda x: F.struct(*[x[c].alias(c) for c in (*ties, *others)], (-x["age"]).alias("created_at_ms"))
        return of(df).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(row)), plain).alias(name))

    out = of(assets)
    for df, name, ties in ((extractions, "extractions", ["extractor_name", "extractor_version"]), (links, "document_links", ["link_id"]), (attached, "memory_attachments", ["attachment_id"])):
        found = newest_first(df, name, ties)
        out = out.join(found, "asset_id", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    return out


def _own_key(key: str, row: str) -> Column:
    """key as text; where it is null, one of the row's own that no key equals, so that rows without a key don't meet in one task."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("none:"), F.xxhash64(row).cast("string")))


def attachments(rows: DataFrame, episodes: DataFrame, documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Attachments of episodes: to a document or to an asset (ids are numbers)."""
    found = rows.join(episodes.select("memory_id", "ts_ms"), "memory_id")
    for key, own in (("doc_id", documents.select("doc_id", "source")), ("asset_id", assets.select("asset_id", "sha256"))):
        keyed = own.where(F.col(key).isNotNull()).withColumn("__key", F.col(key).cast("string")).drop(key)
        found = found.withColumn("__key", _own_key(key, "attachment_id")).join(keyed, "__key", "left").drop("__key")
    return found.select("attachment_id", "memory_id", "ts_ms", "doc_id", "source", "asset_id", "sha256")


def referenced(assets: DataFrame, links: DataFrame) -> DataFrame:
    """Assets that some link names."""
    return assets.join(links.select("asset_id"), "asset_id", "left_semi")


def newest(episodes: DataFrame, documents: DataFrame, assets: DataFrame, counts: tuple[int, int, int] = (50, 100, 100)) -> DataFrame:
    """The newest resources of each kind: (kind, id)."""
    one = episodes.where("status = 'active'").orderBy(F.desc("ts_ms"), F.desc("rowid")).limit(counts[0]).select(F.lit("episode").alias("kind"), F.col("memory_id").alias("id"))
    two = documents.orderBy(F.desc("doc_id")).limit(counts[1]).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    three = assets.orderBy(F.desc("asset_id")).limit(counts[2]).select(F.lit("asset").alias("kind"), F.col("asset_id").cast("string").alias("id"))
    return one.unionByName(two).unionByName(three)


def bookmarks_of(value, folders: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str | None]]:
    """(url, title, folder) of nested bookmark JSON, in its own order."""
    if isinstance(value, list):
        for item in value:
            yield from bookmarks_of(item, folders)
    elif isinstance(value, dict):
        title = " ".join(str(value.get("title") or value.get("name") or "Untitled bookmark").split()) or "Untitled"
        url = value.get("url") or value.get("uri")
        if isinstance(url, str):
            yield url, title, "/".join(folders) or None
        inside = (*folders, title) if isinstance(value.get("children"), list) and not url else folders
        if "children" in value or "roots" in value:
            yield from bookmarks_of(value.get("children"), inside)
            yield from bookmarks_of(value.get("roots"), inside)
        elif not url:
            for child in value.values():
                yield from bookmarks_of(child, folders)


def bookmarks(exports: DataFrame, json_col: str = "json") -> DataFrame:
    """(url, title, folder) of rows of bookmark exports; one that is no JSON gives nothing."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    rows += bookmarks_of(json.loads(raw or "null"))
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 3)], names=["url", "title", "folder"])

    return exports.select(json_col).mapInArrow(run, "url string, title string, folder string")


def _plain(line: Column) -> Column:
    return F.regexp_replace(line, "\u001b\\[[0-9;]*[A-Za-z]", "")


def log_line(line: Column) -> Column:
    """A log line without colour codes and secrets."""
    out = F.regexp_replace(_plain(line), r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)[^\s,;]+", "$1$2[redacted]")
    return F.regexp_replace(out, r"(?i)(--(?:api-?key|token|secret|password))\s+\S+", "$1 [redacted]")


def log_level(line: Column) -> Column:
    """The level that a line names, else info."""
    found = F.upper(F.regexp_extract(_plain(line), r"(?i)\b(error|warn(?:ing)?|info|debug|trace)\b", 1))
    return F.when(found == "", "info").when(found.startswith("WARN"), "warn").otherwise(F.lower(found))
