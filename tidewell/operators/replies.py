"""Replies of a model read leniently into content, confidence and facts, over VARIANT values.

A reply is one JSON object, bare or in a fenced block. Content is `content`, else `summary`, else a sentence from `project` and
`tasks`; facts are the complete ones of `triples`, else the project's tasks. Only strings count as texts and only numbers as
confidence. A reply without content or facts is null, as are null and empty ones. A key that stands twice in an object makes it unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence of a reply that has none, tasks named in a sentence, tasks made facts, and how long their ids may be.
CONFIDENCE, NAMED_TASKS, MOST_TASKS, SUBJECT_CHARS, OBJECT_CHARS = 0.6, 3, 12, 80, 120


def _stripped(text: Column) -> Column:
    """Without white space at both ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _text(value: Column) -> Column:
    """The text of a string value; null for values of other types."""
    return F.when(F.schema_of_variant(value) == "STRING", _stripped(F.try_variant_get(value, "$", "string")))


def _at(value: Column, *keys: str) -> Column:
    """The value at the first of the keys that an object has, whatever its type."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{k}", "variant") for k in keys])


def _items(value: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def identifier(text: Column, chars: int) -> Column:
    """Lower-case letters and digits with single underscores between, cut to so many characters."""
    cut = F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit(chars))
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^_+|_+$", ""), F.lit("")), F.lit("item"))


def _fact(subject: Column, predicate: Column, object_: Column, kind: Column) -> Column:
    return F.struct(subject.alias("subject_id"), predicate.alias("predicate"), object_.alias("object_id"), kind.alias("object_kind"))


def _coerced(value: Column) -> Column:
    """(content, confidence, triples) of a parsed object, or null."""
    tasks = F.filter(F.transform(_items(value, "tasks"), lambda t: F.coalesce(_text(t), _text(_at(t, "description", "title", "task")))), lambda t: t.isNotNull())
    project = _text(_at(value, "project"))
    named = F.array_join(F.slice(tasks, 1, NAMED_TASKS), "; ")
    sentence = (
        F.when(project.isNotNull() & (F.size(tasks) > 0), F.concat(project, F.lit(" has recent work items: "), named, F.lit(".")))
        .when(project.isNotNull(), F.concat(F.lit("Recent memories discuss "), project, F.lit(".")))
        .when(F.size(tasks) > 0, F.concat(F.lit("Recent memories include work items: "), named, F.lit(".")))
    )
    content = F.coalesce(_text(_at(value, "content")), _text(_at(value, "summary")), sentence)
    number = _at(value, "confidence")
    given = F.when(F.schema_of_variant(number).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(number, "$", "double"))
    confidence = F.when(given.isNull(), F.lit(CONFIDENCE)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)))
    kind = lambda t: F.when(F.lower(_text(_at(t, "object_kind"))) == "entity", "entity").otherwise("literal")
    told = F.transform(_items(value, "triples"), lambda t: _fact(_text(_at(t, "subject_id", "subject")), _text(_at(t, "predicate")), _text(_at(t, "object_id", "object")), kind(t)))
    whole = F.filter(told, lambda t: t["subject_id"].isNotNull() & t["predicate"].isNotNull() & t["object_id"].isNotNull())
    worked = F.when(project.isNotNull(), F.transform(F.slice(tasks, 1, MOST_TASKS), lambda t: _fact(identifier(project, SUBJECT_CHARS), F.lit("has_task"), identifier(t, OBJECT_CHARS), F.lit("literal"))))
    triples = F.when(F.size(whole) > 0, whole).otherwise(worked)
    return F.when(F.schema_of_variant(value).startswith("OBJECT") & content.isNotNull() & (F.size(triples) > 0), F.struct(content.alias("content"), confidence.alias("confidence"), triples.alias("triples")))


def fenced(reply: Column) -> Column:
    """The first fenced block that is marked as JSON, else the first of all, from its second line on; null if there is none or it isn't closed."""
    opened = F.coalesce(F.nullif(F.instr(reply, "```json"), F.lit(0)) + 7, F.nullif(F.instr(reply, "```"), F.lit(0)) + 3)
    rest = F.substring(reply, opened, F.char_length(reply))
    body = F.substring(rest, F.instr(rest, "\n") + 1, F.char_length(reply))
    return F.when(F.instr(body, "```") > 0, F.substring_index(body, "```", 1))


def coerced(rows: DataFrame, reply: str, out: str) -> DataFrame:
    """rows with (content, confidence, triples) of each reply, or null, in column `out`. A reply is parsed once: parsed values are columns, which Catalyst doesn't inline where they are used often."""
    bare, block = f"__{out}_bare", f"__{out}_block"
    parsed = rows.select("*", F.try_parse_json(reply).alias(bare), F.try_parse_json(fenced(F.col(reply))).alias(block))
    return parsed.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(_coerced(F.col(bare)), _coerced(F.col(block))).alias(out))
