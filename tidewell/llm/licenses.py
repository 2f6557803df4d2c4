"""License scan by ordered signature rules: hundreds of regular expressions behind a keyword prefilter.

A text's words (lower case, one space between) are what the rules are matched against, so comment
marks, line breaks and punctuation don't matter. The prefilter: from each rule's expression the words are
derived that every match contains; a rule runs only over texts that hold all of them, so nearly all
texts run none. Each match is a detection (rule, first word, end). Overlaps are resolved in two steps:
a detection that lies inside another, longer one is dropped (of equal intervals the earlier rule
stays), then detections are taken in the order of the rules, and one that overlaps a taken one is dropped. Rules
without a label stand for what only looks like a licence; they suppress and are then left out.

The score of a text is the weight of its strongest detection, from 0 (none) to 1 (the licence's own
words or a machine-readable tag); base phrases count too where they are suppressed.

A null or empty text has no words and no detections. Whole texts are scanned. Each row gives one row,
repeated rows and null ids too; empty tables give none. Other columns are carried as they are where asked
for, and a clash with the names that a scan adds is an error. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import need_free, sliced
from tidewell.llm.decontamination import words_of
from tidewell.llm.license_rules import ABBREVIATIONS, TABLE

WEIGHTS = {"tag": 1.0, "text": 1.0, "notice": 0.9, "url": 0.8, "title": 0.6, "base": 0.6, "mention": 0.3, "none": 0.0}


@dataclass(frozen=True)
class Rule:
    """Its place in the order, label (empty: none), kind, expression, and the words that every match contains."""

    place: int
    label: str
    kind: str
    pattern: re.Pattern
    needs: frozenset[bytes]


def needed_words(source: str) -> frozenset[bytes]:
    """Whole words that stand in every match: those outside of groups, classes and optional characters."""
    ends_in_space = re.compile(r"(^| )\((?:\?:)?(?:[^()|]* \|)*[^()|]* \)\??")  # the word behind it is whole
    begins_with_space = re.compile(r"\((?:\?:)? [^()|]*(?:\| [^()|]*)*\)\??(?= |$)")  # the word before it is whole
    source = re.sub(r"\[[^\]]*\][?*+]?|\\\w[?*+]?", "\0", source)
    while True:
        cut = begins_with_space.sub("", ends_in_space.sub(r"\1", source))
        if cut == source:
            cut = re.sub(r"\([^()]*\)[?*+]?", "\0", source)
        if cut == source:
            break
        source = cut
    source = re.sub(r".\?|\.(?:\{[\d,]*\}|[*+])?\??", "\0", source)
    return frozenset(w.encode() for w in source.split(" ") if re.fullmatch("[a-z0-9]+", w))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    out = []
    for line in TABLE.strip().splitlines():
        label, kind, source = line.split(" | ", 2)
        for short, long in ABBREVIATIONS.items():
            source = source.replace(short, long)
        needs = needed_words(source)
        if not needs:
            raise ValueError(f"no word stands in every match of {source}")
        out.append(Rule(len(out), "" if label == "none" else label, kind, re.compile(rf"(?<![^ ])(?:{source})(?![^ ])".encode()), needs))
    return tuple(out)


@functools.cache
def gates() -> tuple[frozenset[bytes], dict[bytes, tuple[Rule, ...]]]:
    """All words that rules need, and the rules by one of their words: the longest, as long words are rare."""
    by: dict[bytes, list[Rule]] = {}
    for r in rules():
        by.setdefault(max(r.needs, key=lambda w: (len(w), w)), []).append(r)
    return frozenset().union(*(r.needs for r in rules())), {w: tuple(found) for w, found in by.items()}


Detection = tuple[int, int, Rule]


def detect(words: list[bytes]) -> list[Detection]:
    """All matches as (first word, word after the last, rule), unresolved."""
    every, by = gates()
    present = every.intersection(words)
    asked = [r for w in present for r in by.get(w, ()) if r.needs <= present]
    if not asked:
        return []
    joined, out, starts = b" ".join(words), [], None
    for r in asked:
        for m in r.pattern.finditer(joined):
            if starts is None:
                starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
            out.append((bisect_left(starts, m.start()), bisect_right(starts, m.end() - 1), r))
    return out


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections without those inside longer ones, and without overlaps: earlier rules win. In the order of the text."""
    outer, reach = [], -1
    for d in sorted(found, key=lambda d: (d[0], -d[1], d[2].place)):
        if d[1] > reach:  # sorted so that what holds it comes before it
            outer.append(d)
            reach = d[1]
    # Starts and ends both rise in outer, so overlaps of a taken one are its neighbours.
    state = [0] * len(outer)  # 1: taken, 2: dropped
    for i in sorted(range(len(outer)), key=lambda i: (outer[i][2].place, i)):
        if state[i]:
            continue
        state[i] = 1
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(outer) and outer[min(i, j)][1] > outer[max(i, j)][0]:
                state[j] = 2
                j += step
    return [d for d, s in zip(outer, state, strict=True) if s == 1 and d[2].label]


ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
_DETECTION = "array<struct<label: string, kind: string, first_word: long, end_word: long, weight: double>>"


def scan(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row of docs its carried columns (default: doc_id), n_words, the base phrases' count, first and last start and labels, all labels, score, and the detections."""
    carry = carry if carry is not None else ["doc_id"]
    need_free(docs.select(*carry), [*ADDED, "__text"])
    named = docs.select(*carry, F.col(text_col).alias("__text"))
    kinds = ("long", "long", "long", "long", "array<string>", "array<string>", "double", _DETECTION)
    added = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(ADDED, kinds, strict=True)))
    item = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("weight", pa.float64())])
    types = (*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(item))

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for raw in batch.column(len(carry)).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                found = detect(words)
                base, kept = [d for d in found if d[2].kind == "base"], resolve(found)
                labels = {d[2].label for d in base}
                score = max((WEIGHTS[d[2].kind] for d in (*base, *kept)), default=0.0)
                told = [{"label": r.label, "kind": r.kind, "first_word": a, "end_word": b, "weight": WEIGHTS[r.kind]} for a, b, r in kept]
                rows.append((len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), sorted(labels), sorted(labels | {d[2].label for d in kept}), score, told))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *[pa.array(list(c), k) for c, k in zip(columns, types, strict=True)]], names=[*batch.schema.names[: len(carry)], *ADDED])

    return named.mapInArrow(run, T.StructType([*named.schema.fields[:-1], *added.fields]))
