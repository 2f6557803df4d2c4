"""Chat formatting by token-level assembly.

Each turn's text is escaped and encoded by itself; the template's control strings are never
encoded but spliced in as reserved ids above the vocabulary. Token offsets are prefix sums of
the segments' lengths, and the loss mask is spread from them: it covers assistant texts only.

Template: `<s>` opens a conversation; `[INST]text[/INST]` is a user's turn, `text</s>` an
assistant's, `[SYS]text[/SYS]` a system turn, and `[ROLE]role[/ROLE]text[/TURN]` any other's.
Escaping doubles backslashes and puts one after the first character of every control string in
a text, so no content can spell one; taking each backslash away again and keeping what
follows it undoes both.

A conversation is one output row. Rows are dealt by conversation, sorted by turn within tasks,
and streamed, so a task holds the turns of one conversation and one batch at most.

Nulls: a null text or role is empty; rows without conversation id make one conversation of
null id; a null turn sorts first. Equal turns sort by role, then text; repeated rows are turns of
their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import sliced

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END, TURN_END = range(len(CONTROLS))
#: First reserved id; the vocabulary ends below it.
RESERVED = 50257

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """text without any control string in it."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[int | None, str, bool]]:
    """A turn as (control, content, under loss); exactly one of control and content counts."""
    content = (None, escape(text), role == "assistant")
    control = lambda c: (c, CONTROLS[c], False)
    if role == "user":
        return [control(INST), content, control(INST_END)]
    if role == "assistant":
        return [content, control(EOS)]
    if role == "system":
        return [control(SYS), content, control(SYS_END)]
    return [control(ROLE), (None, escape(role), False), control(ROLE_END), content, control(TURN_END)]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    if found.get_vocab_size(with_added_tokens=True) > RESERVED:
        raise ValueError(f"{path} has ids from {RESERVED} on, which the controls use")
    return found


def assemble(parts: list[tuple[int | None, str, bool]], coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of segments; coded: the ids of each (unused for controls)."""
    ids = [[RESERVED + c] if c is not None else own for (c, _, _), own in zip(parts, coded, strict=True)]
    lengths = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(lengths)
    # +1 where a segment under loss begins, -1 where it ends; the running sum is the mask.
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    loss = np.array([x[2] for x in parts], bool)
    np.add.at(steps, (ends - lengths)[loss], 1)
    np.add.at(steps, ends[loss], -1)
    return np.array([x for own in ids for x in own], "<u4"), np.cumsum(steps)[:-1].astype(np.uint8)


def format_conversations(rows: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted string, ids binary, loss_mask binary): ids little-endian unsigned 32-bit, a byte of mask each."""
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.schema["conv_id"].dataType
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        tokenizer = load_tokenizer(path)
        start = (BOS, CONTROLS[BOS], False)
        now, parts, coded = None, [], []

        def row(conv, parts, coded):
            ids, mask = assemble(parts, coded)
            return conv, "".join(x[1] for x in parts), ids.tobytes(), mask.tobytes()

        for batch in sliced(batches):
            turns = [segments(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            contents = iter([e.ids for e in tokenizer.encode_batch([x[1] for turn in turns for x in turn if x[0] is None], add_special_tokens=False)])
            done = []
            for conv, turn in zip(batch.column(0).to_pylist(), turns, strict=True):
                if parts and conv != now:
                    done.append(row(now, parts, coded))
                    parts, coded = [], []
                if not parts:
                    now, parts, coded = conv, [start], [[]]
                parts += turn
                coded += [[] if x[0] is not None else next(contents) for x in turn]
            yield out(done)
        if parts:
            yield out([row(now, parts, coded)])

    def out(done):
        conv, formatted, ids, mask = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(conv, arrow), pa.array(formatted, pa.string()), pa.array(ids, pa.binary()), pa.array(mask, pa.binary())], names=["conv_id", "formatted", "ids", "loss_mask"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return dealt.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), T.StructField("formatted", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("loss_mask", T.BinaryType())]))


def parse(tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) and the text under loss, read from ids and mask alone."""
    marks = np.flatnonzero(ids >= RESERVED)
    cuts = [-1, *marks.tolist(), len(ids)]
    spans = [(a + 1, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    texts = [unescape(t) for t in tokenizer.decode_batch([ids[a:b].tolist() for a, b in spans], skip_special_tokens=False)]
    # texts[k] stands before control k
    turns: list[tuple[str, str]] = []
    role = ""
    for k, mark in enumerate((ids[marks] - RESERVED).tolist()):
        if mark == EOS:
            turns.append(("assistant", texts[k]))
        elif mark == INST_END:
            turns.append(("user", texts[k]))
        elif mark == SYS_END:
            turns.append(("system", texts[k]))
        elif mark == ROLE_END:
            role = texts[k]
        elif mark == TURN_END:
            turns.append((role, texts[k]))
    loss = [texts[k] for k, (a, b) in enumerate(spans) if b > a and mask[a:b].all()]
    return turns, "".join(loss)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Digests of what ids and masks hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    columns = formatted.select("conv_id", "ids", "loss_mask", F.length("formatted").cast("long").alias("formatted_chars"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in sliced(batches):
            rows = []
            for ids, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss = parse(tokenizer, np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8))
                rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
            n, all_turns, chars, under = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(all_turns, pa.string()), pa.array(chars, pa.int64()), pa.array(under, pa.string()), batch.column(3)], names=names)

    kind = columns.schema["conv_id"].dataType
    return columns.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]))
