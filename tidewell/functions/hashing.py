"""Hashes that no built-in gives: FNV-1a and a deterministic text embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIME, _BASIS, _MASK = 0x100000001B3, 0xCBF29CE484222325, (1 << 64) - 1


def fnv1a64_hex(text: str) -> str:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits (public constants of that hash)."""
    h = _BASIS
    for byte in text.encode():
        h = ((h ^ byte) * _PRIME) & _MASK
    return f"{h:016x}"


@F.pandas_udf(T.StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a64_hex(t))


def hash_embedding(text: str, dim: int) -> list[float]:
    """A unit vector that depends on the text alone: for tests and offline runs, without meaning."""
    raw = b"".join(hashlib.blake2b(f"{text}\0{i}".encode(), digest_size=4).digest() for i in range(dim))
    v = np.frombuffer(raw, "<u4").astype(np.float64) / 2**31 - 1
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32).tolist()


def hash_embedder(dim: int):
    """A column function from text to vectors of dim floats."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hash_embedding(t, dim))

    return embed
