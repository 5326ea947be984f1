"""Text encoders.

An encoder maps a string Column to an ``array<float>`` Column. The default is
a seeded feature-hashing bag of words: texts are cut into tokens in the JVM, and an
Arrow UDF hashes each distinct token of a few texts once (md5 prefix, the same seeded
hash as everywhere else, so SQL engines can reproduce the vectors) and turns them into
dense signed bucket counts with one ``bincount``. Any other model can be
plugged in with :func:`pandas_encoder` (Arrow batches in, vectors out).

Texts are always encoded once per distinct value (:func:`index_texts`):
eval sets repeat the same query text many times.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.operators.keys import distinct_texts
from quarry.session import stage_table

TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != F.lit(""))


_BUCKET_ROWS = 512       # texts whose hashes are counted at once


def _token_hashes(seed: int, flat: pa.Array) -> np.ndarray:
    """60-bit md5 prefixes of tokens; each distinct one is hashed once."""
    coded, head = flat.dictionary_encode(), f"{seed}|".encode()
    first = b"".join([hashlib.md5(head + t).digest()[:8] for t in coded.dictionary.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(first, ">u8") >> 4).astype(np.int64)[coded.indices.to_numpy()]


def _bucket_udf(dim: int, seed: int | None = None):
    """Signed bucket counts of lists of hashes, or with ``seed`` of lists of tokens."""
    @F.arrow_udf("array<float>")
    def buckets(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), dim), dtype=np.float32)
        for at in range(0, len(lists), _BUCKET_ROWS):        # no object a text, few hashes copied
            part = lists.slice(at, _BUCKET_ROWS)
            lens = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = part.flatten()
            flat = flat.to_numpy(zero_copy_only=False) if seed is None else _token_hashes(seed, flat)
            rows = np.repeat(np.arange(len(part)), lens)
            sign = np.where(((flat >> 40) & 1) == 0, 1.0, -1.0)
            n = np.bincount(rows * dim + flat % dim, weights=sign, minlength=len(part) * dim)
            out[at:at + len(part)] = n.reshape(len(part), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
    return buckets


@dataclass(frozen=True)
class HashEncoder:
    """Seeded feature-hashing bag-of-words encoder."""

    dim: int = 64
    seed: int = 0

    def __call__(self, text: Column) -> Column:
        # 60-bit md5 prefix per token: bucket = h mod dim, sign = bit 40; encoders share the tokens
        return _bucket_udf(self.dim, self.seed)(tokens(text))


def pandas_encoder(fn: Callable[[list[str]], np.ndarray], dim: int) -> Callable[[Column], Column]:
    """Wrap ``fn(list_of_texts) -> (n, dim) array`` as an Arrow-batched encoder."""
    @pandas_udf("array<float>")
    def enc(texts: pd.Series) -> pd.Series:
        m = np.asarray(fn(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(m))
    return enc


def encode_isolated(fn: Callable[[list[str]], np.ndarray], texts: list[str],
                    dim: int) -> tuple[np.ndarray, list[str | None]]:
    """Vectors and errors of a batch. A batch that fails is halved until the failing texts
    stand alone, so k of them cost about ``2 k log2(batch)`` more calls and every other
    text keeps its vector. A vector that is not finite is an error of its text."""
    out, errors = np.zeros((len(texts), dim), dtype=np.float32), [None] * len(texts)
    todo = [(0, len(texts))] if texts else []
    while todo:
        a, b = todo.pop()
        try:
            m = np.asarray(fn(texts[a:b]), dtype=np.float32)
            if m.shape != (b - a, dim):
                raise ValueError(f"expected vectors of shape {(b - a, dim)}, got {m.shape}")
        except Exception as e:  # noqa: BLE001  the encoder is the user's: whatever it raises is the text's error
            if b - a == 1:
                errors[a] = f"{type(e).__name__}: {e}"
            else:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            continue
        out[a:b] = m
        for i in np.flatnonzero(~np.isfinite(m).all(axis=1)):
            errors[a + i] = "ValueError: the vector is not finite"
    return out, errors


@dataclass(frozen=True)
class IsolatingEncoder:
    """Arrow-batched ``fn(list_of_texts) -> (n, dim) array`` whose errors stay with the texts
    that cause them: such a text has no vector (its similarities are 0), the others
    are not touched. :meth:`checked` also tells the error."""

    fn: Callable[[list[str]], np.ndarray]
    dim: int

    def checked(self, text: Column) -> Column:
        """``struct<vector array<float>, error string>``."""
        fn, dim = self.fn, self.dim

        @F.arrow_udf("struct<vector:array<float>,error:string>")
        def enc(texts: pa.Array) -> pa.Array:
            m, errors = encode_isolated(fn, [t or "" for t in texts.to_pylist()], dim)
            bad = np.array([e is not None for e in errors], dtype=bool)
            size = np.where(bad, 0, dim)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(m[~bad].ravel()), mask=pa.array(bad))
            return pa.StructArray.from_arrays([vectors, pa.array(errors, pa.string())], names=["vector", "error"])

        return enc(text)

    def __call__(self, text: Column) -> Column:
        return self.checked(text)["vector"]


@lru_cache(1 << 16)
def _token_hash(seed: int, token: str) -> int:
    return int(hashlib.md5(f"{seed}|{token}".encode()).hexdigest()[:15], 16)


def hash_vectors(texts: list[str], dim: int, seed: int) -> np.ndarray:
    """The vectors of :class:`HashEncoder` for a batch of Python strings."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, text in enumerate(texts):
        for t in re.split(r"[\W_]+", text.lower()):
            if t:
                h = _token_hash(seed, t)
                out[i, h % dim] += -1.0 if (h >> 40) & 1 else 1.0
    return out


def index_texts(rows: DataFrame, text_col: str, id_col: str, order_col: str = "row_id",
                with_total: bool = False):
    """Distinct texts of ``text_col`` with an exact id: ``<id_col>, text_key, text``.

    The id is the first ``order_col`` value at which the text occurs - unique per
    text, found with one partially aggregated group-by. With ``with_total`` also
    returns the number of distinct texts."""
    return distinct_texts(rows.select(F.col(text_col).alias("_t"), order_col), F.col("_t"),
                          F.min(order_col).cast("bigint").alias(id_col), with_total=with_total)


def embed(index: DataFrame, id_col: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """Vectors of an id/text index: ``<id_col>, embedding``.

    Encoding is CPU-bound: an index read from fewer files than cores is spread first."""
    from quarry.sources.tables import spread
    return spread(index).select(id_col, encoder(F.col("text")).alias("embedding"))


def embed_table(index: DataFrame, id_col: str, encoders: list) -> DataFrame:
    """Vectors of an index under several encoders, written once as ``<id_col>, e0,
    e1, ...``: one read of the texts for all encoders, and no text is encoded again
    by a later step. Encoders that isolate errors (:class:`IsolatingEncoder`) add
    ``x0, x1, ...``, the error of a text without a vector (else null)."""
    from quarry.sources.tables import spread
    checks = [hasattr(enc, "checked") for enc in encoders]
    written = stage_table(spread(index).select(id_col, *[
        (enc.checked if check else enc)(F.col("text")).alias(f"e{i}")
        for i, (enc, check) in enumerate(zip(encoders, checks, strict=True))]), "vectors")
    vector = lambda i, check: F.col(f"e{i}.vector" if check else f"e{i}").alias(f"e{i}")
    return written.select(id_col, *[vector(i, c) for i, c in enumerate(checks)],
                          *[F.col(f"e{i}.error").alias(f"x{i}") for i, c in enumerate(checks) if c])


def encode_errors(vectors: DataFrame, names: list[str]) -> DataFrame:
    """``model, error, texts``: how many texts of an :func:`embed_table` failed, by the kind
    of error; models without failures have no row."""
    checked = [(n, f"x{i}") for i, n in enumerate(names) if f"x{i}" in vectors.columns]
    items = [F.struct(F.lit(n).alias("model"), F.split(F.col(x), ":")[0].alias("error")) for n, x in checked]
    if not items:
        return vectors.sparkSession.createDataFrame([], "model string, error string, texts bigint")
    return (vectors.select(F.inline(F.array(*items))).filter(F.col("error").isNotNull())
            .groupBy("model", "error").agg(F.count(F.lit(1)).alias("texts")))


def embed_all(index: DataFrame, id_col: str, encoders: list) -> list[DataFrame]:
    """:func:`embed_table` as one ``<id_col>, embedding`` table per encoder."""
    from quarry.sources.tables import spread
    written = embed_table(index, id_col, encoders)
    return [spread(written.select(id_col, F.col(f"e{i}").alias("embedding"))) for i in range(len(encoders))]
