"""Binary hypervectors of 1024 bits: symbols, binding, rotation, bundles, similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 1024


def atom(symbol: Column, dimensions: int = DIMENSIONS) -> Column:
    """A symbol's vector: SHA-256 of "block:symbol" for every block of 256 bits, as binary."""
    if dimensions % 256:
        raise ValueError("dimensions must be a multiple of 256")
    return F.unhex(F.concat(*(F.sha2(F.concat(F.lit(f"{i}:"), symbol), 256) for i in range(dimensions // 256))))


def _bytes(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of dimensions / 8 bytes; nulls as zeros."""
    held = [x if x is not None else bytes(dimensions // 8) for x in column.to_pylist()]
    return np.frombuffer(b"".join(held), np.uint8).reshape(len(held), dimensions // 8)


def _where(x: np.ndarray, *columns: pa.Array) -> pa.Array:
    null = [any(v is None for v in row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    return pa.array([None if n else v.tobytes() for v, n in zip(x, null, strict=True)], pa.binary())


def bind(a: Column, b: Column, dimensions: int = DIMENSIONS) -> Column:
    return F.arrow_udf(lambda x, y: _where(_bytes(x, dimensions) ^ _bytes(y, dimensions), x, y), "binary")(a, b)


def permute(v: Column, shift: int, dimensions: int = DIMENSIONS) -> Column:
    """The vector turned left by `shift` bits."""
    return F.arrow_udf(lambda x: _where(np.packbits(np.roll(np.unpackbits(_bytes(x, dimensions), axis=1), -shift, axis=1), axis=1), x), "binary")(v)


def similarity(a: Column, b: Column, dimensions: int = DIMENSIONS) -> Column:
    """1 less the share of bits that differ."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        same = 1 - np.unpackbits(_bytes(x, dimensions) ^ _bytes(y, dimensions), axis=1).sum(axis=1) / dimensions
        return pa.array([None if p is None or q is None else float(s) for p, q, s in zip(x.to_pylist(), y.to_pylist(), same, strict=True)], pa.float64())

    return F.arrow_udf(lambda x, y: run(x, y), "double")(a, b)


def _ties(dimensions: int) -> np.ndarray:
    """The bits that a draw gives, first bit highest: the last bit of the symbol "tie:place", places counted from the lowest."""
    last = dimensions // 256 - 1
    return np.array([hashlib.sha256(f"{last}:tie:{dimensions - 1 - i}".encode()).digest()[-1] & 1 for i in range(dimensions)], bool)


def bundle(vectors: Column, dimensions: int = DIMENSIONS) -> Column:
    """Bits that most of an array's vectors have; a draw is settled by a fixed bit. All zeros without vectors."""
    ties = _ties(dimensions)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for held in column.to_pylist():
            if not held:
                out.append(bytes(dimensions // 8))
                continue
            ones = np.zeros(dimensions, np.int64)
            for k in range(0, len(held), 4096):
                ones += np.unpackbits(np.frombuffer(b"".join(held[k : k + 4096]), np.uint8).reshape(-1, dimensions // 8), axis=1).sum(axis=0, dtype=np.int64)
            out.append(np.packbits((2 * ones > len(held)) | ((2 * ones == len(held)) & ties)).tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(lambda column: run(column), "binary")(vectors)


def encode_terms(terms: Column, dimensions: int = DIMENSIONS) -> Column:
    """The bundle of the distinct lower-cased terms."""
    return bundle(F.transform(F.array_distinct(F.transform(terms, lambda x: F.lower(x))), lambda x: atom(x, dimensions)), dimensions)


def cell_score(exact: Column, lexical: Column, vector: Column, predicted: Column) -> Column:
    """A cell's score for a question: an alias in it, shared terms, similarity of vectors, and a bonus if it was predicted."""
    return 0.48 * exact.cast("double") + 0.30 * lexical + 0.22 * vector + F.when(predicted, 0.08).otherwise(0.0)
