"""Product codes of vectors in exact integers.

Vectors become integers, are cut into equal parts, and every part gets the index of its nearest codebook entry. Parts
and entries are zero-padded to a power of two and go through an integer Walsh-Hadamard transform; squared differences
are added up in sequency order, coarse coefficients first. The transform multiplies squared distances by the padded
length, so a partial sum beyond the full one of any entry rules the other entry out, exactly and without floating point.

A task adds up its parts by entry before anything is shuffled; the driver sees codebooks only (``parts * entries`` rows).

Defined results: rows whose vector is null or holds a null or a non-finite component are dropped; other columns may be
null (a null label is a label of its own) and extra columns are ignored, whatever their names; equal vectors have equal
codes; a repeated vec_id keeps all its rows, of which the smaller integers come first in the codebook; ties in distance
go to the smaller index; an empty table gives an empty result. Vectors of unequal length, or of a length that the number
of parts doesn't divide, and components too large for 64-bit sums raise ValueError. There are no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import staged
from agrispark.session import spread

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
STEP = 4  # coefficients between two eliminations
FEW = 8  # once one entry in so many is left, only those that are left are compared
ROWS = 128  # parts compared at once: their sums stay in a core's cache


@dataclass
class Codebooks:
    """Entries of every part: ``entries[part]`` has a row of integers for each entry."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def sequency(size: int) -> np.ndarray:
    """Places of the Walsh functions in the fast transform's output, by their number of sign changes."""
    rows = np.ones((1, 1), np.int8)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size), x.dtype)
    out[:, :x.shape[1]] = x
    half = 1
    while half < size:
        pairs = out.reshape(len(x), -1, 2, half)
        pairs[:, :, 0], pairs[:, :, 1] = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        half *= 2
    return out[:, sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for every row; both sides are transformed."""
    size = x.shape[1]
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    columns = np.ascontiguousarray(entries.T)
    for start in range(0, len(x), ROWS):
        rows = x[start:start + ROWS]
        sums, apart = np.zeros((2, len(rows), len(entries)), x.dtype)
        done, limit = 0, np.full(len(rows), np.iinfo(x.dtype).max, x.dtype)
        while True:
            for c in range(done, min(done + STEP, size)):
                np.subtract(rows[:, c, None], columns[c], out=apart)
                np.multiply(apart, apart, out=apart)
                sums += apart
            done = min(done + STEP, size)
            leader = rows - entries[sums.argmin(1)]
            limit = np.minimum(limit, (leader * leader).sum(1, dtype=x.dtype))
            left = sums <= limit[:, None]
            if done == size or np.count_nonzero(left) * FEW <= left.size:
                break
        row, entry = np.nonzero(left)
        so_far = sums[row, entry]
        for c in range(done, size, STEP):
            far = rows[row, c:c + STEP] - entries[entry, c:c + STEP]
            so_far = so_far + (far * far).sum(1, dtype=x.dtype)
            left = so_far <= limit[row]
            row, entry, so_far = row[left], entry[left], so_far[left]
        least = np.minimum.reduceat(so_far, np.searchsorted(row, np.arange(len(rows))))
        best = np.flatnonzero(so_far == least[row])
        _, first = np.unique(row[best], return_index=True)
        index[start:start + ROWS] = entry[best[first]]
        distance[start:start + ROWS] = least.astype(np.int64) // size
    return index, distance


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the usable vectors as arrays of floor(scale * component), written once."""
    usable = F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return staged(spread(vectors.select("vec_id", "label", "embedding")).where(usable).select("vec_id", "label", x.alias("x")), "integers")


def _shape(kept: DataFrame, parts: int) -> tuple[int, type]:
    """Components of a part, and the integer type that holds every sum of squared differences."""
    size = F.size("x")
    largest = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    low, high, most = kept.agg(F.min(size), F.max(size), largest).first()
    if low != high or (high or 0) % parts:
        raise ValueError(f"vectors of {low} to {high} components can't be cut into {parts} equal parts")
    width = (high or 0) // parts
    bound = (2 * (most or 0)) ** 2 * width * (1 << max(0, width - 1).bit_length())
    if bound >= 1 << 62:
        raise ValueError("components are too large for exact 64-bit sums")
    return width, np.int32 if bound < 1 << 31 else np.int64


def _parts(column: pa.Array, width: int, parts: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, parts, width)


def _first_entries(kept: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).swapaxes(0, 1)


def _moved(kept: DataFrame, books: np.ndarray, kind: type) -> np.ndarray:
    """Every entry replaced by the floored mean of its parts; unused entries stay."""
    parts, n, width = books.shape
    shifted = [walsh(b.astype(kind)) for b in books]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            x = _parts(batch["x"], width, parts, kind)
            for p in range(parts):
                code, _ = nearest(walsh(x[:, p]), shifted[p])
                counts[p] += np.bincount(code, minlength=n)
                np.add.at(sums[p], code, x[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    added = kept.select("x").mapInArrow(add, "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    out = books.copy()
    for part, entry, count, totals in added.collect():  # parts * entries rows at most
        out[part, entry] = [total // count for total in totals]
    return out


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, type]:
    """Codebooks of integer vectors (see ``integers``) and the integer type that comparing needs."""
    width, kind = _shape(kept, parts)
    books = _first_entries(kept, parts, width, entries)
    for _ in range(rounds if books.size else 0):
        books = _moved(kept, books, kind)
    return Codebooks(books), kind


def encode(kept: DataFrame, codebooks: Codebooks, kind: type = np.int64) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for every part, and the squared distance from vector to entries."""
    books = codebooks.entries
    parts, n, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(max(n, 1))])
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    shifted = [walsh(b.astype(kind)) for b in books]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, error = np.full(len(batch), "", dtype=f"<U{2 * parts}"), np.zeros(len(batch), np.int64)
            x = _parts(batch["x"], width, parts, kind) if width else np.zeros((len(batch), parts, 0), kind)
            for p in range(parts):
                index, distance = nearest(walsh(x[:, p]), shifted[p])
                text, error = np.char.add(text, digits[index]), error + distance
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(text.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
            )

    return kept.mapInArrow(code, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decode(codes: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds ``embedding``: the vector that a code stands for."""
    parts, n, width = codebooks.entries.shape
    books = [F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in part.tolist()]) for part in codebooks.entries]
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("embedding", F.concat(*[F.element_at(books[p], at(p)) for p in range(parts)]))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error (summed over equal labels), codebooks_sha256.

    The per-label sums are written first, so that the join of a label with a third of all rows can be split.
    """
    kept = integers(vectors, parts, scale)
    codebooks, kind = fit_codebooks(kept, parts, entries, rounds)
    coded = staged(encode(kept, codebooks, kind), "codes")
    totals = staged(
        coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors"
    )
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )
