"""Importance resampling of documents towards a target distribution, over hashed n-grams.

A document's words, joined by one space, are scanned once: the running CRC is kept at the end of every word. The CRC of
any run of words follows from two of these prefixes, since appending n bytes to a prefix multiplies its CRC by a power
of x in GF(2): CRC(run) = CRC(prefix to its end) xor shift(CRC(prefix to its start), its length). The shift is a product
of operators for powers of two of bytes, applied to whole arrays.

Bucket counts are added up in every task before they are shuffled (``buckets`` rows a task at most); gains are a table of
``buckets`` numbers. Documents are ranked in two levels: range partitions of (score, doc_id), rows within them.

Defined results: a null or empty text, and one without words, has no features, weight 0, and a score, but is never
drawn; a null doc_id counts as empty text in its hash and comes last among ties; repeated rows are ranked separately, in
any order; very long texts are one document like others; extra columns don't matter, whatever their names; an empty table
gives an empty result, and with an empty target every bucket is scored against no target features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrispark.llm.staging import parts_for, staged

# Letters A-Z are lower-cased; digits, a-z and bytes of other scripts make words, all else separates them.
KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
POLYNOMIAL = 0xEDB88320
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in KEPT else 0x20 for b in range(256))
TEXTS = 256  # texts whose words are held at once
ROWS_PER_PART = 250_000


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """What a zero byte after it makes of each value of a CRC's low byte."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), values >> np.uint32(1))
    return values


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for k in range(1, 4):
        out ^= tables[k][(crc >> np.uint32(8 * k)) & 255]
    return out


@lru_cache(maxsize=None)
def _shift(power: int) -> np.ndarray:
    """The linear operator that appends ``2 ** power`` zero bytes, by the four bytes of a CRC."""
    each = np.arange(256, dtype=np.uint32)
    if power == 0:
        whole = [each << np.uint32(8 * k) for k in range(4)]
        return np.stack([_steps()[w & 255] ^ (w >> np.uint32(8)) for w in whole])
    half = _shift(power - 1)
    return np.stack([_applied(half, half[k]) for k in range(4)])


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs as if each were followed by so many zero bytes, without start and end inversion."""
    out = crc.astype(np.uint32, copy=True)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> power) & 1)
        out[at] = _applied(_shift(power), out[at])
    return out


def after_space(crc: np.ndarray) -> np.ndarray:
    """Running CRCs after one more byte, a space."""
    state = ~crc
    return ~(_steps()[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8)))


def run_crcs(texts: list[bytes | None], longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``longest`` words, the text it comes from, and the number of words of every text."""
    crc32, ends, sizes, counts = zlib.crc32, [], [], []
    for text in texts:
        words = text.translate(NORMAL).split() if text else []
        counts.append(len(words))
        if words:
            c = crc32(words[0])
            ends.append(c)
            ends += [c := crc32(b" " + w, c) for w in words[1:]]
            sizes += map(len, words)
    words_of = np.array(counts, np.int64)
    end, size = np.array(ends, np.uint32), np.array(sizes, np.int64)
    text_of = np.repeat(np.arange(len(texts)), words_of)
    first = np.cumsum(words_of) - words_of
    start = np.zeros(len(end), np.uint32)
    start[1:] = after_space(end[:-1])
    start[first[words_of > 0]] = 0
    stop = np.cumsum(size + 1)
    crcs, owners = [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(end))
        last = last[text_of[last] == text_of[last - n + 1]]
        begin = last - n + 1
        length = stop[last] - stop[begin] + size[begin]
        crcs.append(end[last] ^ shifted(start[begin], length))
        owners.append(text_of[last])
    return np.concatenate(crcs), np.concatenate(owners), words_of


def _pieces(batch: pa.RecordBatch, column: str, each: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for at in range(0, len(batch), each):
        piece = batch.slice(at, each)
        yield piece, piece[column].to_pylist()


def hashed(texts: DataFrame, buckets: int, longest: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_features, features): the bucket of every feature as packed 32-bit numbers."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, column in _pieces(batch, "text", TEXTS):
                crcs, owner, n_words = run_crcs(column, longest)
                found = (crcs % np.uint32(buckets)).astype("<u4")[np.argsort(owner, kind="stable")]
                n = np.bincount(owner, minlength=len(piece))
                ends = np.cumsum(n)
                packed = [found[a:b].tobytes() for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(n_words), pa.array(n.astype(np.int64)), pa.array(packed, pa.binary())],
                    ["doc_id", "n_words", "n_features", "features"],
                )

    raw = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(scan, f"doc_id {kind}, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the packed features; ``buckets`` rows reach the driver at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch["features"]:
                counts += np.bincount(np.frombuffer(value.as_buffer(), "<u4"), minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])

    added = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in added.collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share of a bucket over the source's), each count raised by one."""
    buckets = len(source)
    over, under = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * over / (float(s + 1) * under))) for s, t in zip(source.tolist(), target.tolist())], np.int64
    )


def _weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    kind = features.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(value.as_buffer(), "<u4")].sum()) for value in batch["features"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], batch["n_words"], batch["n_features"], pa.array(sums, pa.int64())],
                ["doc_id", "row", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(weigh, f"doc_id {kind}, row long, n_words long, n_features long, weight long")


def noise(seed: int):
    """floor(-1000 * ln(-ln(u))) of a number u in (0, 1) drawn from the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_ranks(
    documents: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least_words: int = 20,
    percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn).

    ``target`` has a column text. Drawn are ``percent`` of the documents with ``least_words`` words or more: those with
    the highest sums of gain and noise, which samples without replacement in proportion to the importance weights.
    """
    spark = documents.sparkSession
    found = staged(hashed(documents, buckets, longest).withColumn("row", F.monotonically_increasing_id()), "features")
    wanted = hashed(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    gains = gains_of(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    long_enough = F.col("n_words") >= least_words
    scored = _weighed(found, gains).withColumn("score", F.col("weight") + noise(seed)).withColumn("open", long_enough)
    n, able = found.agg(F.count(F.lit(1)), F.count_if(long_enough)).first()
    draw = percent * able // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = staged(
        scored.repartitionByRange(parts_for(spark, n, ROWS_PER_PART), *order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("offset")
    ranked = placed.join(offsets, "part").withColumn("place", place)
    return ranked.select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("open") & (F.col("place") <= draw), F.col("place")).alias("rank")
    )


def resampled(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; rows that share a doc_id are drawn together."""
    drawn = importance_ranks(documents, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return documents.join(drawn, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
