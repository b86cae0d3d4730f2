"""Quality scores: random Fourier features, ridge regression by normal equations, isotonic calibration.

Statistics of a document's words and bytes are standardised; cosines of random projections approximate a Gaussian kernel
over them. Every task adds up its rows' normal equations, the sums are added up by matrix row, and one solve of fixed
size gives the ridge weights. A fold of the learning rows, left out of the fit, calibrates: its scores are counted in
bins of fixed number, which pooling adjacent violators makes monotone.

Defined results: null and empty texts have all statistics 0 and the score that follows from it; without any label the
score is 0.5; labels that repeat for a document count once, by their maximum; null labels teach nothing; repeated
documents are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.llm.folds import fold
from agrispark.llm.staging import staged
from agrispark.llm.words import WordHashes, texts_of, word_spans

FEATURES = 384
RIDGE = 1e-4  # times the number of rows
BINS = 2048
LOW, HIGH = -0.5, 1.5  # range of ridge scores that the bins cover; beyond it the outer bins hold
CLIP = 6.0
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digits", "high", "space", "lines", "stops", "commas",
    "marks", "pipes", "brackets", "symbols", "controls", "repeats", "near_repeats", "distinct", "distinct_pairs",
    "no_letter_words", "upper_words", "byte_bits",
]
_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "high": range(128, 256), "space": (32, 9), "lines": (10, 13),
    "stops": b".", "commas": b",;:", "marks": b"!?", "pipes": b"|", "brackets": b"()[]{}<>", "symbols": b"#$%&*+/=@\\^_~`",
    "controls": [*range(0, 9), 11, 12, *range(14, 32), 127],
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def statistics_of(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The statistics of one text, given its bytes and its words' hashes."""
    out = dict.fromkeys(STATISTICS, 0.0)
    n, k = len(data), len(words)
    if n:
        counts = np.bincount(data, minlength=256)
        out["log_bytes"] = np.log1p(n)
        for name, members in _CLASSES.items():
            out[name] = counts[list(members)].sum() / n
        share = counts[counts > 0] / n
        out["byte_bits"] = -(share * np.log2(share)).sum()
    if k:
        starts, ends = word_spans(data)
        lengths = ends - starts
        out["log_words"], out["word_bytes"], out["word_bytes_sd"] = np.log1p(k), np.log1p(lengths.mean()), np.log1p(lengths.std())
        out["repeats"] = (words[1:] == words[:-1]).sum() / k
        out["near_repeats"] = (words[2:] == words[:-2]).sum() / k
        out["distinct"] = len(np.unique(words)) / k ** 0.8
        out["distinct_pairs"] = len(np.unique(words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1])) / k
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
        has, up = letters[ends] - letters[starts], uppers[ends] - uppers[starts]
        out["no_letter_words"] = (has == 0).sum() / k
        out["upper_words"] = ((up > 1) & (2 * up >= has)).sum() / k
    return np.array([out[name] for name in STATISTICS])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the array ``x`` of statistics of every whole text."""
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed=5, lower=False)
        for batch in batches:
            data, offsets = texts_of(batch["text"])
            words, first = hashes.of(data, offsets)
            rows = [
                statistics_of(data[a:b], words[i:j]) for a, b, i, j in zip(offsets[:-1], offsets[1:], first[:-1], first[1:])
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(computed, "doc_id long, x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosine features of a Gaussian kernel whose squared width is the number of statistics, and a constant."""
        rng = np.random.default_rng(11)
        directions = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
        z = np.cos(self.standard(x) @ directions + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2.0 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def bins_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def pooled(positions: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing function nearest to the binned shares: adjacent violators are pooled."""
    blocks: list[list[float]] = []  # [sum of positions, positives, count]
    for at, p, n in zip(positions, positives, counts):
        blocks.append([at * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])



def fit(labelled: DataFrame, calibrate: Column) -> QualityModel:
    """The model of rows (x, y); rows for which ``calibrate`` holds only calibrate it."""
    rows = labelled.select("x", F.col("y").cast("double").alias("y"), calibrate.alias("held"))
    size = len(STATISTICS)
    moments = rows.filter("NOT held").select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    ).toPandas().sort_values("k")
    if not len(moments):
        return QualityModel(np.zeros(size), np.ones(size))
    n, deviation = int(moments["n"].iloc[0]), moments["s"].to_numpy()
    model = QualityModel(moments["m"].to_numpy(), np.where(deviation > 1e-9, deviation, 1.0))

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                z = model.features(np.array(part["x"].flatten()).reshape(len(part), -1))
                total += z.T @ np.hstack([z, np.array(part["y"])[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(FEATURES + 1), pa.int32()), pa.array([TaskContext.get().partitionId()] * (FEATURES + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
            ["i", "part", "sums"],
        )

    def added(key, frame):
        import pandas as pd

        frame = frame.sort_values("part")
        return pd.DataFrame({"i": [key[0]], "sums": [np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0).tobytes()]})

    sums = (
        rows.filter("NOT held").select("x", "y").mapInArrow(normal_equations, "i int, part int, sums binary")
        .groupBy("i").applyInPandas(added, "i int, sums binary").toPandas().sort_values("i")
    )
    table = np.array([np.frombuffer(s) for s in sums["sums"]])
    penalty = RIDGE * n * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(table[:, :-1] + penalty, table[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positives, counts = np.zeros(BINS), np.zeros(BINS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                where = bins_of(model.raw(np.array(part["x"].flatten()).reshape(len(part), -1)))
                positives += np.bincount(where, np.array(part["y"]), BINS)
                counts += np.bincount(where, minlength=BINS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(positives[full]), pa.array(counts[full])], ["bin", "p", "n"])

    for held in ("held", "NOT held"):  # few rows may leave the calibration fold empty
        shares = (
            rows.filter(held).select("x", "y").mapInArrow(binned, "bin long, p double, n long")
            .groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas().sort_values("bin")
        )
        if len(shares):
            break
    centres = LOW + (shares["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.values = pooled(centres, shares["p"].to_numpy(), shares["n"].to_numpy())
    return model


def scored(documents: DataFrame, labels: DataFrame, threshold: float, n_folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from labels outside the held-out fold."""
    statistics = staged(document_statistics(documents), "statistics")
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    learning = statistics.filter(fold(F.col("doc_id"), n_folds) != held).join(known, "doc_id")
    model = fit(learning, F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(model.score(np.vstack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    return statistics.select(
        "doc_id", (fold(F.col("doc_id"), n_folds) == held).alias("held_out"), score("x").alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
