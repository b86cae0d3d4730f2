"""Language identification with error-correcting output codes.

Every language has a codeword. One binary classifier per bit, over byte trigrams, tells the languages whose bit is 1
from the others: its weights are log ratios of smoothed trigram shares, every language counting alike. A text's bits are
real numbers; the codeword with the least total logistic loss wins. The score is the winner's share of the likelihood
that the losses stand for; a text whose winner has less than ``SURE`` of it is flagged as ambiguous.

Up to ``EXHAUSTIVE`` languages get the exhaustive code, more get the best of some random codes of fixed seed.
Learning is one scan with a count per language and bucket, combined before the shuffle; the model has BUCKETS numbers
per language and bit.

Defined results: null texts and texts without a letter are ``und`` with score 0 and ambiguous; rows without a language
teach nothing; without any, all texts are ``und``; a single language gets all texts with letters, score 1; repeated
rows are counted as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.llm.words import LOWER, texts_of

BUCKETS = 4096
EXHAUSTIVE = 7
PRIOR = 0.5  # added to every bucket's count
SURE = 0.5
FLUSH = 64  # languages counted in a task before their counts are handed on
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGNAL = LOWER.astype(np.uint32)
_SIGNAL[[b for b in range(128) if not chr(b).isalpha()]] = 32  # digits, punctuation and white space are one break


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """How often the text's byte trigrams fall into each bucket; breaks in a row count as one place each."""
    c = np.concatenate([[np.uint32(32)], _SIGNAL[data], [np.uint32(32)]]).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    keep = c[1:-1] != 32
    return np.bincount((h[keep] >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)


def has_letter(data: np.ndarray) -> bool:
    return bool(_ASCII_LETTER[data].any()) or LETTER.search(data.tobytes().decode("utf-8", "ignore")) is not None


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all distinct ways to split k languages in two, or a spread random choice of them."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= EXHAUSTIVE:
        columns = [[1] + [1 if (j >> b) & 1 else -1 for b in range(k - 1)] for j in range(2 ** (k - 1) - 1)]
        return np.array(columns, float).T
    rng, best, reach = np.random.default_rng(7), None, -1
    length = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, length))
        code = code[:, np.abs(code.sum(0)) < k]
        agree = code @ code.T
        np.fill_diagonal(agree, -length)
        if length - agree.max() > reach:
            best, reach = code, length - agree.max()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits

    @staticmethod
    def fitted(counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(counts)
        code = codewords(len(languages))
        if not languages:
            return LanguageModel([], code, np.zeros((BUCKETS, 0)))
        shares = np.array([(counts[k] + PRIOR) / (counts[k].sum() + PRIOR * BUCKETS) for k in languages])
        ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
        one, zero = shares.T @ ones / np.maximum(ones.sum(0), 1), shares.T @ zeros / np.maximum(zeros.sum(0), 1)
        return LanguageModel(languages, code, np.log(one) - np.log(zero))

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share of the likelihood, for rows of trigram counts."""
        n = np.maximum(counts.sum(1, keepdims=True), 1)
        bits = counts @ self.weights / np.sqrt(n)
        losses = np.logaddexp(0.0, -bits[:, None, :] * self.code[None, :, :]).sum(2)
        best = losses.argmin(1)
        share = np.exp(losses.min(1, keepdims=True) - losses).sum(1)
        return best, 1.0 / share


def learn(documents: DataFrame) -> LanguageModel:
    """The model of all rows with a language. The driver gets one row per language and bucket."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush():
            names = [k for k in totals for _ in range(BUCKETS)]
            values = np.concatenate([*totals.values(), np.zeros(0, np.int64)]).astype(np.int64)
            buckets = np.tile(np.arange(BUCKETS, dtype=np.int32), len(totals))
            full = values > 0
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(buckets), pa.array(values)], ["lang", "bucket", "n"])
            totals.clear()
            return out.filter(pa.array(full))

        for batch in batches:
            data, offsets = texts_of(batch["text"])
            for lang, a, b in zip(batch["lang"].to_pylist(), offsets[:-1], offsets[1:]):
                if lang not in totals:
                    if len(totals) >= FLUSH:
                        yield flush()
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += trigram_counts(data[a:b])
        yield flush()

    rows = (
        documents.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("binary").alias("text"), "lang")
        .mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts: dict[str, np.ndarray] = {}
    for lang, of in rows.groupby("lang"):
        counts[lang] = np.zeros(BUCKETS)
        counts[lang][of["bucket"].to_numpy()] = of["n"].to_numpy()
    return LanguageModel.fitted(counts)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous to the documents; columns of these names are replaced."""
    result = "struct<lang_pred:string,score:double,ambiguous:boolean>"

    @F.pandas_udf(result)
    def found(column):
        import pandas as pd

        data, offsets = texts_of(pa.Array.from_pandas(column, type=pa.binary()))
        names, scores = [], []
        for at in range(0, len(column), 512):
            rows = [data[a:b] for a, b in zip(offsets[at:at + 512], offsets[at + 1:at + 513])]
            if model.languages:
                best, share = model.decode(np.array([trigram_counts(r) for r in rows]))
                lettered = [has_letter(r) for r in rows]
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(share, lettered)]
            else:
                names += [UNKNOWN] * len(rows)
                scores += [0.0] * len(rows)
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": [s < SURE for s in scores]})

    plain = documents.drop("lang_pred", "score", "ambiguous")
    return plain.withColumn("_found", found(F.col(text).cast("binary"))).select(*plain.columns, "_found.*")


def predicted(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, by a model of the rows that are not held out."""
    model = learn(documents.filter(~held_out))
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def identified(documents: DataFrame, held_out: Column) -> DataFrame:
    """The documents, with all their columns, whose language is found: not ``und`` and not ambiguous."""
    model = learn(documents.filter(~held_out))
    found = identify(documents.select(F.struct("*").alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")
