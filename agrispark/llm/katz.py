"""Language-model scores: word bigrams with Katz backoff.

P(w | h) is the Good-Turing discounted share r*/c(h) where the pair h w was seen r > 0 times in training, and
backoff(h) P(w) where it was not; P(w) is the discounted share of the word, an unseen word having what the discounts of
seen ones leave. backoff(h) makes the words after h sum to exactly 1. A history never seen gives P(w) itself. A text's
first word follows a start mark, and after its last comes an end mark, which is a token.

Counts from 1 to ``CUT`` have the Good-Turing discounts cut off there; greater counts lose as much as ``CUT`` does, so
that every history leaves something for unseen words. A discount that the counts of counts make senseless is ``HALF``.

How it runs: documents are taken in blocks of text. A block sends its distinct words and pairs, as sorted hashes, to
the partitions of the n-gram tables that their hashes name, with their training counts; the partitions add up and answer
with totals, and name one block as each pair's owner. Each block then meets its answers, scores what it can, and sends
the owned pairs' shares to their histories, whose backoff weights come from those sums. Hot words and hot pairs cost one
entry a block. No table or vocabulary is collected or broadcast; the driver sees counts of counts up to ``CUT`` + 1.

``documents`` must give equal partitions whenever it runs (a scan does); a block that differs raises an error.

Defined results: null and empty texts are one end mark; rows that repeat are trained on and scored each; a null doc_id
counts as empty text for the folds; without training rows every base share is that of an unseen word; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import parts_for, staged
from agrispark.llm.words import WordHashes, mixed, texts_of

CUT = 5
HALF = 0.5
BLOCK_BYTES = 5 << 20
PART_BYTES = 8 << 20  # text per partition of a table
BLOCK_ROWS = 1 << 18
BLOCKS_PER_TASK = 1 << 20
START, END = np.uint64(0x1F0E5C0FFEE), np.uint64(0x2F0E5C0FFEE)
WORDS, PAIRS, DOCUMENTS = 0, 1, 2


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; sorted hashes are small after differences."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def restored(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def sorted_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, np.uint64), dtype=np.uint64)


class Block:
    """The tokens of some documents: hashes, where each document begins, and which documents train."""

    def __init__(self, texts: list[bytes], training: np.ndarray):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        words, first = WordHashes(seed=29, lower=True).of(data, offsets)
        n = np.diff(first) + 1
        self.offsets = np.concatenate([[0], np.cumsum(n)])
        tokens = np.full(self.offsets[-1], END)
        last = np.zeros(len(tokens), bool)
        last[self.offsets[1:] - 1] = True
        tokens[~last] = words
        history = np.concatenate([[START], tokens[:-1]]) if len(tokens) else tokens
        history[self.offsets[:-1]] = START
        self.document = np.repeat(np.arange(len(texts)), n)
        self.training = training[self.document]
        self.words, self.word_of = np.unique(np.append(tokens, START), return_inverse=True)
        self.word_of = self.word_of[:-1].astype(np.int32)
        self.history_of = np.searchsorted(self.words, history).astype(np.int32)
        self.pairs, self.pair_of = np.unique(mixed(history * np.uint64(0x9E3779B97F4A7C15) + tokens), return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)

    def counts(self, kind: int) -> np.ndarray:
        if kind == PAIRS:
            return np.bincount(self.pair_of[self.training], minlength=len(self.pairs))
        out = np.bincount(self.word_of[self.training], minlength=len(self.words))
        starts = np.searchsorted(self.words, START)
        out[starts] = 0  # the start mark is a history, never a token
        return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0x5BD1E995)) % np.uint64(parts)).astype(np.int64)


def discounts(n_of: dict[int, int]) -> np.ndarray:
    """What counts 0 to CUT + 1 lose, the last for all greater ones, from the counts of counts."""
    loss = np.zeros(CUT + 2)
    n1 = n_of.get(1, 0)
    top = (CUT + 1) * n_of.get(CUT + 1, 0) / n1 if n1 else 1.0
    for r in range(1, CUT + 1):
        lost = HALF
        if n_of.get(r, 0) and n_of.get(r + 1, 0) and top < 1:
            share = ((r + 1) * n_of[r + 1] / (r * n_of[r]) - top) / (1 - top)
            if 0 < share < 1:
                lost = r * (1 - share)
        loss[r] = lost
    loss[CUT + 1] = min(loss[CUT], HALF)
    return loss


def discounted(counts: np.ndarray, loss: np.ndarray) -> np.ndarray:
    return counts - loss[np.minimum(counts, CUT + 1)]


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """The rows of a partition in blocks of BLOCK_BYTES of text, numbered the same way in every run."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() * BLOCKS_PER_TASK
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256)
            for row in zip(*(rows[c].to_pylist() for c in columns)):
                for values, value in zip(held, row):
                    values.append(value)
                size += len(row[0] or b"") + 1
                if size >= BLOCK_BYTES or len(held[0]) >= BLOCK_ROWS:
                    yield number, held
                    number, size, held = number + 1, 0, [[] for _ in columns]
    if held[0]:
        yield number, held


def _asked(rows: DataFrame, parts: int) -> DataFrame:
    """(kind, part, block, hashes, counts): what every block asks of every partition of the tables."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (texts, held_out) in _blocks(batches, ["text", "held_out"]):
            block = Block([t or b"" for t in texts], ~np.array(held_out, bool))
            for kind, hashes in ((WORDS, block.words), (PAIRS, block.pairs)):
                counts, part = block.counts(kind), part_of(hashes, parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    mine = order[cuts[p]:cuts[p + 1]]
                    if len(mine):
                        own = hashes[mine]
                        out.append((kind, p, number, squeezed(np.diff(own, prepend=np.uint64(0))), squeezed(counts[mine].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    ["kind", "part", "block", "hashes", "counts"],
                )

    return rows.select("text", "held_out").mapInArrow(ask, "kind int, part int, block long, hashes binary, counts binary")


def _answer(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A table partition's answers: to every block its hashes' totals, negative where it owns the pair; and, as block -1,
    how many hashes have each count from 1 to CUT + 1, how many have any, and the sum of counts."""
    frame = frame.sort_values("block")
    hashes = [sorted_hashes(d) for d in frame["hashes"]]
    counts = [restored(d, np.uint32).astype(np.int64) for d in frame["counts"]]
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    flat = np.concatenate(counts)
    totals = np.bincount(inverse, flat, len(every)).astype(np.int64)
    trained = np.flatnonzero(flat)
    owned = np.zeros(len(flat), bool)
    owned[trained[np.unique(inverse[trained], return_index=True)[1]]] = True  # the first block that trains on it
    answers = totals[inverse]
    answers[owned] *= -1
    ends = np.cumsum([len(h) for h in hashes])
    out = [(int(key[0]), int(key[1]), int(b), squeezed(a)) for b, a in zip(frame["block"], np.split(answers, ends[:-1]))]
    stats = np.append(np.bincount(np.minimum(totals, CUT + 2), minlength=CUT + 3)[1:CUT + 2], [(totals > 0).sum(), totals.sum()])
    out.append((int(key[0]), int(key[1]), -1, squeezed(stats.astype(np.int64))))
    return pd.DataFrame(out, columns=["kind", "part", "block", "answers"]).astype({"kind": "int32", "part": "int32"})


def unseen_share(n_of: dict[int, int], loss: np.ndarray, words: int, tokens: int) -> float:
    """What the discounts of all seen words leave for an unseen one; all of it without training."""
    few = sum(n_of[r] * loss[r] for r in range(1, CUT + 1))
    return (few + (words - sum(n_of[r] for r in range(1, CUT + 1))) * loss[CUT + 1]) / tokens if tokens else 1.0


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, partial double, "
    "histories array<long>, times array<int>, history long, history_count long, shares double, lower double"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()),
    pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
]
_FIELDS = pa.schema([(f.split()[0], t) for f, t in zip(_SCORED.split(", "), _TYPES)])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _table(columns: dict, n: int) -> pa.Table:
    return pa.Table.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


def _scored(table: pa.Table, figures: dict, parts: int) -> pa.Table:
    """Scores of a block's documents as far as backoff weights aren't needed, the histories that need them, and, for
    every history of an owned pair, its discounted counts and its words' lower-order shares."""
    kinds, places = table["kind"].to_numpy(), table["place"].to_numpy()
    rows = {k: np.flatnonzero(kinds == k)[np.argsort(places[kinds == k])] for k in (WORDS, PAIRS, DOCUMENTS)}
    if not len(rows[DOCUMENTS]):
        raise RuntimeError("a block of the first pass has no documents in the second: the input's partitions changed")
    own = table.take(rows[DOCUMENTS])
    held_out = own["held_out"].to_numpy()
    unpack = zstandard.ZstdDecompressor().decompress
    block = Block([unpack(d.as_py()) for d in own["data"]], ~held_out)
    found = []
    for kind, hashes in ((WORDS, block.words), (PAIRS, block.pairs)):
        order = np.argsort(part_of(hashes, parts), kind="stable")
        flat = np.concatenate([np.zeros(0, np.int64), *[restored(d.as_py(), np.int64) for d in table["data"].take(rows[kind])]])
        if len(flat) != len(hashes):
            raise RuntimeError("a block differs between the passes: the input's partitions changed")
        totals = np.empty(len(hashes), np.int64)
        totals[order] = flat
        found.append(totals)
    count, pair_count, owned = np.abs(found[0]), np.abs(found[1]), found[1] < 0
    history_count = count.copy()
    history_count[np.searchsorted(block.words, START)] = figures["starts"]
    n, v = figures["tokens"], figures["words"]
    lower = np.where(count > 0, discounted(count, figures["loss"]) / max(n, 1), figures["unseen"])

    c, h, r = count[block.word_of], history_count[block.history_of], pair_count[block.pair_of]
    add = lambda values: np.bincount(block.document, values, len(held_out))
    seen = r > 0
    direct = np.log10(lower[block.word_of])
    direct[seen] = np.log10(discounted(r[seen], figures["pair_loss"]) / h[seen])
    wait = ~seen & (h > 0)
    pairs, times = np.unique(block.document[wait] * len(block.words) + block.history_of[wait], return_counts=True)
    whose, which = pairs // len(block.words), pairs % len(block.words)
    lengths = np.bincount(whose, minlength=len(held_out))
    documents = _table({
        "row": pa.array(table["block"][0].as_py() * BLOCK_ROWS + np.arange(len(held_out))),
        "doc_id": own["doc_id"].combine_chunks(), "held_out": pa.array(held_out), "n_tokens": pa.array(np.diff(block.offsets)),
        "n_known": pa.array(add(c > 0).astype(np.int64)), "base_score": pa.array(add(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))),
        "partial": pa.array(add(direct)), "histories": _lists(block.words[which].view(np.int64), lengths),
        "times": _lists(times.astype(np.int32), lengths),
    }, len(held_out))

    place = np.zeros(len(block.pairs), np.int64)
    place[block.pair_of] = np.arange(len(block.pair_of))
    mine = np.flatnonzero(owned)
    histories, words = block.history_of[place[mine]], block.word_of[place[mine]]
    some = np.unique(histories)
    sums = _table({
        "history": pa.array(block.words[some].view(np.int64)), "history_count": pa.array(history_count[some]),
        "shares": pa.array(np.bincount(histories, discounted(pair_count[mine], figures["pair_loss"]), len(block.words))[some]),
        "lower": pa.array(np.bincount(histories, lower[words], len(block.words))[some]),
    }, len(some))
    return pa.concat_tables([documents, sums])


def _figures(answers: DataFrame, starts: int) -> dict:
    """Totals of both tables: everything that the driver gets of them."""
    rows = answers.filter("block = -1").select("kind", "answers")

    @F.pandas_udf("array<long>")
    def opened(column: pd.Series) -> pd.Series:
        return column.map(lambda d: restored(d, np.int64).tolist())

    sums = {WORDS: np.zeros(CUT + 3, np.int64), PAIRS: np.zeros(CUT + 3, np.int64)}
    for kind, k, n in rows.select("kind", F.posexplode(opened("answers")).alias("k", "n")).groupBy("kind", "k").agg(F.sum("n")).collect():
        sums[kind][k] = n
    of = {kind: {r: int(s[r - 1]) for r in range(1, CUT + 2)} for kind, s in sums.items()}
    words, tokens = (int(x) for x in sums[WORDS][-2:])
    loss = discounts(of[WORDS])
    return {
        "words": words, "tokens": tokens, "starts": starts, "loss": loss, "pair_loss": discounts(of[PAIRS]),
        "unseen": unseen_share(of[WORDS], loss, words, tokens),
    }


def backoff_weights(scored: DataFrame) -> DataFrame:
    """(history, log10 of its backoff weight) of every history seen in training."""
    sums = scored.filter("history IS NOT NULL").groupBy("history").agg(
        F.max("history_count").alias("n"), F.sum("shares").alias("shares"), F.sum("lower").alias("lower")
    )
    return sums.select("history", F.log10((1 - F.col("shares") / F.col("n")) / (1 - F.col("lower"))).alias("weight"))


def scores(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, by a model of those for
    which ``held_out`` is false. ``base_score`` is that of single words with half a count added."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    size, starts = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    parts = parts_for(spark, size or 0, PART_BYTES)
    asked = _asked(rows, parts)
    answers = staged(asked.groupBy("kind", "part").applyInPandas(_answer, "kind int, part int, block long, answers binary"), "ngram-answers")
    figures = _figures(answers, starts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for number, (texts, ids, held) in _blocks(batches, ["text", "doc_id", "held_out"]):
            for at in range(0, len(texts), 512):
                some = slice(at, at + 512)
                n = len(texts[some])
                yield pa.RecordBatch.from_arrays([
                    pa.array([DOCUMENTS] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), pa.array([number] * n, pa.int64()),
                    pa.array([compress(t or b"") for t in texts[some]], pa.binary()), pa.array(ids[some], pa.int64()), pa.array(held[some], pa.bool_()),
                ], ["kind", "place", "block", "data", "doc_id", "held_out"])

    texts = rows.select("text", "doc_id", "held_out").mapInArrow(
        packed, "kind int, place int, block long, data binary, doc_id long, held_out boolean"
    )
    answered = answers.filter("block >= 0").select(
        "kind", F.col("part").alias("place"), "block", F.col("answers").alias("data"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
    )
    scored = staged(
        texts.unionByName(answered).groupBy("block").applyInArrow(lambda table: _scored(table, figures, parts), _SCORED), "scored"
    )
    waiting = scored.filter("row IS NOT NULL").select("row", F.explode(F.arrays_zip("histories", "times")).alias("w")).select(
        "row", F.col("w.histories").alias("history"), F.col("w.times").alias("times")
    )
    backed_off = waiting.join(backoff_weights(scored), "history").groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("backoff"))
    return scored.filter("row IS NOT NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "partial").join(
        backed_off, "row", "left"
    ).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(figures["tokens"]).cast("long").alias("train_tokens"), "base_score",
        (F.col("partial") + F.coalesce("backoff", F.lit(0.0))).alias("score"),
    )
