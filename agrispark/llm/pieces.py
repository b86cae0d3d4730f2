"""SentencePiece encoding and decoding over a shared-prefix forward pass.

Texts are normalised as the model says (a mark for each space, one more in front) and cut into marked words: no piece
holds a mark after another character, so no segmentation crosses those cuts. The distinct words of a batch are sorted,
which is the depth-first order of their trie, and the forward states of a word's characters are those of the previous
word as far as the two agree; only the rest is computed.

The forward state at a position is the best way to reach it: for a unigram model the best sum of scores, as in any
Viterbi search. The scores of a BPE model are merge ranks, whose sums mean nothing, so for such a model the state is the
last piece of the merged prefix: a piece may follow another exactly if merging the two together leaves both as they are,
and one candidate at each position satisfies that. Both give the identifiers of the public library.

Defined results: a null text has null identifiers and decodes to null; an empty text has none and decodes to "";
characters without a piece become byte pieces, or the unknown piece where the model has none; repeated rows are encoded
alike; other columns pass through unread, except that columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
REMEMBERED = 300_000  # words per worker
LONGEST_REMEMBERED = 10_000  # a batch with a longer word is forgotten
PAIRS = 500_000  # remembered decisions about neighbouring pieces
BATCH_CHARS = 1_000_000
NORMAL, UNKNOWN, USER, BYTE, BPE = 1, 2, 4, 6, 2  # types of pieces and of models in the file format


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.bpe = model.trainer_spec.model_type == BPE
        self.ids, self.scores, self.byte_ids = {}, {}, {}
        self.unknown = 0
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(model.pieces):
            self.bytes_of.append(p.piece.replace(MARK, " ").encode("utf-8") if p.type in (NORMAL, USER) else b"")
            if p.type in (NORMAL, USER):
                self.ids[p.piece], self.scores[i] = i, p.score
            elif p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif p.type == UNKNOWN:
                self.unknown, self.bytes_of[i] = i, " ⁇ ".encode()
        self.texts = {i: t for t, i in self.ids.items()}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece holds a mark after another character")
        self.low = min(self.scores.values(), default=0.0) - 10.0  # the score of a character without a piece
        self.trie: dict = {}
        for text, i in self.ids.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = i
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall if "\n" not in self.trie else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.forget()
        self.follows: dict[int, bool] = {}  # by left * number of pieces + right, and by -1 - piece for standing alone

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, best score first, leftmost among equals."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        key = left * len(self.bytes_of) + right
        found = self.follows.get(key)
        if found is None:
            a, b = self.texts[left], self.texts[right]
            found = self.merged(a + b) == [a, b]
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            self.follows[key] = found
        return found

    def fallback(self, character: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in character.encode("utf-8")]

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Identifiers of words that come in sorted order.

        state[j] = (piece, start, score) of the last piece of the best way to position j; open_[j] = the starts from
        which a piece may still go on, with their place in the trie of pieces. Both are stacks along the current word.
        """
        before = ""
        state: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
        open_: list[list[tuple[int, dict]]] = [[]]
        trie, bpe, scores = self.trie, self.bpe, self.scores
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del state[shared + 1:], open_[shared + 1:]
            for j in range(shared, len(word)):
                c = word[j]
                going = [(i, n[c]) for i, n in open_[j] if c in n]
                if c in trie:
                    going.append((j, trie[c]))
                best = None
                for i, node in going:
                    piece = node.get("")
                    if piece is None:
                        continue
                    if bpe:
                        last = state[i][0]
                        if i == 0 or last < 0 or self.may_follow(last, piece):
                            if i or len(node_text := self.texts[piece]) == 1 or self.may_stand(node_text):
                                best = (piece, i, 0.0)
                                break
                    elif best is None or state[i][2] + scores[piece] > best[2]:
                        best = (piece, i, state[i][2] + scores[piece])
                if best is None:
                    best = (-1, j, state[j][2] + self.low)
                state.append(best)
                open_.append(going)
            before = word
            found: list[int] = []
            j = len(word)
            while j:
                piece, i, _ = state[j]
                found.extend([piece] if piece >= 0 else reversed(self.fallback(word[i:j])))
                j = i
            yield word, tuple(reversed(found))

    def may_stand(self, text: str) -> bool:
        """Whether merging a piece's own text gives the piece."""
        key = -1 - self.ids[text]
        found = self.follows.get(key)
        if found is None:
            found = self.follows[key] = self.merged(text) == [text]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of some texts, one after the other, and how many each text has.

        The identifiers of remembered words lie in one array, from which whole batches are gathered.
        """
        cut = [self.cut((self.prefix + t.replace(" ", MARK)) if t else "") for t in texts]
        distinct = set(chain.from_iterable(cut))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        for word, ids in self.encode_sorted(sorted(distinct.difference(self.known))):
            self.known[word] = len(self.ends)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        ends, flat = np.array(self.ends, np.int64), np.array(self.flat, np.int32)
        starts = np.concatenate([[0], ends])[words]
        lengths = ends[words] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)]
        if max(map(len, distinct), default=0) > LONGEST_REMEMBERED:
            self.forget()
        return ids, np.diff(total[np.cumsum([0, *map(len, cut)])])

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q")

    def decode(self, ids: Iterable[int]) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _groups(column: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for value in column:
        text = value.as_py()
        group.append(text)
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _with_column(frame: DataFrame, name: str, kind: T.DataType, compute) -> DataFrame:
    kept = frame.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, n in enumerate(batch.schema.names) if n != name]
            for start, array in compute(batch):
                rows = batch.slice(start, len(array))
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keep], array], [*[batch.schema.names[k] for k in keep], name])

    return frame.mapInArrow(run, schema)


def encode(frame: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the identifiers of a text column; ``model`` is the path of a model file on every executor."""
    def compute(batch):
        at, pieces = 0, _model(model)
        for group in _groups(batch[text]):
            flat, lengths = pieces.encode([t or "" for t in group])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield at, pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([t is None for t in group]))
            at += len(group)

    return _with_column(frame, ids, T.ArrayType(T.IntegerType()), compute)


def decode(frame: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of identifiers; bytes that are not UTF-8 become replacement characters."""
    def compute(batch):
        pieces, column = _model(model), batch[ids]
        step = 512
        for at in range(0, len(column), step):
            rows = column.slice(at, step)
            yield at, pa.array(
                [None if not r.is_valid else pieces.decode(r.values.to_pylist()).decode("utf-8", "replace") for r in rows], pa.string()
            )

    return _with_column(frame, text, T.StringType(), compute)


def round_trip(documents: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns to keep, n_tokens, ids, decoded_sha256 and whether decoding gives the text back, for every whole text.

    The same as ``decode`` after ``encode``, in one pass with one Python worker a task.
    """
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            at = 0
            for group in _groups(batch["text"]):
                flat, lengths = pieces.encode([t or "" for t in group])
                ends = np.cumsum(lengths)
                missing = [t is None for t in group]
                decoded = [pieces.decode(flat[e - n:e].tolist()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([
                    *[batch[c].slice(at, len(group)) for c in keep],
                    pa.array([None if m else int(n) for m, n in zip(missing, lengths)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat), mask=pa.array(missing)),
                    pa.array([None if m else hashlib.sha256(d).hexdigest() for m, d in zip(missing, decoded)], pa.string()),
                    pa.array([m or d == t.encode("utf-8") for m, d, t in zip(missing, decoded, group)]),
                ], [*keep, "n_tokens", "ids", "decoded_sha256", "same"])
                at += len(group)

    rows = documents.select(*keep, "text")
    results = [
        T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType()),
    ]
    return rows.mapInArrow(both, T.StructType([*documents.select(*keep).schema.fields, *results]))
