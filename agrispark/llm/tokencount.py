"""Token counts under a byte-level BPE vocabulary, by heap-and-linked-list merging; no identifiers are produced.

A text is cut at the special strings, each of which is one token, and then by the vocabulary's word pattern. A piece
starts as its bytes; the adjacent pair of lowest rank, leftmost first, is merged again and again. Its count is the
number of bytes minus the number of merges. Pieces repeat, so counts are remembered per worker, within a size bound.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and extra columns need no care, since only
doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000  # pieces per worker
LONGEST_REMEMBERED = 64
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"  # all letters of a text that PLAIN accepts; its only digits are 0-9
PLAIN = re.compile(f"[\t\n\r -~{LATIN}]*").fullmatch


class ByteMerges:
    """Counts the symbols that byte-pair merging leaves of a piece.

    A text of plain Latin characters is cut by the standard library's faster expressions, which agree with the pattern
    on it; every other text by the pattern itself.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = _shown_bytes()
        symbols: dict[str, int] = {c: i for i, c in enumerate(shown)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            new = symbols.setdefault(left + right, len(symbols))
            self.pairs[symbols[left], symbols[right]] = (rank, new)
        specials = sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.any_pieces = regex.compile(pattern).findall
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LATIN}0-9]")
        self.plain_pieces = re.compile(latin.replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")).findall
        self.counts: dict[str, int] = {}

    def count_piece(self, piece: bytes) -> int:
        symbol = list(piece)
        n = len(symbol)
        pairs = self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], new))
        return n - merges

    def count(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.special:
            parts = self.special.split(text)
            total += len(parts) - 1
        for part in parts:
            for piece, times in Counter((self.plain_pieces if PLAIN(part) else self.any_pieces)(part)).items():
                n = self.counts.get(piece)
                if n is None:
                    n = self.count_piece(piece.encode("utf-8"))
                    if len(piece) <= LONGEST_REMEMBERED:
                        if len(self.counts) >= REMEMBERED:
                            self.counts.clear()
                        self.counts[piece] = n
                total += n * times
        return total


def _shown_bytes() -> list[str]:
    """The character by which such vocabulary files show each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in prints else chr(extra))
        extra += b not in prints
    return out


@lru_cache(maxsize=2)
def _merges(path: str, pattern: str) -> ByteMerges:
    return ByteMerges(path, pattern)


def count_tokens(documents: DataFrame, vocabulary: str, pattern: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every whole text.

    ``vocabulary`` is the path of a tokenizer file on every executor, ``pattern`` the expression that cuts its words.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(vocabulary, pattern)
        for batch in batches:
            tokens = [merges.count(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
