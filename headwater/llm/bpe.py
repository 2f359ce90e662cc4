"""Byte-level byte-pair encoding by ranked merges, and its inverse."""

from __future__ import annotations

import base64
import hashlib
import heapq
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HELD_BYTES = 1 << 27  # of words that a task keeps encoded, about; more only cost time
AT_ONCE = 1 << 18  # ids whose bytes are put together
ENTRY = 180  # bytes that a kept word takes beside its letters and ids
LONG_PIECE = 48
NO_RANK = 1 << 62
MARKS = string.punctuation

# Unicode's White_Space, which `\s` of the pattern means; Python also counts four separators.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
BEFORE_SPACE = tuple(c + " " for c in WHITE)


def words(text: str) -> list[str]:
    """The text cut before each space that follows a character other than white space.

    No match of the split pattern crosses such a cut, nor looks beyond it, so words can
    be split and encoded one by one and each distinct word once. They join to the text.
    """
    parts = text.split(" ")
    cut = parts[:1] + [" " + p for p in parts[1:]]
    if not text or not (text[0] == " " or any(pair in text for pair in BEFORE_SPACE)):
        return cut
    joined = []
    for part in cut:
        if joined and (not joined[-1] or joined[-1][-1] in WHITE):
            joined[-1] += part
        else:
            joined.append(part)
    return joined


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold the lowest-ranked adjacent pair, the leftmost on ties, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    open_ = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while open_ and (best := min(open_)) != NO_RANK:
        at = open_.index(best)
        parts[at] += parts[at + 1]
        del parts[at + 1], open_[at]
        if at < len(open_):
            open_[at] = ranks.get(parts[at] + parts[at + 1], NO_RANK)
        if at:
            open_[at - 1] = ranks.get(parts[at - 1] + parts[at], NO_RANK)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of pairs, for pieces of any length."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i):
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Splitter:
    """The matches of the split pattern in one word, most without a regular expression."""

    def __init__(self, pattern: str):
        self.findall = regex.compile(pattern).findall

    def __call__(self, word: str) -> list[str]:
        start = word[:1] == " "
        body = word.rstrip(MARKS)
        if body[start:].isalpha():
            return [body, word[len(body) :]] if len(body) < len(word) else [word]
        left, line, right = word.partition("\n")
        if line and left[-1:].strip() and right[:1].strip():
            return [*self(left), line, *self(right)]
        return self.findall(word)


class Encoder:
    """Encodes texts, each distinct word once; decodes ids by joining their bytes.

    Words and the pieces they split into are kept as packed ids, up to HELD_BYTES.
    """

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = read_ranks(lines)
        self.code = "H" if max(self.ranks.values(), default=0) < 1 << 16 else "I"
        top = max(self.ranks.values(), default=-1) + 1
        pieces = [b""] * top
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.pieces, self.decimals = pa.array(pieces, pa.large_binary()), pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, word: str, ids: bytes) -> bytes:
        if self.held > HELD_BYTES:
            self.known.clear()
            self.held = 0
        self.held += ENTRY + len(word) + len(ids)
        self.known[word] = ids
        return ids

    def word(self, word: str) -> bytes:
        found = []
        for piece in self.split(word):
            ids = self.known.get(piece)
            if ids is None:
                ids = self._keep(piece, array(self.code, merge(piece.encode(), self.ranks)).tobytes())
            found.append(ids)
        if len(found) == 1:
            return found[0] if word in self.known else self._keep(word, found[0])
        return self._keep(word, b"".join(found))

    def text(self, text: str | None) -> bytes:
        """The ids of a text, packed."""
        if not text:
            return b""
        cut = words(text)
        found = list(map(self.known.get, cut))
        if None in found:
            found = [self.word(w) if f is None else f for f, w in zip(found, cut)]
        return b"".join(found)

    def ids(self, text: str | None) -> list[int]:
        return array(self.code, self.text(text)).tolist()

    def digests(self, packed: list[bytes]) -> list[tuple[int, str, str]]:
        """For each list of ids their number, the hash of their decimals joined by a space, and that of
        the bytes they decode to. The bytes of some AT_ONCE ids are put together at a time."""
        ids, out = np.frombuffer(b"".join(packed), f"<u{array(self.code).itemsize}"), []
        ends = np.cumsum([len(p) // ids.itemsize for p in packed]).tolist()
        hashers, row, begin = [hashlib.sha256(), hashlib.sha256()], 0, 0
        for at in range(0, max(len(ids), 1), AT_ONCE):
            some = pa.array(ids[at : at + AT_ONCE])
            joined = [self._joined(column, some) for column in (self.decimals, self.pieces)]
            stop = at + len(some)
            while row < len(ends) and (ends[row] <= stop or stop > begin):
                upto = min(ends[row], stop)
                whole = ends[row] <= stop
                for k, (hasher, (edges, data)) in enumerate(zip(hashers, joined)):
                    first = max(begin, at) - at
                    # No space after the last decimals.
                    hasher.update(data[edges[first] : edges[upto - at] - (k == 0 and whole and ends[row] > begin)])
                if not whole:
                    break
                out.append((ends[row] - begin, hashers[0].hexdigest(), hashers[1].hexdigest()))
                hashers, begin, row = [hashlib.sha256(), hashlib.sha256()], ends[row], row + 1
        return out

    @staticmethod
    def _joined(column: pa.Array, ids: pa.Array) -> tuple[list[int], memoryview]:
        """(edges of the entries, all of them one after the other)."""
        taken = column.take(ids)
        edges = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
        return edges, memoryview(taken.buffers()[2] or b"")


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`docs` with ids array<int>: the tokens of every whole text, NULL counting as empty."""
    with open(ranks, "rb") as file:
        lines = file.read()

    @F.pandas_udf("array<int>")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(lines, pattern)
        for texts in batches:
            yield pd.Series([encoder.ids(t) for t in texts])

    return docs.withColumn("ids", of_texts("text"))


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """`encoded` with text_bytes binary, the joined bytes of `ids`; NULL ids give none."""
    with open(ranks, "rb") as file:
        lines = file.read()

    @F.pandas_udf("binary")
    def of_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = {rank: token for token, rank in read_ranks(lines).items()}
        for column in batches:
            yield pd.Series([b"".join([pieces[i] for i in ids]) if ids is not None else b"" for ids in column])

    return encoded.withColumn("text_bytes", of_ids("ids"))


def round_trip(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded.

    Empty and NULL texts have no tokens and the digests of nothing. Rows stay where they
    are, repeats included; ids never leave the task, so nothing is shuffled.
    """
    with open(ranks, "rb") as file:
        lines = file.read()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(lines, pattern)
        for texts in batches:
            rows, held = [], []
            for text in texts:
                held.append(encoder.text(text))
                if sum(map(len, held)) >= 2 * AT_ONCE:
                    rows += encoder.digests(held)
                    held = []
            rows += encoder.digests(held)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
