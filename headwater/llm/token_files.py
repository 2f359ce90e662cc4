"""Token id files with Elias-Fano coded document boundaries."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.bpe import WHITE, Splitter, words
from headwater.session import materialise, work_folder

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END = 2  # the id appended to each document
MAGIC = b"HWTOKENS"
HEADER = "<8sQQQqBxxxxxxx"  # magic, documents, tokens, rows without doc_id, least doc_id, bytes per id
SAMPLE = 256  # ones between two positions that the select structure keeps
HELD_BYTES = 1 << 28  # of words and pieces that a worker keeps encoded, about; more only cost time
ENTRY = 160  # bytes that a kept word takes beside its letters and ids
STEP_BYTES = 1 << 23  # of text encoded at once
READ_AT_ONCE = 8 * SAMPLE  # documents whose boundaries are decoded together
FILE_TOKENS = 1 << 23  # of a file, at least, before the next begins


class EliasFano:
    """Ascending numbers in about 2 + log2(top / count) bits each.

    Low bits stand side by side; high bits are unary: number i sets bit (high + i). For
    select, the positions of every SAMPLE-th one are kept as 32-bit numbers, so one number
    is found without reading the others and without a table of 64-bit offsets.
    """

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, count)).bit_length() - 1)
        at = (values >> low_bits) + np.arange(count)
        bits = np.zeros(int(at[-1]) + 1 if count else 0, np.uint8)
        bits[at] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(count, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(bits, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _low(self, first: int, last: int) -> np.ndarray:
        bits = np.unpackbits(self.low[first * self.low_bits // 8 : -(-last * self.low_bits // 8)], bitorder="little")
        skip = first * self.low_bits % 8
        bits = bits[skip : skip + (last - first) * self.low_bits].reshape(last - first, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return (at - np.arange(self.count)) << self.low_bits | self._low(0, self.count)

    def select(self, i: int) -> int:
        """Number i, from the sample before it."""
        begin = int(self.samples[i // SAMPLE])
        after = i // SAMPLE + 1
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        at = begin + int(np.flatnonzero(bits)[i % SAMPLE])
        return (at - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Numbers first to last - 1: selected from the samples around them, a block of bits at once."""
        if first >= last:
            return np.empty(0, np.int64)
        begin, after = int(self.samples[first // SAMPLE]), -(-last // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        at = begin + np.flatnonzero(bits)[first % SAMPLE : first % SAMPLE + last - first]
        return (at - np.arange(first, last)) << self.low_bits | self._low(first, last)

    def bytes(self) -> bytes:
        parts = [p.tobytes() for p in (self.low, self.high, self.samples)]
        return struct.pack("<QQQQQ", self.count, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        count, low_bits, *sizes = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        arrays = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4"))):
            arrays.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(count, low_bits, *arrays), at


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """One file: header, ids of all documents, their boundaries, and their doc_ids, which ascend, NULLs first."""
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    head = struct.pack(HEADER, MAGIC, len(sizes), int(sizes.sum()), len(doc_ids) - len(named), least, width)
    starts = EliasFano.of(np.concatenate(([0], np.cumsum(sizes))))
    return b"".join([head, *ids, starts.bytes(), EliasFano.of(named - least).bytes()])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, EliasFano]:
    """(doc_ids, token ids of all documents, boundaries) of one file."""
    magic, _, tokens, unnamed, least, width = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    ids = np.frombuffer(data, f"<u{width}", tokens, struct.calcsize(HEADER))
    starts, at = EliasFano.read(data, struct.calcsize(HEADER) + tokens * width)
    named, _ = EliasFano.read(data, at)
    return [None] * unnamed + [int(d) + least for d in named.all()], ids, starts


class Tokens:
    """Ids of texts by the tokenizers library, each distinct piece encoded once.

    Arrow splits the texts at spaces and finds the distinct words; only these pass
    through Python, and their ids are put together for all texts by position.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.split = Splitter(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}  # words, and the pieces that they split into
        self.held = 0

    def encode(self, wanted: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian numbers."""
        known = self.known
        if self.held > HELD_BYTES:
            known.clear()
            self.held = 0
        found = list(map(known.get, wanted))
        if None not in found:
            return found
        new = [w for w, f in zip(wanted, found) if f is None]
        split = [self.split(w) for w in new]
        missing = list({p for pieces in split for p in pieces if p not in known})
        for piece, ids in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            known[piece] = array(self.code, ids.ids).tobytes()
        several = [(word, pieces) for word, pieces in zip(new, split) if len(pieces) > 1]
        for word, pieces in several:
            known[word] = b"".join([known[p] for p in pieces])
        # A word of one piece is that piece.
        self.held += ENTRY * (len(several) + len(missing)) + 3 * (sum(map(len, missing)) + sum(len(w) for w, _ in several))
        return list(map(known.__getitem__, wanted))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, bytes]:
        """Ids per text, the end id included, and the ids of all texts one after the other."""
        listed = pc.split_pattern(pc.fill_null(column, ""), " ")
        begin = listed.offsets.to_numpy()
        coded = listed.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        begin = begin - begin[0]
        # Words that a space does not begin for sure: their texts are cut one by one.
        unsure = np.array([not w or w[-1] in WHITE for w in distinct], bool)
        whole = np.logical_or.reduceat(unsure[at], begin[:-1])
        first = coded.take(pa.array(begin[:-1])).to_pylist()
        for row in np.flatnonzero(whole).tolist():
            first[row] = words(column[row].as_py() or "")
        lone = [w for row in first for w in (row if isinstance(row, list) else [row]) if w]
        lone = dict(zip(lone, self.encode(lone)))
        # Number of words, then: the first entry of each text, the end id, and nothing.
        entries = self.encode([" " + w for w in distinct])
        entries += [b"".join([lone[w] for w in row if w]) if isinstance(row, list) else lone.get(row, b"") for row in first]
        entries += [END.to_bytes(self.width, "little"), b""]
        at[np.repeat(whole, np.diff(begin))] = len(entries) - 1
        at[begin[:-1]] = len(distinct) + np.arange(len(first))
        at = np.insert(at, begin[1:], len(entries) - 2)
        sizes = np.array([len(e) for e in entries], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        kept = pa.Array.from_buffers(pa.large_binary(), len(entries), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(entries))])
        joined = kept.take(pa.array(at))
        edges = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        ends = begin[1:] + np.arange(1, len(begin))
        starts = edges[np.concatenate(([0], ends[:-1]))] if len(ends) else np.empty(0, np.int64)
        return (edges[ends] - starts) // self.width, joined.buffers()[2].to_pybytes()[edges[0] : edges[-1]]


def tokens_of(model: bytes) -> Tokens:
    """One encoder per Python worker: task functions travel by value, so a global of this
    module would be made anew in each task; the library's own module stays."""
    held = vars(tokenizers).setdefault("_headwater_tokens", {})
    if model not in held:
        held.clear()
        held[model] = Tokens(model)
    return held[model]


def _file_system(folder: str):
    from pyarrow import fs

    if ":" not in folder.split("/")[0]:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, model: str = MODEL, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write `docs` as token files below `folder`; returns their list.

    (part, number, file, documents, tokens): files in the order of part and number hold
    the documents in ascending doc_id order, NULLs first and equal ones by a hash of their text. A
    file gets its name once it is whole, and only listed files count, so repeated or
    lost tasks leave no half of anything. `folder` must be shared by all executors.
    """
    with open(model, "rb") as file:
        content = file.read()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = tokens_of(content), TaskContext.get().partitionId()
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        doc_ids, sizes, ids, number = [], [], [], 0

        def flush():
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tokens"
            each = np.concatenate(sizes)
            with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
                out.write(pack(doc_ids, each, ids, tokens.width))
            store.move(f"{root}/_{name}", f"{root}/{name}")
            row = part, number, name, len(doc_ids), int(each.sum())
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["part", "number", "file", "documents", "tokens"])

        for batch in batches:
            rows = max(1, min(batch.num_rows, batch.num_rows * STEP_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                found = tokens.texts(some.column(1))
                doc_ids += some.column(0).to_pylist()
                sizes.append(found[0])
                ids.append(found[1])
                if sum(map(len, ids)) >= file_tokens * tokens.width:
                    yield flush()
                    doc_ids, sizes, ids, number = [], [], [], number + 1
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # By a hash of the text too, so that one doc_id, or none, may fill several ranges.
    seal = F.xxhash64("text")
    ordered = ordered.repartitionByRange("doc_id", seal).sortWithinPartitions("doc_id", seal, "text")
    return materialise(ordered.mapInArrow(put, "part long, number long, file string, documents long, tokens long"), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the listed files, read from them.

    start counts the ids of all documents before it, over all files in order. The list
    has a short row per file; its running sum is one window over these rows.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _file_system(folder)
        for batch in batches:
            for name, before in zip(batch["file"], batch["before"]):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    doc_ids, ids, starts = unpack(stream.read())
                # The boundaries of some documents at a time: no table of all offsets is made.
                for at in range(0, len(doc_ids), READ_AT_ONCE):
                    some = doc_ids[at : at + READ_AT_ONCE]
                    edges = starts.bounds(at, at + len(some) + 1)
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                    yield pd.DataFrame({"doc_id": pd.Series(some, dtype="Int64"), "start": edges[:-1] + before,
                                        "n_tokens": np.diff(edges), "ids_crc32": crcs})

    # A file a task: files are dealt out by their place in the list.
    at = F.row_number().over(Window.orderBy("part", "number"))
    spread = placed.withColumn("at", at).repartitionByRange(max(1, min(10_000, files.count())), "at").select("file", "before")
    return spread.mapInPandas(take, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, model: str = MODEL, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write `docs` to new files in the shared folder and return what `read` finds there.

    Empty and NULL texts are documents of the end id alone; repeated rows are as many
    documents; other columns are ignored; an empty table writes no file.
    """
    folder = work_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, model, file_tokens), folder)
