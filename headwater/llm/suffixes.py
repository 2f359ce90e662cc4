"""Removal of long byte strings that a corpus repeats, by suffix sorting."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import materialise, unsent

LENGTH = 400  # bytes of a repeated string
WORDS = 51  # words of a repeated passage: over 50
CODE = 8  # bytes that stand for a word
HELD_WORDS = 150_000  # words that a task keeps hashed; more only cost time
WORD = re.compile(r"\S+")
GRAM = 64  # bytes hashed to tell where a repeat may lie
BUFFER = 1 << 19  # bytes that are sorted at once
PART = 1 << 18  # bytes of one group that are sorted together
PIECE = 1 << 16  # windows of one stretch that stay together
RARE = np.uint64((1 << 64) // 20)
MIXERS = tuple(np.uint64(2 * (0x4F1BBCDCBFA53E0A ^ (i * 0x1000193 << 8)) + 1 & (1 << 64) - 1) for i in range(5))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, for all but the last seven."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h, width = _eights(data) * MIXERS[0], 8
    h ^= h >> np.uint64(29)
    for mixer in MIXERS[1:]:
        if width == GRAM:
            break
        h = h[:-width] * mixer + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _bytes(text: str) -> bytes:
    return text.encode()


def word_coder():
    """Texts as CODE bytes for each word, a hash of it: windows of words are then windows
    of bytes, at multiples of CODE."""
    known: dict[str, bytes] = {}

    def coded(text: str) -> bytes:
        words = text.split()
        codes = list(map(known.get, words))
        for i, code in enumerate(codes):
            if code is None:
                if len(known) >= HELD_WORDS:
                    known.clear()
                codes[i] = known[words[i]] = xxhash.xxh3_64_digest(words[i].encode())
        return b"".join(codes)

    return coded


def stretches(data: bytes, length: int = LENGTH):
    """(mark, begin, end, many): runs of window starts begin..end-1 with one least gram.

    Equal windows have equal marks wherever they stand, so a window can repeat only in
    stretches of its own mark. many: the mark's gram occurs more than once in the data,
    so a stretch may repeat within itself.
    """
    codes = np.frombuffer(data, np.uint8)
    if len(codes) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    grams = _grams(codes)
    least = _sliding_min(grams, length - GRAM + 1)
    begin = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    end = np.append(begin[1:], len(least))
    marks = least[begin]
    low = np.sort(grams[grams <= RARE])
    often = np.searchsorted(low, marks, "right") - np.searchsorted(low, marks, "left") != 1
    return marks, begin, end, often


def suffix_order(codes: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The positions marked in `needed`, sorted by their suffixes to `depth` bytes at least.

    Two stages. Suffixes smaller than their successor are sorted directly. The others
    follow without a comparison: scanning the buckets of first bytes in ascending order,
    each finished bucket puts the predecessors of its suffixes, in its own order, at the
    end of their buckets' first parts. `needed` must hold, with each position of the
    second kind, its successor.
    """
    n = len(codes)
    change = np.append(np.diff(codes.astype(np.int16)), -1)
    decided = np.where(change != 0, np.arange(n), n)
    smaller = change[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    text = codes.tobytes().decode("latin-1")
    direct = sorted(np.flatnonzero(needed & smaller).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    first = codes[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and needed[n - 1]:
        induced[codes[n - 1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        chain = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        bucket = []
        while len(chain):
            bucket.append(chain)
            chain = chain[chain > 0] - 1
            chain = chain[(codes[chain] == c) & needed[chain]]
        lo, hi = np.searchsorted(first, [c, c + 1])
        bucket.append(direct[lo:hi])
        bucket = np.concatenate(bucket)
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(codes[before] > c) & needed[before]]
        keys = codes[before]
        before = before[np.argsort(keys, kind="stable")]
        keys, at = np.unique(np.sort(keys), return_index=True)
        for key, some in zip(keys, np.split(before, at[1:]) if len(at) else ()):
            induced[key].append(some)
    return np.concatenate(order)


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, `depth` at most, that each sorted suffix shares with the next one."""
    eights = _eights(np.concatenate((codes, np.zeros(depth + 8, np.uint8))))
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(shared))
    for at in range(0, depth, 8):
        differs = eights[order[alive] + at] ^ eights[order[alive + 1] + at]
        low = (differs & (~differs + np.uint64(1))).astype(np.float64)
        last = differs != 0
        shared[alive[last]] = at + np.log2(low[last]).astype(np.int64) // 8
        alive = alive[~last]
    shared[alive] = depth
    return np.minimum(shared, depth)


def repeated_windows(pieces: list[bytes], length: int = LENGTH):
    """For each piece the starts of its windows that recur in any of the pieces, and the
    starts and first bytes' order of one window of each content: (repeated, chosen)."""
    codes = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    at = np.concatenate(([0], np.cumsum(sizes)))
    window = np.zeros(len(codes), bool)
    for begin, size in zip(at.tolist(), sizes.tolist()):
        window[begin : begin + size - length + 1] = True
    needed = window.copy()
    change = np.append(np.diff(codes.astype(np.int16)), -1)
    decided = np.where(change != 0, np.arange(len(codes)), len(codes))
    rising = change[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    # From a window whose suffix is induced, all successors up to the next sorted one.
    tail = np.flatnonzero(needed[:-1] & ~needed[1:] & ~rising[:-1])
    while len(tail):
        tail = tail + 1
        needed[tail] = True
        tail = tail[(tail < len(codes) - 1) & ~rising[tail]]
        tail = tail[~needed[tail + 1]] if len(tail) else tail
    order = suffix_order(codes, needed, length)
    order = order[window[order]]
    same = common_prefixes(codes, order, length) >= length
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    lone = np.ones(len(order), bool)
    lone[1:] = ~same
    repeated, chosen = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    repeated[order[twice]] = True
    chosen[order[lone]] = True
    return ([np.flatnonzero(repeated[a:b]) for a, b in zip(at[:-1], at[1:])],
            [np.flatnonzero(chosen[a:b]) for a, b in zip(at[:-1], at[1:])])


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers as half-open pairs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + 1).tolist()))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open spans."""
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged


def repeated_spans(docs: DataFrame, length: int = LENGTH, coder=lambda: _bytes) -> DataFrame:
    """(doc_id, key, spans): half-open byte spans of window starts that recur anywhere.

    `coder` gives each task the function that makes a text's bytes.

    Every window of `length` bytes has a mark, the least hash among its grams, which
    depends on its bytes alone. Runs of windows with one mark are the unit of work:
    a few numbers each are shuffled, the bytes only of those runs that share their mark
    with a different run. Equal runs, as in copied documents, are settled by their
    count. The others of a mark are suffix-sorted together and adjacent common prefixes
    tell which windows recur. A mark with more bytes than one task should hold is sorted
    in parts; one window of each content then goes to an exchange that counts the parts
    it occurs in, after map-side counting. No repeat is lost and no mark is one task's.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = coder()
        for batch in batches:
            columns = [[] for _ in range(4)]
            row, seals = [], []
            for i, text in enumerate(batch.column(2)):
                data = coded(text.as_py() or "")
                found = stretches(data, length)
                if not len(found[0]):
                    continue
                for column, values in zip(columns, found):
                    column.append(values)
                row.append(np.full(len(found[0]), i))
                seals += [xxhash.xxh3_64_intdigest(data[b : e + length - 1])
                          for b, e in zip(found[1].tolist(), found[2].tolist())]
            if row:
                marks, begin, end, many = (np.concatenate(c) for c in columns)
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(marks.view(np.int64)),
                     pa.array(np.array(seals, np.uint64).view(np.int64)), pa.array(begin.astype(np.int64)),
                     pa.array(end.astype(np.int64)), pa.array(many)],
                    ["doc_id", "key", "mark", "seal", "begin", "end", "many"])

    runs = materialise(keyed.mapInArrow(
        find, f"doc_id {id_type}, key long, mark long, seal long, begin long, end long, many boolean"), "stretches")
    first = [F.first(c).alias(c) for c in ("doc_id", "key", "begin", "end")]
    kinds = runs.groupBy("mark", "seal").agg(F.count("*").alias("n"), F.max("many").alias("many"), *first)
    kinds = materialise(kinds, "kinds")
    marks = kinds.groupBy("mark").agg(F.count("*").alias("kinds"), F.max("many").alias("any"),
                                      F.sum(F.col("end") - F.col("begin") + length - 1).alias("bytes"))
    marks = marks.filter("kinds > 1 or any").withColumn("parts", F.ceil(F.col("bytes") / PART))
    unsettled = kinds.join(marks.select("mark", "parts"), "mark").select(
        "doc_id", "key", F.struct("mark", "seal", "begin", "end", "parts").alias("run"))
    # A document's own runs: bounded by its length, however many equal rows there are.
    wanted = unsettled.distinct().groupBy("doc_id", "key").agg(F.collect_list("run").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = coder()
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column(0), batch.column(1)):
                data = coded(text.as_py() or "")
                for run in listed.as_py():
                    for at in range(run["begin"], run["end"], PIECE):
                        stop = min(at + PIECE, run["end"]) + length - 1
                        rows.append((run["mark"], run["seal"], run["parts"], at - run["begin"], data[at:stop]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.binary(),))],
                ["mark", "seal", "parts", "at", "bytes"])

    same_key = (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    pieces = keyed.alias("d").join(wanted.alias("w"), same_key).select("d.text", "w.runs").mapInArrow(
        cut, "mark long, seal long, parts long, at long, bytes binary")
    part = F.pmod(F.xxhash64("seal", "at"), F.col("parts")).alias("part")
    pieces = pieces.select("mark", part, "seal", "parts", "at", "bytes").repartition("mark", "part")
    pieces = pieces.sortWithinPartitions("mark", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows):
            repeated, chosen = repeated_windows([r[5] for r in rows], length)
            out = []
            for (mark, _, seal, parts, at, data), starts, lone in zip(rows, repeated, chosen):
                spans = [{"a": a + at, "b": b + at} for a, b in _runs(starts)]
                open_ = [] if parts == 1 else [
                    {"at": i + at, "hash": xxhash.xxh3_64_intdigest(data[i : i + length]) - (1 << 63)} for i in lone.tolist()]
                if spans or open_:
                    out.append((mark, seal, spans, open_))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                     pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                              ["mark", "seal", "spans", "open"])

        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != last and held >= BUFFER:
                    yield settle(rows)
                    rows, held = [], 0
                last = row[:2]
                rows.append(row)
                held += len(row[5])
        if rows:
            yield settle(rows)

    sorted_ = materialise(pieces.mapInArrow(
        compare, "mark long, seal long, spans array<struct<a: long, b: long>>, open array<struct<at: long, hash: long>>"), "sorted")
    open_ = sorted_.select("mark", "seal", F.explode("open").alias("o")).select("mark", "seal", "o.*")
    shared = open_.groupBy("mark", "hash").agg(F.count("*").alias("parts")).filter("parts > 1").select("mark", "hash")
    crossing = open_.join(unsent(shared), ["mark", "hash"]).select("mark", "seal", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    inside = sorted_.select("mark", "seal", F.explode("spans").alias("s")).select("mark", "seal", "s.*")
    whole = kinds.filter("n > 1").select("mark", "seal", F.lit(0).cast("long").alias("a"), (F.col("end") - F.col("begin")).alias("b"))
    verdicts = whole.unionByName(inside.unionByName(crossing).join(
        kinds.filter("n > 1").select("mark", "seal"), ["mark", "seal"], "left_anti"))
    found = runs.join(verdicts, ["mark", "seal"]).select(
        "doc_id", "key", F.struct((F.col("begin") + F.col("a")).alias("a"), (F.col("begin") + F.col("b")).alias("b")).alias("span"))
    # Equal rows have equal spans: each counts once, so the list is bounded by the text's length.
    return found.distinct().groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))


def with_spans(docs: DataFrame, length: int = LENGTH, coder=lambda: _bytes) -> DataFrame:
    """(row, spans): each row of `docs` as a struct, and its spans of window starts that recur, NULL if none does."""
    found = materialise(repeated_spans(docs, length, coder), "spans").select("key", "doc_id", "spans").alias("found")
    # The row goes as one value, so no name of a column can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row")).alias("rows")
    same = (F.xxhash64("row.doc_id", "row.text") == F.col("found.key")) & F.col("row.doc_id").eqNullSafe(F.col("found.doc_id"))
    return rows.join(found, same, "left").select("row", F.col("found.spans").alias("spans"))


def covered(spans, length: int) -> list[tuple[int, int]]:
    return union([(s["a"], s["b"] + length - 1) for s in spans]) if spans is not None else []


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) for every row of `docs`.

    Every byte goes that lies in a string of `length` bytes which also starts elsewhere,
    in the same text or another, judged on the texts as they came. NULL texts count as
    empty, shorter texts lose nothing, of equal rows each is the other's repeat. Matches
    never cross texts. repeats tells whether the row lost any. An empty table gives an
    empty one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, at, kept = (text.as_py() or "").encode(), 0, hashlib.sha256()
                gone = covered(spans.as_py(), length)
                for begin, end in gone:
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                rows.append((len(data), sum(e - b for b, e in gone), len(gone), kept.hexdigest(), bool(gone)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats"])

    return with_spans(docs.select("doc_id", "text"), length).select("row.doc_id", "row.text", "spans").mapInArrow(
        digest, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean")


def _shortened(docs: DataFrame, found: DataFrame, cut) -> DataFrame:
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut("row.text", "spans"))
    shorter = found.select("row", text.alias("text"))
    # Columns by their place: a name may hold a dot.
    kept = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return shorter.select(*[kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with the covered bytes cut from `text`, and n_chars to match.

    A character that is covered in part stays whole, so the text stays valid. All rows
    stay, even those that are left without text; NULL texts stay NULL.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        kept = []
        for text, found in zip(texts, spans):
            if text is None or found is None:
                kept.append(text)
                continue
            data, at, parts = text.encode(), 0, []
            for begin, end in covered(found, length):
                while begin < end and data[begin] & 0xC0 == 0x80:
                    begin += 1
                while begin < end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                parts.append(data[at:begin])
                at = max(at, end)
            kept.append((b"".join(parts) + data[at:]).decode())
        return pd.Series(kept, dtype=object)

    return _shortened(docs, with_spans(docs, length), cut)


def without_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` without the passages of `words` words or more that recur, and n_chars to match.

    Every word goes, with what parts it from the next of its passage, that lies in a run
    of `words` words which also starts elsewhere, in the same text or another, however
    many bytes that is and whatever white space parts them. Rows stay as in
    `without_repeats`.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        kept = []
        for text, found in zip(texts, spans):
            if text is None or found is None:
                kept.append(text)
                continue
            places = [m.span() for m in WORD.finditer(text)]
            # A span may begin or end between words, where two hashes happen to agree.
            runs = [(-(-s["a"] // CODE), (s["b"] - 1) // CODE) for s in found]
            at, parts = 0, []
            for begin, end in union([(a, b + words) for a, b in runs if a <= b]):
                parts.append(text[at : places[begin][0]])
                at = places[end - 1][1]
            kept.append("".join(parts) + text[at:])
        return pd.Series(kept, dtype=object)

    return _shortened(docs, with_spans(docs, words * CODE, word_coder), cut)
