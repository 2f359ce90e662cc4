"""The operators on texts against plain computations and the libraries they stand for."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm.learning import training_rows
from headwater.llm import bpe, decontamination, html, quality, ring, simhash, suffixes, token_files, toxicity

ODD = [None, "", " ", "a", "  two  spaces \n ", "it's DON'T 12３ é🙂  x", "\n\n", "word " * 700, "x" * 3000, "same text here", "same text here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


def prose(seed, n, words=400, length=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(3, 8))) for _ in range(words)]
    return [" ".join(draw.choice(vocabulary) for _ in range(length)) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, ODD)
    rows = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs)).collect()
    assert all(bytes(r.text_bytes) == (r.text or "").encode() for r in again)


def test_digests_of_ids_at_once(monkeypatch):
    """Texts that end before, at and after the ids that are put together, and far longer ones."""
    with open(bpe.RANKS, "rb") as file:
        encoder = bpe.Encoder(file.read(), P.PATTERN)
    draw = random.Random(3)
    texts = [None, "", "a", *[" ".join(prose(i, 1, length=draw.randint(0, 40))) for i in range(60)], "word " * 500, "", "b", None]
    want = []
    for text in texts:
        ids = encoder.ids(text)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for size in (1, 2, 7, 64, 1 << 18):
        monkeypatch.setattr(bpe, "AT_ONCE", size)
        assert encoder.digests([encoder.text(t) for t in texts]) == want
    assert encoder.digests([]) == []


def test_words_split_as_whole_texts_do():
    draw, split, pattern = random.Random(1), bpe.Splitter(P.PATTERN), regex.compile(P.PATTERN)
    for _ in range(20_000):
        text = "".join(draw.choice(" aB1'.,!\n\té s__%２\x1c\xa0") for _ in range(draw.randint(0, 9)))
        assert "".join(bpe.words(text)) == text
        assert [p for w in bpe.words(text) if w for p in split(w)] == pattern.findall(text)


def test_token_files_round_trip(spark):
    ids = [7, None, 3, 3, -2, 100, 11, 12, 13, 14, 15]
    docs = table(spark, ODD, ids).withColumn("start", F.lit(1)).repartition(3)
    tokenizer = Tokenizer.from_file(token_files.MODEL)
    tokenizer.encode_special_tokens = True
    rows = token_files.round_trip(docs, file_tokens=500).orderBy("start").collect()
    at, expected = 0, []
    seal = {r.text: r.seal for r in docs.select("text", F.xxhash64("text").alias("seal")).collect()}
    for doc, text in sorted(zip(ids, ODD), key=lambda r: (r[0] is not None, r[0] or 0, seal[r[1]])):
        found = tokenizer.encode(text or "", add_special_tokens=False).ids + [token_files.END]
        expected.append((doc, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    assert [tuple(r) for r in rows] == expected
    assert token_files.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("values", ([], [0], [5], [0, 0, 9], list(range(0, 100_000, 37))))
def test_elias_fano(values):
    coded, _ = token_files.EliasFano.read(token_files.EliasFano.of(np.array(values, np.int64)).bytes(), 0)
    assert coded.all().tolist() == values
    assert [coded.select(i) for i in range(0, len(values), 11)] == values[::11]
    for first, last in ((0, len(values)), (3, 3), (1, 9), (250, 520), (2047, 2050), (len(values) - 3, len(values))):
        assert coded.bounds(min(max(first, 0), len(values)), min(last, len(values))).tolist() == values[max(first, 0):last]
    if len(values) > 100:
        assert 8 * len(coded.bytes()) < len(values) * (3.2 + np.log2(values[-1] / len(values))) + 400


def test_suffix_order_sorts():
    draw = random.Random(2)
    for _ in range(60):
        text = bytes(draw.choice(b"aab" + bytes([97 + draw.randint(0, 3)])) for _ in range(draw.randint(1, 80)))
        order = suffixes.suffix_order(np.frombuffer(text, np.uint8), np.ones(len(text), bool), 200)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


def test_suffixes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 6000)  # several parts of one mark, and exchanges between them
    draw = random.Random(3)
    passage = "".join(draw.choice("abcdefgh é") for _ in range(600))
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 500))) + passage + "".join(draw.choice("xyé") for _ in range(200))
             for _ in range(120)] + [*ODD, passage * 2, "of " * 900, "a" * 399, "a" * 400, "a" * 401]
    texts.append(texts[0])
    docs = table(spark, texts).withColumn("mark", F.lit("clash")).repartition(5)
    rows = {r.doc_id: tuple(r)[1:5] for r in suffixes.removed(docs).collect()}
    assert {r.doc_id: r.repeats for r in suffixes.removed(docs).collect()} == {i: r[1] > 0 for i, r in rows.items()}
    assert [rows[i] for i in range(len(texts))] == list(brute_repeats(texts, 400))
    kept = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert len(kept) == len(texts) and kept[0].text == "" and kept[0].n_chars == 0 and kept[len(texts) - 2].text == ""
    assert kept[120].text is None and kept[121].text == ""
    assert suffixes.removed(docs.limit(0)).count() == 0


def test_passages_of_over_fifty_words_go(spark):
    drawn = random.Random(19)
    word = lambda n: "".join(drawn.choice("abcdefghij") for _ in range(n))
    passage = [word(n) for n in [4] * 7 + [5] * 43 + [4, 4, 4]]
    short = [word(5) for _ in range(50)]
    assert len(passage) == 53 and len(" ".join(passage)) == 307
    a, b, c, d = (" ".join(word(6) for _ in range(40)) for _ in range(4))
    texts = [f"{a} {' '.join(passage)} {b}", f"{c}\n{'  '.join(passage)}", f"{' '.join(short)} {d}", f"{b} {' '.join(short)}", "é " * 30, "é " * 60, *ODD]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in suffixes.without_passages(docs).collect()}
    assert [rows[i].text for i in range(6)] == [f"{a}  {b}", f"{c}\n", texts[2], texts[3], texts[4], " "]
    assert rows[0].n_chars == len(rows[0].text) and len(rows) == len(texts)
    assert [rows[6 + i].text for i, t in enumerate(ODD) if t is None or len(t) < 100] == [t for t in ODD if t is None or len(t) < 100]
    import corpus_pipeline
    assert {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()} == {i: r.text for i, r in rows.items()}


def brute_groups(prints, ids, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= distance:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min(least[find(i)]) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    draw = random.Random(4)
    texts = list(ODD)
    for text in prose(5, 25):
        words = text.split()
        texts.append(text)
        for _ in range(draw.randint(0, 8)):
            changed = list(words)
            changed[draw.randrange(len(words))] = "other"
            texts.append(" ".join(changed))
    prints = []
    for text in texts:
        words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    docs = table(spark, texts).withColumn("component", F.lit(0))
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [rows[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    expected = brute_groups(prints, range(len(texts)), 4)
    assert [rows[i].component_id for i in range(len(texts))] == expected
    one = simhash.one_of_each(docs.union(docs))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(expected)) and one.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_of_fingerprints_link(spark):
    """A path of values three bits apart, none near its ends' bucket mates."""
    value, prints = 0, [0]
    for step in range(20):
        value ^= 0b111 << 3 * step
        prints.append(value)
    table_ = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints + [(1 << 63) - 1]], "fp long")
    groups = collections.Counter(r.component for r in simhash.linked(table_).collect())
    assert sorted(groups.values()) == [21] or sorted(groups.values()) == [22]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_in_buckets_are_not_broadcast(spark, monkeypatch):
    """Each has a row for every choice of blocks; Spark sizes them as if it had one."""
    plans = {}

    def noted(df, label, write=simhash.materialise, **options):
        plans[label] = plan_of(df)
        return write(df, label, **options)

    monkeypatch.setattr(simhash, "materialise", noted)
    simhash.linked(spark.range(300).select((F.col("id") * F.col("id")).alias("fp")))
    assert "SortMergeJoin" in plans["buckets"] and "SortMergeJoin" in plans["open"]
    assert "Broadcast" not in plans["buckets"] + plans["open"]


def test_exploded_marks_and_passages_are_not_broadcast(spark):
    texts = prose(8, 3)
    docs = table(spark, [*texts, texts[0] + " " + texts[1]])
    assert "SortMergeJoin [mark" in plan_of(suffixes.repeated_spans(docs, 100))
    assert "BroadcastHashJoin" not in plan_of(decontamination.leaks(docs, spark.createDataFrame([(1, texts[2])], "item_id long, text string")))


def test_ring_shards(spark):
    ids = [None, None, 5, 5, 5, *range(1000)]
    docs = table(spark, ["é"] * 5 + [None, ""] + ["text"] * 998, ids).withColumn("point", F.lit(9))
    rows = ring.shard(docs, shards=24).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 24 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 0} == {(8, 0)}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 5 and r.size == 10} == {(10, zlib.crc32("é".encode()))}
    assert ring.shard(docs.limit(0)).count() == 0
    # Each shard has what a plain clockwise walk gives it.
    point = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 20), F.lit(ring.POINTS)).alias("p")).collect()}
    owner, counts = ring.ring(24), collections.Counter(point[i] for i in ids)
    room = [len(ids) // 24 + (s < len(ids) % 24) for s in range(24)]
    walked, over = collections.Counter(), []
    for p in sorted(counts):
        for _ in range(counts[p]):
            if walked[owner[p]] < room[owner[p]]:
                walked[owner[p]] += 1
            else:
                over.append(p)
    home = collections.Counter({s: n for s, n in walked.items()})
    for p in over:
        while walked[owner[p]] >= room[owner[p]]:
            p = (p + 1) % ring.POINTS
        walked[owner[p]] += 1
    assert {s: len(v) for s, v in slots.items()} == walked
    at_home = collections.Counter(r.shard for r in rows if owner[point[r.doc_id]] == r.shard)
    assert all(at_home[s] >= home[s] for s in range(24)) and sum(at_home.values()) >= sum(home.values())
    # Most keys stay at home, and a further shard takes places without moving others.
    owner, grown = ring.ring(24), ring.ring(25)
    assert {g for o, g in zip(owner, grown) if o != g} == {24}


def labelled(spark):
    clean, bad = prose(6, 160), prose(6, 80)
    texts = clean + [t.replace(" ", " scumbag ", 3) + " rotten scumbag" for t in bad]
    labels = [(i, int(i < 160), int(i >= 160)) for i in range(len(texts))]
    return texts, spark.createDataFrame(labels + [(3, None, None), (900, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    texts, labels = labelled(spark)
    fresh = prose(6, 3)
    texts += [fresh[0] + " scumbga scumba rottn scumbags scunbag scumbaag", "", None, fresh[1]]
    docs = table(spark, texts).withColumn("label", F.lit(1)).withColumn("features", F.lit(1))
    rows = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(rows[i].predicted == int(i >= 160) for i in range(240))
    assert [rows[i].predicted for i in (241, 242, 243)] == [0, 0, 0] and rows[240].score > rows[243].score
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.scores(docs, labels.limit(0)).count() == len(texts)
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_automaton_finds_one_edit():
    machine = toxicity.Automaton([("scumbag", False, 2.0), ("idio", True, 1.0), ("bad", False, 1.0)])
    for word in ("scumbag", "scumba", "scumbagg", "sumbag", "scunbag", "xscumbag"):
        assert machine.match(word)[0] == "scumbag"
    assert machine.match("scmubag") is None and machine.match("bud") is None and machine.match("") is None
    assert machine.match("idiotic")[0] == "idio" and machine.match("bad")[2] == 0


def test_training_rows_are_bounded_by_documents(spark):
    """A third of all rows under one doc_id, and NULLs: one text each, whatever the order of the rows."""
    texts, labels = labelled(spark)
    rows = table(spark, texts + [f"{i} {texts[0]}" for i in range(3000)], [*range(len(texts)), *[1] * 3000])
    for bound in (100, 20_000):
        one = training_rows(rows, labels, "toxic", 5, 0, bound).collect()
        two = training_rows(rows.repartition(7).orderBy("text"), labels, "toxic", 5, 0, bound).collect()
        assert sorted(one) == sorted(two) and len(one) == len({r.doc_id for r in one}) <= 240


def test_quality_learns_from_whole_texts_in_any_order(spark):
    """Good and bad texts differ in their last words alone."""
    start = " ".join(prose(41, 60))
    good, bad = prose(42, 150, length=900), [" ".join(w + "!!" for w in t.upper().split()) for t in prose(43, 150, length=900)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = table(spark, [f"{start} {t}" for t in good + bad])
    one = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    two = {r.doc_id: r.score for r in quality.scores(docs.repartition(9).orderBy(F.desc("text")), labels.repartition(3)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(one[i] >= 0.7) == (i < 150) for i in held]) > 0.95
    assert one == two


def test_clashing_names_in_filtering_stages(spark):
    item = prose(9, 1, length=30)[0]
    texts = [f"a b {item}", *prose(51, 3), prose(51, 3)[0]]
    names = ("_doc", "_seal", "_key", "_spans", "row", "key", "seal", "doc", "spans", "component", "found")
    docs = table(spark, texts).select("*", *[F.lit(1).alias(n) for n in names])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for kept in (simhash.one_of_each(docs), suffixes.without_passages(docs), suffixes.without_repeats(docs), decontamination.without_leaks(docs, benchmark)):
        assert kept.columns == docs.columns and 3 <= len(kept.collect()) <= 5


def test_learned_terms_match_misspelled(spark):
    drawn = prose(16, 301)
    clean, bad = drawn[:200], drawn[200:300]
    terms = ["idiotic", "scumbag", "pathetic", "worthless"]
    wrong = ["id1otic", "skumbag", "pahtetic", "wrothless", "idoitic", "scmubags"]
    draw = random.Random(18)
    bad = [f"{t} {draw.choice(terms)} {draw.choice(terms)} {draw.choice(wrong)}" for t in bad]
    texts = clean + bad
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(300)], "doc_id long, quality int, toxic int")
    fresh = drawn[300]
    docs = table(spark, [*texts, fresh, *(f"{fresh} {w} {w} {w}" for w in wrong)])
    sample = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label")).filter("doc_id % 2 = 0")
    found = {(t, stem) for t, stem, _ in toxicity.lexicon(sample)}
    assert {(t, stem) for t in terms for stem in (False, True)} <= found and ("path", True) not in found
    rows = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert [rows[300 + k].predicted for k in range(7)] == [0] + [1] * 6


def test_misspelled_terms_are_near():
    reader = toxicity.Reader([("moron", True, 2.0), ("idiot", False, 1.0), ("idiot", True, 1.0)])
    assert [reader.word(w)[0] for w in ("moorn", "mroonic", "idoit", "Id1ot!", "idots", "123idiot")] == ["moron"] * 2 + ["idiot"] * 4
    assert reader.word("idiot")[2] == 0 and reader.word("moor") is None and reader.word("1230") is None


def test_quoted_hits_count_apart():
    reader = toxicity.Reader([("scumbag", False, 2.0)])
    plain, quoted = reader.features("what a scumbag today"), reader.features('a word like "scumbag" is old')
    assert plain[0] > 0 and quoted[0] == 0 and quoted[2] > 0
    assert reader.features('he said "you scumbag" to them')[0] > 0


def test_quality_tells_kinds_apart(spark):
    good = prose(7, 200)
    bad = [" ".join(w + "!!" for w in t.upper().split()) for t in prose(8, 200)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = table(spark, good + bad + ["", None, "w" * 100_000]).withColumn("score", F.lit(3))
    rows = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(rows[i].held_out for i in held)
    assert np.mean([rows[i].predicted == int(i < 200) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 403
    assert quality.scores(docs, labels.limit(0)).count() == 403


def test_alignment_finds_edited_copies(spark):
    items = prose(9, 6, length=30)
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, ""), (52, "of the")], "item_id long, text string")
    edited = items[1].split()
    edited[4], edited[15] = "swapped", "changed"
    del edited[22]
    filler = prose(10, 4, length=200)
    texts = [filler[0] + " " + items[0].upper() + ". " + filler[1], filler[1] + " " + " ".join(edited) + " " + filler[2], filler[3],
             " ".join(items[2].split()[:9]), *ODD]
    docs = table(spark, texts).withColumn("item_id", F.lit(1)).withColumn("at", F.lit(1))
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, benchmark).collect()}
    assert set(found) == {(0, 0), (1, 1)}
    assert found[0, 0].score == 1 and (found[0, 0].first_word, found[0, 0].n_words) == (200, 30) and found[1, 1].score < 1
    in_blocks = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark, items_per_block=2).collect()}
    assert in_blocks == set(found)
    kept = decontamination.without_leaks(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2, len(texts))) and kept.columns == docs.columns
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), benchmark).count() == 0


def test_blocks_of_many_words(spark):
    many = [(i, " ".join(f"w{i * 30 + k}" for k in range(30))) for i in range(2_000)]
    found = decontamination.leaks(table(spark, ["x y " + many[1234][1], "x"]), spark.createDataFrame(many, "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.score, r.first_word) for r in found.collect()] == [(0, 1234, 1.0, 2)]


def edited(draw, words, share, vocabulary):
    out = []
    for word in words:
        roll = draw.random()
        if roll < share / 3:
            out.append(draw.choice(vocabulary))
        elif roll < share * 2 / 3:
            out += [word, draw.choice(vocabulary)]
        elif roll >= share:
            out.append(word)
    return out


@pytest.mark.parametrize("common", [False, True])
def test_leaks_equal_aligning_all_pairs(spark, common):
    """Items of all lengths, four rates of edits, hot groups of copies, words that all texts hold."""
    draw = random.Random(21 + common)
    vocabulary = [f"w{i}" for i in range(12 if common else 300)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 5, 7, 7, 12, 12, 20, 20, 40, 40)]
    texts = []
    for i in range(160):
        item = items[i % len(items)]
        inside = edited(draw, item, (0.0, 0.1, 0.25, 0.4)[i % 4], vocabulary)
        texts.append([draw.choice(vocabulary) for _ in range(draw.randint(0, 30))] + inside + [draw.choice(vocabulary) for _ in range(draw.randint(0, 30))])
    texts += [texts[43]] * 80 + [items[-1][:9] + ["zz", "zz", "zz"] + items[-1][12:]] * 80
    docs = table(spark, [" ".join(t).replace("w1 ", "W1,\u2003") for t in texts]).withColumn("item", F.lit(1)).withColumn("ids", F.lit(1)).repartition(4)
    benchmark = spark.createDataFrame([(f"item {i}", " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs, benchmark).collect()}
    wanted = {}
    for d, text in enumerate(texts):
        numbers = np.array([int(w[1:]) if w != "zz" else -1 for w in text])
        for i, item in enumerate(items):
            score = decontamination.align(numbers, np.array([int(w[1:]) for w in item]))[0] / len(item)
            if score >= 0.6:
                wanted[d, f"item {i}"] = score
    assert found == pytest.approx(wanted) and len(wanted) > 200
    kept = decontamination.without_leaks(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in wanted}


def test_group_of_edited_copies_is_found(spark):
    """An item verbatim in one document, and with three words changed in three hundred others."""
    item = prose(31, 1, length=40)[0].split()
    other = prose(32, 301, length=60)
    changed = [*item[:8], "aa", *item[9:19], "bb", *item[20:30], "cc", *item[31:]]
    texts = [f"{other[0]} {' '.join(item)}"] + [f"{o} {' '.join(changed)}" for o in other[1:]] + prose(33, 50)
    short = prose(34, 1, length=12)[0].split()
    texts.append(" ".join(w if i % 4 != 3 else "zz" for i, w in enumerate(short)))
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(table(spark, texts), benchmark).collect()}
    assert found == {(i, 1) for i in range(301)} | {(351, 2)}


def test_rows_of_one_doc_id_have_their_own_verdicts(spark):
    texts, labels = labelled(spark)
    item = prose(9, 1, length=30)[0]
    bad, clean = texts[200], [texts[i] for i in (1, 2, 3)]
    docs = table(spark, [*texts, *([bad, *clean] * 2)], [*range(240), *[None] * 4, *[777] * 4])
    kept = [(r.doc_id, r.text) for r in toxicity.without_toxic(docs, labels).collect() if r.doc_id in (None, 777)]
    assert sorted(kept, key=str) == sorted([(i, t) for i in (None, 777) for t in clean], key=str)

    docs = table(spark, [f"{bad} {item}", *clean] * 2, [*[None] * 4, *[777] * 4])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontamination.without_leaks(docs, benchmark).collect()]
    assert sorted(kept, key=str) == sorted([(i, t) for i in (None, 777) for t in clean], key=str)

    far = prose(20, 6)
    docs = table(spark, [*far[:3], far[0], *far[3:], far[3], far[5], None, ""], [None] * 4 + [777] * 4 + [5, None, 8])
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([*((None, t) for t in far[:3]), (777, far[3]), (777, far[4]), (5, far[5]), (8, "")], key=str)


def brute_alignment(text, item):
    best = 0.0
    h = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = decontamination.MATCH if item[i - 1] == text[j - 1] else decontamination.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_the_plain_recurrence():
    draw = np.random.default_rng(1)
    for _ in range(200):
        text, item = draw.integers(0, 4, draw.integers(1, 30)), draw.integers(1, 4, draw.integers(1, 12))
        score, begin, end = decontamination.align(text, item)
        assert score == brute_alignment(text, item)
        assert score == 0 or brute_alignment(text[begin:end], item) == score


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>menu</a></nav><header>top</header>
<div class="cookie-notice">agree</div><article><header><h1>Title &amp; {0}</h1></header><p>One <b>bold</b>
 line {0}<p>Two<br>halves<div class="box">Follow us on the web</div><ul><li>a {0}<li>b</ul><div id="comments"><p>nice</p></div>
<script>var t="</p>";</script></article><aside>more</aside><footer>&copy; x</footer></body>"""


def test_pages(spark):
    urls = ["https://h.example.com/%d" % i for i in range(30)]
    pages = [(i, u, PAGE.format(i)) for i, u in enumerate(urls)] + [
        (90, None, None), (91, "", ""), (92, "no url", "plain &lt;text&gt;  here"), (93, "http://o.org", PAGE.format("x")), (93, "http://o.org", PAGE.format("x"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rows = html.extract(df).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    # The box recurs on the host of thirty pages and goes there; it stays where pages are few.
    assert found[4].text == "Title & 4\nOne bold line 4\nTwo halves\na 4\nb" and found[4].n_chars == len(found[4].text)
    assert found[93].text == "Title & x\nOne bold line x\nTwo halves\nFollow us on the web\na x\nb"
    assert (found[90].text, found[91].text, found[92].text) == ("", "", "plain <text> here")
    assert html.extract(df.limit(0)).count() == 0


def test_quotations_and_names_as_browsers_read_them():
    assert html.main_text("<p title=it's>first</p><p>next</p>") == "first\nnext"
    assert html.main_text("<p>don't</p><p data-x=o'k>mid</p><p>it's last</p>") == "don't\nmid\nit's last"
    assert html.main_text("<p title='a > b' class=\"x>y\">kept</p>") == "kept"
    assert html.main_text('<article><p>an <span class="ad-free">ad-free</span> page</p><div class="notice-board">Board</div></article>') == "an ad-free page\nBoard"
    gone = ("ad", "ad-slot", "site-footer", "cookie-notice", "comment-list", "ad-box-2", "main-nav", "related sidebar", "comments-section")
    assert html.main_text("<article><p>text</p>" + "".join(f'<div class="{g}">{g}</div>' for g in gone) + "</article>") == "text"
    assert html.main_text('<article><p data-class="ad" data-id=menu>text</p></article>') == "text"
    assert html.main_text("<p " + 'a="b" ' * 2000 + "never closed") == "<p " + 'a="b" ' * 2000 + "never closed"


@pytest.mark.parametrize("tag", ["div", "span", "article", "section"])
def test_deep_nesting(spark, tag):
    deep = f"<{tag}>" * 10_000 + "deep" + f"</{tag}>" * 10_000
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<p>{i}</p>{deep}") for i in range(12)], "page_id long, url string, html string")
    assert all(r.text.endswith("deep") or r.text == str(r.page_id) for r in html.extract(pages).collect())
    assert html.main_text(deep) == "deep"


@pytest.mark.parametrize("count", [9, 10, 11])
def test_templates_equal_a_plain_count(spark, count):
    """Subtrees on over half of a host's different pages, where that is ten pages or more."""
    draw = random.Random(count)
    pages = [(i, "http://h.example/p", "".join(f"<div>part {k}</div>" for k in range(12) if draw.random() < (k + 1) / 12) + f"<div>own {i}</div>") for i in range(count)]
    pages += pages[:3]  # copies count once
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = {i: p for i, _, p in pages}
    held = collections.Counter(part for p in texts.values() for part in set(p.split("</div>")[:-1]))
    gone = {part for part, n in held.items() if n >= html.LEAST_PAGES and n > html.RECURRING * len(texts)}
    want = {i: "\n".join(part[5:] for part in p.split("</div>")[:-1] if part not in gone) for i, p in texts.items()}
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want and bool(gone) == (count >= 10)


def test_broken_markup():
    assert html.main_text("<div><p>one</p>two<script>x</p></script></div><table><tr><td>a<td>b<tr><td>c</table>") == "one\ntwo\na\nb\nc"
    assert html.main_text("a < b & c <") == "a < b & c <"
    assert html.main_text("<article>" + "<div>" * 200 + "deep") == "deep"
    assert html.main_text("<p>x<!-- never closed <p>y") == "x"
