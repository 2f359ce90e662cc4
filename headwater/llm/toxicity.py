"""Toxicity from a learned lexicon, matched through Levenshtein automata in context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.learning import TRAINING_ROWS, Logistic, fold, training_rows
from headwater.session import materialise

FOLDS, HELD = 5, 0
THRESHOLD = 0.5
STEMS = range(4, 11)  # letters of a stem: a term with any ending
SUPPORT = 5  # toxic texts that a term occurs in, at least
LIFT = 3.0  # log of the ratio of its rates in toxic and in other texts, at least
TERMS = 4_000  # of the lexicon, the best: the bound of what every task holds
FUZZY = 5  # letters of a term that may be misspelled, at least
CONTEXT = 6  # words on either side of a hit
HELD_WORDS = 300_000  # words that a task keeps looked up, and
HELD_MOVES = 200_000  # transitions; more only cost time
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[^\W_]+")  # digits too: they stand in for letters
QUOTES = re.compile("[\"“”«»„]")
# Words that report speech, and words that address a reader: fixed lists.
REPORTING = frozenset("said says wrote quote quoted called sagte sagt schrieb nannte zitat dijo dice escribió llamó cita dit écrit appelé citation".split())
ADDRESSING = frozenset("you your u ur du dich dein ihr tu te vous votre toi usted ustedes vos".split())


def lexicon(rows: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is_stem, weight) from training rows (text, label): letters whose texts are
    mostly toxic. A stem stands for all words it begins. Whole words stay beside stems; a
    stem goes only where one letter more has the same counts, so stems are as long as
    their support allows and can be told when misspelled.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    terms = rows.select("label", F.explode(words).alias("word")).filter("length(word) >= 3")
    stems = [F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS]
    keys = F.explode(F.array_compact(F.array(F.concat("word", F.lit("$")), *stems)))
    # Stems count words here, not texts; the ratio of the two rates is what decides.
    counts = terms.select("label", keys.alias("term")).groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    totals = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).first()
    toxic, other = (totals["toxic"] or 0) + 1, (totals["other"] or 0) + 1
    lift = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("other") + 0.5) / other)
    best = counts.filter(F.col("toxic") >= SUPPORT).withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    found = best.orderBy(F.desc("lift"), F.desc("toxic"), "term").limit(TERMS).collect()
    stems = {r["term"]: (r["toxic"], r["other"]) for r in found if not r["term"].endswith("$")}
    shorter = {term[:-1] for term, counted in stems.items() if stems.get(term[:-1]) == counted}
    return [(r["term"].rstrip("$"), r["term"] in stems, float(r["lift"])) for r in found if r["term"] not in shorter]


class Automaton:
    """Levenshtein automata of distance one run against a trie of terms, as one machine.

    With `swaps`, two neighbouring letters swapped are one edit as well. A state is a set of (trie node,
    edits so far, letter that a swap still waits for); transitions are computed when first
    met and kept with the best stem they reach, so a word costs a lookup per letter.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], swaps: bool = False):
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[str, float]] = {}
        self.stems: dict[int, tuple[str, float]] = {}
        self.depth = [0]
        for term, stem, weight in terms:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][letter]
            (self.stems if stem else self.words)[node] = term, weight
        self.start = self._closed({(0, 0, "")})
        self.moves: dict[tuple, tuple] = {}

    def _closed(self, states):
        states = set(states)
        states |= {(child, 1, "") for node, edits, _ in states if not edits for child in self.children[node].values()}
        return tuple(sorted(s for s in states if not s[1] or s[2] or (s[0], 0, "") not in states))

    def _step(self, state, letter):
        out = set()
        for node, edits, awaited in state:
            if awaited:
                if letter == awaited:
                    out.add((node, 1, ""))
                continue
            if letter in self.children[node]:
                out.add((self.children[node][letter], edits, ""))
            if not edits:
                out.add((node, 1, ""))
                for first, child in self.children[node].items():
                    out.add((child, 1, ""))
                    if self.swaps and letter != first and letter in self.children[child]:
                        out.add((self.children[child][letter], 1, first))
        return self._closed(out)

    def _best(self, state, terms):
        """(edits, -weight, term) of the best of `terms` that the state accepts."""
        return min(((edits, -terms[node][1], terms[node][0]) for node, edits, awaited in state
                    if node in terms and not awaited and (not edits or self.depth[node] >= FUZZY)), default=None)

    def match(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of the closest term, the one of most weight on ties."""
        state, found = self.start, []
        for letter in word:
            key = state, letter
            move = self.moves.get(key)
            if move is None:
                if len(self.moves) >= HELD_MOVES:
                    self.moves.clear()
                after = self._step(*key)
                move = self.moves[key] = after, self._best(after, self.stems)
            state, stem = move
            if stem:
                found.append(stem)
            if not state:
                break
        whole = self._best(state, self.words)
        if whole:
            found.append(whole)
        if not found:
            return None
        edits, weight, term = min(found)
        return term, -weight, edits


class Reader:
    """Hits of one text in their context."""

    def __init__(self, terms):
        self.machine = Automaton(terms, swaps=True)
        self.known: dict[str, tuple | None] = {}

    def word(self, word: str):
        if len(self.known) >= HELD_WORDS:
            self.known.clear()
        found = None
        lower = word.lower()
        for part in dict.fromkeys(SIGNS.findall(lower) + LETTERS.findall(lower)):
            hit = self.machine.match(part)
            if hit and (found is None or (hit[2], -hit[1]) < (found[2], -found[1])):
                found = hit
        self.known[word] = found
        return found

    def hits(self, text: str | None) -> tuple[int, list[tuple[str, float, int, bool, bool]]]:
        """Words of the text; (term, weight, edits, quoted, addressed) of each hit."""
        words = (text or "").split()
        known, missing = self.known, object()
        out = []
        for at, word in enumerate(words):
            hit = known.get(word, missing)
            if hit is missing:
                hit = self.word(word)
            if hit is not None:
                before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
                near = {w.strip(".,;:!?\"'").lower() for w in before + after}
                marks = len(QUOTES.findall(" ".join(before))) % 2 == 1 or bool(QUOTES.match(word))
                quoted = marks and bool(QUOTES.search(" ".join([word[1:], *after]))) or bool(near & REPORTING)
                out.append((*hit, quoted, bool(near & ADDRESSING)))
        return len(words), out

    def features(self, text: str | None) -> list[float]:
        """Context-window sums over hits: abuse, quotation, misspellings, address; and length."""
        n, hits = self.hits(text)
        plain = [h for h in hits if not h[3] or h[4]]
        exact = sum(w for _, w, e, _, _ in plain if not e)
        fuzzy = sum(w for _, w, e, _, _ in plain if e)
        size = np.log1p(n)
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(sum(w for _, w, e, q, a in hits if q and not a)),
                len({t for t, _, e, _, _ in plain if not e}), np.sqrt(exact / max(n, 20)), np.sqrt(fuzzy / max(n, 20)),
                np.log1p(sum(h[4] for h in plain)), size]


FEATURES = 8


def featured(docs: DataFrame, terms, *keep: str, model: Logistic | None = None) -> DataFrame:
    """`keep` beside the features of each text, or its score where a model is given."""
    @F.pandas_udf("array<double>" if model is None else "double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(terms)
        for texts in batches:
            found = [[float(v) for v in reader.features(t)] for t in texts]
            if model is None:
                yield pd.Series(found, dtype=object)
            else:
                yield pd.Series(model.score(np.array(found).reshape(-1, FEATURES)), dtype="float64")

    return docs.select(*keep, of_texts("text").alias("features" if model is None else "score"))


def learned(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[tuple[str, bool, float]], Logistic]:
    """Terms, and weights of the features, from labelled rows outside the held-out fold."""
    sample = materialise(training_rows(docs, labels, "toxic", FOLDS, HELD, rows), "toxic")
    terms = lexicon(sample)
    known = featured(sample, terms, "doc_id", "label").collect()  # a few numbers for each sampled document
    known = sorted(known, key=lambda r: str(r["doc_id"]))  # sums do not depend on which task answers first
    return terms, Logistic(np.array([r["features"] for r in known]).reshape(-1, FEATURES), np.array([r["label"] for r in known], float))


def scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`, by its text alone.

    Terms and weights are learned from about `rows` labelled rows outside the held-out
    fold. NULL and empty texts have no hits and get a low score; without labels of both
    kinds every score is the prior rate. Repeated rows score alike; other columns are
    ignored; an empty table gives an empty one.
    """
    terms, model = learned(docs, labels, rows)
    found = featured(docs, terms, "doc_id", model=model)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """`docs` without the rows that score as toxic; all others stay as they are. Each row
    goes or stays by its own text, whatever its doc_id.
    """
    terms, model = learned(docs, labels, rows)
    found = featured(docs.withColumn("_row", F.struct(*docs.columns)), terms, "_row", model=model)
    return found.filter(F.col("score") < THRESHOLD).select("_row.*")
