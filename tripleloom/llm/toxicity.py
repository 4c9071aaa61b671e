"""Toxicity of texts, after undoing leetspeak, spacing and repetition.

A character language model (trigrams over Latin letters, a word edge and
one sign for all other letters) is counted over all documents.  Spans that look
disguised - digits and signs inside words, letters set apart, letters repeated
- become lattices: each sign may stand for several letters, for an edge, or,
as a separator or a repetition, for nothing.  The likeliest path is found by
Viterbi decoding and put in the span's place.

The restored text is scored by whole words and by runs of five signs within
words, each by how often a document has it.  From a bounded labelled sample come
those that are far commoner in toxic documents; the strongest, the sum and the number of a
document's entries give a logistic value, and a rising step curve the score,
fitted on folds whose runs were chosen without them.

Only texts are read for a score.  Null and empty texts have no words and get
the score of such; without labels of both classes every score is the smoothed
share.  Repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.fit import fit_logistic, fit_steps, labelled_sample, sigmoid
from tripleloom.llm.store import id_crc, small_batches, stored

#: Labelled rows that the score is fitted on, and runs that it keeps, at most.
FIT_ROWS, RUNS = 20_000, 20_000
#: A run counts if at least this share of the toxic sample, and three documents, have it, and with this weight.
LEAST_SHARE, LEAST_WEIGHT = 0.004, 2.5
TOXIC = 0.7
#: Decoded spans that a task keeps.
KEPT_SPANS = 50_000

# Signs that stand for letters (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "h", "(": "c", "€": "e"}
_SEPARATORS = " .-_*"

# The signs of the character model: 0 is a word's edge, the last one any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_OTHER = len(LETTERS) + 1
_N = _OTHER + 1
_LIMIT = 0x2FFF
#: Entries are numbered below this: runs of five signs from 0, words from half of it on.
_ENTRIES = 1 << 45
#: Words of fewer signs are no entries.
_LEAST_WORD = 3
# A number for each sign at each place of a word; signs far into a word share places.
_PLACES = 32
_SIGNS = np.random.default_rng(20240611).integers(0, 1 << 63, (_PLACES, _N), dtype=np.int64)


def _sign(c: str) -> int:
    if not c.isalpha():
        return 0
    low = c.lower()
    return LETTERS.find(low) + 1 if low in LETTERS else _OTHER


_CODE = np.array([_sign(chr(c)) for c in range(_LIMIT)] + [_OTHER], dtype=np.uint8)

# Units set apart (a star stands among the separators, and may still be a vowel); signs between letters, before
# and behind them (not only exclamation marks); letters repeated.  Possessive runs keep the scan linear.
_SPAN = re.compile(
    r"(?P<apart>(?<!\w)(?:[^\W_]|[@$!|+#(€])(?:[ .\-_*]++(?:[^\W_]|[@$!|+#(€])(?!\w)){2,}+)"
    r"|(?<=[^\W\d_])[0-9@$!|+*#(€]++(?=[^\W\d_])|(?<![^\s\"'“‘«\[])[0-9@$!|+*#(€]++(?=[^\W\d_])"
    r"|(?<=[^\W\d_])!*+[0-9@$|+*#(€][0-9@$!|+*#(€]*+(?=[.,;:?)\]\"'”’»]*+(?!\S))|([^\W\d_])\2\2")
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = re.compile(r"\s")


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Signs of all texts with an edge around each, runs of edges made one, and where each text's own begin."""
    whole = "\n" + "".join(f"{t or ''}\n" for t in texts)
    signs = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    code = _CODE[np.minimum(signs, _LIMIT)]
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[0] = True
    edges = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts], dtype=np.int64)])
    return code[keep], np.cumsum(keep)[edges]


class CharacterModel:
    """Logarithms of trigram shares, with the most likely reading of a disguised span."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_N, _N, _N) + 0.1
        self.log = np.log(table / table.sum(axis=2, keepdims=True)).tolist()
        self._known: dict[tuple[str, bool], str] = {}

    def restore(self, span: str, apart: bool = False) -> str:
        """The likeliest reading; ``apart`` spans may lose their separators."""
        key = span, apart
        if key not in self._known:
            if len(self._known) >= KEPT_SPANS:
                self._known = {}
            self._known[key] = self._decode(span, apart)
        return self._known[key]

    def _decode(self, span: str, apart: bool) -> str:
        span = re.sub(r"(.)\1{3,}", r"\1\1\1", span)
        # A state is the last two signs; it keeps its weight and the way to it.
        states = {(0, 0): (0.0, None)}
        before = ""
        for c in span:
            options: list[tuple[int | None, float]] = []
            code = _sign(c)
            if code:
                options.append((code, 0.0))
                if c == before:
                    options.append((None, -1.0))
            else:
                options += [(ord(x) - 96, -1.0) for x in LEET.get(c, "")]
                if apart and c in _SEPARATORS:
                    options += [(None, 0.0), (0, -1.0)]
                else:
                    options.append((0, -2.0))
                    if c == before:
                        options.append((None, -2.0))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (weight, way) in states.items():
                for code, cost in options:
                    if code is None:
                        key, value, new = (a, b), weight + cost, way
                    elif code == 0 and b == 0:
                        key, value, new = (a, b), weight + cost, way
                    else:
                        key, value, new = (b, code), weight + cost + self.log[a][b][code], (code, way)
                    if key not in after or after[key][0] < value:
                        after[key] = (value, new)
            states = after
            if not apart or c not in _SEPARATORS:
                before = c
        way = max(states.items(), key=lambda s: s[1][0] + self.log[s[0][0]][s[0][1]][0])[1][1]
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(" " if c == 0 else LETTERS[c - 1] if c < _OTHER else "\N{GREEK SMALL LETTER ALPHA}" for c in reversed(out))

    def clear(self, text: str | None) -> str | None:
        """The text with its disguised spans restored."""
        if not text:
            return text
        out, at = [], 0
        for match in _SPAN.finditer(text):
            low, high = match.span()
            apart = match["apart"] is not None
            if low < at or apart and not _LETTER.search(match[0]):
                continue
            if not apart:  # the whole word around the sign
                end = _EDGE.search(text, high)
                high = end.start() if end else len(text)
                while low > at and not text[low - 1].isspace():
                    low -= 1
            word = text[low:high]
            core = word if apart else word.rstrip("!?%&.,;:")
            out += [text[at:low], " ", self.restore(core, apart), " ", word[len(core):]]
            at = high
        return "".join(out) + text[at:] if out else text


def runs(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-sign runs whose inner signs are letters, and the text of each."""
    if len(code) < 5:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = code.astype(np.int32)
    n = len(c) - 4
    value = (((c[:n].astype(np.int64) * _N + c[1:n + 1]) * _N + c[2:n + 2]) * _N + c[3:n + 3]) * _N + c[4:]
    at = np.flatnonzero((c[1:n + 1] != 0) & (c[2:n + 2] != 0) & (c[3:n + 3] != 0))
    return value[at], np.searchsorted(starts, at + 1, side="right") - 1


def whole_words(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and text of each word of three signs or more."""
    edges = np.flatnonzero(code == 0)
    first, long = edges[:-1] + 1, np.diff(edges) - 1
    keep = long >= _LEAST_WORD
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.arange(len(code)) - np.repeat(edges, np.diff(np.append(edges, len(code)))) - 1, _PLACES - 1)
    sums = np.add.reduceat(_SIGNS[place, code], edges)[:-1][keep]
    return (sums & (_ENTRIES // 2 - 1)) + _ENTRIES // 2, np.searchsorted(starts, first[keep], side="right") - 1


def entries(value: np.ndarray, text: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each text has each run or word: once, three times, and then as a share of its words.

    Gives the texts and ``4 * entry + level`` for each level that is reached.
    """
    both, many = np.unique(text * _ENTRIES + value, return_counts=True)
    text, value = both // _ENTRIES, both % _ENTRIES
    share = many / np.maximum(words[text], 1)
    reached = [many >= 1, many >= 3, (many >= 3) & (share >= 0.004), (many >= 2) & (share >= 0.015)]
    return (np.concatenate([text[r] for r in reached]),
            np.concatenate([value[r] * 4 + level for level, r in enumerate(reached)]))


def word_numbers(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.cumsum(code == 0)[starts - 1])


class Lexicon(NamedTuple):
    keys: np.ndarray  # sorted, as of ``entries``
    weights: np.ndarray
    known: np.ndarray  # whether a run begins with these four signs
    words: np.ndarray  # whether a word's number ends in these bits

    @classmethod
    def of(cls, keys, weights) -> Lexicon:
        order = np.argsort(keys)
        keys = np.asarray(keys, dtype=np.int64)[order]
        known, words, number = np.zeros(_N**4, dtype=bool), np.zeros(1 << 20, dtype=bool), keys // 4
        known[number[number < _ENTRIES // 2] // _N] = True
        words[number[number >= _ENTRIES // 2] & (len(words) - 1)] = True
        return cls(keys, np.asarray(weights, dtype=float)[order], known, words)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the greatest weight of an entry, the sum of weights, and the number of entries."""
        code, starts = coded(texts)
        (run, run_text), (word, word_text) = runs(code, starts), whole_words(code, starts)
        out = np.zeros((len(texts), 3))
        if not len(run) + len(word) or not len(self.keys):
            return out
        few, some = self.known[run // _N], self.words[word & (len(self.words) - 1)]
        text, key = entries(np.concatenate([run[few], word[some]]), np.concatenate([run_text[few], word_text[some]]),
                            word_numbers(code, starts))
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[place] == key
        text, weight = text[found], self.weights[place[found]]
        np.maximum.at(out[:, 0], text, weight)
        np.add.at(out[:, 1], text, weight)
        np.add.at(out[:, 2], text, 1)
        out[:, 1:] = np.log1p(out[:, 1:])
        return out


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; each task sends at most one sum per trigram."""
    def run(batches):
        total = np.zeros(_N**3, dtype=np.int64)
        for batch in batches:
            c = coded(batch.column(0).to_pylist())[0].astype(np.int32)
            if len(c) > 2:
                total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["k", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "k int, n long").groupBy("k").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_N**3)
    counts[rows["k"]] = rows["n"]
    return counts


class Scorer(NamedTuple):
    lexicon: Lexicon
    curve: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    prior: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(texts), self.prior)
        z = self.lexicon.evidence(texts) @ self.curve[:-1] + self.curve[-1]
        return 0.99 * np.interp(z, *self.steps) + 0.01 * sigmoid(z)


def train(docs: DataFrame, labels: DataFrame, keep, characters, fit_rows: int = FIT_ROWS) -> Scorer:
    """Fits on at most ``fit_rows`` labelled documents that ``keep`` admits."""
    sample = labelled_sample(docs, labels, "toxic", keep, fit_rows)
    sample = stored(sample.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2))), "toxic-sample")

    def count(batches):
        for batch in batches:
            texts = [characters.value.clear(t) for t in batch.column("text").to_pylist()]
            code, starts = coded(texts)
            (run, run_text), (word, word_text) = runs(code, starts), whole_words(code, starts)
            text, key = entries(np.concatenate([run, word]), np.concatenate([run_text, word_text]),
                                word_numbers(code, starts))
            kind = (batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy())[text]
            key, many = np.unique(key * 4 + kind, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 4), pa.array((key % 4).astype(np.int32)),
                                              pa.array(many)], names=["run", "kind", "n"])

    found = sample.mapInArrow(count, "run long, kind int, n long").groupBy("run").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    sizes = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    n = np.array([[sizes.get((f, y), 0) for y in (0, 1)] for f in (0, 1)])
    toxic, total = int(n[:, 1].sum()), int(n.sum())
    prior = (toxic + 1) / (total + 2)
    if not toxic or toxic == total:
        return Scorer(Lexicon.of([], []), np.zeros(0), (np.zeros(0), np.zeros(0)), prior)
    found = stored(found.where(F.col("n1") + F.col("n3") >= 2), "toxic-runs")

    def lexicon(folds) -> Lexicon:
        t = sum((F.col(f"n{2 * f + 1}") for f in folds), F.lit(0))
        c = sum((F.col(f"n{2 * f}") for f in folds), F.lit(0))
        all_t, all_c = (int(sum(n[f, y] for f in folds)) for y in (1, 0))
        least = max(3 if len(folds) > 1 else 2, LEAST_SHARE * all_t)
        weight = F.log((t + 0.1) / (all_t + 0.2)) - F.log((c + 0.1) / (all_c + 0.2))
        rows = (found.select("run", weight.alias("w"), t.alias("t")).where((F.col("t") >= least) & (F.col("w") >= LEAST_WEIGHT))
                .orderBy(F.desc("t"), "run").limit(RUNS).toPandas())
        return Lexicon.of(rows["run"].to_numpy(), rows["w"].to_numpy())

    folds = [lexicon([1]), lexicon([0])]  # each fold's documents are weighed by the other's runs

    def weigh(batches):
        for batch in batches:
            texts = [characters.value.clear(t) for t in batch.column("text").to_pylist()]
            fold = batch.column("fold").to_numpy()[:, None]
            x = np.where(fold == 0, folds[0].evidence(texts), folds[1].evidence(texts))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, k]) for k in range(3))],
                                             names=["label", "a", "b", "c"])

    rows = sample.mapInArrow(weigh, "label int, a double, b double, c double").toPandas()
    rows = rows.sort_values(["label", "a", "b", "c"])
    x, y = rows[["a", "b", "c"]].to_numpy(), rows["label"].to_numpy(dtype=float)
    curve = fit_logistic(x, y, ridge=1.0)
    return Scorer(lexicon([0, 1]), curve, fit_steps(x @ curve[:-1] + curve[-1], y), prior)


def toxicity(docs: DataFrame, labels: DataFrame, toxic: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels of documents with crc32(doc_id) mod 3 = 1 are held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = id_crc() % 3 == 1
    characters = spark.sparkContext.broadcast(CharacterModel(character_counts(docs)))
    scorer = spark.sparkContext.broadcast(train(docs, labels, ~held, characters))

    def run(batches):
        for batch in batches:
            texts = [characters.value.clear(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"),
                                              pa.array(scorer.value(texts))], names=["doc_id", "held_out", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= toxic).cast("int"))
