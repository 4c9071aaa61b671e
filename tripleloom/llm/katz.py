"""Katz backoff language model of any order, and its score of every document.

With counts c of the training tokens and of runs of up to ``order`` tokens, a
token w after the history h, whose own history without its first token is h',
has the probability

    d(c(hw)) c(hw) / c(h)   if the run hw was seen,
    alpha(h) p(w | h')      if only h was seen,
    p(w | h')               if h was not seen either,

and without a history d(c(w)) c(w) / N for a seen token, and for all unseen
ones together what the seen ones leave.  Texts begin with start signs.  The
discounts d are Good-Turing's up to count 5, for each length of run by itself;
larger counts give up a small constant, so that every history leaves
something.  alpha(h) is what the runs after h leave, over the p(w | h') of the
tokens not seen after h: the probabilities after each history sum to one.

Counts live in buckets of hash ranges.  A block of documents sends each bucket
its distinct runs once and gets their counts back in the same order; then it
evaluates its tokens, from the longest run down.  The sums for alpha(h) take
each distinct run from one block, and only where held-out documents have the
history, as runs of training documents are seen by definition.  So the work per bucket
does not depend on how often a run occurs, and a hot run is one entry per
block.  What is moved is packed columns, not rows per token.

The input must be a stored table: its scan runs twice and must give the same
blocks, which is checked.  A null or wordless text is the end token alone; a
null id counts as empty text for the split.  Repeated rows count as often as
they occur.  Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import id_crc, small_batches, stored
from tripleloom.llm.text import PLAIN, find_words, mix, ranges, word_hashes
from tripleloom.operators.joins import planned_bytes

#: Tokens of the longest run that is counted.
ORDER = 3
#: Counts up to this one are discounted by Good-Turing.
GOOD_TURING = 5
#: Tokens after which a block ends, and stored input bytes per bucket.
BLOCK_TOKENS, BUCKET_BYTES = 1_000_000, 8 << 20

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_H, _W = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


# Packed columns: the bytes of equal weight together, compressed.

def _put(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _get(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _put_sorted(values: np.ndarray) -> bytes:
    return _put(np.diff(values, prepend=np.uint64(0)))


def _get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_get(data, np.uint64), dtype=np.uint64)


def _run_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of runs from those of all but the last token and of the last one."""
    return mix(before * _H + words * _W)


def _starts(length: int) -> np.uint64:
    """The hash of a run of start signs alone: a history, but no run of a text."""
    value = np.array([_START])
    for _ in range(length - 1):
        value = _run_hashes(value, np.array([_START]))
    return value[0]


class _Runs(NamedTuple):
    """The distinct runs of one length in a block, in the order of their hashes.

    ``before`` and ``after`` number the run without its last and without its
    first token among the runs shorter by one; ``at`` is each token's run, and
    ``start`` the run of start signs.
    """

    hashes: np.ndarray
    before: np.ndarray
    after: np.ndarray
    at: np.ndarray
    start: int


def _put_bits(values: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(values).tobytes(), 1)


def _get_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8))[:n].astype(bool)


class _Block(NamedTuple):
    """Tokens of some documents by their number in the sorted ``words``; the start sign is a word too."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    def runs(self, order: int) -> list[_Runs]:
        """The runs of each length up to ``order``."""
        sign = int(np.searchsorted(self.words, _START))
        none = np.zeros(0, dtype=np.int64)
        made = [_Runs(self.words, none, none, self.tokens, sign)]
        firsts = np.cumsum(self.sizes) - self.sizes
        tokens = np.append(self.tokens, sign)
        for _ in range(order - 1):
            last = made[-1]
            before = np.empty(len(tokens), dtype=np.int64)
            before[1:-1] = last.at[:-1]
            before[firsts] = before[-1] = last.start
            code, inverse = np.unique(before * len(self.words) + tokens, return_inverse=True)
            history, word = np.divmod(code, len(self.words))
            hashes = _run_hashes(last.hashes[history], self.words[word])
            by_hash = np.argsort(hashes)
            place = np.empty(len(by_hash), dtype=np.int64)
            place[by_hash] = np.arange(len(by_hash))
            at = place[inverse]
            after = np.empty(len(by_hash), dtype=np.int64)
            after[at] = np.append(last.at, last.start)
            made.append(_Runs(hashes[by_hash], history[by_hash], after, at[:-1], int(at[-1])))
        return made


def _blocks(batches):
    """(number, ids, block) for each run of documents with enough tokens; numbers repeat when a task does."""
    part = TaskContext.get().partitionId()
    ids, hashes, sizes, held, count, turn = [], [], [], [], 0, 0

    def made():
        words, tokens = np.unique(np.concatenate([*hashes, [_START]]), return_inverse=True)
        return (part << 24) + turn, pa.concat_arrays(ids), _Block(
            words, tokens[:-1].astype(np.int64), np.concatenate(sizes), np.concatenate(held))

    for batch in batches:
        if not batch.num_rows:
            continue
        found = find_words(batch.column("text"), PLAIN)
        n = np.diff(found.bounds)
        values = np.full(len(found.starts) + len(n), _END, dtype=np.uint64)
        values[ranges(found.bounds[:-1] + np.arange(len(n)), n)] = word_hashes(found)
        ids.append(batch.column("doc_id"))
        hashes.append(values)
        sizes.append(n + 1)
        held.append(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
        count += len(values)
        if count >= BLOCK_TOKENS:
            yield made()
            ids, hashes, sizes, held, count, turn = [], [], [], [], 0, turn + 1
    if ids:
        yield made()


_SENT = "kind int, bucket int, block long, n int, keys binary, counts binary"


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _send(bits: int, order: int):
    """Distinct runs of each block, cut by length (``kind``) and bucket.

    A run's number is twice its training count, and one more where held-out documents of the block have it.
    """
    def run(batches):
        for number, _, block in _blocks(batches):
            train = np.repeat(~block.held, block.sizes)
            texts = int((~block.held).sum())
            rows = {c: [] for c in ("kind", "bucket", "block", "n", "keys", "counts")}
            for kind, runs in enumerate(block.runs(order), 1):
                counts = np.bincount(runs.at[train], minlength=len(runs.hashes))
                counts[runs.start] = texts
                counts *= 2
                counts[runs.at[~train]] |= 1
                counts[runs.start] |= int(block.held.any())
                bucket = _bucket(runs.hashes, bits)
                edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in np.unique(bucket).tolist():
                    part = slice(edges[b], edges[b + 1])
                    for name, value in zip(rows, (kind, b, number, int(part.stop - part.start),
                                                  _put_sorted(runs.hashes[part]),
                                                  _put(counts[part].astype(np.uint32))), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["kind"], pa.int32()), pa.array(rows["bucket"], pa.int32()),
                 pa.array(rows["block"], pa.int64()), pa.array(rows["n"], pa.int32()),
                 pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], names=list(rows))
    return run


_REPLY = "kind int, bucket int, block long, counts binary, own binary, asked binary, stats array<long>"


def _count(sent: pa.Table) -> pa.Table:
    """Total counts of a bucket's keys for each block, and how many keys have each small count.

    ``own`` marks the keys that one block adds up for all, ``asked`` those that any held-out document has.
    """
    sent = sent.sort_by("block")
    kind, bucket = sent["kind"][0].as_py(), sent["bucket"][0].as_py()
    keys = np.concatenate([_get_sorted(x) for x in sent["keys"].to_pylist()])
    counts = np.concatenate([_get(x, np.uint32) for x in sent["counts"].to_pylist()]).astype(np.int64)
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, counts >> 1, len(distinct)).astype(np.int64)
    asked = np.zeros(len(distinct), dtype=bool)
    asked[place[counts & 1 == 1]] = True
    own = np.zeros(len(keys), dtype=bool)
    own[first[total > 0]] = True
    known = total[(total > 0) & (distinct != _starts(kind))]
    stats = [int((known == r).sum()) for r in range(1, GOOD_TURING + 2)] + [len(known), int(known.sum())]
    ends = np.cumsum(sent["n"].to_numpy())
    parts = list(zip(ends - sent["n"].to_numpy(), ends, strict=True))
    n = len(parts)
    return pa.table({
        "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "block": pa.array([*sent["block"].to_pylist(), -1], pa.int64()),
        "counts": pa.array([*(_put(total[place[a:b]].astype(np.uint64)) for a, b in parts), None], pa.binary()),
        "own": pa.array([*(_put_bits(own[a:b]) for a, b in parts), None], pa.binary()),
        "asked": pa.array([*(_put_bits(asked[place[a:b]]) for a, b in parts), None], pa.binary()),
        "stats": pa.array([*([None] * n), stats], pa.list_(pa.int64()))})


class Discounts(NamedTuple):
    """What is left of each count: a factor up to ``GOOD_TURING``, above it all but a constant."""

    factors: np.ndarray
    constant: float

    @classmethod
    def of(cls, ones: list[int]) -> Discounts:
        """From the numbers of keys with count 1, 2, ...; absolute discounts where Good-Turing's are no shares."""
        n = np.array([0, *ones], dtype=float)
        k = GOOD_TURING
        absolute = min(max(n[1] / (n[1] + 2 * n[2]), 0.05), 0.95) if n[1] and n[2] else 0.5
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        factors = [1.0]
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
            factors.append(d if 0 < d < 1 else 1 - absolute / r)
        return cls(np.array(factors), min(max(k * (1 - factors[k]), 0.01), 0.75))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small = self.factors[np.minimum(counts, GOOD_TURING)] * counts
        return np.where(counts > GOOD_TURING, counts - self.constant, small)


class Model(NamedTuple):
    """The few numbers that all tokens share; ``discounts`` by length of run."""

    tokens: int
    types: int
    discounts: tuple[Discounts, ...]
    unseen: float

    @classmethod
    def of(cls, stats: list[list[int]]) -> Model:
        """From the numbers of runs of each length with count 1, 2, ..., of all, and their tokens."""
        *ones, types, tokens = stats[0]
        discounts = tuple(Discounts.of(s[:-2]) for s in stats)
        words = discounts[0]
        counts = np.arange(1, GOOD_TURING + 1)
        n = np.array(ones[:GOOD_TURING])
        kept = (n * words(counts)).sum() + (tokens - (n * counts).sum()) - words.constant * (types - n.sum())
        return cls(tokens, types, discounts, 1 - kept / tokens if tokens else 1.0)

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts[0](counts) / max(self.tokens, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))


def _ship(batches):
    """The tokens of each block, to meet the block's counts."""
    for number, ids, block in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([number]), pa.array([None], pa.binary()),
             pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int64())),
             pa.array([_put_sorted(block.words)], pa.binary()), pa.array([_put(block.tokens.astype(np.uint32))], pa.binary()),
             pa.array([_put(block.sizes.astype(np.uint32))], pa.binary()), pa.array([_put(block.held)], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
            names=["kind", "bucket", "block", "counts", "own", "asked", "stats", "words", "tokens", "sizes", "held", "ids"])


_SHIPPED = _REPLY + ", words binary, tokens binary, sizes binary, held binary, ids array<long>"
_VALUED = ("kind int, bucket int, block long, n int, keys binary, x binary, y binary, ids array<long>, "
           "held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, part array<double>")
_SHARES, _ASKS, _DOCS = 0, 1, 2


def _counts_of(rows: list[dict], runs: _Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of one length their counts, which of them the block has to add up, and which are asked for."""
    counts, own, asked = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
    for r in rows:
        counts.append(_get(r["counts"], np.uint64).astype(np.int64))
        own.append(_get_bits(r["own"], len(counts[-1])))
        asked.append(_get_bits(r["asked"], len(counts[-1])))
    counts, own, asked = (np.concatenate(x) for x in (counts, own, asked))
    if len(counts) != len(runs.hashes):
        raise ValueError("the two scans gave different blocks: the input must be a stored table")
    return counts, own, asked


def _value(bits: int, order: int, model):
    """Scores of a block's documents but for the backoff weights; the block's shares of them; and what it asks."""
    def run(rows: pa.Table) -> pa.Table:
        model_ = model.value
        rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")]).to_pylist()
        if not rows or rows[0]["kind"] != -1:
            raise ValueError("counts for a block that the second scan has not: the input must be a stored table")
        row = rows[0]
        block = _Block(_get_sorted(row["words"]), _get(row["tokens"], np.uint32).astype(np.int64),
                       _get(row["sizes"], np.uint32).astype(np.int64), _get(row["held"], bool))
        runs = block.runs(order)
        counts, own, asked = zip(*(_counts_of([r for r in rows if r["kind"] == k], of_length)
                                   for k, of_length in enumerate(runs, 1)), strict=True)
        del rows
        # Of each length and distinct run: what its last token has after the others, but for the weights.
        share = model_.word(counts[0])
        values = [np.log10(share)]
        packed = []
        for k in range(1, order):
            seen, history = counts[k] > 0, counts[k - 1][runs[k].before]
            kept = model_.discounts[k](counts[k])
            # Shares: of each history with own runs, the mass that they give up and what they take of the shorter one.
            mine = np.flatnonzero(own[k] & seen & asked[k - 1][runs[k].before])
            mine = mine[mine != runs[k].start]
            gives = np.bincount(runs[k].before[mine], counts[k][mine] - kept[mine], len(counts[k - 1]))
            takes = np.bincount(runs[k].before[mine], share[runs[k].after[mine]], len(counts[k - 1]))
            of_own = np.unique(runs[k].before[mine])
            packed.append((_SHARES, k, runs[k - 1].hashes, of_own, gives[of_own], takes[of_own]))
            value = values[-1][runs[k].after] - np.log10(np.maximum(history, 1))
            share = kept / np.maximum(history, 1)
            value[seen] = np.log10(share[seen])
            values.append(value)
        ends = np.cumsum(block.sizes)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        # Asks: from the longest run down, the histories from which tokens back off, by document.
        left = np.arange(len(block.tokens))
        for k in range(order - 1, 0, -1):
            left = left[counts[k][runs[k].at[left]] == 0]
            history = runs[k].before[runs[k].at[left]]
            known = counts[k - 1][history] > 0
            asks, times = np.unique(history[known] * len(ends) + doc[left[known]], return_counts=True)
            places, asker = np.divmod(asks, len(ends))
            packed.append((_ASKS, k, runs[k - 1].hashes, places, asker.astype(np.uint32), times.astype(np.uint32)))

        def by_doc(values):
            return np.add.reduceat(values, ends - block.sizes)

        seen = counts[0][block.tokens]
        out = [(0, 0, _DOCS, b"", b"", b"", row["ids"], block.held.tolist(), block.sizes.tolist(),
                by_doc((seen > 0).astype(np.int64)).tolist(), by_doc(np.log10(model_.base(seen))).tolist(),
                by_doc(values[-1][runs[-1].at]).tolist())]
        for what, kind, hashes, places, x, y in packed:
            b = _bucket(hashes[places], bits)
            edges = np.searchsorted(b, np.arange((1 << bits) + 1))
            for k in np.unique(b).tolist():
                part = slice(edges[k], edges[k + 1])
                out.append((kind, k, what, _put_sorted(hashes[places[part]]), _put(x[part]), _put(y[part]), *[None] * 6))
        names = ["kind", "bucket", "n", "keys", "x", "y", "ids", "held", "n_tokens", "n_known", "base", "part"]
        columns = dict(zip(names, zip(*out, strict=True), strict=True))
        kinds = {"kind": pa.int32(), "bucket": pa.int32(), "block": pa.int64(), "n": pa.int32(), "keys": pa.binary(),
                 "x": pa.binary(), "y": pa.binary(), "held": pa.list_(pa.bool_()), "base": pa.list_(pa.float64()),
                 "part": pa.list_(pa.float64())}
        columns["block"] = [row["block"]] * len(out)
        return pa.table({n: pa.array(columns[n], kinds.get(n, pa.list_(pa.int64())))
                         for n in ["kind", "bucket", "block", *names[2:]]})
    return run


def _weigh(rows: pa.Table) -> pa.Table:
    """The backoff weights of a bucket's histories, summed for the documents that asked."""
    rows = rows.sort_by("block").to_pylist()
    shares = [r for r in rows if r["n"] == _SHARES]
    asks = [r for r in rows if r["n"] == _ASKS]
    keys = np.concatenate([_get_sorted(r["keys"]) for r in shares]) if shares else np.zeros(0, np.uint64)
    histories, place = np.unique(keys, return_inverse=True)
    gives, takes = (np.bincount(place, np.concatenate([_get(r[c], np.float64) for r in shares]), len(histories))
                    if shares else np.zeros(0) for c in ("x", "y"))
    # The tokens seen after a history never have the whole mass of the shorter one: what it gives up is not theirs.
    weight = np.log10(np.maximum(gives, 1e-300)) - np.log10(np.maximum(1 - takes, 1e-12))
    docs, sums = [], []
    for r in asks:
        at = np.searchsorted(histories, _get_sorted(r["keys"]))
        doc = _get(r["x"], np.uint32)
        found, slot = np.unique(doc, return_inverse=True)
        docs.append(_put(found))
        sums.append(_put(np.bincount(slot, weight[at] * _get(r["y"], np.uint32), len(found))))
    return pa.table({"block": pa.array([r["block"] for r in asks], pa.int64()), "kind": pa.array(
        [r["kind"] for r in asks], pa.int32()), "bucket": pa.array([r["bucket"] for r in asks], pa.int32()), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())})


_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double")


def _add(model):
    """Documents of a block with the weights put in."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("kind", "ascending"), ("bucket", "ascending")]).to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        score = np.array(own["part"])
        for r in rows:
            if r["docs"] is not None:
                score[_get(r["docs"], np.uint32)] += _get(r["sums"], np.float64)
        return pa.table({
            "doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array(own["held"], pa.bool_()),
            "n_tokens": pa.array(own["n_tokens"], pa.int64()), "n_known": pa.array(own["n_known"], pa.int64()),
            "train_tokens": pa.array([model.value.tokens] * len(score), pa.int64()),
            "base_score": pa.array(own["base"], pa.float64()), "score": pa.array(score)})
    return run


def katz_scores(docs: DataFrame, held_out=None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of the stored ``docs``.

    The model, of runs of up to ``order`` tokens (2 or more), learns from the
    rows that ``held_out`` (by default crc32(doc_id) mod 5 = 1) does not mark.
    """
    if order < 2:
        raise ValueError("a model that backs off needs runs of two tokens or more")
    spark = docs.sparkSession
    small_batches(spark)
    bits = max(0, (planned_bytes(docs) // BUCKET_BYTES).bit_length())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (id_crc() % 5 == 1 if held_out is None else held_out).alias("held_out"))
    sent = base.mapInArrow(_send(bits, order), _SENT)
    replies = stored(sent.groupBy("kind", "bucket").applyInArrow(_count, _REPLY), "counts", release=True)
    stats = {r["kind"]: r["stats"] for r in replies.where("block = -1").groupBy("kind").agg(
        F.array(*[F.sum(F.col("stats")[i]) for i in range(GOOD_TURING + 3)]).alias("stats")).collect()}
    none = [0] * (GOOD_TURING + 3)
    model = spark.sparkContext.broadcast(Model.of([stats.get(k, none) for k in range(1, order + 1)]))
    shipped = base.mapInArrow(_ship, _SHIPPED)
    met = shipped.unionByName(replies.where("block >= 0"), allowMissingColumns=True)
    valued = stored(met.groupBy("block").applyInArrow(_value(bits, order, model), _VALUED), "values", release=True)
    weights = valued.where(F.col("n") != _DOCS).select("kind", "bucket", "block", "n", "keys", "x", "y").groupBy(
        "kind", "bucket").applyInArrow(_weigh, "block long, kind int, bucket int, docs binary, sums binary")
    done = valued.where(F.col("n") == _DOCS).select(
        "block", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), "ids", "held", "n_tokens", "n_known", "base", "part")
    return done.unionByName(weights, allowMissingColumns=True).groupBy("block").applyInArrow(_add(model), _SCORED)
