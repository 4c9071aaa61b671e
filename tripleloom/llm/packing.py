"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two, at
most 1024: as many whole ones as fit, then the binary digits of the rest from
the largest down.  Pieces of equal length form a bucket, and each piece is a
sequence of its own, so no sequence crosses documents and none is padded.

Tokens come from a public tokenizer.  Texts are cut before single blanks and
line ends that a visible character follows; the tokenizer's own splitting also
ends there, so that equal units have equal ids, and each distinct unit of a
batch is encoded once.

A null text is empty and gives the end token alone.  Repeated rows give pieces
of their own.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.store import small_batches, stored
from tripleloom.llm.text import ranges, utf8

LENGTH = 1024
END = 0
#: Units whose ids a worker keeps.
KEPT_UNITS = 300_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[10, 32]] = True
# What surely is no white space: printable ASCII and the first bytes that begin none.
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
_VISIBLE[195:225] = True
_VISIBLE[228:248] = True


_SPECIAL = ("<|endoftext|>",)


def _byte_signs() -> dict[str, int]:
    """The byte for each sign of byte-level names: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole batches of texts, by a byte-level vocabulary file.

    The vocabulary's numbers are the order of its merges, so the file's own
    vocabulary gives the ranks of the faster encoder used here; the tests hold
    its ids against the file's tokenizer.  New units are encoded many in one
    text: their ids are told apart by the bytes that each id stands for.  With
    ``added`` the file's added tokens are found in texts, as its tokenizer does
    by default; what lies between two of them is encoded on its own.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        names, tokens = content["model"]["vocab"], content["added_tokens"] if added else []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
            raise ValueError("added tokens that take in or look at their surroundings are not supported")
        self._added = {t["content"].encode(): t["id"] for t in tokens}
        self._literal = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))))
        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in name): number for name, number in names.items()
                 if all(c in signs for c in name) and name not in _SPECIAL}
        self._encode = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self._bytes[list(ranks.values())] = [len(b) for b in ranks]
        self._clear()

    def _clear(self):
        # Unit 0 is the end of a text.
        self._known: dict[bytes, int] = {}
        self._ids, self._sizes = [np.array([END], dtype=np.uint32)], [np.array([1])]

    def _learn(self, units: list[bytes]) -> None:
        """Gives the units the next numbers; those that could melt with a neighbour are encoded alone."""
        literals = [u for u in units if u in self._added]
        self._add(literals, np.array([self._added[u] for u in literals], dtype=np.uint32), np.ones(len(literals), dtype=np.int64))
        units = [u for u in units if u not in self._added]
        texts = [u.decode() for u in units]
        alone = np.array([t[0] not in " \n" or t[-1].isspace() for t in texts], dtype=bool)
        single = np.flatnonzero(alone).tolist()
        for low in range(0, len(units), 5_000):
            at = low + np.flatnonzero(~alone[low:low + 5_000])
            if len(at):
                ids = np.array(self._encode("".join([texts[i] for i in at.tolist()])), dtype=np.uint32)
                ends = np.cumsum([len(units[i]) for i in at.tolist()])
                edges = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
                self._add([units[i] for i in at.tolist()], ids, np.diff(edges, prepend=0))
        made = [self._encode(texts[i]) for i in single]
        self._add([units[i] for i in single], np.array([i for ids in made for i in ids], dtype=np.uint32),
                  np.array([len(ids) for ids in made], dtype=np.int64))

    def _add(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._known) + 1
        self._known.update(zip(units, range(first, first + len(units)), strict=True))
        self._ids.append(ids)
        self._sizes.append(sizes)

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        new = [u for u in units if u not in self._known]
        if len(self._known) + len(new) > KEPT_UNITS:
            self._clear()
            new = units
        self._learn(new)
        if len(self._ids) > 1:
            self._ids, self._sizes = [np.concatenate(self._ids)], [np.concatenate(self._sizes)]
        return np.array([self._known[u] for u in units], dtype=np.int64)

    def _literals(self, data: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int]]:
        """Bounds of the added tokens within texts."""
        starts, ends, low = [], [], 0
        if not self._added:
            return starts, ends
        view = memoryview(np.ascontiguousarray(data))
        while match := self._literal.search(view, low):
            start, low = match.span()
            border = int(at[np.searchsorted(at, start, side="right")])
            if low <= border:
                starts.append(start)
                ends.append(low)
            else:
                low = start + 1  # it runs into the next text
        return starts, ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end token, and the texts' bounds in them."""
        data, at = utf8(texts)
        n = len(at) - 1
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            cut[:-2] = _SPACE[data[:-1]] & _VISIBLE[data[1:]]
        cut[at[1:][at[1:] > 0] - 1] = False  # what follows a last blank is another text
        starts, ends = (np.array(x, dtype=np.int64) for x in self._literals(data, at))
        cut[starts[starts > 0] - 1] = False  # as at the end of a text
        cut[starts] = True
        cut[ends] = True
        cut[at] = True
        edges = np.flatnonzero(cut)
        if len(edges) < 2:
            return np.full(n, END, np.uint32), np.arange(n + 1)
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        # An end behind the last unit of each text.
        last = np.searchsorted(edges, at[1:])
        numbers = np.insert(numbers, last, 0)
        flat, sizes = self._ids[0], self._sizes[0]
        first = np.cumsum(sizes) - sizes
        long = sizes[numbers]
        bounds = np.concatenate([[0], np.cumsum(long)[last + np.arange(n)]])
        return flat[ranges(first[numbers], long)], bounds


@functools.lru_cache(maxsize=1)
def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder per worker process, with the units of its earlier tasks."""
    return Encoder(path, added)


def pieces(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(path: str, length: int, with_ids: bool, added: bool):
    def run(batches):
        encode = encoder(path, added)
        for batch in batches:
            ids, bounds = encode(batch.column("text"))
            ids = ids.astype("<u4")
            text, start, size = [], [], []
            for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                at = 0
                for n in pieces(high - low, length):
                    text.append(i)
                    start.append(at)
                    size.append(n)
                    at += n
            first = bounds[:-1][text] + np.array(start, dtype=np.int64)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), size, strict=True)]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(text, pa.int64())), "start": pa.array(start, pa.int64()),
                "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(np.diff(bounds)[text], pa.int64())}
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(ids[ranges(first, np.array(size, dtype=np.int64))].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True,
         added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and ids of every piece.

    ``bucket`` is the binary logarithm of the length, by which
    ``write_buckets`` lays the pieces out.  ``length`` must be a power of two.
    With ``added`` the tokenizer file's added tokens keep their own ids.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    cut = stored(base.mapInArrow(_cut(tokenizer, length, with_ids, added), fields + (", ids array<int>" if with_ids else "")),
                 "pieces")
    # Numbers of the stored pieces: a repeated task reads the same file and gives the same ones.
    numbered = cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return numbered.withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length; readers of a bucket get sequences of equal size."""
    packed.write.partitionBy("bucket").parquet(path)
