"""Packing along a space-filling curve.

Documents become hashed vectors of their tokens, projected to a few dimensions
and put in the order of a Hilbert curve, so that neighbours in the order are
alike. Ranges of the curve are packed each by a task of its own, one document
after another; the end of a range becomes sequences of power-of-two lengths,
which need no padding either.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .packing import Encoder

CAPACITY = 1024
#: Entries of a hashed vector, dimensions of its projection, bits of each dimension on the curve.
HASHED, DIMENSIONS, BITS = 256, 4, 12
SEED = 7
#: Documents, or pieces, that a task hands on together.
BATCH = 512


#: Characters below this are in the same classes of letters, digits and space for both libraries.
_SHARED = "\u0250"


class MergingEncoder(Encoder):
    """An :class:`Encoder` that learns words by the tokenizer's own merges in a second library, which takes a sixth of the time.

    Only words of Latin letters and the like are learned so, and only if the
    file is a byte-level BPE whose tokens are numbered in the order of its
    merges, so that the least id is the first merge. All else, and every text
    that isn't taken word by word, goes the tokenizer's own way; both give the
    same ids.
    """

    def __init__(self, path: str):
        super().__init__(path)
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, merges = model["model"].get("vocab", {}), model["model"].get("merges", [])
        ids = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
        plain = (model.get("normalizer") is None) and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space")
        self.merging = None
        if plain and model["model"]["type"] == "BPE" and ids and ids == sorted(ids) and ids[0] == 256:
            letters = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
            rest = [b for b in range(256) if b not in letters.values()]
            letters |= {chr(256 + k): b for k, b in enumerate(rest)}  # bytes that print nothing are written by letters from 256 on
            special = set(self.special)
            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            self.merging = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        if self.merging is None:
            return super()._learn(words)
        near = [w for w in words if w.isascii() or max(w) < _SHARED]
        if len(near) < len(words):
            super()._learn([w for w in words if not (w.isascii() or max(w) < _SHARED)])
        if near:
            ids = array("I", self.merging.encode_ordinary(" " + " ".join(near)))
            ends = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in near])
            cuts = [0, *((np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(ids, np.uint32)]), ends) + 1) * 4).tolist()]
            said = ids.tobytes()
            self.known.update(zip(near, [said[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))


_ENCODERS: dict[str, MergingEncoder] = {}


def encoder(path: str) -> MergingEncoder:
    """This process's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MergingEncoder(path)
    return _ENCODERS[path]


def projection(seed: int = SEED, hashed: int = HASHED, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Seeded signs: what each entry of a hashed vector adds to each dimension."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (hashed, dimensions))


def slots(vocabulary: int, hashed: int = HASHED) -> np.ndarray:
    """The entry of a hashed vector for each token id."""
    return (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % hashed


def hashed_vector(entries: np.ndarray, hashed: int = HASHED) -> np.ndarray:
    """Square roots of the shares of each entry in a document, a vector of length 1."""
    return np.sqrt(np.bincount(entries, minlength=hashed) / len(entries))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``points``, integers of ``bits`` bits; at most 63 bits in all.

    Level by level, from the coarsest on: a cell's orientation is undone by
    exchanging and mirroring the lower bits, and Gray codes become numbers.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> level & 1
    return key


def vectors(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``id, row, tokens, place`` of every document: its ids with ``end_id`` after them, and its projected vector.

    ``tokens`` holds 16 bits an id where the vocabulary allows, else 32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        signs, wide, end = projection(seed, HASHED, dimensions), _wide(tokenizer_path, end_id), np.asarray([end_id], "<u4").tobytes()
        slot = slots(max(e.tokenizer.get_vocab_size(), end_id + 1))
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                ids = [e.ids(t.as_py() or "") + end for t in part.column("text")]
                flat = [np.frombuffer(x, "<u4") for x in ids]
                place = np.stack([hashed_vector(slot[x]) for x in flat]) @ signs
                if not wide:
                    ids = [x.astype("<u2").tobytes() for x in flat]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(ids, pa.binary()), pa.array(place.tolist(), pa.list_(pa.float32()))], ["id", "row", "tokens", "place"])

    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("row", T.LongType())]).add("tokens", "binary").add("place", T.ArrayType(T.FloatType()))
    return source.mapInArrow(run, schema)


def _wide(tokenizer_path: str, end_id: int) -> bool:
    """Whether an id may need more than 16 bits."""
    return max(encoder(tokenizer_path).tokenizer.get_vocab_size() - 1, end_id) >= 1 << 16


def on_curve(placed: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Add ``key``, the place on the curve of ``place``.

    Each dimension is measured from the mean in standard deviations of all
    documents, and spread evenly over its cells as if it were normal: two
    figures a dimension come to the driver.
    """
    at = [F.col("place")[i].cast("double") for i in range(dimensions)]
    row = placed.agg(*[f(c) for c in at for f in (F.mean, F.stddev_pop)]).first()
    mean, spread = np.array([v or 0.0 for v in row[::2]]), np.array([v or 1.0 for v in row[1::2]])

    @F.pandas_udf("long")
    def key(places: pd.Series) -> pd.Series:
        z = (np.stack(places.to_numpy()) - mean) / spread if len(places) else np.zeros((0, dimensions))
        even = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))
        return pd.Series(hilbert_key(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))

    return placed.withColumn("key", key("place"))


class Sequences:
    """Sequences being filled one after another; ``take`` and ``end`` give their finished pieces."""

    def __init__(self, first: int, capacity: int):
        self.number, self.capacity, self.used = first, capacity, 0
        self.open: list[tuple] = []  # pieces of the sequence at hand, whose ends may yet change

    def _piece(self, doc: tuple, ids: np.ndarray, lo: int, hi: int, offset: int) -> tuple:
        return (*doc, lo, hi - lo, zlib.crc32(np.ascontiguousarray(ids[lo:hi], "<u4")), len(ids), self.number, offset)

    def take(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple]:
        """Append a document, cut where a sequence is full."""
        lo, n = 0, len(ids)
        while lo < n:
            hi = min(n, lo + self.capacity - self.used)
            self.open.append((doc, ids, lo, hi))
            self.used += hi - lo
            lo = hi
            if self.used == self.capacity:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, ids, lo, hi in parts:
            yield self._piece(doc, ids, lo, hi, offset)
            offset += hi - lo
        self.number += 1

    def end(self) -> Iterator[tuple]:
        """The sequence at hand as sequences of power-of-two lengths, longest first."""
        parts, left = self.open[::-1], self.used
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                doc, ids, lo, hi = parts.pop()
                if hi - lo > size:
                    parts.append((doc, ids, lo + size, hi))
                    hi = lo + size
                now.append((doc, ids, lo, hi))
                size -= hi - lo
            yield from self._close(now)
        self.open, self.used = [], 0


def pack_along_curve(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Pieces of all documents along the curve: ``id, row, key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and ``end_id``; it is cut where a sequence of
    ``capacity`` tokens is full. The last tokens of each range of the curve
    become sequences of power-of-two lengths, so that no sequence needs
    padding, as long as padding goes up to ``capacity`` or a power of two.
    Null and empty texts are the end id alone. Repeated rows and ids are packed
    one by one; equal texts are neighbours in the order read, and however many
    they are, ranges split among them. Empty tables give no rows; other columns
    aren't read.
    """
    placed = stored(vectors(docs, tokenizer_path, id_col, text_col, end_id, dimensions, seed))
    keyed = on_curve(placed, dimensions, bits).select("id", "row", "key", "tokens")
    ranges = keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row").withColumn("part", F.spark_partition_id().cast("long") * (1 << 32))
    names = ["id", "row", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("id", placed.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    wide = _wide(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, id_type, out = None, None, []

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "id" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        for b in batches:
            if not b.num_rows:
                continue
            id_type = b.schema.field("id").type
            sequences = sequences or Sequences(b.column("part")[0].as_py(), capacity)
            for *doc, tokens in zip(*[b.column(n).to_pylist() for n in ("id", "row", "key")], b.column("tokens"), strict=True):
                out += sequences.take(tuple(doc), np.frombuffer(tokens.as_py(), "<u4" if wide else "<u2"))
                if len(out) >= 16 * BATCH:
                    yield made()
                    out = []
        if sequences:
            out += sequences.end()
        if out:
            yield made()

    return ranges.mapInArrow(run, schema)
