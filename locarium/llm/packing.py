"""Best-fit packing after a Martello-Toth dominance reduction.

What decides a packing is how many pieces there are of each length, a table
of at most ``capacity`` rows however large the corpus. The reduction and the
best-fit pass work on that table, in runs of equal bins; the pieces then find
their bins by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import single_threaded, stored

CAPACITY = 2048
#: Distinct words whose ids a worker process remembers: some 150 MB.
REMEMBERED = 750_000


class Encoder:
    """Token ids of texts, with those of recurring words remembered.

    Byte-level BPE first splits a text where a single space precedes a word
    and never merges across, so the ids of a text are those of its words, each
    with the space before it, one after another. Texts in which white space
    follows a space or ends the text on one are encoded whole, and so are those
    that hold one of the tokenizer's added tokens, which it takes out first.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # tokens are written in letters that stand for one byte each
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words that each follow a space: they are encoded together, and told apart by their tokens' bytes."""
        ids = self._encode([" " + " ".join(words)])[0]
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        at = np.cumsum(self.bytes_of[np.frombuffer(ids, np.uint32)])
        cuts = [0, *((np.searchsorted(at, ends) + 1) * 4).tolist()]
        self.known.update(zip(words, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._encode([text])[0]
        first, *words = text.split(" ")
        known = self.known
        try:
            tail = b"".join([known[x] for x in words])
        except KeyError:
            new = [x for x in dict.fromkeys(words) if x not in known]
            if any(not x or x[0].isspace() for x in new):
                return self._encode([text])[0]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(words))
            self._learn(new)
            tail = b"".join([known[x] for x in words])
        return self._encode([first])[0] + tail if first else tail


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: later tasks of a worker find what earlier ones learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, ids_crc32, task, nth`` of every document.

    A document is its ids and ``end_id``; null text is empty. Longer ones than
    ``capacity`` are cut into pieces of that length, of which the first may be
    shorter. ``nth`` counts the pieces of a length within ``task``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path).ids
        seen = np.zeros(capacity + 1, np.int64)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            source, cols = [], ([], [], [], [], [])
            for k, text in enumerate(b.column(1)):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n, capacity), n]
                for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    source.append(k)
                    for c, v in zip(cols, (piece, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), seen[hi - lo]), strict=True):
                        c.append(int(v))
                    seen[hi - lo] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), b.column(2).take(pa.array(source, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["id", "task", "piece", "start", "length", "ids_crc32", "nth"])

    schema = docs.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("task")).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("nth", "long")):
        schema = schema.add(name, kind)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("task")).mapInArrow(run, schema)


class Bins:
    """Runs of equal bins and where the pieces of each length go.

    ``rules`` holds ``(length, lo, hi, per_bin, first_bin, offset)``: of that
    length, the pieces ranked lo..hi-1 go ``per_bin`` to a bin, from
    ``first_bin`` on, at ``offset`` and after.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}
        self.used = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.rules: list[tuple[int, int, int, int, int, int]] = []

    def place(self, length: int, bins: int, per_bin: int, first: int, offset: int, pieces: int | None = None) -> None:
        n = bins * per_bin if pieces is None else pieces
        lo = self.used[length]
        self.rules.append((length, lo, lo + n, per_bin, first, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], bins: int) -> None:
        """Close ``bins`` bins that hold exactly these lengths."""
        offset = 0
        for length in lengths:
            self.place(length, bins, 1, self.bins, offset)
            offset += length
        self.bins += bins


def reduce_instance(state: Bins) -> int:
    """Martello and Toth's reduction: fix sets of at most three pieces that dominate all others with their largest.

    A set dominates another if its pieces can be matched with groups of the
    other's, none larger than the piece it is matched with; then some optimal
    packing has the dominating set as a bin. For the longest piece j:

    * nothing fits beside it: {j};
    * some piece fills the bin with it, or no two fit beside it: {j, the longest that fits};
    * at most two fit beside it: {j, longest that fits} if that is as long as
      the best pair together;
    * else {j, a, b}, a the longest that fits and b the longest that fits beside
      both, if no pair that fits has both its pieces longer than b: of any pair
      the longer is then no longer than a, the shorter no longer than b.

    Equal pieces are fixed together. Returns how many bins were fixed.
    """
    room = state.capacity
    lengths = sorted(state.left)
    begun = state.bins
    for j in sorted(state.left, reverse=True):
        while j in state.left:
            left = state.left
            lengths = [x for x in lengths if x in left]
            rest = room - j
            k = bisect.bisect_right(lengths, rest) - 1  # the longest that fits beside one j
            if k >= 0 and lengths[k] == j and left[j] == 1:
                k -= 1
            if k < 0:
                state.fix((j,), left[j])
                break
            a = lengths[k]
            small = _smallest(left, lengths, j, 3)
            two_fit = len(small) > 1 and small[0] + small[1] <= rest
            three_fit = len(small) > 2 and sum(small) <= rest
            if a == rest or not two_fit or (not three_fit and a >= _best_pair(left, lengths, j, rest)):
                state.fix((j, a), left[j] // 2 if a == j else min(left[j], left[a]))
            elif not three_fit and (b := _third(left, lengths, (j, a), rest - a)) and _none_longer(left, lengths, j, b, rest):
                state.fix((j, a, b), min(left[x] // (j, a, b).count(x) for x in (j, a, b)))
            else:
                break
    return state.bins - begun


def _smallest(left: dict[int, int], lengths: list[int], j: int, n: int) -> list[int]:
    """The ``n`` shortest pieces besides one of length ``j``."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n, left[x] - (x == j))
        if len(out) >= n:
            break
    return out[:n]


def _third(left: dict[int, int], lengths: list[int], taken: tuple[int, int], rest: int) -> int:
    """The longest piece besides ``taken`` that fits into ``rest``, or 0."""
    for x in reversed(lengths[: bisect.bisect_right(lengths, rest)]):
        if left[x] > taken.count(x):
            return x
    return 0


def _none_longer(left: dict[int, int], lengths: list[int], j: int, b: int, rest: int) -> bool:
    """No two pieces longer than ``b``, besides one ``j``, fit into ``rest``."""
    longer = _smallest(left, lengths[bisect.bisect_right(lengths, b) :], j, 2)
    return len(longer) < 2 or sum(longer) > rest


def _best_pair(left: dict[int, int], lengths: list[int], j: int, rest: int) -> int:
    """The most that two pieces besides one ``j`` take of ``rest``."""
    have = {x: left[x] - (x == j) for x in lengths}
    lengths = [x for x in lengths if have[x]]
    lo, hi, best = 0, len(lengths) - 1, 0
    while lo <= hi:
        total = lengths[lo] + lengths[hi]
        if total > rest:
            hi -= 1
            continue
        if lo != hi or have[lengths[lo]] > 1:
            best = max(best, total)
        lo += 1
    return best


def best_fit(state: Bins) -> None:
    """Best-fit decreasing over the lengths left, whole runs of bins at a time.

    The tightest bin that a piece fits stays the tightest for the next equal
    piece while it fits, so a bin of a run takes as many as fit before the
    next bin of the run takes any.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first bin, bins)
    rooms: list[int] = []  # sorted

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in open_runs:
                open_runs[room] = []
                bisect.insort(rooms, room)
            open_runs[room].append((first, bins))

    for length in sorted(state.left, reverse=True):
        while count := state.left.get(length, 0):
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[k]
            else:
                room, first = state.capacity, state.bins
                bins = -(-count // (room // length))
                state.bins += bins
            per_bin = room // length
            offset = state.capacity - room
            full = min(bins, count // per_bin)
            if full:
                state.place(length, full, per_bin, first, offset)
                put(room - per_bin * length, first, full)
            some = count - full * per_bin if full < bins else 0
            if some:
                state.place(length, 1, per_bin, first + full, offset, some)
                put(room - some * length, first + full, 1)
            put(room, first + full + bool(some), bins - full - bool(some))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """The whole packing of so many pieces of each length."""
    state = Bins(counts, capacity)
    reduce_instance(state)
    best_fit(state)
    return state


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents: ``id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Repeated rows and repeated ids are packed one by one; null and empty texts
    are the end id alone. Empty tables give no rows. The driver sees the
    number of pieces of each length, ``capacity`` figures at most.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    per_task = stored(table.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    state = plan_bins(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranks = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # lengths x tasks rows, which grow with the corpus: never broadcast
    ranked = table.join(ranks.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # Rules are a few per length and run of bins, whatever the number of documents.
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for rule in state.rules:
        by_length.setdefault(rule[0], []).append(rule)
    tables = {n: np.array(sorted(r, key=lambda x: x[1]), np.int64) for n, r in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    n = int(length[part[0]])
                    rule = rules[n][np.searchsorted(rules[n][:, 1], rank[part], side="right") - 1]
                    nth = rank[part] - rule[:, 1]
                    sequence[part] = rule[:, 4] + nth // rule[:, 3]
                    offset[part] = rule[:, 5] + nth % rule[:, 3] * n
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    schema = out.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return out.mapInPandas(sequences, schema)
