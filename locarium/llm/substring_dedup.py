"""Substring deduplication by MinHash bands over paragraphs.

Paragraphs are of two kinds. Lines of at least ``MIN_WORDS`` words are whole
paragraphs (very long lines are cut where their own words say so), and every
text has besides, across its lines, paragraphs of ``PARAGRAPH`` words that
begin where the words themselves say so: at the least of every ``STRIDE``
consecutive word pairs' hashes, and at the text's ends. A run of ``MIN_WORDS`` words holds one of these
whole, and the same one wherever the run stands. Bands tuned for recall bring
similar paragraphs into buckets, those that begin alike where words chose them; within a bucket the exact Jaccard similarity
of their word shingles decides, and components of the verified links are the
clusters of which one occurrence stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import connected_components, dealt, fresh, key_filter, passes, stored
from .simhash import cells, forest

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Words of a repeated passage, at least; texts with fewer have none.
MIN_WORDS = 50
#: Words of a paragraph that begins where the words say so, and word pairs of which the least begins one.
PARAGRAPH = 30
STRIDE = MIN_WORDS - PARAGRAPH - 1
#: Lines of more words are cut after words whose hash is divisible by CUT.
LONG_LINE, CUT = 512, 128
#: Items that a task remembers, to bring the bands of each but once.
REMEMBERED = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, least_rows: int = 1, most_rows: int = 8) -> tuple[int, int]:
    """``(bands, rows)`` that find a pair at ``similarity`` with chance ``recall``, for the least work.

    Work is the number of bands, which are shuffled, and, weighed by 4, the
    share of unrelated pairs (similarities below a quarter of the threshold,
    evenly) that collide.
    """
    best = None
    for rows in range(least_rows, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        low = np.linspace(0, similarity / 4, 101)
        false = float((1 - (1 - low**rows) ** bands).mean())
        cost = bands * (1 + 4 * false)
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
    return best[1], best[2]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_TABLES: dict[str, np.ndarray] = {}


def _lower_table() -> np.ndarray:
    """The lower-case letter of each code point, where that is one."""
    if "lower" not in _TABLES:
        low = (chr(i).lower() for i in range(0x110000))
        _TABLES["lower"] = np.fromiter((ord(c) if len(c) == 1 else i for i, c in enumerate(low)), np.uint32, 0x110000)
    return _TABLES["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the polynomial's base and of its inverse, modulo 2**64."""
    if len(_TABLES.get("power", ())) < n:
        one = np.ones(1, np.uint64)
        for name, base in (("power", _ODD), ("back", _INVERSE)):
            _TABLES[name] = np.cumprod(np.concatenate((one, np.full(n + 1000, base))))
    return _TABLES["power"][:n], _TABLES["back"][:n]


class Runs:
    """Hashes of runs of a sequence: a polynomial over its values, taken back to each run's own place."""

    def __init__(self, values: np.ndarray):
        power, self.back = _powers(len(values) + 1)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)))

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.sum[hi] - self.sum[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * _MIX)


class Turn:
    """The words of some texts, laid end to end, and their paragraphs.

    Words are ``[^\\x20\\x09-\\x0D]+``, hashed with each letter in lower case. ``lo`` and ``hi``
    bound each paragraph in words.
    """

    def __init__(self, texts: list[str], paragraph: int = PARAGRAPH, min_words: int = MIN_WORDS):
        whole = "\n".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hashes = Runs(_lower_table()[points].astype(np.uint64)).hash(self.starts, self.ends)
        n = len(self.hashes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.cumsum(sizes) - sizes  # where each text begins, in code points
        self.first = np.searchsorted(self.starts, self.offset)  # its first word
        self.owner = np.repeat(np.arange(len(texts)), np.diff(np.append(self.first, n)))
        chosen = self._chosen(paragraph, min_words - paragraph - 1)
        lines = self._lines(np.flatnonzero(points == 10), min_words)
        words = Runs(self.hashes)
        lo = chosen
        item = words.hash(lo, lo + paragraph)
        alone = self._alone(item, lo, paragraph)
        lo, item = lo[alone], item[alone]
        self.chosen = len(lo)  # the paragraphs after these are lines
        self.lo, self.hi = np.concatenate((lo, lines[0])), np.concatenate((lo + paragraph, lines[1]))
        self.item = np.concatenate((item, words.hash(*lines)))

    def _chosen(self, paragraph: int, stride: int) -> np.ndarray:
        """First words of the paragraphs chosen by their words: the first least of every ``stride`` pairs of a text; and those at its ends."""
        n = len(self.hashes)
        if n < paragraph + stride + 1:
            return np.zeros(0, np.int64)
        pairs = _mixed(self.hashes[:-1] * _MIX + self.hashes[1:])
        low = np.uint64((1 << 24) - 1)
        least = (pairs & ~low) | (np.arange(n - 1, dtype=np.uint64) & low)
        width = 1
        while width < stride:
            step = min(width, stride - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = np.flatnonzero(self.owner[: len(least)] == self.owner[stride : stride + len(least)])
        least = (least[inside] & low).astype(np.int64)
        size = np.diff(np.append(self.first, n))
        enough = size > paragraph + stride
        at = np.unique(np.concatenate((inside + ((least - inside) & int(low)), self.first[enough], (self.first + size - paragraph)[enough])))
        at = at[at + paragraph <= n]
        return at[self.owner[at] == self.owner[at + paragraph - 1]]

    def _lines(self, breaks: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last words of lines with enough words; of long lines, of their pieces."""
        n = len(self.hashes)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(self.starts, breaks), [n]))).astype(np.int64)
        size = np.diff(cuts)
        long = np.repeat(size > LONG_LINE, size)
        more = np.flatnonzero(long & (self.hashes % np.uint64(CUT) == 0)) + 1
        cuts = np.unique(np.concatenate((cuts, more)))
        enough = np.diff(cuts) >= min_words
        return cuts[:-1][enough], cuts[1:][enough]

    def _alone(self, item: np.ndarray, lo: np.ndarray, paragraph: int) -> np.ndarray:
        """False for a paragraph that overlaps an equal one of its text, as words said over and over make."""
        keep = np.ones(len(item), bool)
        order = np.lexsort((lo, item))
        same = item[order][1:] == item[order][:-1]
        near = same & (np.diff(lo[order]) < paragraph)
        if near.any():
            held = 0
            for k in np.flatnonzero(same).tolist():
                a, b = order[k], order[k + 1]
                if k == 0 or not same[k - 1]:
                    held = lo[a]
                if lo[b] - held < paragraph:
                    keep[b] = False
                else:
                    held = lo[b]
        return keep

    def shingles(self, k: int = SHINGLE) -> np.ndarray:
        """A hash of the ``k`` words from each word on."""
        words = np.concatenate((self.hashes, np.zeros(k, np.uint64)))
        rolled = np.zeros(len(self.hashes), np.uint64)
        for i in range(k):
            rolled = (rolled ^ words[i : i + len(rolled)]) * _MIX
            rolled ^= rolled >> np.uint64(29)
        return rolled

    def buckets(self, which: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs ``which`` in the order of their places, and the bucket of each band of the paragraphs ``which``, all chosen by their words or all lines.

        Chosen paragraphs share a bucket only if their first two words are the
        same: a run chooses the same ones wherever it stands, and those of one
        text that overlap don't meet.
        """
        which = which[np.argsort(self.lo[which], kind="stable")]
        if not len(which):
            return which, np.zeros((0, bands), np.uint64)
        values = np.append(self.shingles(), np.uint64(0))
        ends = np.empty(2 * len(which), np.int64)
        ends[::2], ends[1::2] = self.lo[which], self.hi[which] - SHINGLE + 1
        begins = np.where(which < self.chosen, self.hashes[self.lo[which]] * _MIX + self.hashes[self.lo[which] + 1], np.uint64(0))
        rng = np.random.default_rng(7)
        keys = np.zeros((len(which), bands), np.uint64)
        for band in range(bands):
            keys[:, band] = begins
            for _ in range(rows):
                a, b = rng.integers(1, 1 << 63, 2, np.uint64)
                least = np.minimum.reduceat(_mixed((values + b) * (a | np.uint64(1))), ends)[::2]
                keys[:, band] = (keys[:, band] ^ least) * _MIX
                keys[:, band] ^= keys[:, band] >> np.uint64(31)
            keys[:, band] += np.uint64(band)
        return which, keys


def turns(texts: list[str | None], paragraph: int, min_words: int, characters: int = 250_000) -> Iterator[tuple[int, Turn]]:
    """The texts in turns of some ``characters``, each with the place of its first text."""
    at = 0
    while at < len(texts):
        begun, held = at, 0
        while at < len(texts) and held < characters:
            held += len(texts[at] or "")
            at += 1
        yield begun, Turn([t or "" for t in texts[begun:at]], paragraph, min_words)


def _scan(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, paragraph: int, min_words: int) -> DataFrame:
    """``id, row, word, start, end, n_words, item, shingles`` of the paragraphs of all documents.

    ``shingles`` are there for the items ``needed``, once a task, and, as a
    filter of bounded size picks them, for some others; the rest has null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value
        seen: set[int] = set()
        for b in batches:
            for at, t in turns(b.column(1).to_pylist(), paragraph, min_words):
                own = t.owner[t.lo]
                place = pa.array(at + own)
                start, end = t.starts[t.lo] - t.offset[own], t.ends[t.hi - 1] - t.offset[own]
                ints = [pa.array(x.astype(np.int32)) for x in (t.lo - t.first[own], start, end, t.hi - t.lo)]
                if len(seen) > REMEMBERED:
                    seen.clear()
                values = t.shingles().view(np.int64)
                sets: list[np.ndarray | None] = [None] * len(t.item)
                for k in np.flatnonzero(passes(has, t.item)).tolist():
                    if (i := int(t.item[k])) not in seen:
                        seen.add(i)
                        sets[k] = np.unique(values[t.lo[k] : t.hi[k] - SHINGLE + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(2).take(place), *ints, pa.array(t.item.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = rows.select("id", "row").schema
    for name in ("word", "start", "end", "n_words"):
        schema = schema.add(name, "integer")
    schema = schema.add("item", "long").add("shingles", ArrayType(LongType()))
    names = schema.names
    return rows.mapInArrow(run, schema)


def _banded(docs: DataFrame, text_col: str, paragraph: int, min_words: int, similarity: float, recall: float) -> DataFrame:
    """``(bucket, item)`` of every band of every paragraph.

    One row a band does for paragraphs that begin alike; whole lines have two
    or more, lest all lines with a common phrase gather in a bucket. Of equal
    paragraphs that a task remembers the first brings all bands, any other the
    first band alone, as a sign that it occurs again.
    """
    tuned = (tune_bands(similarity, recall), tune_bands(similarity, recall, least_rows=2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            for _, t in turns(b.column(0).to_pylist(), paragraph, min_words):
                if len(seen) > REMEMBERED:
                    seen.clear()
                count = []
                for i in t.item.tolist():
                    seen[i] = n = seen.get(i, 0) + 1
                    count.append(n)
                times = np.array(count, np.int64)
                line = np.arange(len(times)) >= t.chosen
                for kind, (bands, rows) in enumerate(tuned):
                    which, keys = t.buckets(np.flatnonzero((times <= 2) & (line == kind)), bands, rows)
                    brings = np.ones(keys.shape, bool)
                    brings[times[which] == 2, 1:] = False
                    item = np.repeat(t.item[which], bands)[brings.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[brings].view(np.int64)), pa.array(item.view(np.int64))], ["bucket", "item"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, item long")


def _meeting(banded: DataFrame) -> DataFrame:
    """``(bucket, item, n)`` of the buckets that have two rows or more, by one pass over rows sorted by bucket and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int] | None = None  # the last run of equal rows, which may go on
        shared = False  # whether a run of its bucket came before it
        for b in batches:
            bucket, item = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(bucket):
                continue
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (item[1:] != item[:-1])))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(bucket)))
            bucket, item = bucket[at], item[at]
            if held is not None:
                if held[0] == bucket[0] and held[1] == item[0]:
                    n[0] += held[2]
                else:
                    bucket, item, n = (np.concatenate(([h], x)) for h, x in zip(held, (bucket, item, n), strict=True))
            else:
                shared = False
            alike = bucket[1:] == bucket[:-1]
            before = np.concatenate(([shared], alike))
            keep = (before | np.concatenate((alike, [False])) | (n > 1))[:-1]
            held, shared = (int(bucket[-1]), int(item[-1]), int(n[-1])), bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep].astype(np.int64)) for x in (bucket, item, n)], ["bucket", "item", "n"])
        if held is not None and (shared or held[2] > 1):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["bucket", "item", "n"])

    return banded.repartition("bucket").sortWithinPartitions("bucket", "item").mapInArrow(run, "bucket long, item long, n long")


def _pairs(codes: np.ndarray, kinds: int, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets ``i`` and ``j`` share, for many pairs at once.

    The sets lie end to end in ``codes``, numbers below ``kinds``, from
    ``place`` on. Pairs are taken in parts of some million values.
    """
    size = np.diff(place)
    held = np.cumsum(size[i] + size[j])
    out = np.zeros(len(i), np.int64)
    cuts = np.searchsorted(held, np.arange(0, held[-1] + 1_000_000, 1_000_000)) if len(i) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            sets = np.stack((i[lo:hi], j[lo:hi]), axis=1).ravel()
            n = size[sets]
            pair = np.repeat(np.arange(len(sets)) // 2, n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - place[sets], n)
            key = pair * kinds + codes[at]
            key.sort()
            out[lo:hi] = np.bincount(key[1:][key[1:] == key[:-1]] // kinds, minlength=hi - lo)
    return out


#: Rows of a cell up to which all its pairs are looked at together with those of other cells.
FEW = 8


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within each cell; rows come sorted by cell."""

    def link(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect the rows of a large cell as all its links would.

        Rows linked to one that has been compared with all others get no turn
        at first. What is missed then are links between two such rows of
        different components, of which one at least isn't in the largest
        component: those rows get their turn afterwards.
        """
        n = len(size)
        at = np.unique(codes, return_inverse=True)[1]
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(at, kind="stable")
        held = np.split(owner[order], np.flatnonzero(np.diff(at[order])) + 1)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        place = np.concatenate(([0], np.cumsum(size)))
        done = np.zeros(n, bool)

        def turn(i: int) -> None:
            both = np.bincount(np.concatenate([held[c] for c in at[place[i] : place[i + 1]]]), minlength=n)
            j = np.flatnonzero(both)
            j = j[(j != i) & (both[j] >= similarity * (size[i] + size[j] - both[j]) - 1e-9)]
            done[j] = True
            left.append(np.full(len(j), i))
            right.append(j)

        for i in range(n):
            if not done[i]:
                turn(i)
        root = forest(n, np.concatenate(left), np.concatenate(right))
        for i in np.flatnonzero(done & (root != np.bincount(root).argmax())).tolist():
            turn(i)
        return np.concatenate(left), np.concatenate(right)

    def work(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "a", "b")])
        item = rows.column("item").to_numpy()
        lists = rows.column("shingles").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        place = lists.offsets.to_numpy().astype(np.int64)
        size = np.diff(place)
        kinds, codes = np.unique(lists.values.to_numpy(), return_inverse=True)
        first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        n = np.diff(np.append(first, len(item)))
        left, right = [], []
        for k in range(2, FEW + 1):  # all pairs of all cells of k rows
            cells_of = first[n == k]
            if len(cells_of):
                x, y = np.triu_indices(k, 1)
                i, j = (cells_of[:, None] + x).ravel(), (cells_of[:, None] + y).ravel()
                both = _pairs(codes, len(kinds), place, i, j)
                close = both >= similarity * (size[i] + size[j] - both) - 1e-9
                left.append(i[close])
                right.append(j[close])
        for lo, m in zip(first[n > FEW].tolist(), n[n > FEW].tolist(), strict=True):
            i, j = link(codes[place[lo] : place[lo + m]], size[lo : lo + m])
            left.append(lo + i)
            right.append(lo + j)
        i, j = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (left, right))
        root = forest(len(item), i, j)
        child = np.flatnonzero(root != np.arange(len(item)))
        return pa.RecordBatch.from_arrays([pa.array(item[child]), pa.array(item[root[child]])], ["u", "v"])

    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b], rest.schema)])
        key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "a", "b")])
        other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        done = int(other[-1]) + 1 if len(other) else 0
        rest = rows.slice(done)
        if done:
            yield work(rows.slice(0, done).combine_chunks())
    if rest is not None and rest.num_rows:
        yield work(rest.combine_chunks())


def _apart(places: DataFrame, paragraph: int) -> DataFrame:
    """Without all but the first of a component's paragraphs that overlap in one text.

    Two paragraphs that begin a word or two apart are similar, and no repeat.
    """
    of = Window.partitionBy("component", "row")
    block = F.floor((F.col("word") - F.min("word").over(of)) / paragraph)
    last = F.lag("block").over(of.orderBy("word"))
    return places.withColumn("block", block).withColumn("last", last).where("last is null or last <> block").drop("block", "last")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS, paragraph: int = PARAGRAPH) -> DataFrame:
    """``id, start, end, n_words, component, component_id, copies, kept`` of every repeated paragraph.

    Letters are lower-cased and runs of white space count as one. Paragraphs
    link when the Jaccard similarity of their 5-word shingles (64-bit hashes)
    is at least ``similarity``; the first occurrence of a component, by id and
    start, stays. ``component_id`` is its id. A run of at least ``min_words``
    words that recurs anywhere has at least one row for every occurrence; one
    of ``paragraph`` words or more may have. Texts of fewer words have no rows, nor have null and empty ones; null ids
    come last, repeated rows repeat their paragraphs (of equal places, one
    stays). Columns beside the two named are not read.
    """
    if not SHINGLE <= paragraph < min_words - 1:
        raise ValueError("a paragraph has at least five words, and two fewer than a passage")
    meeting = stored(_meeting(_banded(docs, text_col, paragraph, min_words, similarity, recall)))
    again = meeting.where("n > 1").select("item").distinct()
    # Buckets of the same items, as a near copy makes in most bands, are compared once: their number, bounds and hash sum agree.
    met = meeting.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count("*").alias("items"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("sum")).where("lo < hi")
    different = met.groupBy("lo", "hi", "items", "sum").agg(F.min("bucket").alias("bucket")).select("bucket")
    compared = stored(meeting.select("bucket", "item").join(different, "bucket", "left_semi"))
    found = stored(_scan(docs, compared.select("item").distinct(), id_col, text_col, paragraph, min_words))
    sets = found.where("shingles is not null").select("item", "shingles").groupBy("item").agg(F.first("shingles").alias("shingles"))
    links = dealt(cells(compared).join(sets, "item"), "bucket", "a", "b", then=("item",)).mapInArrow(lambda it: _verified(it, similarity), "u long, v long")
    components = connected_components(links).withColumnRenamed("node", "item")
    repeated = components.join(again, "item", "full").select("item", F.coalesce("component", "item").alias("component"))
    places = stored(_apart(found.drop("shingles").join(repeated, "item").drop("item"), paragraph))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "start", "row")
    best = places.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    out = places.join(best, "component")
    stays = (F.col("row") == F.col("best.row")) & (F.col("start") == F.col("best.start"))
    return out.select("id", "start", "end", "n_words", "component", F.col("best.id").alias("component_id"), "copies", stays.alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the paragraphs that don't stay cut out of their texts.

    Rows are told apart by a number of their own, so that ids and whole rows
    may repeat. White space around what is cut stays as it is.
    """
    key, cut, row = fresh(docs, "key", "cut", "row")
    keyed = stored(docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))))
    gone = substring_dedup(keyed, key, text_col, **options).where("not kept")
    spans = gone.groupBy(F.col("id.row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))
    text = F.col(text_col)

    def step(acc, s):
        ahead = F.greatest(s["start"] - acc["at"], F.lit(0))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, ahead)).alias("out"))

    kept = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    joined = keyed.join(spans, F.col(f"{key}.row") == F.col(row), "left")
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), text).otherwise(kept)).select(*docs.columns)
