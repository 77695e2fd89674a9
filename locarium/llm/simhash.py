"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in some of their
blocks of bits (pigeonhole), so equal blocks give all candidates. Rows that
share blocks are compared bit-sliced: lane by lane their bits stand in
vertical planes of 64-bit words, one query fingerprint updates 64 distances at
a time through carry-save counters, and a block is abandoned once all its
lanes are beyond the radius. Only a spanning forest of each cell leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealt, fresh, maybe_in, stored

SEED = 42
#: Rows of a bucket beyond which it is split into chunks, compared chunk by chunk.
CHUNK = 1024
#: Expected rows of a bucket beyond which finer blocks are used.
BUCKET = 512
_LOW = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of
    ``words`` words count as often as they occur, and a shorter text is one
    shingle. A bit is 1 if more than half the hashes have it. No word: 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):  # bounds memory for very long texts
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) and the columns ``keep`` for every document."""
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fp)], ["id", *keep, "fp"])

    schema = docs.select(F.col(id_col).alias("id")).schema
    for f in kept:
        schema = schema.add(f)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep).mapInArrow(run, schema.add("fp", "long", False))


def _block_masks(rows: int, radius: int) -> list[int]:
    """Masks of bits on which at least one pair within ``radius`` must agree.

    The 64 bits fall into m blocks; any m - radius of them are kept. m is the
    least for which a bucket of ``rows`` random fingerprints stays small. Every
    choice finds all pairs.
    """
    m = radius + 1
    while m < min(2 * radius + 2, 64) and rows / 2 ** ((m - radius) * 64 / m) > BUCKET:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _match(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i < j`` of the same cell within ``radius``; cells lie one after another."""
    n = len(fps)
    width = (sizes + 63) // 64
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    word0 = np.concatenate(([0], np.cumsum(width)[:-1]))
    words = int(width.sum())
    cell = np.repeat(np.arange(len(sizes)), sizes)
    lane = word0[cell] * 64 + np.arange(n) - first[cell]
    at = np.full(words * 64, -1, np.int64)
    at[lane] = np.arange(n)
    used = np.packbits(at >= 0, bitorder="little").view(np.uint64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[lane] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)
    own = lane // 64
    ahead = word0[cell] + width[cell] - own  # words of the cell from the query's own on
    q_all = np.repeat(np.arange(n), ahead)
    w_all = np.arange(len(q_all)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + np.repeat(own, ahead)
    counters = (radius + 1).bit_length()
    left, right = [], []
    for part in range(0, len(q_all), 1 << 17):
        q, w = q_all[part : part + (1 << 17)], w_all[part : part + (1 << 17)]
        over = ~used[w]
        mine = w == own[q]
        # lanes up to the query's own are not compared again
        over[mine] |= _ALL >> (np.uint64(63) - (lane[q[mine]] % 64).astype(np.uint64))
        count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        for bit in range(64):
            flip = np.where((fps[q] >> np.uint64(bit)) & _LOW, _ALL, np.uint64(0))
            carry = planes[bit][w] ^ flip
            for c in count:
                c_old = c.copy()
                c ^= carry
                carry &= c_old
            # the counters rise by one at most, so a lane passes radius + 1 exactly
            beyond = ~over
            for k, c in enumerate(count):
                beyond &= c if (radius + 1) >> k & 1 else ~c
            over |= beyond
            if bit % 8 == 7:
                alive = over != _ALL
                if not alive.all():
                    q, w, over, count = q[alive], w[alive], over[alive], [c[alive] for c in count]
                    if not len(q):
                        break
        if len(q):
            row, hit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(q[row])
            right.append(at[w[row] * 64 + hit])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` items over the links ``i - j``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (up := label[label]).tolist() != label.tolist() if n < 64 else not np.array_equal(up := label[label], label):
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def cells(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(bucket, item, ...)`` dealt into cells ``(bucket, a, b)`` that hold every pair of a bucket.

    A bucket of up to ``chunk`` rows is one cell. A larger one falls into
    chunks by the item's hash, and each pair of chunks is a cell, so no task
    holds more than some two chunks of a bucket. Items of a bucket are distinct.
    """
    large = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n"))
    marked = rows.join(large, "bucket", "left")
    mine = F.pmod(F.xxhash64("item", F.lit("chunk")), F.col("chunks")).cast("int")
    names = rows.columns
    small = marked.where("chunks is null").select(*names, F.lit(0).alias("a"), F.lit(0).alias("b"))
    split = marked.where("chunks is not null").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    split = split.select(*names, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    return small.unionByName(split)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pd.DataFrame]:
    """Spanning forests of cells; their rows come sorted by cell and may run over batches."""
    rest: pd.DataFrame | None = None

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[["bucket", "a", "b"]].to_numpy()[1:] != rows[["bucket", "a", "b"]].to_numpy()[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rows)))
        fps = rows["item"].to_numpy(np.int64)[np.repeat(size > 1, size)].view(np.uint64)
        if not len(fps):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        i, j = _match(fps, size[size > 1], radius)
        root = forest(len(fps), i, j)
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[child].view(np.int64), "v": fps[root[child]].view(np.int64)})

    for batch in batches:
        rows = batch.to_pandas() if isinstance(batch, pa.RecordBatch) else batch
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        key = rows[["bucket", "a", "b"]].to_numpy()
        same = (key == key[-1]).all(axis=1) if len(rows) else np.zeros(0, bool)
        rest = rows[same]
        if not same.all():
            yield work(rows[~same])
    if rest is not None and len(rest):
        yield work(rest)


def linked(fps: DataFrame, radius: int = 4, rows: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct fingerprints (``item``) within ``radius`` of each other."""
    masks = _block_masks(fps.count() if rows is None else rows, radius)
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("item").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)]))
    table = cells(fps.select(bucket.alias("bucket"), "item"))
    return dealt(table, "bucket", "a", "b", then=("item",)).mapInPandas(lambda it: _links(it, radius), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, fp, component, component_id`` and ``keep`` for every document; component_id is the smallest id reachable.

    ``component`` names the group by one of its fingerprints.

    Links join fingerprints at ``radius`` or fewer differing bits; equal ones
    are one node. Texts without a word have fingerprint 0 and link like any
    other. Null ids come last: a group of null ids alone has a null
    component_id. Repeated rows are all returned. Empty tables give no rows.
    """
    table = stored(fingerprints(docs, id_col, text_col, words, keep))
    nodes = stored(table.groupBy(F.col("fp").alias("item")).agg(F.min("id").alias("first")))
    components = connected_components(linked(nodes.select("item"), radius))
    named = nodes.join(components.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    named = stored(named)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    node = named.join(smallest, "component").select(F.col("item").alias("fp"), "component", "component_id")
    return table.join(node, "fp").select("id", *keep, "fp", "component", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id.

    Rows that share that id are told apart by their text's hash, the smallest
    of which stays; a row repeated as a whole stays once for each repeat. Of a
    group that has null ids alone, the smallest hash stays. A bitmap of bounded
    size keeps rows without partners where they lie; only the others are shuffled.
    """
    names = docs.columns
    text, key, shared = fresh(docs, "hash", "key", "shared")
    hashed = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    groups = stored(simhash_groups(docs.withColumn(text, hashed), id_col, text_col, words, radius, keep=(text,)).withColumnRenamed(text, "text"))
    of = F.xxhash64(F.col("id"), F.col("text"))
    several = groups.groupBy("component").count().where("count > 1").select("component")
    stay = groups.join(several, "component", "left_semi").where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.first("id").alias("id"), F.min("text").alias("text"))
    held = groups.join(several, "component", "left_semi").select(of.alias("key")).distinct()
    keyed = docs.withColumn(text, hashed).withColumn(key, F.xxhash64(F.col(id_col), F.col(text))).withColumn(shared, maybe_in(held, F.col(key)))
    # A key that the bitmap holds by chance belongs to no group, and stays.
    rows = groups.join(several, "component", "left_semi").select("id", "text").distinct()
    gone = rows.alias("r").join(stay.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.text") == F.col("s.text")), "left_anti").select("r.*")
    some = keyed.where(F.col(shared)).alias("d").join(gone.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{text}") == F.col("g.text")), "left_anti")
    return keyed.where(~F.col(shared)).select(*names).unionByName(some.select(*names))


def as_hex(fp: str) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


