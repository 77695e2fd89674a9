"""Importance resampling towards a target distribution, over an integer word dictionary.

Documents are read once, in chunks of bounded size. A chunk numbers its words
itself and keeps each text as a run of those numbers; the words of all chunks
then meet once and get ids that hold everywhere. n-grams are tuples of ids:
every distinct tuple's bytes are put together and hashed once, and its counts
and gain are joined back to the chunks that hold it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: A chunk ends with the text that brings it to so many words, all told or distinct. No result depends on either.
CHUNK_WORDS = 1 << 21
CHUNK_DISTINCT = 1 << 19
#: Words sent to all executors when tuples of several words are spelt: the most frequent ones, some 2 MB.
COMMON = 1 << 16

#: What a byte of UTF-8 becomes: digits, small letters and all beyond ASCII stay, capitals become small, any other separates.
_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased; null has none."""
    return text.translate(_BYTES).split() if text else []


def chunks(docs: DataFrame, id_col: str | None, text_col: str, chunk_words: int = CHUNK_WORDS, chunk_distinct: int = CHUNK_DISTINCT) -> DataFrame:
    """Rows of two kinds: ``chunk, id, row, tokens`` of every document, and ``chunk, local, word, n`` of every word of a chunk.

    ``tokens`` are the chunk's own numbers of the document's words, 32 bits
    each. Chunks of different partitions never share a number.
    """
    id_of = F.col(id_col) if id_col else F.lit(None).cast("long")
    source = docs.select(id_of.alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), (F.spark_partition_id().cast("long") * (1 << 32)).alias("chunk"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("id", source.schema["id"].dataType), T.StructField("row", T.LongType())])
    schema = schema.add("tokens", "binary").add("local", "integer").add("word", "binary").add("n", "long")
    kinds = {"chunk": pa.int64(), "row": pa.int64(), "tokens": pa.binary(), "local": pa.int32(), "word": pa.binary(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        texts: list[np.ndarray] = []
        chunk = held = 0

        def rows(size: int, /, **given: object) -> pa.RecordBatch:
            columns = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], kinds[c]) if c in given else pa.nulls(size, kinds.get(c, id_type)) for c in schema.names]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def vocabulary() -> Iterator[pa.RecordBatch]:
            words, counts = list(number), np.bincount(np.concatenate(texts), minlength=len(number))
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield rows(len(part), chunk=[chunk] * len(part), local=np.arange(lo, lo + len(part), dtype=np.int32), word=part, n=counts[lo : lo + len(part)])

        for b in batches:
            if not b.num_rows:
                continue
            id_type, tokens, of = b.schema.field("id").type, [], []
            chunk = max(chunk, b.column("chunk")[0].as_py())
            for text in b.column("text"):
                words = words_of(text.as_py())
                at = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                tokens.append(at.tobytes())
                of.append(chunk)
                texts.append(at)
                held += len(words)
                if held >= chunk_words or len(number) >= chunk_distinct:
                    yield from vocabulary()
                    number, texts, held, chunk = defaultdict(itertools.count().__next__), [], 0, chunk + 1
            yield rows(len(tokens), chunk=of, id=b.column("id"), row=b.column("row"), tokens=tokens)
        if number:
            yield from vocabulary()

    return source.mapInArrow(run, schema)


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The documents of a chunk as they were read, their tokens one after another, and where each document's end."""
    table = table.sort_by("row")
    texts = table["tokens"].to_pylist()
    return table, np.frombuffer(b"".join(texts), np.uint32), np.cumsum([len(t) // 4 for t in texts])


def _codes(tokens: np.ndarray, ends: np.ndarray, max_n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..max_n the code of the n-gram that begins at each token, and where each code is found first.

    Codes number the distinct n-grams of a chunk, shorter ones first; an
    n-gram that its text ends before has code -1. A single word's code is the
    chunk's number of it, and all are the same whenever they are made again.
    """
    end_of, place = np.repeat(ends, np.diff(np.r_[0, ends])), np.arange(len(tokens))
    size = int(tokens.max(initial=0)) + 1
    code, out, made = tokens.astype(np.int64), [], 0
    for n in range(1, max_n + 1):
        whole = place[place + n <= end_of]
        keys = code[whole] if n == 1 else code[whole] * size + tokens[whole + n - 1]
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        code = np.full(len(tokens), -1, np.int64)
        code[whole] = inverse
        out.append((np.where(code < 0, -1, code + made), whole[first]))
        made += len(first)
    return out


def _dictionary(vocabulary: DataFrame) -> DataFrame:
    """``chunk, local, n, target, id, word, total, target_total`` in one shuffle: each word gets an id.

    Words and their counts over all chunks stand on one row of each word, and are null on the others.
    """
    numbered = vocabulary.repartition("word").withColumn("m", F.monotonically_increasing_id())
    of = Window.partitionBy("word")
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0))).over(of)
    summed = numbered.withColumns({"id": F.min("m").over(of), "total": total(~F.col("target")), "target_total": total(F.col("target"))})
    first = F.col("m") == F.col("id")
    return stored(summed.select("chunk", "local", "n", "target", "id", *[F.when(first, F.col(c)).alias(c) for c in ("word", "total", "target_total")]))


def _tuples(docs: DataFrame, words: DataFrame, max_n: int) -> DataFrame:
    """``chunk, target, code, tuple, n``: the distinct n-grams of each chunk as tuples of ids. A chunk is of bounded size."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, tokens, ends = _in_order(left)
        ids = np.zeros(right.num_rows, np.int64)
        ids[right["local"].to_numpy()] = right["id"].to_numpy()
        codes, tuples, counts = [], [], []
        for n, (code, first) in enumerate(_codes(tokens, ends, max_n), 1):
            found, count = np.unique(code[code >= 0], return_counts=True)
            codes.append(found)
            counts.append(count)
            tuples += ids[tokens[first[:, None] + np.arange(n)]].tolist()
        key = [left["chunk"][0].as_py() if left.num_rows else None] * len(tuples), [left["target"][0].as_py() if left.num_rows else None] * len(tuples)
        return pa.table({"chunk": pa.array(key[0], pa.int64()), "target": pa.array(key[1], pa.bool_()), "code": np.concatenate(codes), "tuple": pa.array(tuples, pa.list_(pa.int64())), "n": np.concatenate(counts)})

    of = docs.select("chunk", "target", "row", "tokens").groupBy("chunk", "target").cogroup(words.select("chunk", "target", "local", "id").groupBy("chunk", "target"))
    return stored(of.applyInArrow(run, "chunk long, target boolean, code long, tuple array<long>, n long"))


def _spelt(tuples: DataFrame, words: DataFrame, common: int = COMMON) -> DataFrame:
    """``tuple, total, target_total, spelt``: every distinct tuple once, with its counts and its words joined by a space."""
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0)))
    distinct = stored(tuples.groupBy("tuple").agg(total(~F.col("target")).alias("total"), total(F.col("target")).alias("target_total")))
    parts = distinct.select("tuple", F.posexplode("tuple").alias("at", "id"))
    known = words.where("word is not null")
    # A proven bound: so many words. Any other occurs in few tuples, so that no id is a hot key of the join.
    frequent = stored(known.orderBy(F.desc(F.col("total") + F.col("target_total")), "id").limit(common).select("id", F.col("word").alias("frequent")))
    held = parts.join(F.broadcast(frequent), "id", "left")
    rest = held.where("frequent is null").join(known.select("id", "word"), "id")
    both = held.where("frequent is not null").select("tuple", "at", F.col("frequent").alias("word")).unionByName(rest.select("tuple", "at", "word"))
    ordered = both.groupBy("tuple").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    spelt = F.aggregate(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1)["word"], lambda a, p: F.concat(a, F.lit(b" "), p["word"]))
    return distinct.join(ordered.select("tuple", spelt.alias("spelt")), "tuple")


def bucket_gains(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket that ``hashed(bucket, total, target_total)`` has: at most ``buckets`` rows.

    In doubles ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``,
    where s of all S features of the documents and t of all T of the target fall into the bucket.
    """
    sums = hashed.groupBy("bucket").agg(F.sum("total").cast("double").alias("s"), F.sum("target_total").cast("double").alias("t"))
    whole = hashed.agg(F.sum("total").cast("double").alias("of_s"), F.sum("target_total").cast("double").alias("of_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("of_s") + buckets) / ((F.col("s") + 1) * (F.col("of_t") + buckets))
    return sums.join(F.broadcast(whole), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))`` for h, the first 32 bits of SHA-256 of ``seed:id``; a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` to the rows drawn: ranges of the order are numbered within themselves and moved on by what lies before them."""
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = (F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    # monotonically_increasing_id counts a task's rows in its low 33 bits
    ranges = stored(fit.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth")))
    # one row a range
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("nth") + 1
    numbered = ranges.join(starts, "part").withColumn("rank", F.when(rank <= drawn, rank))
    none = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(none.columns).unionByName(none)


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, chunk_words: int = CHUNK_WORDS, chunk_distinct: int = CHUNK_DISTINCT,
) -> DataFrame:
    """One row per document: ``id, row, n_words, n_features, weight, score, rank``.

    Features are all runs of 1 to ``max_n`` words, repeats counted; a document's
    weight is the sum of the gains of its features' buckets, and its score adds
    Gumbel noise seeded by its id. Of the documents with ``least_words`` words,
    ``percent`` of a hundred are drawn by the highest score, ties to the smaller
    id, and ranked from 1; others have no rank. Null texts are empty and weigh
    0. A null id comes last among ties; rows that share an id are each taken
    for what they are, in the order read. An empty target has no features; an
    empty table gives no rows. Other columns aren't read.
    """
    flag = F.lit(False).alias("target"), F.lit(True).alias("target")
    read = stored(chunks(docs, id_col, text_col, chunk_words, chunk_distinct))
    aim = stored(chunks(target, None, target_text_col, chunk_words, chunk_distinct))
    vocabulary = lambda t, which: t.where("word is not null").select("chunk", "local", "word", "n", which)
    words = _dictionary(vocabulary(read, flag[0]).unionByName(vocabulary(aim, flag[1])))
    texts = read.where("word is null").select("chunk", "id", "row", "tokens")
    if max_n == 1:  # a chunk's words are its tuples, and the dictionary has their counts
        tuples = words.select("chunk", "target", F.col("local").cast("long").alias("code"), F.array("id").alias("tuple"))
        spelt = words.where("word is not null").select(F.array("id").alias("tuple"), "total", "target_total", F.col("word").alias("spelt"))
    else:
        both = texts.select("chunk", "row", "tokens", flag[0]).unionByName(aim.where("word is null").select("chunk", "row", "tokens", flag[1]))
        tuples = _tuples(both, words, max_n)
        spelt = _spelt(tuples, words)
    hashed = stored(spelt.select("tuple", (F.crc32("spelt") % buckets).cast("int").alias("bucket"), "total", "target_total"))
    gain_of = hashed.select("tuple", "bucket").join(F.broadcast(bucket_gains(hashed, buckets)), "bucket").select("tuple", "gain")
    held = tuples.where(~F.col("target")).join(gain_of, "tuple").select("chunk", "code", "gain")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        left, tokens, ends = _in_order(left)
        gain = np.zeros(right.num_rows, np.int64)
        gain[right["code"].to_numpy()] = right["gain"].to_numpy()
        sizes = np.diff(np.r_[0, ends])
        features, weight = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for n, (code, _) in enumerate(_codes(tokens, ends, max_n), 1):
            features += np.maximum(sizes - n + 1, 0)
            upto = np.r_[0, np.cumsum(np.where(code < 0, 0, gain[code] if len(gain) else 0))]
            weight += upto[ends] - upto[ends - sizes]
        return pa.table({"id": left["id"], "row": left["row"], "n_words": sizes.astype(np.int64), "n_features": features, "weight": weight})

    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("row", T.LongType())]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    weighed = texts.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(weigh, schema)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    return _ranked(scored, percent, least_words)
