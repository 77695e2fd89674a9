"""Exact deduplication by a heavy-hitter split.

A mergeable Misra-Gries summary finds digests that hold a large share of the
rows. Their exact winners are few by construction and are broadcast, so that
their copies are settled where they lie; only the remaining digests, none of
which is frequent, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, maybe_in, stored

#: Counters of a summary. Digests in more than 2/(COUNTERS+1) of all rows are sure to be found.
COUNTERS = 1023


def _summarise(counts: pd.Series, counters: int) -> pd.Series:
    """Reduce to at most ``counters`` entries: take the next largest count off all of them."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False, kind="stable")
    counts = counts.iloc[:counters] - counts.iloc[counters]
    return counts[counts > 0]


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(digest, low)``: every digest in more than 2/(counters+1) of the rows, and few others.

    ``low`` is a lower bound of the digest's count. Each task's summary lacks
    at most 1/(counters+1) of its rows for any digest, and so does their sum;
    entries are kept if the sum exceeds 1/(counters+1) of all rows, hence at
    most ``counters`` of them, whatever the input.
    """

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = pd.Series(dtype="int64"), 0
        for batch in batches:
            rows += len(batch)
            counts = _summarise(counts.add(batch["digest"].value_counts(), fill_value=0).astype("int64"), counters)
        yield pd.DataFrame({"digest": pd.Series([None, *counts.index], dtype=object), "low": [rows, *counts]})

    merged = digests.select("digest").mapInPandas(summaries, "digest string, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    merged = stored(merged)
    rows = merged.where("digest is null").agg(F.sum("low")).first()[0] or 0
    return merged.where("digest is not null").where(F.col("low") * (counters + 1) > rows)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``id, row, digest, keep_id, group_size, kept``.

    Texts are equal when they are identical after lower-casing A-Z; null
    counts as empty. The row with the largest id of a group stays. A null id
    is smaller than any other; of rows that share the largest id, one stays.
    ``row`` numbers the rows as read and only breaks such ties. Empty tables
    give no rows; other columns of ``docs`` are not read.
    """
    digest = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    table = stored(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest")))
    best = F.max(F.struct("id", "row")).alias("best")
    size = F.count("*").alias("group_size")
    heavy = frequent_digests(table, counters)
    # A proven bound: at most `counters` rows of some 100 bytes.
    winners = stored(table.join(F.broadcast(heavy.select("digest")), "digest", "left_semi").groupBy("digest").agg(best, size))
    at_home = table.join(F.broadcast(winners), "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    ordinary = rest.join(rest.groupBy("digest").agg(best, size), "digest")
    return at_home.unionByName(ordinary).select(
        "id",
        "row",
        "digest",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. See :func:`exact_groups`.

    Copies of frequent texts go where they lie, by the broadcast winners; rows
    whose digest occurs once stay where they lie. A bitmap of bounded size
    tells most of these apart from the rest, whose rows alone are shuffled,
    grouped by digest: of each the one with the largest id stays, of rows that
    share id and text one.
    """
    digest, shared, best, known = fresh(docs, "digest", "shared", "best", "known")
    of = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    table = stored(docs.select(F.col(id_col).alias("id"), of.alias("digest")))
    heavy = frequent_digests(table, counters)
    # A proven bound: at most `counters` rows of some 100 bytes.
    winners = stored(table.join(F.broadcast(heavy.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("id")))
    again = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti").groupBy("digest").count().where("count > 1")
    keyed = docs.withColumn(digest, of).join(F.broadcast(winners.select(F.col("digest").alias(digest), F.col("id").alias(best), F.lit(True).alias(known))), digest, "left")
    light, of_heavy = F.col(known).isNull(), F.coalesce(F.col(known), F.lit(False)) & F.col(id_col).eqNullSafe(F.col(best))
    marked = keyed.where(light | of_heavy).withColumn(shared, of_heavy | maybe_in(again.select(F.xxhash64("digest").alias("key")), F.xxhash64(digest)))
    names = docs.columns
    order = F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"))
    some = marked.where(F.col(shared)).groupBy(digest).agg(F.max_by(F.struct(*names), order).alias(best)).select(f"{best}.*")
    return marked.where(~F.col(shared)).select(*names).unionByName(some)
