"""Mixing of sources to target weights by capped water-filling.

Only DataFrame functions are used. Sources share a budget in proportion to
their weights; a source whose share exceeds its cap (so many epochs of its own
size) is clamped there, and what it can't take is shared again among the
others, until none is above its cap. Each document is then taken a whole
number of times, and a seeded selection of them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

EPOCHS = 3
SEED = 20240917
#: Slices of a source, and parts of a slice, by which the last, fractional repetition is cut: only one part of one slice
#: of a source, 1/4096 of 1/4096 of its documents, is ordered.
SLICES = PARTS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight, ...)``.

    The budget is the sum of all sizes. Each round compares every source's
    share with its cap and clamps those above; only the sums come to the
    driver. Sources of size 0 get 0. With nothing to share, all targets are 0.
    """
    cap = F.col("source_size") * epochs
    clamped = F.lit(False)
    while True:
        now = sources.withColumn("clamped", clamped)
        free = F.when(~F.col("clamped"), F.col("weight"))
        left, weights, n = now.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("clamped"), cap)), F.lit(0)), F.sum(free), F.count_if("clamped")).first()
        if not weights:
            return sources.withColumn("target", cap.cast("double"))
        share = F.col("weight") * (F.lit(float(left or 0)) / F.lit(float(weights)))
        # The level never falls, so a source once above its cap stays there.
        clamped = share >= cap
        if sources.where(clamped).count() <= n:
            return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def _cut(sums: DataFrame, part: str, by: str) -> DataFrame:
    """Per source of ``sums(source, <by>, words, <part>)`` the first ``by`` that ``part`` words end within, and what is left for it.

    No row for sources that ``part`` covers wholly.
    """
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col(part))
    first = F.min(F.struct(by, (F.col(part) - F.col("upto") + F.col("words")).alias("left"))).alias("first")
    return ends.groupBy("source").agg(first).select("source", F.col(f"first.{by}").alias(by), F.col("first.left").alias("left"))


def _plan(sized: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cut_slice, cut_part, left``.

    Of a source's documents in the order of slice, part and digest, those
    before the cut are taken once more, and ``left`` words from the cut on.
    """
    slices = stored(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    # One row a source from here on; the order of sources needs them side by side.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = stored(slices.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight))
    targets = stored(
        water_fill(sources, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("more", F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0).cast("long")))
        .drop("weight")
    )

    def of_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        return a.alias("a").join(b.withColumnRenamed("source", "of").alias("b"), F.col("a.source").eqNullSafe(F.col("of")), how).drop("of")

    first = stored(_cut(of_source(slices, targets.select("source", "more")), "more", "slice").select("source", F.col("slice").alias("cut_slice"), "left"))
    parts = of_source(sized, first).where("slice = cut_slice").groupBy("source", "part", "left").agg(F.sum("size").alias("words"))
    second = _cut(parts, "left", "part").select("source", F.col("part").alias("cut_part"), "left")
    plan = of_source(of_source(targets, first.select("source", "cut_slice"), "left"), second, "left")
    # Without a cut all documents of the source are taken once more, or it has no words.
    return stored(plan.select("source", "source_size", "target", "whole", F.coalesce("cut_slice", F.lit(SLICES)).alias("cut_slice"), F.coalesce("cut_part", F.lit(PARTS)).alias("cut_part"), F.coalesce("left", F.lit(0).cast("long")).alias("left")))


def _placed(rows: DataFrame, plan: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with ``source_size, target, whole`` and ``taken`` of the plan; ``names`` tells how their columns and these are called."""
    c = {k: F.col(v) for k, v in names.items()}
    of = plan.select(F.col("source").alias(names["of"]), *[F.col(k).alias(names[k]) for k in ("source_size", "target", "whole", "cut_slice", "cut_part", "left")])
    joined = rows.join(of, c["source"].eqNullSafe(F.col(names["of"]))).drop(names["of"])
    behind = (c["slice"] < c["cut_slice"]) | ((c["slice"] == c["cut_slice"]) & (c["part"] < c["cut_part"]))
    within = (c["slice"] == c["cut_slice"]) & (c["part"] == c["cut_part"])
    upto = F.sum(c["size"]).over(Window.partitionBy(c["source"]).orderBy(c["digest"], c["size"]).rowsBetween(Window.unboundedPreceding, 0))
    taken = c["whole"] * c["size"]
    settled = joined.where(~within).withColumn(names["taken"], taken + F.when(behind, c["size"]).otherwise(F.lit(0)))
    cut = joined.where(within).withColumn(names["taken"], taken + F.least(c["size"], F.greatest(F.lit(0), c["left"] - (upto - c["size"]))))
    return settled.unionByName(cut)


_INNER = ("source", "size", "digest", "slice", "part", "source_size", "target", "whole", "cut_slice", "cut_part", "left", "taken", "of")


def _keys(id_col: str, seed: int) -> tuple[Column, Column, Column]:
    """A document's digest, and the slice and part that it stands in."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return digest, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SLICES, F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken, whole, digest``.

    Sources are ordered by code point, null (a source of its own) last, and
    weigh ``weights`` in turn. A document is taken ``whole`` times and the
    documents of a source that come first in an order seeded by id once more,
    as far as the target goes: the last of them in part, so that a source's
    words differ from its target by less than one. Null and empty texts have
    size 0 and are never taken. A null id sorts last; rows that agree in id
    and size are interchangeable. ``digest`` orders the rows of a source.
    """
    digest, slice_, part = _keys(id_col, seed)
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), digest.alias("digest"), slice_.alias("slice"), part.alias("part")))
    out = _placed(sized, _plan(sized, weights, epochs), {k: k for k in _INNER})
    return out.select("id", "source", "size", "source_size", "target", "taken", "whole", "digest")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` repeated as :func:`mix` decides, with the same columns; texts aren't shuffled, but for the one cut part of each source.

    A document taken so many whole times comes as so many rows, and one taken
    in part as a further row with as many of its words, joined by spaces.
    ``n_chars``, where it is there, follows the text. Repeated rows are each
    taken for what they are.
    """
    names = dict(zip(_INNER, fresh(docs, *_INNER), strict=True)) | {"source": source_col}
    digest, slice_, part = _keys(id_col, seed)
    with_keys = {names["size"]: word_count(F.col(text_col)), names["digest"]: digest, names["slice"]: slice_, names["part"]: part}
    keyed = docs.withColumns(with_keys)
    sized = stored(keyed.select(F.col(source_col).alias("source"), *[F.col(names[k]).alias(k) for k in ("size", "slice", "part")]))
    size, taken, rep = F.col(names["size"]), F.col(names["taken"]), fresh(docs, "rep")[0]
    rows = _placed(keyed, _plan(sized, weights, epochs), names).where(taken > 0)
    rows = rows.withColumn(rep, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    left = (taken - (F.col(rep) - 1) * size).cast("int")
    whole = left >= size
    if "n_chars" in docs.columns and text_col != "n_chars":
        cut = F.when(whole, F.col(text_col)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})")), F.lit(1), left), " "))
        rows = rows.withColumns({text_col: cut, "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.char_length(cut).cast(docs.schema["n_chars"].dataType))})
    else:
        rows = rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})")), F.lit(1), left), " ")))
    return rows.select(*docs.columns)
