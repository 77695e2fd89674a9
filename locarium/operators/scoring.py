"""Percentile points, component scores, ranks and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium import settings as S
from locarium.storage import stored


def no_nan(c: Column) -> Column:
    """A missing value is null: not-a-number becomes null."""
    return F.when(~F.isnan(c), c)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` written in ranges of ``order``; ``part`` numbers them, so that each is ordered by a task of its own."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def mid_rank(df: DataFrame, columns: list[str], prefix: str = "pct_") -> DataFrame:
    """Add for each column the mid-rank percentile ``100 (below + equal/2) / n`` among its present values.

    Null stays null. A constant column and a single row give 50. All columns
    are ranked together: values (as doubles) are counted, dealt into ranges of
    column and value, and summed within their range; what lies in earlier
    ranges of a column is a table of one row per column and range.
    """
    row = _unused(df, "row_id")
    base = stored(df.withColumn(row, F.monotonically_increasing_id()))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(columns)])).alias("x")
    long = base.select(F.col(row).alias("row"), cells).select("row", "x.c", "x.v").where("v is not null")
    counts = in_ranges(long.groupBy("c", "v").agg(F.count("*").alias("n")), F.col("c"), F.col("v"))
    sums = counts.groupBy("c", "part").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("c")
    earlier = sums.select("c", "part", F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("n").over(of).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("within", within).join(earlier, ["c", "part"])
    pct = 100.0 * ((F.col("earlier") + F.col("within")) + 0.5 * F.col("n")) / F.col("total")
    wide = long.join(ranks.select("c", "v", pct.alias("pct")), ["c", "v"]).groupBy("row").agg(*[F.max(F.when(F.col("c") == i, F.col("pct"))).alias(f"p{i}") for i in range(len(columns))])
    out = base.join(wide.withColumnRenamed("row", row), row, "left")
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"p{i}").alias(prefix + n) for i, n in enumerate(columns)])


def feature_points(features: DataFrame, lower_is_better: tuple[str, ...] = S.LOWER_IS_BETTER) -> DataFrame:
    """``pct_*`` of every weighted feature: percentile, turned round where lower is better; a missing feature earns 0.

    The logarithm of skewed counts keeps their order and changes no percentile.
    """
    names = [f for group in S.COMPONENTS.values() for f in group]
    ranked = mid_rank(features, names)
    turned = {f"pct_{n}": F.coalesce(100.0 - F.col(f"pct_{n}") if n in lower_is_better else F.col(f"pct_{n}"), F.lit(0.0)) for n in names}
    return ranked.withColumns(turned)


def _lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], *([F.lit(default)] if default is not None else []))


def components(points: DataFrame, weights: dict[str, dict[str, float]] = S.COMPONENTS, cap: float = 100.0) -> DataFrame:
    """``component_*``: weighted points and bonuses, at most ``cap``."""
    out = points.withColumns({"host_bonus": _lookup(F.col("host_type"), S.HOST_BONUS, 0).cast("long"), "road_bonus": _lookup(F.col("road_class"), S.ROAD_BONUS, 0).cast("long")})
    bonus = {"host_commercial": F.col("host_bonus"), "access": F.col("road_bonus")}
    for name, group in weights.items():
        total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"pct_{f}") for f, w in group.items()])
        out = out.withColumn(f"component_{name}", F.least(F.lit(cap), total + bonus.get(name, F.lit(0))))
    return out


def grid_evidence_missing(radius: float) -> Column:
    """Neither a substation nor a line within ``radius`` (inclusive); unknown distances count as far."""
    return ~F.coalesce((F.col("dist_substation_m") <= radius) | (F.col("dist_line_m") <= radius), F.lit(False))


def profile(town: float, centre: float) -> Column:
    """urban within ``centre`` of the capital or ``town`` of a town (inclusive), else corridor."""
    near = (F.col("dist_centre_m") <= centre) | (F.col("dist_town_m") <= town)
    return F.when(F.coalesce(near, F.lit(False)), "urban").otherwise("corridor")


def confidence(cfg: S.Settings) -> tuple[Column, Column]:
    """``(level, reasons)``: Low without grid evidence, else by how many of three factors hold."""
    missing = grid_evidence_missing(cfg.grid_missing_m)
    factors = [
        (F.coalesce(F.col("grid_completeness_ratio") < cfg.sparse_below, F.lit(False)), "District with sparse map coverage"),
        (F.col("host_type") == "none", "No identified host"),
        (F.coalesce(F.col("poi_3km") <= cfg.remote_pois, F.lit(False)), "Remote location"),
    ]
    n = reduce(lambda a, b: a + b, [f.cast("int") for f, _ in factors])
    level = F.when(missing, "Low").otherwise(F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low"))), F.least(n, F.lit(2)) + 1))
    said = F.concat_ws("; ", F.when(missing, "Grid evidence missing"), *[F.when(f, text) for f, text in factors])
    return level, F.when(said == "", "No lowering factor").otherwise(said)


def score(features: DataFrame, cfg: S.Settings, weights: dict[str, dict[str, float]] = S.COMPONENTS, profiles: dict[str, dict[str, float]] = S.PROFILES) -> DataFrame:
    """Scores, ranks and confidence of every candidate.

    Rank is by score descending, then id. The grid component is 0 and its
    status UNKNOWN where evidence is missing.
    """
    out = components(feature_points(features), weights)
    missing = grid_evidence_missing(cfg.grid_missing_m)
    out = out.withColumns(
        {"component_grid_evidence": F.when(missing, 0.0).otherwise(F.col("component_grid_evidence")), "grid_evidence_status": F.when(missing, "UNKNOWN").otherwise("CALCULATED"), "profile": profile(cfg.town_m, cfg.centre_m)}
    )
    of = {p: reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"component_{c}") for c, w in t.items()]) for p, t in profiles.items()}
    level, reasons = confidence(cfg)
    out = out.withColumns({"score": F.when(F.col("profile") == "urban", of["urban"]).otherwise(of["corridor"]), "confidence": level, "confidence_reasons": reasons, "universal_unknowns": F.lit("; ".join(S.UNKNOWNS))})
    return ranked(out)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``nth`` 1..n in a total ``order``: counted within ranges, after what earlier ranges hold."""
    placed = in_ranges(df, *order)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row a range
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("within", within).join(earlier, "part").withColumn("nth", (F.col("earlier") + F.col("within")).cast("long")).select(*df.columns, "nth")


def ranked(df: DataFrame, by: str = "score", key: str = "candidate_id") -> DataFrame:
    """Add ``rank`` 1..n by ``by`` rounded to 9 digits, descending, then ``key``."""
    return numbered(df, F.round(by, 9).desc(), F.col(key).asc()).withColumnRenamed("nth", "rank")


def bounds(scores: DataFrame) -> DataFrame:
    """``figure, breaches``: rows in which a score, component or percentile is missing or leaves 0..100, and repeated or lacking ranks."""
    names = [c for c in scores.columns if c == "score" or c.startswith(("component_", "pct_"))]
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(-1e-9, 100 + 1e-9)).alias(f"b{i}") for i, c in enumerate(names)]
    ranks = (F.greatest(F.count("*"), F.max("rank")) - F.count_distinct("rank")).cast("long").alias("ranks")
    row = scores.agg(*bad, ranks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(f"b{i}").alias("breaches")) for i, c in enumerate(names)], F.struct(F.lit("rank").alias("figure"), F.col("ranks").alias("breaches")))).alias("r")).select("r.*")


def check_scores(scores: DataFrame) -> list[str]:
    """Every breach of the scores' bounds, as text; empty if they hold."""
    names = [c for c in scores.columns if c == "score" or c.startswith(("component_", "pct_"))]
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(-1e-9, 100 + 1e-9)).alias(c) for c in names]
    row = scores.agg(*bad, F.count("*").alias("__n"), F.count_distinct("rank").alias("__ranks"), F.max("rank").alias("__last"), F.count_if(~F.col("confidence").isin("High", "Medium", "Low")).alias("__level")).first()
    out = [f"{c} leaves 0..100 in {row[c]} rows" for c in names if row[c]]
    if row["__n"] and not row["__n"] == row["__ranks"] == row["__last"]:
        out.append("ranks are not 1..n")
    if row["__level"]:
        out.append("unknown confidence level")
    return out
