"""Backtests, resampling, stability and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locarium import settings as S
from locarium.operators import scoring
from locarium.storage import stored


def at_k(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``k, hits, precision, recall`` of ``ranked(rank, hit)``: precision divides by k, recall is null without any hit."""
    spark = ranked.sparkSession
    total = ranked.agg(F.sum(F.col("hit").cast("long")).alias("total"))
    grid = spark.createDataFrame([(k,) for k in ks], "k int")
    counts = ranked.where(F.col("rank") <= max(ks)).join(F.broadcast(grid), F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum(F.col("hit").cast("long")).alias("hits"))
    return grid.join(counts, "k", "left").join(total, F.lit(True)).select("k", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.nullif("total", F.lit(0).cast("long"))).alias("recall"))


def _top_k(drawn: DataFrame, by: list[Column], keys: list[str], ks: tuple[int, ...]) -> DataFrame:
    """``keys, k, precision`` of the first ``k`` rows of each draw; Spark keeps the first of each before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    first = drawn.withColumn("nth", nth).where(F.col("nth") <= max(ks))
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return first.select(*keys, "hit", "nth", grid).where("nth <= k").groupBy(*keys, "k").agg((F.count_if("hit") / F.first("k")).alias("precision"))


def _interval(precision: DataFrame, *keys: str, mean: bool = False) -> DataFrame:
    low, high = (F.round(F.percentile("precision", F.lit(p)), 9) for p in (0.025, 0.975))
    return precision.groupBy(*keys).agg(*([F.round(F.avg("precision"), 9).alias("mean")] if mean else []), low.alias("low"), high.alias("high"))


def _spread(df: DataFrame, runs: DataFrame) -> DataFrame:
    """``df`` once for each run (``run`` as text), over all cores: a small table becomes a large one here."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism).crossJoin(F.broadcast(runs))


def _runs(spark: SparkSession, runs: int) -> DataFrame:
    return spark.range(runs).select(F.col("id").cast("string").alias("run"))


def _lacking(found: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """The runs with fewer than ``least`` rows in ``found``."""
    return runs.join(found.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least), "run", "left_anti")


def random_baseline(ranked: DataFrame, ks: tuple[int, ...], seed: int = 20260924, runs: int = 1000, near: int | None = None) -> DataFrame:
    """``k, mean, low, high`` of precision over seeded random orders of the candidates; 2.5 and 97.5 percentiles.

    Run r orders the candidates by the MD5 of seed, run and id, so that every
    engine draws alike and no task needs more than its rows. Only digests that
    begin so low that some ``near`` (8 max k) of a run are expected are ordered; a run that
    has fewer than max k of them is ordered whole.
    """
    rows = stored(ranked.select("candidate_id", "hit"))
    n = rows.count()
    key = F.md5(F.concat(F.lit(f"{seed}:"), "run", F.lit(":"), F.col("candidate_id").cast("string")).cast("binary"))
    begin = format(min(2**32 * (near or 8 * max(ks)) // max(n, 1), 2**32 - 1), "08x")
    keyed = lambda some: _spread(rows, some).withColumn("key", key)
    every = _runs(rows.sparkSession, runs)
    low = stored(keyed(every).where(F.col("key") < begin))
    short = stored(_lacking(low, every, min(max(ks), n)))
    if not short.isEmpty():
        low = low.join(short, "run", "left_anti").unionByName(keyed(short))
    return _interval(_top_k(low, [F.col("key"), F.col("candidate_id")], ["run"], ks), "k", mean=True)


def bootstrap(table: DataFrame, methods: tuple[str, ...], ks: tuple[int, ...], seed: int = 20260924, runs: int = 1000, near: int | None = None) -> DataFrame:
    """``method, k, low, high``: percentile intervals of precision over resamples, the same draw for every method, and of the first two methods' difference.

    ``table`` has ``candidate_id, hit`` and a score per method. Each run draws
    as many candidates as there are, with replacement, by the MD5 of seed, run
    and place; a draw is ranked again by score, ties by id, then by place. As
    many draws fall on the ``near`` (8 max k) best candidates of a method, on
    the average, so that only those are kept; a run with fewer than max k of
    them is drawn whole.
    """
    spark = table.sparkSession
    numbered = stored(scoring.numbered(table.select("candidate_id", "hit", *methods), F.col("candidate_id").asc()))
    n = numbered.count()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), "run", F.lit(":"), F.col("place").cast("string")).cast("binary"))
    every, places = _runs(spark, runs), numbered.select(F.col("nth").alias("place"))
    drawn = lambda some: _spread(places, some).withColumn("nth", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(max(n, 1)) + 1)
    best = {m: stored(numbered.select("nth", F.col(m).alias("by"), "candidate_id", "hit").orderBy(F.col("by").desc_nulls_last(), "candidate_id").limit(near or 8 * max(ks))) for m in methods}
    some = None
    for b in best.values():
        some = b.select("nth") if some is None else some.unionByName(b.select("nth"))
    picked = stored(drawn(every).join(F.broadcast(some.distinct()), "nth"))
    each = None
    for m in methods:
        held = picked.join(F.broadcast(best[m]), "nth").select("run", "place", "by", "candidate_id", "hit")
        short = stored(_lacking(held, every, min(max(ks), n)))
        if not short.isEmpty():
            whole = drawn(short).join(numbered.select("nth", F.col(m).alias("by"), "candidate_id", "hit").hint("shuffle_hash"), "nth")
            held = held.join(short, "run", "left_anti").unionByName(whole.select(*held.columns))
        one = _top_k(held, [F.col("by").desc_nulls_last(), F.col("candidate_id"), F.col("place")], ["run"], ks).withColumn("method", F.lit(m))
        each = one if each is None else each.unionByName(one)
    each = stored(each)
    if len(methods) > 1:
        a, b = (each.where(F.col("method") == m).select("run", "k", F.col("precision").alias(x)) for m, x in zip(methods, "ab", strict=False))
        each = each.unionByName(a.join(b, ["run", "k"]).select("run", "k", (F.col("a") - F.col("b")).alias("precision"), F.lit("difference").alias("method")))
    return _interval(each, "method", "k")


def variants(step: float = 0.2) -> list[tuple[str, dict[str, dict[str, float]], dict[str, dict[str, float]]]]:
    """Every weight once lower and once higher by ``step``, its group renormalised: ``(name, components, profiles)``."""
    out = []
    for kind, table in (("component", S.COMPONENTS), ("profile", S.PROFILES)):
        for group, weights in table.items():
            for name in weights:
                for sign in (1 - step, 1 + step):
                    changed = {k: v * (sign if k == name else 1) for k, v in weights.items()}
                    total = sum(changed.values())
                    new = table | {group: {k: v / total for k, v in changed.items()}}
                    out.append((f"{kind}.{group}.{name}*{sign:g}", new if kind == "component" else S.COMPONENTS, new if kind == "profile" else S.PROFILES))
    return out


def stability(points: DataFrame, cfg: S.Settings, n: int, step: float = 0.2) -> DataFrame:
    """``variant, overlap``: share of the base's top ``n`` that each changed weight leaves there.

    ``points`` has percentile points; weights alone change, so one table
    serves all variants, each a weighted sum and a top-n.
    """
    base = stored(points)
    w = Window.partitionBy("variant").orderBy(F.round("score", 9).desc(), "candidate_id")
    rows = []
    for name, comps, profiles in [("base", S.COMPONENTS, S.PROFILES), *variants(step)]:
        rows.append((name, *[float(v) for table in (comps, profiles) for group in table.values() for v in group.values()]))
    weights = [_weight(group, name) for table in (S.COMPONENTS, S.PROFILES) for group, of in table.items() for name in of]
    # one expression over a table of weights, a row a variant: as many expressions as variants are too large to be compiled
    table = points.sparkSession.createDataFrame(rows, "variant string, " + ", ".join(f"{c} double" for c in weights))
    long = base.crossJoin(F.broadcast(table)).select("candidate_id", "variant", _score_column(cfg).alias("score"))
    top = stored(long.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("variant", "candidate_id"))
    stay = top.where("variant <> 'base'").join(top.where("variant = 'base'").select("candidate_id"), "candidate_id", "left_semi")
    return stay.groupBy("variant").agg((F.count("*") / F.lit(n)).alias("overlap"))


def _weight(group: str, name: str) -> str:
    """The column of a weight in a table of variants."""
    return f"w_{group}_{name}"


def _score_column(cfg: S.Settings) -> Column:
    bonus = {"host_commercial": F.col("host_bonus"), "access": F.col("road_bonus")}
    missing = scoring.grid_evidence_missing(cfg.grid_missing_m)
    part = {}
    for name, group in S.COMPONENTS.items():
        total = F.lit(0.0)
        for f in group:
            total = total + F.col(_weight(name, f)) * F.col(f"pct_{f}")
        part[name] = F.least(F.lit(100.0), total + bonus.get(name, F.lit(0)))
    part["grid_evidence"] = F.when(missing, 0.0).otherwise(part["grid_evidence"])
    of = {}
    for p, weights in S.PROFILES.items():
        total = F.lit(0.0)
        for c in weights:
            total = total + F.col(_weight(p, c)) * part[c]
        of[p] = total
    return F.when(scoring.profile(cfg.town_m, cfg.centre_m) == "urban", of["urban"]).otherwise(of["corridor"])


def data_quality(df: DataFrame, key: str, lat: str = "y", lon: str = "x") -> DataFrame:
    """``check, n``: nulls of every column, repeated ids and repeated places (at 6 digits), as rows beyond the first."""
    place = F.struct(F.round(lat, 6), F.round(lon, 6))
    wanted = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in df.columns]
    row = df.agg(*wanted, (F.count("*") - F.count_distinct(key)).alias("repeated ids"), (F.count("*") - F.count_distinct(place)).alias("repeated places"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").cast("long").alias("n")) for c in row.columns])).alias("r")).select("r.*")
