"""Checks of tables against declared columns, all problems at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A declared column: its Spark type by name, and whether null is a problem."""

    name: str
    kind: str
    required: bool
    about: str = ""


def check_table(df: DataFrame, fields: list[Field], key: str | None = None) -> DataFrame:
    """``column, problem, n``: undeclared, absent and mistyped columns, nulls in required ones, repeated keys.

    One aggregate serves all checks of values. No rows means no problem.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f for f in fields}
    found = [(n, "no such column", 1) for n in wanted if n not in have]
    found += [(n, "not declared", 1) for n in have if n not in wanted]
    found += [(n, f"type {f.kind} wanted", 1) for n, f in wanted.items() if n in have and have[n] != f.kind]
    aggs = {(n, "missing"): F.count_if(F.col(n).isNull()) for n, f in wanted.items() if f.required and n in have}
    if key in have:
        aggs[(key, "repeated")] = F.count(key) - F.count_distinct(key)
    if aggs:
        row = df.agg(*[c.alias(str(i)) for i, c in enumerate(aggs.values())]).first()
        found += [(n, what, row[i]) for i, (n, what) in enumerate(aggs) if row[i]]
    return df.sparkSession.createDataFrame(found, "column string, problem string, n long")


def require(df: DataFrame, fields: list[Field], key: str | None = None) -> DataFrame:
    """``df`` with its columns in declared order; an error lists every problem."""
    if problems := check_table(df, fields, key).collect():
        raise ValueError("; ".join(f"{r['column']}: {r['problem']} ({r['n']})" for r in problems))
    return df.select(*[f.name for f in fields])


def row_problems(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, problems`` of every row that breaks a rule; no row is dropped or mended. A null test holds for no row."""
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return df.select(key, broken.alias("problems")).where(F.size("problems") > 0)


def check_points(df: DataFrame, box: tuple[float, float, float, float], key: str, examples: int = 5) -> DataFrame:
    """``problem, n, examples`` of points ``x, y``: missing, not finite, outside ``box``; the smallest keys as examples."""
    x, y = F.col("x"), F.col("y")
    missing = x.isNull() | y.isNull()
    odd = F.isnan("x") | F.isnan("y") | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    outside = ~(x.between(box[0], box[2]) & y.between(box[1], box[3]))
    kind = F.when(missing, "missing").when(odd, "not finite").when(outside, "outside")
    rows = df.select(key, kind.alias("problem")).where("problem is not null")
    nth = F.row_number().over(Window.partitionBy("problem").orderBy(key))
    return rows.withColumn("__nth", nth).groupBy("problem").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__nth") <= examples, F.col(key)))).alias("examples"))


def feature_bounds(features: DataFrame, ids: DataFrame, pairs: tuple[tuple[str, str], ...], numeric: tuple[str, ...], shares: tuple[str, ...] = (), absent: tuple[str, ...] = ()) -> DataFrame:
    """``rule, breaches``: how many rows break each bound of a feature table.

    Its ids are those of ``ids`` (both ways); figures aren't negative or
    infinite; of each pair of radii the small one's figure isn't larger;
    shares are at most 1; ``absent`` columns are null or 0. Null breaks nothing.
    """
    bad = {f"{c} negative or infinite": (F.col(c) < 0) | (F.abs(F.col(c)) == float("inf")) for c in numeric}
    bad |= {f"{a} exceeds {b}": F.col(a) > F.col(b) for a, b in pairs}
    bad |= {f"{c} exceeds 1": F.col(c) > 1 for c in shares}
    bad |= {f"{c} present": F.coalesce(F.col(c), F.lit(0)) != 0 for c in absent}
    row = features.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"b{i}") for i, c in enumerate(bad.values())])
    rules = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"b{i}").alias("breaches")) for i, name in enumerate(bad)])).alias("r")).select("r.*")
    a, b = features.select("candidate_id"), ids.select("candidate_id")
    differ = a.join(b, "candidate_id", "left_anti").unionByName(b.join(a, "candidate_id", "left_anti"))
    return rules.unionByName(differ.agg(F.lit("ids differ").alias("rule"), F.count("*").alias("breaches")))


def promoted(geometry: Column, kind: Column) -> Column:
    """A polygon's rings as a multipolygon of one; a multipolygon stays. ``geometry`` is ``array<array<array<...>>>`` of rings, or of polygons."""
    return F.when(kind == "Polygon", F.array(F.get(geometry, F.lit(0)))).otherwise(geometry)
