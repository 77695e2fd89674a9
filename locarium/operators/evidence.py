"""Evidence records, comparisons and the facts that briefs rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions import display
from locarium.functions.text import number_tokens

#: Numeric fields of a site: ``name: (unit, display)``.
NUMERIC = {
    "score": (None, display.one_decimal),
    "rank": (None, display.people),
    "component_demand": (None, display.one_decimal),
    "component_access": (None, display.one_decimal),
    "component_host_commercial": (None, display.one_decimal),
    "component_charging_gap": (None, display.one_decimal),
    "component_grid_evidence": (None, display.one_decimal),
    "pop_1km": ("people", display.people),
    "pop_5km": ("people", display.people),
    "pop_10km": ("people", display.people),
    "poi_1km": (None, display.people),
    "poi_3km": (None, display.people),
    "chargers_10km": (None, display.people),
    "chargers_25km": (None, display.people),
    "dist_road_m": ("m", display.distance),
    "dist_trunk_m": ("m", display.distance),
    "dist_charger_m": ("m", display.distance),
    "dist_substation_m": ("m", display.distance),
    "dist_line_m": ("m", display.distance),
    "dist_town_m": ("m", display.distance),
    "grid_completeness_ratio": (None, display.ratio),
    "host_bonus": (None, display.people),
    "road_bonus": (None, display.people),
}
CATEGORICAL = ("host_type", "profile", "confidence", "road_class", "grid_evidence_status")


def _numbers() -> list[Column]:
    out = []
    for name, (unit, shown) in NUMERIC.items():
        value = F.col(name).cast("double")
        out.append(F.struct(F.lit(name).alias("metric"), F.lit("numeric").alias("kind"), value.alias("value_d"), F.lit(None).cast("string").alias("value_s"), F.lit(unit).cast("string").alias("unit"), shown(value).alias("display")))
    return out


def _texts() -> list[Column]:
    return [F.struct(F.lit(n).alias("metric"), F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("value_d"), F.col(n).cast("string").alias("value_s"), F.lit(None).cast("string").alias("unit"), F.coalesce(F.col(n).cast("string"), F.lit("unknown")).alias("display")) for n in CATEGORICAL]


def site_records(sites: DataFrame) -> DataFrame:
    """``id, candidate_id, type, metric, kind, value_d, value_s, unit, display``: one record per site and field.

    Not-a-number is null, and a missing value's type is UNKNOWN.
    """
    rows = sites.select("candidate_id", F.explode(F.array(*_numbers(), *_texts())).alias("r")).select("candidate_id", "r.*")
    value = F.when(~F.isnan("value_d"), F.col("value_d"))
    missing = value.isNull() & F.col("value_s").isNull()
    return rows.select(F.concat_ws("/", F.lit("site"), "candidate_id", "metric").alias("id"), "candidate_id", F.when(missing, "UNKNOWN").otherwise("CALCULATED").alias("type"), "metric", "kind", value.alias("value_d"), "value_s", "unit", "display")


def compare_sites(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, metric, a_display, b_display, relation`` for each pair ``(a, b)``; a pair of a site with itself is an error.

    The relation is neutral: which stored value is greater, or whether texts
    agree; null where a value is missing.
    """
    if not pairs.where("a = b").isEmpty():
        raise ValueError("a site can't be compared with itself")
    cols = ("metric", "kind", "value_d", "value_s", "display")
    left = records.select(F.col("candidate_id").alias("a"), *[F.col(c).alias(f"a_{c}" if c not in ("metric", "kind") else c) for c in cols])
    right = records.select(F.col("candidate_id").alias("b"), "metric", *[F.col(c).alias(f"b_{c}") for c in cols[2:]])
    both = pairs.join(left, "a").join(right, ["b", "metric"])
    number = F.when(F.col("a_value_d") == F.col("b_value_d"), "equal").when(F.col("a_value_d") > F.col("b_value_d"), "a_greater").when(F.col("a_value_d") < F.col("b_value_d"), "b_greater")
    text = F.when(F.col("a_value_s") == F.col("b_value_s"), "same").when(F.col("a_value_s") != F.col("b_value_s"), "different")
    return both.select("a", "b", "metric", "a_display", "b_display", F.when(F.col("kind") == "numeric", number).otherwise(text).alias("relation"))


def find_sites(sites: DataFrame, **equal: object) -> DataFrame:
    """Sites whose columns equal the given values, by rank; an unknown column is an error, None asks for nothing."""
    if unknown := set(equal) - set(sites.columns):
        raise ValueError(f"no such field: {sorted(unknown)}")
    out = sites
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out.orderBy("rank")


def brief_actions(sites: DataFrame, near: float, sparse_below: float) -> DataFrame:
    """``candidate_id, risks``: what to check on site, chosen by four facts, in a fixed order."""
    risk = [
        F.when(F.col("grid_evidence_status") == "UNKNOWN", "confirm the grid connection"),
        F.when(F.coalesce(F.col("grid_completeness_ratio") < sparse_below, F.lit(False)), "survey the district's network"),
        F.when(F.col("host_type") == "none", "find a host"),
        F.when(F.coalesce(F.col("dist_charger_m") <= near, F.lit(False)), "weigh the charger nearby"),
    ]
    return sites.select("candidate_id", F.array_compact(F.array(*risk)).alias("risks"))


def explain(sites: DataFrame, profiles: dict[str, dict[str, float]]) -> DataFrame:
    """``candidate_id, component, value, weight, points``: the stored parts of a score; nothing is scored anew."""
    rows = []
    for name in profiles["urban"]:
        weight = F.when(F.col("profile") == "urban", F.lit(profiles["urban"][name])).otherwise(F.lit(profiles["corridor"][name]))
        rows.append(F.struct(F.lit(name).alias("component"), F.col(f"component_{name}").alias("value"), weight.alias("weight")))
    out = sites.select("candidate_id", F.explode(F.array(*rows)).alias("r")).select("candidate_id", "r.*")
    return out.withColumn("points", F.col("value") * F.col("weight"))


def grounding(statements: DataFrame, records: DataFrame) -> DataFrame:
    """``statement_id, numbers, grounded``: how many of a statement's numbers some cited record shows.

    ``statements`` has ``statement_id, text, cited`` (record ids). Repeated
    numbers count each time.
    """
    shown = statements.select("statement_id", F.explode_outer("cited").alias("id")).join(records.select("id", "display"), "id").groupBy("statement_id").agg(F.array_distinct(F.flatten(F.collect_list(number_tokens(F.col("display"))))).alias("shown"))
    rows = statements.join(shown, "statement_id", "left").withColumn("said", number_tokens(F.col("text")))
    none = F.array().cast("array<string>")
    return rows.select("statement_id", F.size("said").cast("long").alias("numbers"), F.size(F.filter("said", lambda t: F.array_contains(F.coalesce("shown", none), t))).cast("long").alias("grounded"))
