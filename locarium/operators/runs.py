"""Runs of tools: records inside their results, numbers that nobody may state, and what a run must have done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.text import signed_number_tokens
from locarium.storage import stored


def harvest(results: DataFrame, key: str, json: str, shapes: dict[str, tuple[str, ...]]) -> DataFrame:
    """``key, shape, id, value`` of every object inside a JSON column whose fields are exactly those of a shape; ``value`` is its JSON.

    All results are opened one level at a time, whatever they nest, until
    nothing is left to open. What has a shape isn't opened further. Of objects
    of one shape that share an ``id`` within a key the last one counts, in the
    order of lists and, within objects, of field names. Null and malformed JSON
    holds nothing.
    """
    level = stored(results.select(key, F.col(json).alias("value"), F.array().cast("array<int>").alias("path")).where(F.try_parse_json("value").isNotNull()).withColumn("node", F.monotonically_increasing_id()))
    found: list[DataFrame] = []
    while not level.isEmpty():
        opened = stored(_opened(level, key))
        fields = opened.where("field is not null").groupBy("node").agg(F.array_sort(F.collect_set("field")).alias("fields"))
        shape = F.coalesce(*[F.when(F.col("fields") == F.array(*map(F.lit, sorted(f))), F.lit(name)) for name, f in shapes.items()])
        whole = stored(fields.withColumn("shape", shape).where("shape is not null").select("node", "shape"))
        found.append(level.join(whole, "node").select(key, "shape", F.get_json_object("value", "$.id").alias("id"), "path", "value"))
        left = opened.join(whole, "node", "left_anti").where(F.col("child").rlike(r"^[\[{]"))
        level = stored(left.select(key, F.col("child").alias("value"), F.concat("path", F.array("pos")).alias("path")).withColumn("node", F.monotonically_increasing_id()))
    if not found:
        return level.select(key, F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("id"), "value")
    return reduce(DataFrame.unionByName, found).groupBy(key, "shape", "id").agg(F.max_by("value", "path").alias("value"))


def _opened(level: DataFrame, key: str) -> DataFrame:
    """``node, key, path, pos, field, child``: the elements of each row's array or object, fields null for an array's; children as JSON."""
    variant = level.select("node", key, "path", F.parse_json("value").alias("__v"))
    inner = variant.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("__v").outer()).toDF("pos", "field", "child"))
    return inner.select("node", key, "path", F.col("pos").cast("int").alias("pos"), "field", F.to_json("child").alias("child"))


#: How a derived number may be written.
FORMS = ((0, True), (0, False), (1, True), (1, False), (2, True), (2, False))


def _written(value: Column, percent: bool) -> list[Column]:
    """The number and its amount in all forms."""
    out = []
    for digits, grouped in FORMS:
        for v in (value, F.abs(value)):
            text = F.format_number(v, digits)
            out.append(F.concat(text if grouped else F.replace(text, F.lit(","), F.lit("")), F.lit("%" if percent else "")))
    return out


def trap_values(statements: DataFrame, records: DataFrame) -> DataFrame:
    """``statement_id, token, kind, a, b``: numbers of a statement that only arithmetic over its cited records gives.

    For any two cited records ``(id, field, value)`` of the same field: their
    difference, what percent of the second that is, and the mean of all cited
    values of the field (``a`` and ``b`` null), each in six forms with and
    without sign. A statement cites a bounded number of records; the derived
    numbers meet its own by equality. Null values derive nothing, and nothing is
    a percentage of 0.
    """
    ids = statements.select("statement_id", F.explode(F.array_distinct("evidence_ids")).alias("id"))
    cited = stored(ids.join(records.where("value is not null"), "id").select("statement_id", "id", "field", F.col("value").cast("double").alias("value")))
    other = cited.select("statement_id", "field", F.col("id").alias("b"), F.col("value").alias("w"))
    two = cited.join(other, ["statement_id", "field"]).where("id <> b")
    by = F.col("value") - F.col("w")
    forms = [(F.lit("difference"), _written(by, False)), (F.lit("percent"), _written(F.when(F.col("w") != 0, 100 * by / F.col("w")), True))]
    pairs = reduce(DataFrame.unionByName, [two.select("statement_id", kind.alias("kind"), F.col("id").alias("a"), "b", F.explode(F.array_distinct(F.array_compact(F.array(*w)))).alias("token")) for kind, w in forms])
    mean = cited.groupBy("statement_id", "field").agg(F.avg("value").alias("m"), F.count("*").alias("n")).where("n > 1")
    none = F.lit(None).cast(records.schema["id"].dataType)
    means = mean.select("statement_id", F.lit("mean").alias("kind"), none.alias("a"), none.alias("b"), F.explode(F.array_distinct(F.array(*_written(F.col("m"), False)))).alias("token"))
    said = statements.select("statement_id", F.explode(F.array_distinct(signed_number_tokens(F.col("text")))).alias("token"))
    return said.join(pairs.unionByName(means), ["statement_id", "token"]).select("statement_id", "token", "kind", "a", "b").distinct()


def trajectories(calls: DataFrame, run: str, order: str) -> DataFrame:
    """``run, trajectory, counters``: a run's calls in order, repeated and failed ones marked, and how many there are of each mark.

    ``calls`` has ``tool``, ``repeated`` and ``failed``. A run has a bounded number of calls.
    """
    mark = F.concat("tool", F.when(F.coalesce("repeated", F.lit(False)), ":duplicate").when(F.coalesce("failed", F.lit(False)), ":error").otherwise(""))
    marked = calls.select(run, F.col(order).alias("at"), mark.alias("mark"))
    counts = marked.groupBy(run, "mark").agg(F.count("*").alias("n")).groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("counters"))
    paths = marked.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mark"))), lambda x: x["mark"]).alias("trajectory"))
    return paths.join(counts, run)


def in_order(trajectory: Column, wanted: Column) -> Column:
    """Whether ``wanted`` occurs within ``trajectory`` in this order, with anything between."""
    return F.aggregate(trajectory, F.lit(0), lambda k, m: F.when(m == F.get(wanted, k), k + 1).otherwise(k)) >= F.size(wanted)


def check_cases(found: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """``run, failures``: how each run differs from what is expected of it; an empty array means not at all.

    ``found`` has ``status``, ``rules``, ``cited``, ``texts`` and the columns of
    :func:`trajectories`. ``expected`` asks with any of ``status``, ``rules``
    (exactly these), ``trajectory`` (exactly), ``steps`` (in this order),
    ``never`` (marks that may not occur), ``counts`` (a map), ``cites``,
    ``contains`` and ``excludes`` (whatever the case); a null asks for nothing.
    A run that isn't there fails as 'no run'.
    """
    j = expected.alias("e").join(found.withColumn("__there", F.lit(True)).alias("f"), run, "left")
    none = F.array().cast("array<string>")
    e, f = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"f.{c}"))
    some = lambda c: F.coalesce(c, none)
    low = F.lower(F.array_join(some(f("texts")), " "))
    wrong = {
        "status": ~e("status").eqNullSafe(f("status")),
        "rules": F.array_sort(some(e("rules"))) != F.array_sort(some(f("rules"))),
        "trajectory": ~e("trajectory").eqNullSafe(some(f("trajectory"))),
        "steps": ~in_order(some(f("trajectory")), e("steps")),
        "never": F.arrays_overlap(e("never"), some(f("trajectory"))),
        "counts": F.exists(F.map_entries(e("counts")), lambda x: x["value"] != F.coalesce(F.try_element_at(f("counters"), x["key"]), F.lit(0))),
        "cites": F.size(F.array_except(e("cites"), some(f("cited")))) > 0,
        "contains": F.exists(e("contains"), lambda p: ~F.contains(low, F.lower(p))),
        "excludes": F.exists(e("excludes"), lambda p: F.contains(low, F.lower(p))),
    }
    there = F.col("__there").isNotNull()
    asked = [F.when(there & e(c).isNotNull() & w, F.lit(c)) for c, w in wrong.items() if c in expected.columns]
    return j.select(run, F.array_compact(F.array(F.when(~there, F.lit("no run")), *asked)).alias("failures"))
