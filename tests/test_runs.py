import json

from pyspark.sql import functions as F

from locarium.operators import answers, runs


def test_harvest_at_any_depth(spark):
    rec = lambda i, v: {"id": i, "type": "FACT", "display": v}
    one = {"a": [[rec("r1", "x")], {"b": {"c": [rec("r2", "y"), rec("r1", "z")]}}], "n": None, "s": "{}", "near": {"id": "r3", "type": "FACT"}}
    rows = [(1, json.dumps(one)), (2, json.dumps(rec("r9", "top"))), (3, "not json"), (4, None), (5, "[]"), (6, "3"), (7, json.dumps([{"id": "c", "relation": "equal"}, {"wrap": rec("r1", {"deep": rec("no", 1)})}]))]
    df = spark.createDataFrame(rows, "k int, said string").repartition(3)
    got = runs.harvest(df, "k", "said", {"record": ("id", "type", "display"), "comparison": ("id", "relation")}).collect()
    assert sorted((r["k"], r["shape"], r["id"]) for r in got) == [(1, "record", "r1"), (1, "record", "r2"), (2, "record", "r9"), (7, "comparison", "c"), (7, "record", "r1")]
    assert {r["id"]: json.loads(r["value"])["display"] for r in got if r["k"] == 1} == {"r1": "z", "r2": "y"}
    assert runs.harvest(df.limit(0), "k", "said", {"record": ("id",)}).count() == 0


def test_numbers_that_only_arithmetic_gives(spark):
    records = spark.createDataFrame([("a", "score", 80.0), ("b", "score", 60.5), ("c", "pop", 1500.0), ("d", "pop", 0.0), ("e", "pop", None)], "id string, field string, value double")
    rows = [(1, "It is 19.5 higher, 32% more.", ["a", "b"]), (2, "On average 70.25, or 750.", ["a", "b", "c", "d"]), (3, "It differs by 1,500 people.", ["c", "d", "e"]), (4, "80 and 60.5, 19.4.", ["a", "b"]), (5, "19.5", ["a"]), (6, "-19.5 lower, -24.4%", ["a", "b"])]
    st = spark.createDataFrame(rows, "statement_id int, text string, evidence_ids array<string>")
    got = {(r["statement_id"], r["token"], r["kind"]) for r in runs.trap_values(st, records).collect()}
    assert got == {(1, "19.5", "difference"), (1, "32%", "percent"), (2, "70.25", "mean"), (2, "750", "mean"), (3, "1,500", "difference"), (6, "-19.5", "difference"), (6, "-24.4%", "percent")}


def test_cases_against_trajectories(spark):
    calls = [(1, 1, "find", False, False), (1, 2, "get", None, None), (1, 3, "get", True, False), (2, 1, "find", False, True), (2, 2, "compare", False, False)]
    t = runs.trajectories(spark.createDataFrame(calls, "run int, n int, tool string, repeated boolean, failed boolean"), "run", "n")
    assert {r["run"]: r["trajectory"] for r in t.collect()} == {1: ["find", "get", "get:duplicate"], 2: ["find:error", "compare"]}
    found = t.withColumns({"status": F.lit("answered"), "rules": F.array(F.lit("b"), F.lit("a")), "cited": F.array(F.lit("r1")), "texts": F.array(F.lit("The Score is 5."))})
    want = [
        (1, "answered", ["a", "b"], ["find", "get", "get:duplicate"], ["find", "get:duplicate"], ["compare"], {"get": 1}, ["r1"], ["score IS"], ["seven"]),
        (2, "fallback", ["a"], ["find"], ["compare", "find:error"], ["compare"], {"get": 1}, ["r1", "r2"], ["seven"], ["5."]),
        (3, None, None, None, None, None, None, None, None, None),
    ]
    exp = spark.createDataFrame(want, "run int, status string, rules array<string>, trajectory array<string>, steps array<string>, never array<string>, counts map<string,int>, cites array<string>, contains array<string>, excludes array<string>")
    got = {r["run"]: r["failures"] for r in runs.check_cases(found, exp, "run").collect()}
    assert got == {1: [], 2: ["status", "rules", "trajectory", "steps", "never", "counts", "cites", "contains", "excludes"], 3: ["no run"]}


def test_structured_numbers_must_be_cited_as_such(spark):
    rec = spark.createDataFrame([("k", "FACT", "within 12 km and 7 km", True), ("s", "CALCULATED", "12 km", False)], "id string, type string, display string, knowledge boolean")
    st = spark.createDataFrame([(1, "FACT", "It is 12 km.", ["k"], []), (2, "FACT", "It is 7 km.", ["k"], []), (3, "FACT", "It is 12 km.", ["s"], []), (4, "FACT", "It is 12 km.", ["k", "s"], [])], "statement_id int, kind string, text string, evidence_ids array<string>, quotes array<string>")
    got = {r["statement_id"] for r in answers.check(st, rec).collect() if "number_must_cite_structured_record" in r["rules"]}
    assert got == {1}
