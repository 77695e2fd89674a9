import pytest
from pyspark.sql import functions as F

from locarium.functions import display, tags, text
from locarium.operators import answers, retrieval
from locarium.storage import stored


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_tokens_numbers_and_slugs(spark):
    assert one(spark, text.tokens(F.col("t")), t="Été dist_road_m x") == ["été", "dist_road_m", "dist", "road", "m", "x"]
    assert one(spark, text.number_tokens(F.col("t")), t="1,234.5 and 7.") == ["1,234.5", "7"]
    assert one(spark, text.signed_number_tokens(F.col("t")), t="Top-30 at -1.5 and 40% of cand-0123456789ab") == ["30", "-1.5", "40%"]
    assert one(spark, text.slug(F.col("t")), t=" A  b/C! ") == "a-b-c"


def test_displays_round_half_even_on_the_exact_value(spark):
    assert one(spark, display.one_decimal(F.col("v")), v=0.35) == "0.3"
    assert one(spark, display.people(F.col("v")), v=131688.25) == "131,688"
    assert one(spark, display.distance(F.col("v")), v=999.4) == "999 m" and one(spark, display.distance(F.col("v")), v=1000.0) == "1.0 km"
    assert one(spark, display.kilometres(F.col("v")), v=2500) == "2.5 km" and one(spark, display.kilometres(F.col("v")), v=10000) == "10 km"


def test_selectors(spark):
    m = F.create_map(F.lit("shop"), F.col("v"), F.lit("socket:type2"), F.lit("1"))
    for selector, want in (("shop=mall", True), ("shop=*", True), ("shop=x", False), ("socket:*", True), ("fuel=*", False)):
        assert one(spark, tags.selects(m, selector), v="mall") is want
    with pytest.raises(ValueError):
        tags.selects(m, "nonsense")


def test_bm25_by_hand_and_bounds(spark):
    chunks = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d")], "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "b b d")], "query_id long, text string")
    index = retrieval.build_index(chunks)
    got = retrieval.rank(index, queries).orderBy("nth").collect()
    import math

    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = {1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), 3: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 2))}
    assert {r["chunk_id"]: round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    for bad in (0, 11, True, 2.0):
        with pytest.raises(ValueError):
            retrieval.search(index, queries, bad)


def test_best_of_each_query_without_all_of_them(spark):
    """A cut ranking has the rows and totals of the whole one; ties go by chunk id, a query without matches has none."""
    chunks = spark.createDataFrame([(i, "common " + "rare " * (i % 3 == 0) + f"w{i % 7}") for i in range(200)], "chunk_id long, text string").repartition(5)
    queries = spark.createDataFrame([(0, "common"), (1, "rare w3"), (2, "nothing"), (3, "w1")], "query_id long, text string")
    index = retrieval.build_index(chunks)
    key = lambda r: (r["query_id"], r["nth"], r["chunk_id"], r["score"], r["total"], tuple(r["matched_terms"]))
    whole = sorted(map(key, retrieval.rank(index, queries).collect()))
    for most in (1, 4, 500):
        assert sorted(map(key, retrieval.rank(index, queries, most=most).collect())) == [r for r in whole if r[1] <= most]
    assert [r[2] for r in whole if r[0] == 0][:3] != [] and {r[0]: r[4] for r in whole}.get(0) == 200 and 2 not in {r[0] for r in whole}
    even = retrieval.search(index, queries.where("query_id < 2"), 3, F.col("chunk_id") % 2 == 0, chunks).collect()
    by = {q: [r for r in whole if r[0] == q and r[2] % 2 == 0] for q in (0, 1)}
    assert sorted((r["query_id"], r["nth"], r["chunk_id"], r["total"]) for r in even) == [(q, i + 1, r[2], len(by[q])) for q in by for i, r in enumerate(by[q][:3])]


def test_matches_of_a_query_never_become_rows(spark, monkeypatch):
    """A cut ranking writes terms and the best of each group, never a row per query and match; groups and blocks change no result."""
    chunks = spark.createDataFrame([(i, f"common word w{i % 5} x{i % 3}") for i in range(400)], "chunk_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(q, f"common word w{q % 5}") for q in range(30)], "query_id long, text string").coalesce(1)
    gold = spark.createDataFrame([(0, 399), (0, 398), (1, 1)], "query_id long, chunk_id long").coalesce(1)
    sizes: list[int] = []

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "stored", counted)
    monkeypatch.setattr(retrieval, "GROUP", 600)
    monkeypatch.setattr(retrieval, "ASKED", 60)
    got = sorted((r["query_id"], r["nth"], r["chunk_id"], r["total"]) for r in retrieval.rank(retrieval.build_index(chunks), queries, most=3, of=gold).collect())
    assert max(sizes) < 1000  # there are 12,000 matches
    # a query's own word tells, ties go by id; the first of query 0's pairs stands behind the 80 chunks with w0 and those before it without
    first = [(q, i + 1, q % 5 + 5 * i, 400) for q in range(30) for i in range(3)]
    assert got == sorted([*first, (0, 80 + sum(1 for i in range(399) if i % 5), 398, 400)])


def test_chunks_of_one_id_are_one_chunk(spark):
    """Rows that repeat an id count once in df and give their chunk each of their lengths; rows without an id count as one."""
    chunks = spark.createDataFrame([(1, "a b"), (1, "a c c"), (2, "a"), (None, "a d"), (None, "d")], "chunk_id long, text string")
    index = retrieval.build_index(chunks)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"a": 3, "b": 1, "c": 1, "d": 1} == {r["term"]: r["df"] for r in retrieval.index_terms(chunks).collect()}
    got = {r["chunk_id"]: r["score"] for r in retrieval.rank(index, spark.createDataFrame([(0, "a")], "query_id long, text string")).collect()}
    import math

    idf, norm = math.log(1 + (5 - 3 + 0.5) / 3.5), lambda n: 1.2 * (0.25 + 0.75 * n / 1.8)
    assert got == {1: round(sum(idf * 2 * 2.2 / (2 + norm(n)) for n in (2, 3)), 9), 2: round(idf * 2.2 / (1 + norm(1)), 9)}


def test_sections_outside_fences(spark):
    doc = "# T\nintro\n## A\none\n\ntwo\n```\n# no\n\nx\n```\n### B\n- i\n- j"
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    got = retrieval.sections(docs).orderBy("start").collect()
    assert [(r["level"], r["title"], r["path"]) for r in got] == [(1, "T", ["T"]), (2, "A", ["T", "A"]), (3, "B", ["T", "A", "B"])]


def test_answer_rules(spark):
    records = spark.createDataFrame([("r1", "CALCULATED", "12.5 km", False), ("r2", "UNKNOWN", "none", False), ("k1", "FACT", "the score  is a rank of 30 sites", True)], "id string, type string, display string, knowledge boolean")
    rows = [
        ("ok", "CALCULATED", "It is 12.5 km away.", ["r1"], []),
        ("bad", "CALCULATED", "It is 13 km away, about right.", ["r1", "zz"], []),
        ("abs", "UNKNOWN", "Nothing.", ["r2"], []),
        ("fact", "FACT", "Land is available.", ["r2"], []),
        ("quote", "FACT", "As said.", ["k1"], ["score is a", "no such words"]),
        ("nul", None, None, None, None),
    ]
    got = {r["statement_id"]: set(r["rules"]) for r in answers.check(spark.createDataFrame(rows, "statement_id string, kind string, text string, evidence_ids array<string>, quotes array<string>"), records).collect()}
    assert got["ok"] == set()
    assert got["bad"] == {"unknown_evidence_id", "number_not_grounded", "approximation_language"}
    assert got["abs"] == {"unknown_must_state_absence"}
    assert got["fact"] == {"unknown_stated_as_fact", "land_available_claim"}
    assert got["quote"] == {"quote_not_in_cited_chunk"}
    assert got["nul"] == {"missing_citation"}


def test_gold_of_short_and_long_queries(spark):
    chunks = spark.createDataFrame([(1, "one red house on the hill by the old sea wall here"), (2, "redhouse hillside"), (3, "a red, house"), (4, "red"), (5, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "ed house on the hill by the old sea wa"), (2, "red house"), (3, "red"), (4, "he hill b"), (5, "..."), (6, "house")], "query_id long, text string")
    assert sorted(tuple(r) for r in retrieval.holding(asked, chunks).collect()) == [(1, 1), (2, 1), (2, 3), (3, 1), (3, 3), (3, 4), (4, 1), (6, 1), (6, 3)]
