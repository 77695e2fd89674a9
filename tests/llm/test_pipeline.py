import collections

import corpus_pipeline
from conftest import prose
from pyspark.sql import functions as F

import __spark_entry__
from locarium.llm import queries, simhash


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_pipeline_stage_by_stage(spark, tmp_path):
    bad = ["grumblefitz", "snortwhistle"]
    rows = []
    for i in range(240):
        text = prose(i, 60) + (f" {bad[i % 2]} {prose(i + 1, 5)}" if i % 6 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(300 + i, rows[i * 7 + 1][1].upper() if i % 2 else rows[i * 7 + 1][1], "en", "s0", 1) for i in range(20)]
    long = prose(9999, 900)
    rows += [(400 + i, long + f" {prose(i, 1)}", "en", "s1", 1) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(any(b in r[1] for b in bad))) for r in rows[:240]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        where = str(tmp_path / name)
        out.write.parquet(where)
        seen[name] = spark.read.parquet(where)
        if name != "packing":
            assert out.columns == df.columns
        docs = seen[name]
    clean = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert all((not any(b in r[1].lower() for b in bad)) == (r[0] in clean) for r in rows)
    groups = collections.defaultdict(list)
    for r in rows:
        if r[0] in clean:
            groups[r[1].lower()].append(r[0])
    unique = {max(g) for g in groups.values()}
    assert {r["doc_id"] for r in seen["exact_dedup"].collect()} == unique
    fps = {r[0]: simhash.fingerprint(r[1]) for r in rows if r[0] in unique}
    near = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert near <= unique and all(any((fps[i] ^ fps[j]).bit_count() <= 4 for j in unique if j < i) for i in unique - near)
    assert not any((fps[i] ^ fps[j]).bit_count() <= 4 for i in near for j in near if i < j)
    words = seen["mixing"].select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words - sum(len(r[1].split()) for r in rows if r[0] in near)) <= 3
    pieces = seen["packing"].collect()
    assert {r["doc_id"] for r in pieces} <= near and sum(r["length"] for r in pieces) >= words
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
