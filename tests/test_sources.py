import pytest

from locarium.operators.validation import Field, check_points
from locarium.sources import layers, readers


def test_layer_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    fields = [Field("id", "bigint", True), Field("name", "string", False)]
    path = str(tmp_path / "layer")
    mark = layers.write_layer(df, path, fields, "id")
    assert layers.fingerprint(df.orderBy("name")) == mark and layers.read_layer(spark, path, fields, "id").count() == 2
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        layers.read_layer(spark, path, fields, "id")
    with pytest.raises(ValueError, match="missing"):
        layers.write_layer(df, path, [fields[0], Field("name", "string", True)], "id")
    layers.write_missing(spark, str(tmp_path / "none"), "no source")
    with pytest.raises(layers.LayerMissing):
        layers.read_layer(spark, str(tmp_path / "none"), fields)


def test_csv_lists_every_bad_row(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("name,lat,lon,source_url,date_retrieved\na,-1.95,30.06,u,2024\n")
    assert readers.read_points(spark, str(good)).first()["charger_id"].startswith("csv-")
    bad = tmp_path / "bad.csv"
    bad.write_text("name,lat,lon,source_url,date_retrieved\na,x,30,u,d\nb,95,30,,d\n")
    with pytest.raises(ValueError, match="no coordinates.*off the globe, no source"):
        readers.read_points(spark, str(bad))


def test_points_are_checked(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 99.0, 0.0)], "id long, x double, y double")
    assert {r["problem"]: r["examples"] for r in check_points(df, (0, 0, 9, 9), "id").collect()} == {"missing": [2], "not finite": [3], "outside": [4]}


def test_entry_registers_core_queries():
    import __spark_entry__

    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "c04_scores" in known and set(sql) <= set(known)
