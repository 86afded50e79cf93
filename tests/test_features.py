"""Feature scans and pivots on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from geomatch.operators import features as ops
from geomatch.sources import features as sources

PROPERTIES = {
    "area": {"cands": {"b1": 1, "b2": 2.5}},
    "note": "text",
    "broken": {"cands": [1, 2]},
    "other": {"index": {"b9": 1}},
    "profile": {"cands": {"b1": [1.0, 2.0], "b3": {"k": 1}, "b4": None}},
}


@pytest.fixture(scope="module")
def unpivoted(spark):
    texts = spark.createDataFrame([(json.dumps(PROPERTIES),)], "document string")
    return sources.unpivot_properties(texts).cache()


def test_unpivot(unpivoted):
    rows = {(r.feature_name, r.building_id): (r.value, r.value_array, r.value_json) for r in unpivoted.collect()}
    assert rows == {
        ("area", "b1"): (1.0, None, None), ("area", "b2"): (2.5, None, None),
        ("profile", "b1"): (None, [1.0, 2.0], None), ("profile", "b3"): (None, None, '{"k":1}'),
        ("profile", "b4"): (None, None, "null"),
    }


def test_buildings_of_the_first_feature(unpivoted):
    kept = ops.first_feature_buildings(unpivoted).select("building_id").distinct().collect()
    assert {r.building_id for r in kept} == {"b1", "b2"}


def test_parquet_round_trip_and_last_value(spark, tmp_path):
    rows = [("b1", "x", 1.0, None), ("b2", "x", 3.0, None), ("b1", "x", 2.0, None), ("b1", "a", None, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "building_id string, feature_name string, value double, value_array array<double>")
    table.coalesce(1).write.parquet(str(tmp_path / "f"))
    features = sources.read_features(spark, str(tmp_path / "f"))
    latest = {(r.building_id, r.feature_name): r.value for r in ops.latest_features(features).collect()}
    assert latest == {("b1", "x"): 2.0, ("b2", "x"): 3.0, ("b1", "a"): None}
    wide = {r.building_id: r.x for r in ops.feature_pivot(features, ["x"]).collect()}
    assert wide == {"b1": 2.0, "b2": 3.0}
    maps = {r.building_id: (r.features, r.n_features) for r in ops.feature_maps(features).collect()}
    assert maps["b1"] == ({"a": (None, [1.0, 2.0], None), "x": (2.0, None, None)}, 2)
    listing = [(r.feature_no, r.feature_name, r.shown) for r in ops.feature_listing(features).where("building_id = 'b1'").collect()]
    assert sorted(listing) == [(1, "a", "[2 items]"), (2, "x", "2.0000")]
    keys = [r.key for r in ops.feature_keys(features).orderBy("key_pos").collect()]
    assert keys == ["b1", "b2"]
    sources.write_features(features.withColumn("pos", F.col("pos.row")), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4


def test_repeated_ids_order_and_all_kinds_survive_the_round_trip(spark, tmp_path):
    text = '{"f":{"cands":{"b9":1,"b2":"t","b9":2,"b1":true,"b3":["x"],"b4":{"k":1,"k":2}}},"g":{"cands":{"b7":[1,null]}}}'
    rows = sources.unpivot_properties(spark.createDataFrame([(text,)], "document string"))
    sources.write_features(rows, str(tmp_path / "f"))
    back = sources.read_features(spark, str(tmp_path / "f"))
    found = [(r.building_id, r.value, r.value_array, r.value_json) for r in back.orderBy("pos").collect()]
    assert found == [
        ("b9", 2.0, None, None), ("b2", None, None, '"t"'), ("b1", None, None, "true"), ("b3", None, None, '["x"]'),
        ("b4", None, None, '"{\\"k\\":1,\\"k\\":2}"'), ("b7", None, [1.0, None], None),
    ]
    assert [r.key for r in ops.feature_keys(back).orderBy("key_pos").collect()] == ["b9", "b2", "b1", "b3", "b4", "b7"]


def test_conversion(spark, tmp_path):
    source = tmp_path / "p.json"
    source.write_text(json.dumps(PROPERTIES))
    sources.convert_properties(spark, str(source), str(tmp_path / "out"))
    assert sources.read_features(spark, str(tmp_path / "out")).count() == 5
    source.write_text('{"note": "text"}')
    with pytest.raises(ValueError):
        sources.convert_properties(spark, str(source), str(tmp_path / "none"))
