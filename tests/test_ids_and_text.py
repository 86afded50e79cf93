"""Column functions against plain Python."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from geomatch.functions import crs, display, ids, labels
from geomatch.functions.objects import dict_entries
from geomatch.sources.catalog import decode_path

IDS = [
    "bag_0518100000271783", "0518100000271783", "NL.IMBAG.Pand.0518100000239978", "a_b_17", "_", "x_", "17", "",
    "bag_", "Customer#000000001", "123456789", "1234567890x12345678901", "bag_bag_1", "00000000000000000017",
]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression.alias("r")).collect()]


def python_number(text, raw=False):
    found = re.search(r"(\d{10,})", text)
    if found:
        return found.group(1)
    return text if raw else (text.split("_")[-1] if "_" in text else text)


def test_numeric_ids(spark):
    assert column(spark, IDS, ids.numeric_id(F.col("v"))) == [python_number(t) for t in IDS]
    assert column(spark, IDS, ids.numeric_id(F.col("v"), "raw")) == [python_number(t, True) for t in IDS]
    with pytest.raises(ValueError):
        ids.numeric_id(F.col("v"), "other")


def test_prefixes_and_padding(spark):
    assert column(spark, IDS, ids.strip_prefix(F.col("v"))) == [re.sub("^[^_]*_", "", t) for t in IDS]
    assert column(spark, IDS, ids.padding_variants(F.col("v"))) == [[t, t.lstrip("0"), t.rjust(16, "0")] for t in IDS]
    toggled = [t[4:] if t.startswith("bag_") else "bag_" + t for t in IDS]
    assert column(spark, IDS, ids.toggle_prefix(F.col("v"))) == toggled


def test_aliases(spark):
    own = column(spark, ["bag_0518100000271783", "0518100000271783", "x"], ids.own_aliases(F.col("v")))
    assert own == [["bag_0518100000271783", "0518100000271783"], ["0518100000271783"], ["x"]]
    shown = column(spark, ["bag_0518100000271783", "17"], ids.display_aliases(F.col("v")))
    assert [[tuple(a) for a in row] for row in shown] == [
        [("bag_0518100000271783", 0), ("0518100000271783", 1), ("0518100000271783", 2)],
        [("17", 0), ("bag_17", 2)],
    ]


def test_predicted_label_is_strictly_above_the_threshold(spark):
    rows = [(None, 0.49), (None, 0.5), (None, 0.51), (0, 0.9), (1, 0.1), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, given int, confidence double")
    got = df.orderBy("i").select(labels.predicted_label(F.col("given"), F.col("confidence"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 0, 1, 0]
    lower = df.orderBy("i").select(labels.predicted_label(F.col("given"), F.col("confidence"), 0.4)).collect()
    assert [r[0] for r in lower] == [1, 1, 1, 0, 1, 0]


def test_labels_arrive_in_many_spellings(spark):
    assert column(spark, ["1", "1.0", "0", "0.0", "true", "False", "x", None], labels.label(F.col("v"))) == [
        1, 1, 0, 0, 1, 0, None, None,
    ]


def test_fixed_decimals_round_the_exact_value(spark):
    values = [0.03125, -0.03125, 12.35, 0.00005, 1.00005, 2.5, -0.00001, 1234567.5, 0.0, 1e-9, 0.1 + 0.2]
    for digits in (0, 1, 2, 4):
        unit = Decimal(1).scaleb(-digits)
        wanted = [f"{Decimal(v).quantize(unit, ROUND_HALF_UP):f}" for v in values]
        got = column(spark, values, display.to_fixed(F.col("v"), digits), "double")
        assert [g.lstrip("-") for g in got] == [w.lstrip("-") for w in wanted]
        assert all(g.startswith("-") == (math.copysign(1, v) < 0) for g, v in zip(got, values) if v)
    assert column(spark, [float("nan")], display.to_fixed(F.col("v"), 2), "double") == ["NaN"]
    assert column(spark, [0.875, None], display.percent(F.col("v")), "double") == ["87.5%", "0.0%"]
    assert column(spark, [3 * 1024 * 1024], display.megabytes(F.col("v")), "bigint") == ["3.00 MB"]


def test_feature_text(spark):
    df = spark.createDataFrame([(1.5, None), (None, [1.0, 2.0]), (None, None)], "v double, a array<double>")
    got = df.select(display.feature_text(F.col("v"), F.col("a"), F.lit("{}"))).collect()
    assert [r[0] for r in got] == ["1.5000", "[2 items]", "{}"]


def test_badges_and_colours(spark):
    rows = [(1, 1), (1, 0), (0, 0), (1, None), (0, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p int, t int").orderBy("i")
    got = df.select(
        labels.correctness(F.col("p"), F.col("t")), labels.prediction_text(F.col("p")), labels.label_text(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Correct", "Match", "Match"), ("Incorrect", "Match", "No Match"), ("Correct", "No Match", "No Match"),
        ("", "Match", "Unknown"), ("Incorrect", "No Match", "Match"),
    ]
    states = [(False, False, None), (True, False, None), (True, True, None), (True, True, "true_match"),
              (False, True, "false_positive"), (False, True, "no_match"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(states)], "i int, f boolean, p boolean, m string").orderBy("i")
    got = df.select(*[labels.stage_colour(s, F.col("f"), F.col("p"), F.col("m")) for s in (1, 2, 3)]).collect()
    assert [tuple(r) for r in got] == [
        ("blue", "blue", "blue"), ("orange", "orange", "orange"), ("orange", "yellow", "yellow"),
        ("orange", "yellow", "green"), ("blue", "yellow", "red"), ("blue", "yellow", "darkgray"), ("blue", "blue", "blue"),
    ]
    assert [tuple(c) for c in column(spark, ["Road", "Tree", None], labels.object_type_rgb(F.col("v")))] == [
        (153, 153, 153), (136, 136, 136), (136, 136, 136),
    ]


CRS = ["EPSG:4326", "urn:ogc:def:crs:EPSG::7415", "https://www.opengis.net/def/crs/EPSG/0/7415", "EPSG:28992", None]


def test_epsg_codes(spark):
    assert column(spark, CRS, crs.epsg_code(F.col("v"))) == ["4326", "7415", "0", "28992", None]
    assert column(spark, CRS, crs.epsg_code(F.col("v"), "last")) == ["4326", "7415", "7415", "28992", None]


def test_lonlat(spark):
    approximate = (4.3007 + 1000.0 / 111320.0, 52.0705 + 2000.0 / 111320.0)
    got = column(spark, CRS, crs.to_lonlat(F.lit(1000.0), F.lit(2000.0), F.col("v")))
    assert [tuple(p) for p in got] == [(1000.0, 2000.0)] + [approximate] * 4
    # The base point of the national grid.
    got = column(spark, CRS[1:4], crs.to_lonlat(F.lit(155000.0), F.lit(463000.0), F.col("v"), "rd_polynomial"))
    for point in got:
        assert point["lon"] == pytest.approx(5.38720621) and point["lat"] == pytest.approx(52.15517440)
    (mercator,) = column(spark, ["EPSG:3857"], crs.to_lonlat(F.lit(20037508.342789244), F.lit(0.0), F.col("v")))
    assert mercator["lon"] == pytest.approx(180.0) and mercator["lat"] == pytest.approx(0.0, abs=1e-9)


def test_percent_decoding(spark):
    values = ["a%20b+c", "100%", "x%zz%41", "plain"]
    assert column(spark, values, decode_path(F.col("v"))) == ["a b+c", "100%", "x%zzA", "plain"]


def test_repeated_keys_keep_the_first_place_and_the_last_value(spark):
    texts = ['{"b":1,"a":2,"b":3,"c":4,"a":5}', '{"z":1,"y":2}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.from_json("t", "map<string, int>").alias("m")
    )
    rows = df.select("t", F.explode(dict_entries(F.col("m"))).alias("e")).select("t", "e.*").collect()
    by_text = {t: [(r.key, r.value) for r in sorted(rows, key=lambda r: r.pos) if r.t == t] for t in texts}
    assert by_text == {
        texts[0]: [("b", 3), ("a", 5), ("c", 4)], texts[1]: [("z", 1), ("y", 2)], texts[2]: [],
    }
