"""Results, status, lookups, ranks and metrics on hand-written rows."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geomatch.operators import lookup, matching, metrics, ranking, status
from geomatch.sources import results

RESULTS = (
    '{"t1.json": {'
    ' "bag_0000000000000003": {"possible_matches": ['
    '   {"index_id": "i1", "confidence": 0.5}, {"index_id": "i2", "confidence": 0.51, "true_label": 1.0},'
    '   {"index_id": "i3", "confidence": 0.51, "true_label": "0", "predicted_label": 0}]},'
    ' "0000000000000001": {"possible_matches": [{"index_id": "i1", "confidence": 0.9, "true_label": 0}]},'
    ' "empty_one": {"possible_matches": []}, "missing_one": {},'
    ' "nodigits": {"possible_matches": [{"confidence": null, "predicted_label": 1}, {"index_id": 7}]}},'
    ' "t0.json": {"0000000000000001": {"possible_matches": ['
    '   {"index_id": "j1", "confidence": 0.2, "true_label": 1}, {"index_id": "j2", "confidence": 0.8}]}}}'
)


@pytest.fixture(scope="module")
def scanned(spark):
    texts = spark.createDataFrame([("r.json", RESULTS)], "doc_path string, document string")
    buildings = results.result_buildings(texts).cache()
    return results.result_pairs(buildings).cache(), buildings.drop("matches")


def test_results_scan(scanned):
    pairs, buildings = scanned
    rows = [tuple(r) for r in buildings.orderBy("file_pos", "bld_pos").collect()]
    assert rows == [
        ("t1.json", 0, "bag_0000000000000003", 0, 3), ("t1.json", 0, "0000000000000001", 1, 1),
        ("t1.json", 0, "empty_one", 2, 0), ("t1.json", 0, "missing_one", 3, 0), ("t1.json", 0, "nodigits", 4, 2),
        ("t0.json", 1, "0000000000000001", 0, 2),
    ]
    got = pairs.where("building_id in ('bag_0000000000000003', 'nodigits')").orderBy("bld_pos", "match_pos")
    assert [(r.index_id, r.confidence, r.true_label, r.predicted_label) for r in got.collect()] == [
        ("i1", 0.5, None, None), ("i2", 0.51, 1, None), ("i3", 0.51, 0, 0), ("", 0.0, None, 1), ("7", 0.0, None, None),
    ]


def test_several_documents_are_ordered_by_path(spark):
    one = '{"f": {"b": {"possible_matches": [{"index_id": "%s"}]}}}'
    texts = spark.createDataFrame([("z", one % "last"), ("a", one % "first")], "doc_path string, document string")
    buildings = results.result_buildings(texts, several=True)
    flat = matching.flatten_pairs(results.result_pairs(buildings), buildings.drop("matches"))
    assert [r.index_id for r in flat.collect()] == ["last"]


def test_last_file_wins(scanned):
    pairs, buildings = scanned
    flat = matching.flatten_pairs(pairs, buildings).where("building_id = '0000000000000001'")
    assert {(r.file_name, r.index_id) for r in flat.collect()} == {("t0.json", "j1"), ("t0.json", "j2")}
    row = matching.flatten_buildings(buildings).where("building_id = '0000000000000001'").first()
    assert (row.file_name, row.first_file_pos, row.first_bld_pos, row.occurrences) == ("t0.json", 0, 1, 2)
    assert tuple(matching.load_totals(buildings).first()) == (8, 6, 7, 5)


def test_status(spark, scanned):
    pairs, buildings = scanned
    features = spark.createDataFrame([("0000000000000003",), ("only_features",)], "building_id string")
    rows = {r.building_id: tuple(r)[1:] for r in status.building_status(features, pairs, buildings).collect()}
    assert rows == {
        "bag_0000000000000003": (False, True, "true_match"),
        "0000000000000003": (True, True, "true_match"),
        "0000000000000001": (False, True, "no_match"),
        "empty_one": (False, True, None),
        "missing_one": (False, True, None),
        "nodigits": (False, True, "no_match"),
        "only_features": (True, False, None),
    }


def test_shared_number_takes_the_later_building_with_a_status(spark):
    buildings = spark.createDataFrame(
        [("f", 0, "a_1234567890", 0, 1), ("f", 0, "b_1234567890", 1, 1), ("f", 0, "c_1234567890", 2, 0)],
        "file_name string, file_pos bigint, building_id string, bld_pos bigint, n_matches bigint",
    )
    pairs = spark.createDataFrame(
        [("f", 0, "a_1234567890", 0, 0, "x", 0.9, 1, None), ("f", 0, "b_1234567890", 1, 0, "x", 0.9, 0, None)],
        "file_name string, file_pos bigint, building_id string, bld_pos bigint, match_pos bigint, index_id string, "
        "confidence double, true_label int, predicted_label int",
    )
    nothing = spark.createDataFrame([], "building_id string")
    got = status.building_status(nothing, pairs, buildings).where("building_id = '1234567890'").first()
    assert got.match_status == "false_positive"


def test_found_status_prefers_the_better_name(spark):
    table = spark.createDataFrame(
        [("bag_1234567890", False, True, "no_match"), ("77", True, False, None), ("1234567891", True, True, None)],
        "building_id string, has_features boolean, has_pairs boolean, match_status string",
    )
    objects = spark.createDataFrame([("1234567890",), ("bag_77",), ("x_1234567891",), ("none",)], "object_id string")
    got = {r.object_id: tuple(r)[1:] for r in status.find_status(objects, table).collect()}
    assert got == {
        "1234567890": (False, True, "no_match"), "bag_77": (True, False, None),
        "x_1234567891": (True, True, None), "none": (None, None, None),
    }


def test_pairs_and_matches_of_requests(spark, scanned):
    pairs, buildings = scanned
    asked = ["x_0000000000000003", "1", "empty_one", "unknown", "bag_0000000000000001"]
    requests = spark.createDataFrame([(a,) for a in asked], "request_id string")
    rows = matching.pairs_of(requests, pairs, buildings).collect()
    by_request = {a: sorted((r for r in rows if r.request_id == a), key=lambda r: (-(r.confidence or 0), r.match_pos or 0)) for a in asked}
    assert [(r.candidate_id, r.index_id, r.prediction) for r in by_request["x_0000000000000003"]] == [
        ("0000000000000003", "i2", 1), ("0000000000000003", "i3", 0), ("0000000000000003", "i1", 0),
    ]
    # "1" is part of the second key only.
    assert [(r.matched_id, r.index_id) for r in by_request["1"]] == [("0000000000000001", "j2"), ("0000000000000001", "j1")]
    # "empty_one" has no digits, so its number is the part after the underscore: contained in its own key.
    assert [(r.matched_id, r.total_pairs, r.index_id) for r in by_request["empty_one"]] == [("empty_one", 0, None)]
    assert [(r.matched_id, r.total_pairs) for r in by_request["unknown"]] == [(None, 0)]
    matches = matching.matches_of(requests, pairs, buildings).collect()
    assert {(r.request_id, r.match_id) for r in matches} == {
        ("x_0000000000000003", "i2"), ("1", "j2"), ("bag_0000000000000001", "j2"),
    }


def reference_lookup(request, keys, exact, contains):
    """Plain loop: exact tiers, then containment in key order."""
    for tier, wanted in enumerate(exact):
        if wanted in keys:
            return wanted, tier
    for i, text in enumerate(contains):
        for key in keys:
            if text and key and (text in key or key in text):
                return key, len(exact) + i
    return None, None


@pytest.mark.parametrize("seed", range(3))
def test_lookups_equal_a_plain_loop(spark, seed, tmp_path):
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("012") for _ in range(n))
    keys = list(dict.fromkeys([rng.choice(["", "bag_", "p.", "q_"]) + digits(rng.choice([0, 1, 2, 4, 10, 16])) for _ in range(60)]))
    asked = list(dict.fromkeys(
        [rng.choice(["", "bag_", "z_"]) + digits(rng.choice([0, 1, 2, 3, 10, 12, 16, 18])) for _ in range(120)]
        + rng.sample(keys, 10) + ["x" * 80 + keys[3], "0" * 16]
    ))
    key_table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, key_pos bigint")
    requests = spark.createDataFrame([(a,) for a in asked], "request_id string")

    def number(text):
        run = "".join(ch if ch.isdigit() else " " for ch in text).split()
        run = next((r for r in run if len(r) >= 10), None)
        return run or text.split("_")[-1]

    for find, tiers in (
        (lookup.feature_lookup, lambda a, n: ([a, n], [n, n.lstrip("0"), n.rjust(16, "0")])),
        (lookup.pair_lookup, lambda a, n: ([n], [n])),
    ):
        got = {r.request_id: (r.key, r.tier) for r in find(requests, key_table).collect()}
        assert got == {a: reference_lookup(a, keys, *tiers(a, number(a))) for a in asked}
        if seed == 0:
            index = lookup.KeyIndex.write(key_table, str(tmp_path / find.__name__), slots=8)
            assert got == {r.request_id: (r.key, r.tier) for r in find(requests, index).collect()}


def test_repeated_keys_count_at_their_first_place(spark):
    keys = spark.createDataFrame([("ab1", 5), ("ab2", 2), ("ab1", 1)], "key string, key_pos bigint")
    requests = spark.createDataFrame([("ab",), ("ab1x",)], "request_id string")
    got = {r.request_id: r.key for r in lookup.pair_lookup(requests, keys).collect()}
    assert got == {"ab": "ab1", "ab1x": "ab1"}


def test_index_of_repeated_null_and_no_keys(spark, tmp_path):
    """Also with places that are decimals, and without broadcasting the texts asked for."""
    rows = "key string, key_pos decimal(20,0), extra int"
    keys = spark.sql("SELECT * FROM VALUES ('ab1', 5, 0), ('ab2', 2, 0), ('ab1', 1, 0), (NULL, 0, 0), ('', 9, 0)")
    index = lookup.KeyIndex.write(keys.toDF("key", "key_pos", "extra").selectExpr("key", "cast(key_pos as decimal(20,0)) key_pos", "extra"), str(tmp_path / "some"), slots=4)
    none = lookup.KeyIndex.write(spark.createDataFrame([], rows), str(tmp_path / "none"), slots=4)
    requests = spark.createDataFrame([("ab",), ("ab1x",), ("zz",), ("",), (None,)], "request_id string")
    found = {"ab": "ab1", "ab1x": "ab1", "zz": None, "": "", None: None}
    assert {r.request_id: r.key for r in lookup.pair_lookup(requests, index).collect()} == found
    assert {r.request_id: r.key for r in lookup.pair_lookup(requests, none).collect()} == dict.fromkeys(found)


def test_many_texts_are_joined_with_an_index_by_a_shuffle(spark, tmp_path, monkeypatch):
    keys = spark.createDataFrame([(f"bag_{i:04}", i) for i in range(50)], "key string, key_pos bigint")
    requests = spark.createDataFrame([(f"x_{i:04}",) for i in range(0, 90, 7)], "request_id string")
    wanted = lookup.pair_lookup(requests, keys).collect()
    monkeypatch.setattr(lookup, "BROADCAST_TEXTS", 0)
    index = lookup.KeyIndex.write(keys, str(tmp_path / "index"), slots=4)
    assert sorted(lookup.pair_lookup(requests, index).collect()) == sorted(wanted)


def test_partial_file_name_before_the_exact_one(spark):
    files = spark.createDataFrame([("tile", 0), ("tile_1.json", 1)], "file_name string, file_pos bigint")
    requests = spark.createDataFrame([("a/b/tile_1.json",), ("other.json",)], "request_id string")
    assert {r.request_id: r.key for r in lookup.file_lookup(requests, files).collect()} == {
        "a/b/tile_1.json": "tile", "other.json": None,
    }
    exact = lookup.file_lookup(requests, files, prefer_exact=True).collect()
    assert {r.request_id: r.key for r in exact}["a/b/tile_1.json"] == "tile_1.json"


OBJECTS = [
    ("B", "B/1", 0, "0518100000000001", False), ("A", "A/2", 0, "x_0518100000000001", True),
    ("A", "A/2", 1, "0518100000000001", False), ("A", "A/1", 3, "tower", False), ("B", "B/1", 1, "NL.0518100000000002", False),
]


def test_object_and_file_lookup(spark):
    objects = spark.createDataFrame(OBJECTS, "source string, file_path string, obj_pos int, object_id string, is_empty boolean")
    asked = spark.createDataFrame(
        [("bag_0518100000000001", "A/2"), ("0518100000000001", "B/1"), ("b_tower", "A/1"), ("nope", "A/1"), ("bag_0518100000000002", "B/1")],
        "request_id string, file_path string",
    )
    got = {(r.request_id, r.file_path): r.object_id for r in lookup.object_lookup(asked, objects).collect()}
    assert got == {
        ("bag_0518100000000001", "A/2"): None,  # the first match in the file is an empty object
        ("0518100000000001", "B/1"): "0518100000000001",
        ("b_tower", "A/1"): "tower",
        ("nope", "A/1"): None,
        ("bag_0518100000000002", "B/1"): "NL.0518100000000002",
    }
    found = {r.request_id: (r.source, r.file_path, r.object_id) for r in lookup.find_file(asked, objects).collect()}
    assert found["bag_0518100000000001"] == ("A", "A/2", "x_0518100000000001")
    assert found["bag_0518100000000002"] == ("B", "B/1", "NL.0518100000000002")
    assert found["nope"] == (None, None, None)


def test_hot_and_small_groups_are_ranked_alike(spark):
    """One group of nearly all rows, many small ones, more tasks than groups: one way for all."""
    rows = [("hot", i % 7, i) for i in range(5000)] + [(f"c{i % 40}", 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(6)
    order = [F.desc("a"), F.asc("b")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    ranked = ranking.rank_in_group(df, ["g"], order, "r")
    assert dict(ranked.dtypes)["r"] == "bigint"
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, plain.collect()))


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for c in range(60):
        ids = rng.sample(range(40), rng.randint(0, 5))
        if rng.random() < 0.8:
            truth[c] = rng.choice(ids) if ids and rng.random() < 0.7 else rng.randrange(40)
        for pos, i in enumerate(ids):
            rows.append((f"f{c % 3}", c % 3, f"c{c}", c, pos, f"i{i}", rng.choice([0.1, 0.5, 0.6, 0.9]), rng.choice([0, 1, None]), None))
    rows += rows[:5]  # repeated pairs count once
    pairs = spark.createDataFrame(
        rows,
        "file_name string, file_pos bigint, building_id string, bld_pos bigint, match_pos bigint, index_id string, "
        "confidence double, true_label int, predicted_label int",
    )
    candidates = spark.createDataFrame([(f"f{c % 3}", f"c{c}") for c in range(60)], "file_name string, building_id string")
    known = spark.createDataFrame([(f"c{c}", f"i{i}") for c, i in truth.items()], "building_id string, index_id string")
    return pairs, candidates, known, list(dict.fromkeys(rows)), truth


def test_metrics_equal_a_plain_count(measured):
    pairs, candidates, known, rows, truth = measured
    got = {r.file_name: r for r in metrics.metrics_from_pairs(pairs, candidates, known).collect()}
    for f in range(3):
        mine = [r for r in rows if r[0] == f"f{f}"]
        is_true = lambda r: truth.get(r[3]) == int(r[5][1:])
        m_index = sum(1 for c in truth if c % 3 == f)
        m_block = len({r[3] for r in mine if is_true(r)})
        above = [r for r in mine if r[6] > 0.5]
        best = {}
        for r in sorted(mine, key=lambda r: (r[3], -r[6], r[4])):
            best.setdefault(r[3], r)
        kept = [r for r in best.values() if r[6] > 0.5]
        for name, chosen in (("threshold", above), ("best_match", kept)):
            tp = sum(map(is_true, chosen))
            row = got[f"f{f}"]
            assert row[f"{name}_true_positives"] == tp
            assert row[f"{name}_false_positives"] == len(chosen) - tp
            assert row[f"{name}_false_negatives_in_blocking"] == m_block - tp
            assert row[f"{name}_false_negatives_not_in_blocking"] == m_index - m_block
            assert row[f"{name}_total_false_negatives"] + tp == m_index
            assert row[f"{name}_precision"] == pytest.approx(tp / len(chosen) if chosen else 0.0)
            assert row[f"{name}_recall_overall"] == pytest.approx(tp / m_index)
        assert (row.candidates_in_file, row.potential_matches_in_index, row.potential_matches_in_blocking) == (20, m_index, m_block)


def test_best_match_equals_the_first_rank(measured):
    pairs, *_ = measured
    by_rank = matching.ranked_pairs(pairs.distinct(), k=1).where("confidence > 0.5").select("building_id", "index_id")
    best = matching.best_match(pairs).select("building_id", "index_id")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, by_rank.collect()))


def test_verdicts(spark):
    rows = [("a", 0.1, 1), ("b", 0.9, 0), ("b", 0.9, 1), ("c", 0.9, 0), ("c", 0.9, None), ("d", 0.9, None)]
    pairs = spark.createDataFrame([(b, c, t, None) for b, c, t in rows], "building_id string, confidence double, true_label int, predicted_label int")
    got = {r.building_id: r.verdict for r in matching.comparison_verdicts(pairs).collect()}
    assert got == {
        "a": "No matches were found in the BKAFI pairs", "b": "True match was found",
        "c": "False positive match was found", "d": "Match predictions found (true labels unknown)",
    }


def test_metrics_file(spark, tmp_path):
    document = {"XGBClassifier": {"file_metrics": {
        "tile": {"candidates_in_file": 4, "threshold_precision": 0.85, "threshold_true_positives": 3.0},
        "tile_1.json": {"candidates_in_file": 9, "potential_matches_in_index": 5, "potential_matches_in_blocking": 2},
    }}}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(document))
    table = results.read_metrics(spark, str(path))
    assert [(r.file_name, r.candidates_in_file, r.threshold_true_positives, r.best_match_f1_score) for r in table.orderBy("file_pos").collect()] == [
        ("tile", 4, 3, 0.0), ("tile_1.json", 9, 0, 0.0),
    ]
    with pytest.raises(ValueError):
        results.read_metrics(spark, str(path), "Other")
    buildings = spark.createDataFrame([("tile_1.json", 11), ("tile", 99)], "file_name string, n_matches bigint")
    requests = spark.createDataFrame([("Source A/tile_1.json",), ("zzz",)], "request_id string")
    first = metrics.file_summary(requests, table, buildings).collect()
    assert [(r.metrics_file, r.total_buildings, r.total_pairs, r.precision) for r in first] == [("tile", 4, 11, 0.85)]
    (exact,) = metrics.file_summary(requests, table, buildings, prefer_exact=True).collect()
    assert (exact.metrics_file, exact.potential_true_matches_not_in_bkafi, exact.potential_true_matches) == ("tile_1.json", 3, 2)
    assert len(metrics.file_summary(requests, table, buildings).columns) == 2 + 33
