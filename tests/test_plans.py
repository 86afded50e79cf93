"""Shapes of physical plans: what must and must not be in them."""

import re
from pathlib import Path

import pytest

from geomatch import storage
from geomatch.operators import extraction, lookup, metrics
from geomatch.plans import adapters, queries
from geomatch.plans.queries import QUERIES
from geomatch.sources import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored_plans(monkeypatch):
    """Plans of the tables that are written while a query is built."""
    found = []
    write = storage.write

    def noted(df, path):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path)

    monkeypatch.setattr(storage, "write", noted)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_no_python_and_no_single_partition(spark, stored_plans, name):
    for text in [plan(spark, name), *stored_plans]:
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"):
            assert word not in text
        # One row for each map task may meet: totals without a key, and scalar subqueries.
        for at in re.finditer("Window", text):
            assert "SinglePartition" not in text[at.start() : at.start() + 400]


def test_a_lookup_cuts_its_keys_once_and_drops_what_nobody_asks_for(spark):
    keys = spark.range(1000).selectExpr("concat('bag_', lpad(cast(id as string), 16, '0')) as key", "id as key_pos")
    keys.write.mode("overwrite").parquet(path := f"{storage.shared_folder(spark)}/keys")
    one = spark.createDataFrame([("bag_0000000000000007",)], "request_id string")
    text = lookup.pair_lookup(one, spark.read.parquet(path))._jdf.queryExecution().sparkPlan().toString()
    # Once to be cut, and once to name the keys that were found.
    assert sum("FileScan" in line and "key_pos" in line for line in text.splitlines()) <= 2
    assert re.search(r"Aggregate.*?LeftSemi", text, re.S)


def test_a_lookup_of_many_texts_combines_parts_of_keys_before_they_are_shuffled(spark, monkeypatch):
    rows = "concat('bag_', lpad(cast(id as string), 16, '0'))"
    keys = spark.range(500).selectExpr(f"{rows} as key", "500 - id as key_pos")
    asked = spark.range(700).selectExpr(f"explode(array({rows}, cast(id as string), concat(cast(id as string), cast(id as string), {rows}))) as request_id")
    asked = asked.union(spark.createDataFrame([(None,), ("",), ("7",)], "request_id string"))
    few = lookup.feature_lookup(asked, keys)
    expected = sorted(map(str, few.collect()))
    monkeypatch.setattr(lookup, "BROADCAST_TEXTS", 10)
    monkeypatch.setattr(lookup, "TASK_KEYS", 60)
    monkeypatch.setattr(lookup, "TASK_TEXTS", 100)
    many = lookup.feature_lookup(asked, keys)
    assert sorted(map(str, many.collect())) == expected
    text = many._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" not in text


def test_texts_asked_for_come_once_without_a_shuffle(spark, stored_plans):
    keys = spark.createDataFrame([("aaa", 1), ("bab", 2)], "key string, key_pos long")
    asked = spark.createDataFrame([("aaaaa",), ("ababab",), (None,)], "request_id string")
    ids = asked.select("request_id")
    wanted, _ = lookup._asked(ids, [lookup.F.col("request_id")], lookup.F.array("request_id", "request_id"), lookup._lengths(keys, "key"))
    rows = [tuple(r) for r in wanted.collect()]
    assert len(rows) == len(set(rows)) and ("aaaaa", 1, "aaa", True) in rows
    assert "hashpartitioning" not in stored_plans[-1]


def test_paths_are_resolved_by_as_many_tasks_as_requests_need(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_REQUESTS", 10)
    asked = spark.createDataFrame([(f"tile_{i}.json", i) for i in range(40)] + [(None, -1), ("tile_1.json", -2)], "request_path string, n int")
    files = spark.createDataFrame([(f"RawCitiesData/The Hague/tile_{i}.json",) for i in range(0, 40, 2)], "path string")
    found = catalog.resolve_paths(asked, files)
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("REPARTITION_BY_NUM") >= 2 or len(re.findall(r"hashpartitioning\(request_path#\d+, 5\)", text)) >= 2
    assert "SortAggregate" not in text
    rows = {r.n: r.path for r in found.collect()}
    assert len(rows) == 42 and rows[-1] is None and rows[-2] is None and rows[1] is None and rows[4] == "RawCitiesData/The Hague/tile_4.json"


def leaves(node):
    """Leaves of an executed plan, also those of the subqueries that prune a scan."""
    found = node.collectLeaves()
    for leaf in (found.apply(i) for i in range(found.size())):
        yield leaf
        below = leaf.subqueries()
        for i in range(below.size()):
            yield from leaves(below.apply(i))


def test_a_lookup_of_one_request_reads_few_files_of_an_index(spark, tmp_path):
    keys = spark.range(500).selectExpr("concat('bag_', lpad(cast(id as string), 16, '0')) as key", "id as key_pos")
    index = lookup.KeyIndex.write(keys, str(tmp_path / "index"), slots=128)
    one = spark.createDataFrame([("bag_0000000000000007",)], "request_id string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lookup.pair_lookup(one, index)
        assert [tuple(r) for r in df.collect()] == [("bag_0000000000000007", "bag_0000000000000007", 1)]
        scans = list(leaves(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    for name in ("texts", "keys"):
        scan = next(s for s in scans if "FileScan" in s.toString() and s.relation().location().rootPaths().head().getName() == name)
        files = len(list((tmp_path / "index" / name).glob("slot=*/*.parquet")))
        assert files > 100
        assert 1 <= scan.metrics().apply("numFiles").value() < 0.05 * files


def test_extraction_parses_requested_documents_only(spark):
    documents = spark.createDataFrame([("A", "a.json", "{}")], "source string, file_path string, document string")
    documents.write.mode("overwrite").parquet(path := f"{storage.shared_folder(spark)}/documents")
    asked = spark.createDataFrame([("x", "a.json")], "request_id string, file_path string")
    text = extraction.extract_objects(asked, spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(ArrayType(StructType(StructField(version") == 1
    # The text is looked at above the join with what is wanted of it.
    assert text.index("from_json") < text.index("Join Inner")


@pytest.mark.parametrize("name", ["object_bbox", "object_height", "footprint", "footprint_stats", "drawable_objects"])
def test_geometry_adds_no_shuffle_to_its_documents(spark, name):
    building = plan(spark, "dequantised_vertices").count("Exchange")
    assert plan(spark, name).count("Exchange") == building


@pytest.mark.parametrize("name", ["object_bbox", "dequantised_vertices", "ring_vertices"])
def test_a_document_is_parsed_once(spark, name):
    text = plan(spark, name)
    # The one parse also tells whether the text is a whole document.
    assert text.count("from_json(ArrayType(StructType(StructField(transform") == 1 and "get_json_object" not in text


def test_scans_read_only_what_they_need(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "potential_matches"))
    assert schemas and all(s.count(":") == 1 for s in schemas)


def test_status_uses_hash_aggregation_for_pairs(spark):
    assert "packed" in plan(spark, "match_status") and "HashAggregate" in plan(spark, "match_status")


def test_top_k_limits_groups_before_the_shuffle(spark):
    text = plan(spark, "topk_pairs")
    assert text.count("WindowGroupLimit") == 2


def test_extraction_renumbers_once_and_alike_in_short_and_long_lists(spark, monkeypatch):
    solid = '{"type":"Solid","boundaries":[[[[3,1,7]],[[1,-2,90]]]]}'
    loose = '{"type":"MultiSurface","boundaries":[[[5,3,"x",null,1.0,2]]]}'
    empty = '{"type":"MultiSurface","boundaries":[]}'
    text = '{"type":"CityJSON","CityObjects":{"a":{"type":"Building","geometry":[%s,%s]},"b":{"geometry":[%s]}},"vertices":[%s]}' % (
        solid, loose, empty, ",".join(f"[{i},0,0]" for i in range(9)),
    )
    documents = spark.createDataFrame([("A", "a.json", text)], "source string, file_path string, document string")
    asked = spark.createDataFrame([("a", "a.json"), ("b", "a.json")], "request_id string, file_path string")
    found = [extraction.extract_objects(asked, documents)]
    # Two depths, each for whole numbers and for other entries.
    assert found[0]._jdf.queryExecution().optimizedPlan().toString().count("array_position(") == 4
    monkeypatch.setattr(extraction, "SCANNED_VERTICES", -1)
    found.append(extraction.extract_objects(asked, documents))
    short, long = [sorted((r.request_id, r.cityjson) for r in f.collect()) for f in found]
    assert short == long and "[[[[2,0,4]],[[0,-2,5]]]]" in short[0][1].replace(" ", "")


def test_an_index_cuts_its_keys_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    keys = spark.range(500).selectExpr("concat('bag_', lpad(cast(id * 7 % 500 as string), 16, '0')) as key", "500 - id as key_pos")
    keys = keys.union(spark.createDataFrame([(None, 900), ("", 901), ("bag_0000000000000003", 902)], "key string, key_pos long"))
    asked = spark.range(600).selectExpr("concat('bag_', lpad(cast(id as string), 16, '0')) as request_id")
    expected = sorted(map(str, lookup.pair_lookup(asked, keys).collect()))
    seen, cuts = [], lookup._cuts
    monkeypatch.setattr(lookup, "TASK_KEYS", 60)
    monkeypatch.setattr(lookup, "_cuts", lambda frame: seen.append(frame._jdf.queryExecution().optimizedPlan().toString()) or cuts(frame))
    index = lookup.KeyIndex.write(keys, str(tmp_path / "index"), slots=8)
    assert re.search(r"RepartitionByExpression \[key#\d+ ASC NULLS FIRST\], 9", seen[0])
    assert sorted(map(str, lookup.pair_lookup(asked, index).collect())) == expected


def test_results_documents_gather_pairs_where_they_lie(spark):
    text = adapters.results_texts(spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" in text
    text = adapters.results_texts(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_name" not in text


def test_refreshed_tables_build_their_documents_once(spark, monkeypatch):
    built = []
    build = adapters.index_documents
    monkeypatch.setattr(adapters, "index_documents", lambda *a: built.append(a) or build(*a))
    queries._refreshed(spark, SF_DIR)
    assert len(built) == 1


@pytest.mark.parametrize("known", [False, True])
def test_metrics_deal_pairs_to_tasks_by_their_number(spark, monkeypatch, known):
    ids = ("concat('tile_', id % 3) as file_name", "cast(id % 400 as string) as building_id", "cast(id % 7 as string) as index_id")
    pairs = spark.range(3000).selectExpr(*ids, "id % 11 / 11.0D as confidence", "id as match_pos", "cast(id % 2 as int) as true_label")
    candidates = pairs.select("file_name", "building_id").unionByName(spark.range(50).selectExpr("'tile_9' as file_name", "cast(id as string) as building_id"))
    truth = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", "1"), ("2", None), (None, "3")], "building_id string, index_id string") if known else None
    usual = sorted(metrics.metrics_from_pairs(pairs, candidates, truth).collect())
    monkeypatch.setattr(metrics, "TASK_ROWS", 100, raising=False)
    found = metrics.metrics_from_pairs(pairs, candidates, truth)
    text = found._jdf.queryExecution().sparkPlan().toString()
    tasks = (3000 + 3050 + 5 * known) // 100 + 1
    for key in ("_slot", "file_name"):
        assert re.search(rf"hashpartitioning\({key}[^\n]*, {tasks}\), REPARTITION_BY_NUM", text)
    assert sorted(found.collect()) == usual


def test_lines_are_dealt_by_their_number_and_join_the_orders_only(spark, monkeypatch, tmp_path):
    lines = spark.createDataFrame([(1, 5, "N"), (1, 3, "N"), (1, None, "N"), (2, 4, "N"), (None, 1, "N"), (3, 2, "N"), *[(9, 7, "N")] * 20], "l_orderkey long, l_partkey long, l_returnflag string")
    lines = lines.selectExpr("*", "1 as l_linenumber", "1 as l_suppkey", "1.0D as l_extendedprice", "1.0D as l_quantity", "null as l_shipdate", "0.5D as l_discount", "0.1D as l_tax", "'O' as l_linestatus")
    lines.withColumn("l_shipdate", lines.l_shipdate.cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, "1-URGENT"), (2, "5-LOW"), (2, "1-URGENT"), (3, None), (None, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(adapters, "LINES_PER_TASK", 1, raising=False)
    pairs = adapters.pairs(spark, str(tmp_path))
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 27\), REPARTITION_BY_NUM", text) and len(re.findall("FileScan", text)) == 3
    got = sorted(((r.bld_pos, r.index_id and int(r.index_id), r.true_label) for r in pairs.collect()), key=str)
    wanted = [(1, 5, 0), (1, 3, 1), (1, None, 0), (2, 4, 0), (2, 4, 1), (None, 1, 0), (3, 2, 0), *[(9, 7, 0)] * 20]
    assert got == sorted(wanted, key=str)


def test_comparison_set_builds_and_parses_its_documents_in_one_pass(spark, stored_plans):
    plan(spark, "comparison_set")
    (parsed,) = [p for p in stored_plans if "CityObjects" in p]
    assert "Generate" in parsed and "parse_json" not in parsed
    # Ids are searched for, and joined again: gathered from the pairs once.
    assert sum("index_id" in p and "Union" in p for p in stored_plans) == 1


def test_parts_of_an_index_are_shuffled_once_by_their_slot(spark, tmp_path, monkeypatch):
    rows = "concat('bag_', lpad(cast(id * 7 % 500 as string), 16, '0'))"
    keys = spark.range(500).selectExpr(f"{rows} as key", "cast(500 - id as decimal(31,0)) as key_pos")
    odd = [("bag_0000000000000003", 902), ("bag_0000000000000003", -5), ("", 903), ("7", None), (None, 1)]
    keys = keys.union(spark.createDataFrame(odd, "key string, key_pos int").selectExpr("key", "cast(key_pos as decimal(31,0))"))
    plans, write = {}, lookup.KeyIndex._write
    monkeypatch.setattr(lookup.KeyIndex, "_write", lambda index, name, table, *more: (plans.update({name: table._jdf.queryExecution().executedPlan().toString()}), write(index, name, table, *more)))
    monkeypatch.setattr(lookup, "TASK_KEYS", 60)
    monkeypatch.setattr(lookup, "DEAL_BITS", 4, raising=False)
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    index = lookup.KeyIndex.write(keys, str(tmp_path / "index"), slots=8)
    # Dealt twice by range as keys, shuffled once as texts.
    assert plans["texts"].count("Exchange hashpartitioning") == 1 and "hashpartitioning(cast(pmod(xxhash64(text" in plans["texts"]
    # The keys are not kept beside the index.
    assert set(folder.iterdir()) == before
    texts = spark.read.parquet(f"{index.path}/texts")
    assert texts.count() == texts.select("text", "whole").distinct().count()
    expected = {}
    for key, pos in keys.where("key IS NOT NULL").collect():
        for text, whole in [(key, True), *((key[i:j], False) for i in range(len(key)) for j in range(i + 1, len(key) + 1))]:
            expected.setdefault((text, whole), []).append(pos)
    assert {(r.text, r.whole): r.key_pos for r in texts.collect()} == {t: min((p for p in ps if p is not None), default=None) for t, ps in expected.items()}


def test_objects_meet_their_requests_where_their_documents_lie(spark):
    text = '{"type":"CityJSON","CityObjects":{%s},"vertices":[]}'
    rows = [
        ("A", "a.json", text % '"bag_0000000000000007":{"type":"Building"},"0000000000000008":{"type":"Road"},"x":{}'),
        ("B", "a.json", text % '"bag_0000000000000007":{"type":"Bridge"},"0000000000000009":{"type":"Bridge"}'),
        ("B", "b.json", text % '"bag_0000000000000007":{"type":"Tunnel"},"0000000000000007":{"type":"Other"},"c_0000000000000007":{"type":"Last"}'),
        ("B", "b.json", text % '"bag_0000000000000008":{"type":"Eight"}'),
        (None, "n.json", text % '"0000000000000007":{"type":"None"}'),
        ("A", None, text % '"0000000000000007":{"type":"None"}'),
    ]
    documents = spark.createDataFrame(rows, "source string, file_path string, document string")
    asked = [(i, p) for i in ("bag_0000000000000007", "0000000000000007", "z_0000000000000007", "0000000000000008", "0000000000000009", "x", "", None) for p in ("a.json", "b.json", "n.json", "o.json", None)]
    asked = spark.createDataFrame(asked * 2, "request_id string, file_path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = extraction.extract_objects(asked, documents)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.request_id, r.file_path, r.object_id, re.search('"type":"(?!CityJSON)([A-Z][a-z]+)"', r.cityjson)[1]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[plan.index("Window") : plan.index("from_json(ArrayType(StructType(StructField(version")]
    assert "Exchange" not in above and "Join" not in above
    first = [("a.json", "bag_0000000000000007", "Building"), ("b.json", "bag_0000000000000007", "Tunnel")]
    eight = [("a.json", "0000000000000008", "Road"), ("b.json", "bag_0000000000000008", "Eight")]
    assert got == sorted((i, *f) for ids, fs in ((("bag_0000000000000007", "0000000000000007", "z_0000000000000007"), first), (("0000000000000008",), eight)) for i in ids for f in fs)


def test_comparison_objects_keeps_no_documents(spark, stored_plans):
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    found = QUERIES["comparison_objects"](spark, SF_DIR)
    # Ids, their places and the texts of their objects.
    assert len(stored_plans) - 1 == len(set(folder.iterdir()) - before) == 3
    assert found.where("cityjson IS NOT NULL").count() > 1000
