"""A results document read in fragments by many tasks, against the same document as one text."""

import json
import random
from pathlib import Path

import pytest

from geomatch import storage
from geomatch.plans import adapters
from geomatch.sources import large, results


def rows_of(frame):
    key = lambda r: (r.file_pos, r.bld_pos, r.building_id)
    return [(r.file_name, r.file_pos, r.building_id, r.bld_pos, r.n_matches, r.matches) for r in sorted(frame.collect(), key=key)]


def same(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows_of(large.result_buildings(spark, path))
        tasks = large._fragments(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows_of(results.result_buildings(results.read_texts(spark, path)))
    return tasks, got


def document(rng, n_files, n_buildings):
    odd = ['a"b', "c}d", "e{f", "g\\", "h\\\"}", "[i]", ",j", "é}", ""]
    match = lambda: {"index_id": rng.choice(odd) + str(rng.randrange(99)), "confidence": rng.choice([0.5, "0.7", None]), "true_label": rng.choice([1, "0.0", None])}
    building = lambda: {"possible_matches": [match() for _ in range(rng.randrange(4))]} if rng.random() < 0.8 else rng.choice([{}, None])
    return {rng.choice(odd) + f"tile_{f}": {rng.choice(odd) + f"bag_{b}": building() for b in range(rng.randrange(n_buildings))} for f in range(n_files)}


@pytest.mark.parametrize("indent", [None, 2, "\t"])
@pytest.mark.parametrize("split", [150, 1000, 10_000_000])
def test_same_rows_as_one_text(spark, tmp_path, indent, split):
    path = tmp_path / "results.json"
    path.write_text(json.dumps(document(random.Random(split), 12, 15), indent=indent, ensure_ascii=False) + ("\n" if indent else ""), encoding="utf-8")
    tasks, rows = same(spark, str(path), split)
    assert len(rows) > 20 and (tasks > 8 or split > 1000)


def test_repeated_keys_keep_the_first_place_and_the_last_value(spark, tmp_path):
    one = lambda i: '{"possible_matches":[{"index_id":"%s"}]}' % i
    text = '{"a":{"x":%s,"y":%s,"x":%s},"b":{"z":%s},"c":{},"a":{"w":%s,"v":%s,"w":%s}}' % tuple(one(i) for i in "1234567")
    (tmp_path / "r.json").write_text(text)
    _, rows = same(spark, str(tmp_path / "r.json"), 30)
    assert [r[:4] for r in rows] == [("a", 0, "w", 0), ("a", 0, "v", 1), ("b", 1, "z", 0)]


@pytest.mark.parametrize("text", ["{}", '{"a":{}}', '{"a":null,"b":{"x":{"possible_matches":[]}}}', ' { "a" : { "x" : null } , "b":{} } \n'])
def test_small_documents(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    same(spark, str(tmp_path / "r.json"), 3)


def test_parts_are_one_document(spark, tmp_path):
    whole = json.dumps(document(random.Random(7), 9, 12))
    (tmp_path / "whole.json").write_text(whole)
    rows = spark.createDataFrame(list(enumerate(whole[:-1].split("}"))), "n long, text string")
    large.write_fragments(rows.repartitionByRange(5, "n").sortWithinPartitions("n"), str(tmp_path / "parts"))
    assert rows_of(large.result_buildings(spark, str(tmp_path / "parts"))) == rows_of(results.result_buildings(results.read_texts(spark, str(tmp_path / "whole.json"))))


def test_each_text_is_read_once(spark, tmp_path, monkeypatch):
    """Neither its state is found by two searches nor is it parsed for a filter and again for the rows."""
    found = []
    write = storage.write
    monkeypatch.setattr(storage, "write", lambda df, path: (found.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, path)))
    (tmp_path / "r.json").write_text('{"f": {"a\\"}]": {"possible_matches": [{"index_id": "{[", "confidence": 1}]}}}')
    rows = large.result_buildings(spark, str(tmp_path / "r.json")).collect()
    assert [(r.file_name, r.building_id, r.n_matches, r.matches[0].index_id) for r in rows] == [("f", 'a"}]', 1, "{[")]
    assert sum(text.count("from_json(") for text in found) == 1
    assert sum(text.count("regexp_replace(plain") for text in found) == 1


def test_what_follows_the_last_end_of_a_split_is_read_where_it_goes_on():
    assert large._homes([False, True, False, False, True, False]) == [1, 4, 4, 4, 6, 6]
    assert large._homes([]) == []


def test_texts_are_shuffled_once_for_segments_and_numbers_and_not_kept(spark, tmp_path, monkeypatch):
    (tmp_path / "whole.json").write_text(json.dumps(document(random.Random(3), 5, 6)))
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    before, found, write = set(folder.iterdir()), [], storage.write
    monkeypatch.setattr(storage, "write", lambda df, path: (found.append(df._jdf.queryExecution().executedPlan().toString()), write(df, path)))
    rows = large.result_buildings(spark, str(tmp_path / "whole.json"))
    (parsed,) = [p for p in found if "from_json" in p]
    assert parsed.count("Exchange hashpartitioning") == 1 and "hashpartitioning(home" in parsed
    # Entries and the places of files stay, fragments do not.
    assert len(set(folder.iterdir()) - before) == 2
    assert rows.count() == len(rows_of(results.result_buildings(results.read_texts(spark, str(tmp_path / "whole.json")))))


def test_parts_of_a_built_document_are_small_and_compressed(spark, monkeypatch):
    monkeypatch.setattr(adapters, "BUILDINGS_PER_PART", 100)
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    path = Path(adapters.results_document(spark, "/root/testdata/sf0.001").removeprefix("file:"))
    parts = list(path.glob("part-*"))
    assert len(parts) > 10 and all(p.name.endswith(".gz") for p in parts)
    assert set(folder.iterdir()) - before == {path}
