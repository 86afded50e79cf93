"""Tables refreshed by version key, on real files and on listings."""

import json
import os

import pytest

from geomatch.sources import catalog, cityjson, snapshots


def tile(*names, kind="Building"):
    ring = {"type": "MultiSurface", "boundaries": [[[0, 1, 2]]]}
    objects = {n: {"type": kind, "geometry": [ring]} for n in names}
    return json.dumps({"version": "1.1", "CityObjects": objects, "vertices": [[0, 0, 1], [1, 0, 1], [1, 1, 2]]})


def put(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def listed(spark, folder):
    files = catalog.file_catalog(spark, str(folder), {"A": str(folder / "a"), "B": str(folder / "b")})
    return files.withColumnRenamed("path", "file_path")


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def city(spark, tmp_path):
    """A data root with files, a reader that notes what it is asked for, and a refresh."""
    root, target, asked = tmp_path / "data", str(tmp_path / "tables"), []
    put(root, "a/one.json", tile("x", "y"), 1_000)
    put(root, "a/t[1] wo,é.json", tile("z"), 1_000)
    put(root, "b/three.json", tile("p", "q", kind="Road"), 1_000)
    put(root, "b/bad.json", "{", 1_000)
    texts = snapshots.changed_texts(spark, {"A": str(root / "a"), "B": str(root / "b")}, str(root))

    def read(wanted):
        asked.append({r.file_path for r in wanted.collect()})
        return texts(wanted)

    def refresh():
        found = snapshots.refresh(spark, listed(spark, root), read, target)
        return {r.file_path: r.state for r in found.collect()}

    return root, target, asked, refresh


def same_as_rebuilt(spark, root, target):
    documents = cityjson.read_documents(spark, {"A": str(root / "a"), "B": str(root / "b")}, str(root))
    for name, make in cityjson.TABLES.items():
        assert rows_of(snapshots.read_table(spark, target, name)) == rows_of(make(documents)), name


def test_refresh_equals_a_rebuild_and_reads_changed_files_only(spark, city):
    root, target, asked, refresh = city
    assert set(refresh().values()) == {"new"} and snapshots.newest(spark, target) == 1
    same_as_rebuilt(spark, root, target)
    put(root, "a/one.json", tile("x"), 2_000)
    put(root, "b/four.json", tile("r", "s", "t"), 2_000)
    (root / "b/three.json").unlink()
    states = refresh()
    assert states == {"a/one.json": "changed", "b/four.json": "new", "b/three.json": "removed", "b/bad.json": "same", "a/t[1] wo,é.json": "same"}
    assert asked[-1] == {"a/one.json", "b/four.json"}
    same_as_rebuilt(spark, root, target)
    before = len(asked)
    assert set(refresh().values()) == {"same"} and len(asked) == before and snapshots.newest(spark, target) == 2
    snapshots.compact(spark, target)
    assert {r.in_generation for r in snapshots.manifest(spark, target).collect()} == {3}
    same_as_rebuilt(spark, root, target)


def test_a_refresh_that_broke_off_is_not_seen_and_is_repeated(spark, city, monkeypatch):
    root, target, _, refresh = city
    refresh()
    before = rows_of(snapshots.read_table(spark, target, "city_object"))
    put(root, "a/one.json", tile("new1", "new2"), 2_000)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refresh()
    assert rows_of(snapshots.read_table(spark, target, "city_object")) == before
    # The broken generation held other rows for the same number.
    put(root, "a/one.json", tile("new3"), 3_000)
    assert refresh()["a/one.json"] == "changed"
    same_as_rebuilt(spark, root, target)


def test_all_files_removed_and_none_at_first(spark, tmp_path):
    target = str(tmp_path / "tables")
    none = spark.createDataFrame([], "source string, file_path string, version_key string")
    assert snapshots.read_table(spark, target, "vertex").count() == 0
    assert snapshots.refresh(spark, none, lambda w: pytest.fail("nothing to read"), target).count() == 0
    one = spark.createDataFrame([("A", "f", None), ("A", "f", None)], none.schema)
    texts = spark.createDataFrame([("A", "f", tile("x")), ("A", "other", tile("y"))], "source string, file_path string, document string")
    snapshots.refresh(spark, one, lambda w: texts, target)
    assert [r.object_id for r in snapshots.read_table(spark, target, "city_object").collect()] == ["x"]
    assert {r.state for r in snapshots.refresh(spark, one, lambda w: texts, target).collect()} == {"same"}
    assert {r.state for r in snapshots.refresh(spark, none, lambda w: texts, target).collect()} == {"removed"}
    assert snapshots.read_table(spark, target, "city_object").count() == 0


def test_more_changed_files_than_paths_read_the_roots(spark, city):
    root, target, _, _ = city
    few = snapshots.changed_texts(spark, {"A": str(root / "a"), "B": str(root / "b")}, str(root), at_once=1)
    snapshots.refresh(spark, listed(spark, root), few, target)
    same_as_rebuilt(spark, root, target)


def test_one_file_reads_one_slot(spark, city):
    root, target, _, refresh = city
    refresh()
    rows = snapshots.read_table(spark, target, "city_object", "A", "a/one.json")
    text = rows._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.splitlines() if "PartitionFilters" in line and "slot" in line]
    assert any("(slot#" in f.split("PartitionFilters")[1] for f in filters)
    assert sorted(r.object_id for r in rows.collect()) == ["x", "y"]
