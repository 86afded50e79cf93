"""CityJSON files, geometry and extraction on hand-written documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geomatch.operators import comparison, extraction, geometry
from geomatch.sources import catalog, cityjson

CITY = "RawCitiesData/The Hague"

TILE_1 = """{"type": "CityJSON", "version": "1.1",
 "transform": {"scale": [0.5, 0.5, 0.25], "translate": [100, 200, 10]},
 "metadata": {"referenceSystem": "EPSG:28992", "geographicalExtent": [0, 0, 0, 1000, 2000, 50]},
 "CityObjects": {
  "bag_0518100000000009": {"type": "Building", "attributes": {"name": "Tower", "measuredHeight": 0, "height": 7},
   "children": ["x"],
   "geometry": [
    {"type": "Solid", "lod": 2, "boundaries": [
      [[[8, 6, 4, 2]], [[8, 6, 5]]],
      [[[0, 1, 3]]]]},
    {"type": "MultiSurface", "boundaries": [[[2, 4, 6], [4, 6, 8]], [[5, 6, 8]]]}]},
  "bag_0518100000000001": {"type": "Road", "attributes": {"measuredHeight": 3.5}}},
 "vertices": [[0,0,-40],[1,1,-40],[2,0,0],[3,3,900],[4,0,0],[4,4,8],[4,2,0],[9,9,9],[2,2,0]]}"""

TILE_2 = """{"CityObjects": {
  "comp": {"type": "Building", "geometry": [{"type": "CompositeSurface", "boundaries": [[[0, 1, 2]]]}]},
  "none": {"type": "Bridge", "geometry": []},
  "blank": {}, "odd": 5, "nul": null,
  "floats": {"geometry": [{"type": "MultiSurface", "boundaries": [[[0, 1.0, "2", 1, 2]]]}]}},
 "vertices": [[0, 0, 1], [2, 0, 1], [2, 2, 3], [50, 60, 70]]}"""

TILE_9 = """{"CityObjects": {
  "0518100000000001": {"type": "Building", "geometry": []},
  "NL.IMBAG.Pand.0518100000000007": {"type": "Building"}}, "vertices": []}"""

TILE_DUP = """{"CityObjects": {
  "a": {"type": "Old"}, "b": {"type": "Building", "geometry": [
     {"type": "MultiSurface", "boundaries": [[[0, 0, 1, 1, 2, 3, -1, 99]]]},
     {"type": "MultiSurface", "boundaries": [[[0, 0, 0, 1]]]},
     {"type": "MultiPoint", "boundaries": [0, 1]}]},
  "a": {"type": "New", "geometry": [{"type": "Solid", "boundaries": [[[[-1, 3, 1, 99]]]]}]}},
 "vertices": [[0, 0, 5], [4, 0, 5], [4, 4, 5], [0, 4, 5]]}"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("data root")
    files = {
        "Source A/tile_1.json": TILE_1, "Source A/deep/tile_2.json": TILE_2, "Source A/bad.json": '{"CityObjects": {',
        "Source A/notes.txt": "no", "Source A/list.json": "[1]",
        "Source B/tile_9.json": TILE_9, "Source B/tile dup+1.json": TILE_DUP,
    }
    for name, text in files.items():
        path = base / CITY / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def documents(spark, root):
    roots = {s: f"{root}/{CITY}/Source {s}" for s in "AB"}
    return cityjson.read_documents(spark, roots, data_root=root).cache()


def path_of(name):
    return f"{CITY}/{name}"


def test_catalogue(spark, root):
    rows = catalog.file_catalog(spark, root).collect()
    assert {(r.source, r.path, r.file_name) for r in rows} == {
        ("A", path_of("Source A/tile_1.json"), "tile_1.json"),
        ("A", path_of("Source A/deep/tile_2.json"), "tile_2.json"),
        ("A", path_of("Source A/bad.json"), "bad.json"),
        ("A", path_of("Source A/list.json"), "list.json"),
        ("B", path_of("Source B/tile_9.json"), "tile_9.json"),
        ("B", path_of("Source B/tile dup+1.json"), "tile dup+1.json"),
    }
    assert {r.size for r in rows if r.file_name == "tile_1.json"} == {len(TILE_1)}
    explicit = catalog.file_catalog(spark, root + "/elsewhere", {"A": f"{root}/{CITY}/Source A/deep"}).collect()
    assert [r.path for r in explicit] == [f"{root}/{CITY}/Source A/deep/tile_2.json"]


def test_both_sources_fall_back_to_the_data_root(spark):
    listing = spark.createDataFrame([("x/a.json",), ("SourceA/b.json",), ("Source A/c.json",)], "path string")
    got = {(r.source, r.path) for r in catalog.assign_sources(listing).collect()}
    assert got == {("A", "Source A/c.json")} | {("B", p) for p in ("x/a.json", "SourceA/b.json", "Source A/c.json")}


def test_path_resolution(spark, root):
    files = catalog.file_catalog(spark, root)
    asked = {
        path_of("Source B/tile_9.json"): path_of("Source B/tile_9.json"),
        "any/where/tile_1.json": path_of("Source A/tile_1.json"),
        "Source%20B/tile%20dup+1.json": path_of("Source B/tile dup+1.json"),
        "Source A/deep/tile_2.json": path_of("Source A/deep/tile_2.json"),
        "tile_2.json": None,
    }
    requests = spark.createDataFrame([(a,) for a in asked], "request_path string")
    assert {r.request_path: r.path for r in catalog.resolve_paths(requests, files).collect()} == asked
    selected = {r.request_path: r.path for r in catalog.resolve_paths(requests, files, mode="select").collect()}
    assert selected["any/where/tile_1.json"] is None and selected["Source A/deep/tile_2.json"]


def test_bad_files_are_listed_and_skipped(documents):
    assert {r.file_path for r in cityjson.bad_files(documents).collect()} == {
        path_of("Source A/bad.json"), path_of("Source A/list.json"),
    }
    assert {r.file_path for r in cityjson.city_objects(documents).collect()} == {
        path_of(p) for p in ("Source A/tile_1.json", "Source A/deep/tile_2.json", "Source B/tile_9.json", "Source B/tile dup+1.json")
    }


def test_headers(documents):
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in cityjson.city_files(documents).collect()}
    first = rows["tile_1.json"]
    assert (first.version, first.crs, first.scale, first.n_objects, first.n_vertices) == ("1.1", "EPSG:28992", [0.5, 0.5, 0.25], 2, 9)
    assert (rows["tile_2.json"].version, rows["tile_2.json"].crs, rows["tile_2.json"].n_objects) == (None, None, 6)
    assert rows["tile dup+1.json"].n_objects == 2


def objects_of(documents, name):
    return cityjson.city_objects(documents).where(F.col("file_path").endswith(name)).orderBy("obj_pos").collect()


def test_objects_keep_file_order(documents):
    assert [r.object_id for r in objects_of(documents, "tile_1.json")] == ["bag_0518100000000009", "bag_0518100000000001"]
    second = objects_of(documents, "tile_2.json")
    assert [(r.object_id, r.is_empty) for r in second] == [
        ("comp", False), ("none", False), ("blank", True), ("odd", True), ("nul", True), ("floats", False),
    ]
    assert [(r.object_id, r.object_type, r.obj_pos) for r in objects_of(documents, "dup+1.json")] == [("a", "New", 0), ("b", "Building", 1)]


def test_attributes(documents):
    rows = {
        r.object_id: (r.name, r.height)
        for r in cityjson.city_objects(documents).select(
            "object_id", geometry.display_name().alias("name"), geometry.attribute_height().alias("height")
        ).collect()
    }
    assert rows["bag_0518100000000009"] == ("Tower", 7.0)
    assert rows["bag_0518100000000001"] == ("bag_0518100000000001", 3.5)
    assert rows["comp"] == ("comp", 10.0)
    described = geometry.object_descriptions(cityjson.city_objects(documents)).where("object_id = 'bag_0518100000000009'")
    assert {(r.key, r.value) for r in described.collect()} == {("Type", "Building"), ("name", "Tower"), ("measuredHeight", "0"), ("height", "7")}


def test_vertices(documents):
    rows = cityjson.vertices(documents).where(F.col("file_path").endswith("tile_1.json")).orderBy("vertex_idx").collect()
    assert len(rows) == 9 and tuple(rows[5])[2:] == (5, 4.0, 4.0, 8.0, 102.0, 202.0, 12.0)
    plain = cityjson.vertices(documents).where(F.col("file_path").endswith("tile_2.json")).orderBy("vertex_idx").first()
    assert (plain.vx, plain.x, plain.z) == (0.0, 0.0, 1.0)


def boxes_of(documents, **options):
    rows = geometry.object_boxes(cityjson.object_geometries(documents, **options)).collect()
    return {(r.object_id, r.geom_idx): (r.min_x, r.min_y, r.min_z, r.max_x, r.max_y, r.max_z) for r in rows}


def test_boxes(documents):
    boxes = boxes_of(documents)
    # The inner shell, with its deep and high vertices, does not count.
    assert boxes[("bag_0518100000000009", 0)] == (101.0, 200.0, 10.0, 102.0, 202.0, 12.0)
    assert boxes[("bag_0518100000000009", 1)] == (101.0, 200.0, 10.0, 102.0, 202.0, 12.0)
    assert boxes[("b", 0)] == (0.0, 0.0, 5.0, 4.0, 4.0, 5.0)
    assert boxes[("a", 0)] == (0.0, 0.0, 5.0, 4.0, 4.0, 5.0)
    assert boxes[("floats", 0)] == (0.0, 0.0, 1.0, 2.0, 2.0, 3.0)
    assert ("comp", 0) not in boxes
    every = boxes_of(documents, geom_types=("Solid", "MultiSurface", "CompositeSurface"))
    assert every[("comp", 0)] == (0.0, 0.0, 1.0, 2.0, 2.0, 3.0)
    assert {k[1] for k in boxes_of(documents, first_only=True)} == {0}


def test_heights(documents):
    rows = geometry.object_heights(cityjson.object_geometries(documents)).collect()
    assert {(r.object_id, r.geom_idx): (r.height, r.shown_height) for r in rows} == {
        ("bag_0518100000000009", 0): (2.0, 2.0), ("bag_0518100000000009", 1): (2.0, 2.0),
        ("a", 0): (0.0, 10.0), ("b", 0): (0.0, 10.0), ("b", 1): (0.0, 10.0), ("floats", 0): (2.0, 2.0),
    }
    drawn = geometry.drawable_objects(cityjson.object_geometries(documents)).collect()
    assert {(r.object_id, r.geom_idx, r.n_points) for r in drawn} == {
        ("bag_0518100000000009", 0, 4), ("bag_0518100000000009", 1, 3), ("floats", 0, 5),
    }


def test_footprints(documents):
    prints = geometry.footprints(cityjson.object_geometries(documents))
    raw = {(r.object_id, r.geom_idx): [(p.x, p.y) for p in r.points] for r in prints.collect()}
    assert raw[("bag_0518100000000009", 0)] == [(101.0, 201.0), (102.0, 201.0), (102.0, 200.0), (101.0, 200.0)]
    assert raw[("b", 0)] == [(0, 0), (0, 0), (4, 0), (4, 0), (4, 4), (0, 4)]
    assert ("a", 0) not in raw
    kept = {(r.object_id, r.geom_idx): [(p.x, p.y) for p in r.points] for r in geometry.distinct_footprints(prints).collect()}
    assert kept[("b", 0)] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert kept[("b", 1)] == [(0, 0), (0, 0), (0, 0), (4, 0)]  # two would remain, so all stay


def test_footprint_stats(documents):
    rows = {(r.object_id, r.geom_idx): r for r in geometry.footprint_stats(cityjson.object_geometries(documents)).collect()}
    b = rows[("b", 0)]
    assert (b.n_points, b.center_x, b.center_y, b.max_size, b.scale, b.scaled_height) == (4, 2.0, 2.0, 4.0, 1.0, 10.0)


def test_scale_of_large_small_and_pointlike_footprints(spark):
    def document(size):
        return json.dumps({
            "CityObjects": {"o": {"geometry": [{"type": "MultiSurface", "boundaries": [[[0, 1, 2]]]}]}},
            "vertices": [[0, 0, 0], [size, 0, 0], [size, size, 0]],
        })

    rows = [("A", str(size), document(size)) for size in (200, 0.05, 0, 100)]
    docs = spark.createDataFrame(rows, "source string, file_path string, document string")
    stats = geometry.footprint_stats(cityjson.object_geometries(docs)).collect()
    assert {r.file_path: r.scale for r in stats} == {"200": 0.25, "0.05": 1000.0, "0": None, "100": 1.0}


def test_file_boxes_and_bounds(documents):
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in geometry.file_boxes(documents).collect()}
    assert (rows["tile_1.json"].max_y, rows["tile_1.json"].center_z) == (2000.0, 25.0)
    # Without an extent the whole pool counts, used or not.
    assert (rows["tile_2.json"].max_x, rows["tile_2.json"].center_y) == (50.0, 30.0)
    assert "tile_9.json" not in rows
    bounds = {r.file_path.rsplit("/", 1)[1]: r for r in geometry.geographic_bounds(geometry.file_boxes(documents)).collect()}
    first = bounds["tile_1.json"]
    assert first.max_lon == pytest.approx(4.3007 + 1000 / 111320) and first.is_valid and not first.is_small
    assert bounds["tile dup+1.json"].is_small
    ring = geometry.bounds_ring(geometry.geographic_bounds(geometry.file_boxes(documents))).where(
        F.col("file_path").endswith("tile_1.json")
    ).orderBy("corner_no").collect()
    assert (ring[0].lat, ring[0].lon) == (ring[4].lat, ring[4].lon) and (ring[2].lat, ring[2].lon) == (first.max_lat, first.max_lon)


def extract(spark, documents, *requests):
    asked = spark.createDataFrame(list(requests), "request_id string, file_path string")
    return {r.request_id: json.loads(r.cityjson) for r in extraction.extract_objects(asked, documents).collect()}


def test_extraction(spark, documents):
    got = extract(
        spark, documents, ("0518100000000009", path_of("Source A/tile_1.json")),
        ("blank", path_of("Source A/deep/tile_2.json")), ("comp", path_of("Source A/deep/tile_2.json")),
    )
    assert set(got) == {"0518100000000009", "comp"}
    assert got["0518100000000009"] == {
        "type": "CityJSON", "version": "1.1",
        "CityObjects": {"bag_0518100000000009": {
            "type": "Building", "attributes": {"name": "Tower", "measuredHeight": 0, "height": 7}, "children": ["x"],
            "geometry": [
                {"type": "Solid", "lod": 2, "boundaries": [[[[7, 6, 4, 2]], [[7, 6, 5]]], [[[0, 1, 3]]]]},
                {"type": "MultiSurface", "boundaries": [[[2, 4, 6], [4, 6, 7]], [[5, 6, 7]]]},
            ]}},
        "vertices": [[0, 0, -40], [1, 1, -40], [2, 0, 0], [3, 3, 900], [4, 0, 0], [4, 4, 8], [4, 2, 0], [2, 2, 0]],
        "metadata": {"referenceSystem": "EPSG:28992", "geographicalExtent": [0, 0, 0, 1000, 2000, 50]},
        "transform": {"scale": [0.5, 0.5, 0.25], "translate": [100, 200, 10]},
    }
    # Other geometry types keep their indices and bring no vertices.
    assert got["comp"] == {
        "type": "CityJSON", "version": "1.0", "vertices": [],
        "CityObjects": {"comp": {"type": "Building", "geometry": [{"type": "CompositeSurface", "boundaries": [[[0, 1, 2]]]}]}},
    }


def test_extraction_keeps_invalid_indices(spark, documents):
    (got,) = extract(spark, documents, ("a", path_of("Source B/tile dup+1.json"))).values()
    assert got["vertices"] == [[4, 0, 5], [0, 4, 5]]
    assert got["CityObjects"]["a"]["geometry"] == [{"type": "Solid", "boundaries": [[[[-1, 1, 0, 2]]]]}]


def test_extraction_round_trip(spark):
    rng = random.Random(3)
    vertices = [[rng.randrange(1000), rng.randrange(1000), rng.randrange(100)] for _ in range(700)]
    objects = {
        f"o{i}": {"geometry": [{"type": "Solid", "boundaries": [[[[rng.randrange(700) for _ in range(rng.randint(3, 9))]] for _ in range(rng.choice([1, 3, 80]))]]}]}
        for i in range(12)
    }
    text = json.dumps({"CityObjects": objects, "vertices": vertices})
    docs = spark.createDataFrame([("A", "f", text)], "source string, file_path string, document string")
    got = extract(spark, docs, *[(o, "f") for o in objects])
    assert set(got) == set(objects)
    for name, source in objects.items():
        small = got[name]
        rings = lambda d: [r for s in d["geometry"][0]["boundaries"] for f in s for r in f]
        before = [[vertices[i] for i in ring] for ring in rings(source)]
        after = [[small["vertices"][i] for i in ring] for ring in rings(small["CityObjects"][name])]
        assert before == after
        assert len(small["vertices"]) == len({i for ring in rings(source) for i in ring})


def test_comparison_set(spark, documents):
    pairs = spark.createDataFrame(
        [("f", "bag_0518100000000009", 0, "0518100000000001", 0.9, None, None),
         ("f", "bag_0518100000000009", 1, "x_comp", 0.95, 1, 1), ("f", "bag_0518100000000009", 2, "gone", 0.1, 0, None)],
        "file_name string, building_id string, match_pos int, index_id string, confidence double, true_label int, predicted_label int",
    )
    shapes = cityjson.object_geometries(documents, ("Solid", "MultiSurface", "CompositeSurface"), first_only=True)
    rows = comparison.comparison_set(pairs, None, cityjson.city_objects(documents), shapes).orderBy("pair_rank").collect()
    assert [(r.index_id, r.index_source, r.index_object_id, r.index_n_points) for r in rows] == [
        ("x_comp", "A", "comp", 3), ("0518100000000001", "A", "bag_0518100000000001", None), ("gone", None, None, None),
    ]
    assert {(r.candidate_source, r.candidate_object_id, r.candidate_shown_height) for r in rows} == {("A", "bag_0518100000000009", 2.0)}


def test_tables_are_written(spark, documents, tmp_path):
    cityjson.write_tables(documents, str(tmp_path / "silver"))
    stored = spark.read.parquet(str(tmp_path / "silver/city_object"))
    direct = cityjson.city_objects(documents)
    shown = ["source", "file_path", "obj_pos", "object_id", "object_type", "is_empty", "numeric_id"]
    for extra in ([], [F.to_json("attributes").alias("a")]):
        assert sorted(map(str, stored.select(*shown, *extra).collect())) == sorted(map(str, direct.select(*shown, *extra).collect()))
    for options in ({}, {"first_only": True}, {"geom_types": ("CompositeSurface",)}):
        written = geometry.object_heights(cityjson.geometries_of(stored, **options)).collect()
        assert sorted(map(str, written)) == sorted(map(str, geometry.object_heights(cityjson.object_geometries(documents, **options)).collect()))
    asked = spark.createDataFrame([("comp", path_of("Source A/deep/tile_2.json"))], "request_id string, file_path string")
    extraction.write_minimal(extraction.extract_objects(asked, documents), str(tmp_path / "out"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(line)["CityObjects"]["comp"]["type"] == "Building"
