"""Boxes, heights, footprints and geographic bounds.

Geometry rows carry their coordinates (see :mod:`geomatch.sources.cityjson`), so everything here is
computed inside the row: these operators add no shuffle to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch import constants as C
from geomatch.functions.crs import is_wgs84, to_lonlat
from geomatch.sources.cityjson import parsed_documents, vertex_pool

_KEYS = ("source", "file_path", "obj_pos", "object_id", "object_type", "geom_idx", "geom_type")


def _low(points: str, axis: str) -> Column:
    return F.array_min(F.transform(F.col(points), lambda p: p[axis]))


def _high(points: str, axis: str) -> Column:
    return F.array_max(F.transform(F.col(points), lambda p: p[axis]))


def _box(points: str) -> list[Column]:
    return [_low(points, a).alias(f"min_{a}") for a in "xyz"] + [_high(points, a).alias(f"max_{a}") for a in "xyz"]


def _outer_points(geometries: DataFrame, *keep: str) -> DataFrame:
    """Points of the outer shell of a solid, or of all surfaces."""
    outer = F.filter("rings", lambda r: r["shell"].isNull() | (r["shell"] == 0))
    return geometries.select(*_KEYS, *keep, F.flatten(F.transform(outer, lambda r: r["points"])).alias("outer"))


def object_boxes(geometries: DataFrame) -> DataFrame:
    """Box and height of each geometry that has a valid vertex."""
    boxes = _outer_points(geometries).select(*_KEYS, *_box("outer"))
    return boxes.where(F.col("min_x").isNotNull()).withColumn("height", F.col("max_z") - F.col("min_z"))


def _shown_height() -> Column:
    return F.when(F.col("height") > 0, F.col("height")).otherwise(F.lit(C.DEFAULT_HEIGHT))


def object_heights(geometries: DataFrame) -> DataFrame:
    """``height`` of the outer box, ``shown_height`` with the default where it is not positive."""
    spans = _outer_points(geometries).select(
        *_KEYS, (_high("outer", "z") - _low("outer", "z")).alias("height")
    )
    return spans.withColumn("shown_height", _shown_height())


def _first_ring() -> Column:
    first = F.filter(
        "rings",
        lambda r: (F.coalesce(r["shell"], F.lit(0)) == 0) & (r["face"] == 0) & (r["ring"] == 0),
    )
    return F.get(first, F.lit(0))["points"]


def footprints(geometries: DataFrame, min_points: int = 3) -> DataFrame:
    """First ring of the first face of each geometry, if it has enough points:
    ``points array<struct<vpos, vertex_idx, x, y, z>>``."""
    return geometries.select(*_KEYS, _first_ring().alias("points")).where(F.size("points") >= min_points)


def distinct_footprints(prints: DataFrame) -> DataFrame:
    """Drop points that repeat the previous one in x and y, unless fewer than three would remain.

    A run of equal points keeps its first, so comparing with the previous point is the same as
    comparing with the previous kept one.
    """

    def moved(p: Column, i: Column) -> Column:
        previous = F.get(F.col("points"), i - 1)
        return (i == 0) | (previous["x"] != p["x"]) | (previous["y"] != p["y"])

    others = [c for c in prints.columns if c != "points"]
    kept = prints.select(*others, "points", F.filter("points", moved).alias("_kept"))
    return kept.select(
        *others, F.when(F.size("_kept") >= 3, F.col("_kept")).otherwise(F.col("points")).alias("points")
    )


def footprint_points(prints: DataFrame) -> DataFrame:
    """Footprints as flat points with their place in the ring."""
    return prints.select(*_KEYS, F.posexplode("points").alias("point_no", "p")).select(
        *_KEYS, "point_no", "p.x", "p.y", "p.z"
    )


def footprint_stats(geometries: DataFrame) -> DataFrame:
    """Centre (mean of the points), extents, display scale and scaled height of each footprint.

    A footprint without extent has no scale.
    """
    shapes = _outer_points(geometries.withColumn("points", _first_ring()), "points").select(
        *_KEYS, "points", (_high("outer", "z") - _low("outer", "z")).alias("height")
    )
    prints = distinct_footprints(shapes.where(F.size("points") >= 3))
    n = F.size("points")

    def mean(axis: str) -> Column:
        return F.aggregate(F.col("points"), F.lit(0.0), lambda s, p: s + p[axis]) / n

    stats = prints.select(
        *_KEYS,
        _shown_height().alias("shown_height"),
        n.alias("n_points"),
        mean("x").alias("center_x"),
        mean("y").alias("center_y"),
        (_high("points", "x") - _low("points", "x")).alias("size_x"),
        (_high("points", "y") - _low("points", "y")).alias("size_y"),
    ).withColumn("max_size", F.greatest("size_x", "size_y"))
    out_of_range = (F.col("max_size") > C.SCALE_ABOVE) | (F.col("max_size") < C.SCALE_BELOW)
    scaled = stats.withColumn(
        "scale",
        F.when(F.col("max_size") == 0, F.lit(None).cast("double"))
        .when(out_of_range, F.lit(C.SCALE_TARGET) / F.col("max_size"))
        .otherwise(1.0),
    )
    return scaled.withColumn("scaled_height", F.col("shown_height") * F.col("scale"))


def drawable_objects(geometries: DataFrame) -> DataFrame:
    """Geometries with a box, a footprint of three points or more, and a positive height."""
    counted = geometries.withColumn("n_points", F.size(_first_ring()))
    sized = _outer_points(counted, "n_points").select(
        *_KEYS, "n_points", (_high("outer", "z") - _low("outer", "z")).alias("height")
    )
    return sized.where((F.col("height") > 0) & (F.col("n_points") >= 3))


def attribute_height() -> Column:
    """Height named by ``attributes``: ``measuredHeight``, else ``height``, else the default; zero
    counts as missing."""

    def attribute(name: str) -> Column:
        return F.nullif(F.try_variant_get("attributes", f"$.{name}", "double"), F.lit(0.0))

    return F.coalesce(attribute("measuredHeight"), attribute("height"), F.lit(C.DEFAULT_HEIGHT))


def display_name() -> Column:
    """``attributes.name``, else the object id."""
    return F.coalesce(
        F.nullif(F.try_variant_get("attributes", "$.name", "string"), F.lit("")), F.col("object_id")
    )


def object_descriptions(objects: DataFrame) -> DataFrame:
    """Attributes as rows, after one row for the type: ``object_id, display_name, key, value``."""
    named = objects.select(
        "source", "file_path", "object_id", display_name().alias("display_name"), "object_type",
        F.try_variant_get("attributes", "$", "map<string, string>").alias("items"),
    )
    kind = F.coalesce(F.nullif("object_type", F.lit("")), F.lit("Unknown"))
    rows = F.array_append(
        F.transform(
            F.map_entries(F.coalesce("items", F.create_map().cast("map<string, string>"))),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ),
        F.struct(F.lit("Type").alias("key"), kind.alias("value")),
    )
    return named.select("source", "file_path", "object_id", "display_name", F.explode(rows).alias("r")).select(
        "source", "file_path", "object_id", "display_name", "r.key", "r.value"
    )


def file_boxes(documents: DataFrame) -> DataFrame:
    """Box and centre of each file: its declared extent (six numbers or more), else the box of its
    whole vertex pool.

    The pool is reduced map-side in the task that parsed it; one row per file is shuffled.
    """
    parsed = parsed_documents(documents, "metadata variant, transform variant, vertices array<array<double>>").select(
        "source",
        "file_path",
        F.try_variant_get("doc.metadata", "$.referenceSystem", "string").alias("crs"),
        F.try_variant_get("doc.metadata", "$.geographicalExtent", "array<double>").alias("extent"),
        F.try_variant_get("doc.transform", "$.scale", "array<double>").alias("scale"),
        F.try_variant_get("doc.transform", "$.translate", "array<double>").alias("translate"),
        vertex_pool(),
    )
    points = parsed.select(
        "source", "file_path", "crs", "extent", "scale", "translate", F.explode_outer("pool").alias("v")
    )

    def coordinate(axis: int) -> Column:
        factor = F.coalesce(F.get("scale", F.lit(axis)), F.lit(1.0))
        return F.get("v", F.lit(axis)) * factor + F.coalesce(F.get("translate", F.lit(axis)), F.lit(0.0))

    def declared(i: int) -> Column:
        return F.when(F.size("extent") >= 6, F.get("extent", F.lit(i)))

    ends = [(f"min_{a}", F.min, i, i) for i, a in enumerate("xyz")]
    ends += [(f"max_{a}", F.max, i, i + 3) for i, a in enumerate("xyz")]
    box = points.groupBy("source", "file_path", "crs").agg(
        *[F.coalesce(F.max(declared(e)), pick(coordinate(axis))).alias(name) for name, pick, axis, e in ends]
    )
    return box.where(F.col("min_x").isNotNull()).withColumns(
        {f"center_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"}
    )


def geographic_bounds(boxes: DataFrame, mode: str = "approximate") -> DataFrame:
    """Longitude/latitude bounds of each file box, from its four corners, with validity flags."""
    corners = F.array(
        *[
            to_lonlat(F.col(f"{bx}_x"), F.col(f"{by}_y"), F.col("crs"), mode)
            for bx in ("min", "max")
            for by in ("min", "max")
        ]
    )
    placed = boxes.select(
        "source", "file_path", "crs", "min_x", "min_y", "max_x", "max_y", "center_x", "center_y",
        is_wgs84(F.col("crs")).alias("_is_wgs84"), corners.alias("corners"),
    )

    def bound(axis: str, name: str, high: bool) -> Column:
        own = F.col(f"{'max' if high else 'min'}_{axis}")
        from_corners = (F.greatest if high else F.least)(*[F.col("corners")[i][name] for i in range(4)])
        return F.when(F.col("_is_wgs84"), own).otherwise(from_corners)

    bounds = placed.select(
        "source", "file_path", "_is_wgs84", "center_x", "center_y",
        bound("y", "lat", False).alias("min_lat"),
        bound("x", "lon", False).alias("min_lon"),
        bound("y", "lat", True).alias("max_lat"),
        bound("x", "lon", True).alias("max_lon"),
    )
    middle = {
        "center_lat": F.when(F.col("_is_wgs84"), F.col("center_y")).otherwise((F.col("min_lat") + F.col("max_lat")) / 2),
        "center_lon": F.when(F.col("_is_wgs84"), F.col("center_x")).otherwise((F.col("min_lon") + F.col("max_lon")) / 2),
    }
    in_range = (
        (F.col("min_lat") >= -90) & (F.col("max_lat") <= 90) & (F.col("min_lon") >= -180) & (F.col("max_lon") <= 180)
    )
    small = (F.abs(F.col("max_lat") - F.col("min_lat")) < C.MIN_BOUNDS_DEGREES) | (
        F.abs(F.col("max_lon") - F.col("min_lon")) < C.MIN_BOUNDS_DEGREES
    )
    return bounds.withColumns({**middle, "is_valid": in_range, "is_small": small}).drop("_is_wgs84", "center_x", "center_y")


def bounds_ring(bounds: DataFrame) -> DataFrame:
    """Closed rectangle of valid bounds: corners SW, SE, NE, NW, SW as ``corner_no, lat, lon``."""
    corners = [("min", "min"), ("min", "max"), ("max", "max"), ("max", "min"), ("min", "min")]
    ring = F.array(
        *[F.struct(F.col(f"{a}_lat").alias("lat"), F.col(f"{o}_lon").alias("lon")) for a, o in corners]
    )
    return (
        bounds.where("is_valid")
        .select("source", "file_path", F.posexplode(ring).alias("corner_no", "c"))
        .select("source", "file_path", "corner_no", "c.lat", "c.lon")
    )
