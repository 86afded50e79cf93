"""Building status and stage colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch import constants as C
from geomatch.functions.ids import display_aliases, numeric_id, own_aliases, toggle_prefix
from geomatch.functions.labels import stage_colour, stage_rgb
from geomatch.operators.matching import with_prediction

# Status codes, ordered so that the largest one of a building's pairs is its status.
_NO_PAIRS, _NO_MATCH, _FALSE_POSITIVE, _TRUE_MATCH = range(4)


def _status_name(code: Column) -> Column:
    return (
        F.when(code == _TRUE_MATCH, C.TRUE_MATCH)
        .when(code == _FALSE_POSITIVE, C.FALSE_POSITIVE)
        .when(code == _NO_MATCH, C.NO_MATCH)
    )


def match_status(
    pairs: DataFrame, buildings: DataFrame | None = None, threshold: float = C.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Match status of each building over the pairs of its last file:
    ``building_id, first_file_pos, first_bld_pos, match_status``.

    ``buildings`` adds those with an empty list, whose status is NULL. File place and status code are
    packed into one number (file * 4 + code): its maximum is the worst case of the last file, so the
    pairs need one hash aggregation with map-side combine and no join.
    """
    code = (
        F.when((F.col("prediction") == 1) & (F.col("true_label") == 1), _TRUE_MATCH)
        .when((F.col("prediction") == 1) & (F.col("true_label") == 0), _FALSE_POSITIVE)
        .otherwise(_NO_MATCH)
    )
    rows = with_prediction(pairs, threshold).select("building_id", "file_pos", "bld_pos", code.alias("code"))
    if buildings is not None:
        empty = buildings.where("n_matches = 0")
        rows = rows.unionByName(empty.select("building_id", "file_pos", "bld_pos", F.lit(_NO_PAIRS).alias("code")))
    packed = rows.groupBy("building_id").agg(
        F.max(F.col("file_pos") * 4 + F.col("code")).alias("packed"),
        F.min("file_pos").alias("first_file_pos"),
        F.min_by("bld_pos", "file_pos").alias("first_bld_pos"),
    )
    return packed.select(
        "building_id", "first_file_pos", "first_bld_pos", _status_name(F.col("packed") % 4).alias("match_status")
    )


def building_status(
    features: DataFrame,
    pairs: DataFrame,
    buildings: DataFrame,
    threshold: float = C.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Status of every known id: ``building_id, has_features, has_pairs, match_status``.

    Buildings with pairs are also known by their digit run; where two share one, the later building
    with a status wins. A building with an empty list has pairs but no status.
    """
    matched = match_status(pairs, buildings, threshold).select(
        F.explode(own_aliases(F.col("building_id"))).alias("building_id"),
        F.lit(False).alias("has_features"),
        F.lit(True).alias("has_pairs"),
        F.when(
            F.col("match_status").isNotNull(), F.struct("first_file_pos", "first_bld_pos", "match_status")
        ).alias("status"),
    )
    featured = features.select("building_id").distinct().select(
        "building_id",
        F.lit(True).alias("has_features"),
        F.lit(False).alias("has_pairs"),
        F.lit(None).cast(matched.schema["status"].dataType).alias("status"),
    )
    return (
        matched.unionByName(featured)
        .groupBy("building_id")
        .agg(
            F.max("has_features").alias("has_features"),
            F.max("has_pairs").alias("has_pairs"),
            F.max("status")["match_status"].alias("match_status"),
        )
    )


def find_status(objects: DataFrame, status: DataFrame) -> DataFrame:
    """Status of each displayed object, NULLs when it has none: ``object_id`` and the status columns.

    The object is tried by its id, its digit run, then with the ``bag_`` prefix toggled; a status is
    known by the same three names. Ties go to the better name, then the smaller id.
    """
    names = status.select(
        "building_id", "has_features", "has_pairs", "match_status",
        F.explode(display_aliases(F.col("building_id"))).alias("a"),
    ).groupBy(F.col("a.alias").alias("alias")).agg(
        F.min(
            F.struct(F.col("a.kind").alias("kind"), "building_id", "has_features", "has_pairs", "match_status")
        ).alias("hit")
    )
    tries = objects.select("object_id").distinct().select(
        "object_id", F.explode(display_aliases(F.col("object_id"))).alias("a")
    ).select("object_id", F.col("a.alias").alias("alias"), F.col("a.kind").alias("tier"))
    hits = (
        tries.join(names, "alias", "left")
        .groupBy("object_id")
        .agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("tier", "hit"))).alias("best"))
    )
    return hits.select(
        "object_id",
        F.col("best.hit.has_features").alias("has_features"),
        F.col("best.hit.has_pairs").alias("has_pairs"),
        F.col("best.hit.match_status").alias("match_status"),
    )


def stage_colours(objects: DataFrame, status: DataFrame) -> DataFrame:
    """Objects with their colour at each stage: ``object_id, stage1, stage2, stage3, red, green,
    blue``, the numbers being those of stage 3."""
    found = find_status(objects, status)
    colours = found.select(
        "object_id",
        *[
            stage_colour(
                stage, F.col("has_features"), F.col("has_pairs"), F.col("match_status")
            ).alias(f"stage{stage}")
            for stage in (1, 2, 3)
        ],
    )
    return colours.select("*", stage_rgb(F.col("stage3")).alias("rgb")).select(
        "object_id", "stage1", "stage2", "stage3", "rgb.red", "rgb.green", "rgb.blue"
    )
