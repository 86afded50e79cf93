"""Feature tables per building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch.functions.display import feature_text
from geomatch.functions.ids import own_aliases

_VALUES = ("value", "value_array", "value_json")


def latest_features(features: DataFrame) -> DataFrame:
    """One row per (building, feature): the last one by ``pos`` wins. Repeats are combined before
    the shuffle, and the result of a building is never larger than the number of features."""
    return features.groupBy("building_id", "feature_name").agg(
        F.max_by(F.struct(*_VALUES), "pos").alias("v"), F.min("pos").alias("pos")
    ).select("building_id", "feature_name", *(f"v.{c}" for c in _VALUES), "pos")


def first_feature_buildings(features: DataFrame) -> DataFrame:
    """Rows of the buildings that occur under the first feature (smallest ``feature_pos``)."""
    first = features.agg(F.min("feature_pos")).scalar()
    ids = features.where(F.col("feature_pos") == first).select("building_id").distinct()
    return features.join(ids, "building_id", "left_semi")


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["feature_name"] < b["feature_name"], -1).when(a["feature_name"] > b["feature_name"], 1).otherwise(0)


def feature_maps(features: DataFrame) -> DataFrame:
    """``building_id, features map<string, struct<value, value_array, value_json>>, n_features``, features in name order."""
    return (
        latest_features(features)
        .groupBy("building_id")
        .agg(F.array_sort(F.collect_list(F.struct("feature_name", F.struct(*_VALUES).alias("v"))), _by_name).alias("entries"))
        .select(
            "building_id",
            F.map_from_entries("entries").alias("features"),
            F.size("entries").alias("n_features"),
        )
    )


def feature_names(features: DataFrame) -> list[str]:
    """Names of all features, in the order of their first row: the columns a pivot needs."""
    first = features.groupBy("feature_name").agg(F.min("pos").alias("pos"))
    return [r.feature_name for r in first.orderBy("pos", "feature_name").select("feature_name").collect()]


def feature_pivot(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide table with one column per named feature: one shuffle, combined map-side."""
    return features.groupBy("building_id").agg(
        *[
            F.max_by(F.when(F.col("feature_name") == n, F.col("value")), F.when(F.col("feature_name") == n, F.col("pos"))).alias(n)
            for n in names
        ]
    )


def feature_listing(features: DataFrame) -> DataFrame:
    """Features as shown, one row each, with their place in name order:
    ``building_id, feature_no, feature_name, shown``."""
    entries = (
        latest_features(features)
        .groupBy("building_id")
        .agg(F.array_sort(F.collect_list(F.struct("feature_name", *_VALUES)), _by_name).alias("entries"))
    )
    return entries.select("building_id", F.posexplode("entries").alias("feature_no", "e")).select(
        "building_id",
        (F.col("feature_no") + 1).alias("feature_no"),
        "e.feature_name",
        feature_text(F.col("e.value"), F.col("e.value_array"), F.col("e.value_json")).alias("shown"),
    )


def features_of_objects(features: DataFrame, objects: DataFrame) -> DataFrame:
    """Features of the buildings that the given objects (``object_id``), as those of a file, stand for: by id or digit run."""
    ids = objects.select(F.explode(own_aliases(F.col("object_id"))).alias("building_id")).distinct()
    return features.join(ids, "building_id", "left_semi")


def feature_keys(features: DataFrame) -> DataFrame:
    """Lookup keys of the feature table: ``key, key_pos``, in order of first appearance."""
    return features.groupBy(F.col("building_id").alias("key")).agg(F.min("pos").alias("key_pos"))
