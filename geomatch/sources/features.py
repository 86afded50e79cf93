"""Feature tables: Parquet scan and sink, property-dictionary unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions.objects import dict_entries
from geomatch.schemas import FEATURE


_VALUES = ("value", "value_array", "value_json")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Long feature table; ``pos`` orders rows by their place in the dictionary and, where the files have none, by file and
    row in the file."""
    rows = spark.read.schema(FEATURE).parquet(path)
    place = F.struct(
        F.col("pos").alias("place"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return rows.select("building_id", "feature_name", *_VALUES, place.alias("pos"))


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the long table, sorted by building inside each file so that row groups can be skipped."""
    (
        features.select("building_id", "feature_name", *_VALUES, "pos")
        .sortWithinPartitions("building_id", "feature_name", "pos")
        .write.mode(mode)
        .parquet(path)
    )


def unpivot_properties(texts: DataFrame) -> DataFrame:
    """Property dictionary ``{feature: {"cands": {building: value}}}`` as long rows:
    ``building_id, feature_name, feature_pos, value, value_array, value_json, pos``.

    Features or ``cands`` that are not objects drop out. A number becomes ``value``, an array of numbers
    ``value_array``; ``value_json`` keeps anything else as JSON text. ``pos`` is the place of the feature, then of
    the building in it. A repeated key keeps its first place and its last value.
    """
    features = (
        texts.select(F.from_json("document", "map<string, string>").alias("features"))
        .select(F.explode(dict_entries(F.col("features"))).alias("f"))
        .select(
            F.col("f.key").alias("feature_name"),
            F.col("f.pos").alias("feature_pos"),
            F.from_json("f.value", "cands map<string, variant>").alias("typed"),
            F.from_json("f.value", "cands map<string, string>").alias("plain"),
        )
    )
    # A value with a repeated key inside it is no variant, and then none of its dictionary is: those values are read by themselves.
    values = F.coalesce(
        "typed.cands",
        F.transform_values("plain.cands", lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant"))),
    )
    members = features.select("feature_name", "feature_pos", values.alias("cands"))
    rows = members.select("feature_name", "feature_pos", F.explode(dict_entries(F.col("cands"))).alias("b")).select(
        F.col("b.key").alias("building_id"),
        "feature_name",
        "feature_pos",
        (F.shiftleft(F.col("feature_pos").cast("bigint"), 32) + F.col("b.pos")).alias("pos"),
        F.col("b.value").alias("v"),
    )
    kind = F.schema_of_variant("v")
    value = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
    items = F.when(kind.rlike("^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL|VOID)"), F.try_variant_get("v", "$", "array<double>"))
    names = ["building_id", "feature_name", "feature_pos"]
    return rows.select(*names, value.alias("value"), items.alias("value_array"), "v", "pos").select(
        *names, "value", "value_array",
        F.when(F.col("value").isNull() & F.col("value_array").isNull(), F.coalesce(F.to_json("v"), F.lit("null"))).alias("value_json"),
        "pos",
    )


def convert_properties(spark: SparkSession, source: str, target: str) -> None:
    """Property dictionary (JSON) to the Parquet feature table; raises when no row results."""
    rows = unpivot_properties(
        spark.read.text(source, wholetext=True).select(F.col("value").alias("document"))
    )
    if rows.isEmpty():
        raise ValueError(f"no feature rows in {source}")
    write_features(rows, target)
