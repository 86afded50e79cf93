"""Match results and metrics summaries: JSON scans into flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch import constants as C
from geomatch.functions.labels import label
from geomatch.functions.objects import dict_entries
from geomatch.operators.ranking import rank_in_group

_MATCH = "struct<index_id: string, confidence: string, true_label: string, predicted_label: string>"
RESULTS = f"map<string, map<string, struct<possible_matches: array<{_MATCH}>>>>"

METRIC_FIELDS = {
    **{name: "bigint" for name in C.FILE_COUNTS},
    **{
        f"{strategy}_{name}": kind
        for strategy in C.STRATEGIES
        for names, kind in ((C.STRATEGY_RATIOS, "double"), (C.STRATEGY_COUNTS, "bigint"))
        for name in names
    },
}


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files as whole texts: ``doc_path, document``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("document")
    )


def result_buildings(texts: DataFrame, several: bool = False) -> DataFrame:
    """Results ``{file: {building: {possible_matches: [...]}}}`` with the list still nested:
    ``file_name, file_pos, building_id, bld_pos, n_matches, matches``.

    With ``several`` documents, files are ordered by document path, then by place in the document. Texts cannot be split, so
    many files of a bounded size are the form for many buildings.
    """
    files = texts.select("doc_path", F.from_json("document", RESULTS).alias("files")).select(
        "doc_path", F.explode(dict_entries(F.col("files"))).alias("file")
    )
    buildings = files.select(
        "doc_path",
        F.col("file.key").alias("file_name"),
        F.col("file.pos").cast("bigint").alias("file_pos"),
        F.col("file.value").alias("buildings"),
    ).select("doc_path", "file_name", "file_pos", F.explode(dict_entries(F.col("buildings"))).alias("b"))
    rows = buildings.select(
        "doc_path",
        "file_name",
        "file_pos",
        F.col("b.key").alias("building_id"),
        F.col("b.pos").cast("bigint").alias("bld_pos"),
        F.greatest(F.coalesce(F.size("b.value.possible_matches"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_matches"),
        F.col("b.value.possible_matches").alias("matches"),
    )
    if several:
        # Paths are ranked apart from the texts, by slices of their order.
        paths = texts.select("doc_path").distinct().withColumn("_all", F.lit(0))
        ranks = rank_in_group(paths, ["_all"], [F.asc("doc_path")], "_rank").select("doc_path", "_rank")
        rows = rows.join(ranks, "doc_path").withColumn("file_pos", F.shiftleft(F.col("_rank") - 1, 32) + F.col("file_pos")).drop("_rank")
    return rows.drop("doc_path")


def result_pairs(buildings: DataFrame) -> DataFrame:
    """The pair table of :func:`result_buildings`."""
    m = F.col("m")
    return buildings.select(
        "file_name", "file_pos", "building_id", "bld_pos",
        F.posexplode("matches").alias("match_pos", "m"),
    ).select(
        "file_name",
        "file_pos",
        "building_id",
        "bld_pos",
        F.col("match_pos").cast("bigint").alias("match_pos"),
        F.coalesce(m["index_id"], F.lit("")).alias("index_id"),
        F.coalesce(m["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
        label(m["true_label"]).alias("true_label"),
        label(m["predicted_label"]).alias("predicted_label"),
    )


def read_results(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(pair, result_building)`` of one or several results documents."""
    several = not (isinstance(path, str) and path.endswith(".json"))
    buildings = result_buildings(read_texts(spark, path), several)
    return result_pairs(buildings), buildings.drop("matches")


def _number(text: Column, kind: str) -> Column:
    number = text.try_cast("double")
    return F.coalesce(number.try_cast(kind), F.lit(0).cast(kind))


def file_metrics(texts: DataFrame, model: str = C.DEFAULT_MODEL) -> DataFrame:
    """Per-file metrics of one model: ``model, file_name, file_pos`` and the metric fields, missing
    fields as 0. The result is empty when the model is absent; see :func:`read_metrics`."""
    schema = "map<string, struct<file_metrics: map<string, map<string, string>>>>"
    files = (
        texts.select(F.from_json("document", schema).alias("models"))
        .select(F.try_element_at("models", F.lit(model))["file_metrics"].alias("files"))
        .select(F.explode(dict_entries(F.col("files"))).alias("f"))
    )
    return files.select(
        F.lit(model).alias("model"),
        F.col("f.key").alias("file_name"),
        F.col("f.pos").cast("bigint").alias("file_pos"),
        *[
            _number(F.try_element_at("f.value", F.lit(name)), kind).alias(name)
            for name, kind in METRIC_FIELDS.items()
        ],
    )


def read_metrics(spark: SparkSession, path: str, model: str = C.DEFAULT_MODEL) -> DataFrame:
    """:func:`file_metrics` of a file; raises when the model is not in it."""
    texts = read_texts(spark, path)
    models = texts.select(F.explode(F.json_object_keys("document")).alias("model"))
    if models.where(F.col("model") == model).isEmpty():
        raise ValueError(f"model {model!r} not found in {path}")
    return file_metrics(texts, model)
