"""Candidate pairs: flattening, ranking, predicted matches, badges, best match, load totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch import constants as C
from geomatch.functions import labels
from geomatch.functions.display import percent
from geomatch.functions.ids import numeric_id
from geomatch.operators.lookup import KeyIndex, pair_lookup
from geomatch.operators.ranking import rank_in_group, top_in_group


def with_prediction(pairs: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add ``prediction``, the given label or the one the confidence implies."""
    return pairs.withColumn(
        "prediction", labels.predicted_label(F.col("predicted_label"), F.col("confidence"), threshold)
    )


def flatten_buildings(buildings: DataFrame) -> DataFrame:
    """One row per building over all files: the last file wins, the first one keeps its place.

    ``building_id, file_name, file_pos, n_matches, first_file_pos, first_bld_pos, occurrences``.
    """
    place = F.struct("file_pos", "bld_pos")
    flat = buildings.groupBy("building_id").agg(
        F.max(F.struct("file_pos", "file_name", "n_matches")).alias("last"),
        F.min(place).alias("first"),
        F.count("*").alias("occurrences"),
    )
    return flat.select(
        "building_id",
        "last.file_name",
        "last.file_pos",
        "last.n_matches",
        F.col("first.file_pos").alias("first_file_pos"),
        F.col("first.bld_pos").alias("first_bld_pos"),
        "occurrences",
    )


def flatten_pairs(pairs: DataFrame, buildings: DataFrame) -> DataFrame:
    """Pairs that survive :func:`flatten_buildings`.

    Only the (building, file) entries that a later file overrides are joined, and they are few, so
    Spark can broadcast them at run time and leave the pairs in place.
    """
    last = buildings.groupBy("building_id").agg(F.max("file_pos").alias("_last"), F.count("*").alias("_n"))
    overridden = (
        buildings.join(last.where("_n > 1"), "building_id")
        .where("file_pos < _last")
        .select("building_id", "file_pos")
    )
    return pairs.join(overridden, ["building_id", "file_pos"], "left_anti").select(*pairs.columns)


def place_key(file_pos: str, bld_pos: str) -> Column:
    """Place of a building over all files as one fixed-width number."""
    return F.col(file_pos).cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col(bld_pos)


def load_totals(buildings: DataFrame) -> DataFrame:
    """Totals of a load: all occurrences, and after the last file has won.

    ``total_pairs, occurrences, flat_pairs, distinct_candidates``.
    """
    flat = buildings.groupBy("building_id").agg(
        F.sum("n_matches").alias("pairs"),
        F.count("*").alias("rows"),
        F.max(F.struct("file_pos", "n_matches")).alias("last"),
    )
    return flat.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("total_pairs"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum("last.n_matches"), F.lit(0)).alias("flat_pairs"),
        F.count("*").alias("distinct_candidates"),
    )


def _confidence_order() -> list[Column]:
    return [F.desc("confidence"), F.asc("match_pos")]


def _project_pairs(pairs: DataFrame, request: Column, threshold: float) -> DataFrame:
    return with_prediction(pairs, threshold).withColumns(
        {
            "candidate_id": numeric_id(request),
            "index_id": F.coalesce("index_id", F.lit("")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        }
    )


def _last_file(pairs: DataFrame, buildings: DataFrame | None) -> DataFrame:
    return pairs if buildings is None else flatten_pairs(pairs, buildings)


def ranked_pairs(
    pairs: DataFrame,
    buildings: DataFrame | None = None,
    k: int | None = None,
    threshold: float = C.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Pairs of every building by confidence, ties in list order:
    ``building_id, pair_rank, candidate_id, index_id, prediction, true_label, confidence``.

    With ``buildings``, the last file of a building wins; without, the pairs must already be those of one file for each.
    ``k`` keeps the first ``k`` pairs of each building; by default all are kept.
    """
    rows = _project_pairs(_last_file(pairs, buildings), F.col("building_id"), threshold)
    if k is not None:
        ranked = top_in_group(rows, ["building_id"], _confidence_order(), k, "pair_rank")
    else:
        ranked = rank_in_group(rows, ["building_id"], _confidence_order(), "pair_rank")
    return ranked.select(
        "building_id",
        F.col("pair_rank").cast("bigint").alias("pair_rank"),
        "candidate_id", "index_id", "prediction", "true_label", "confidence",
    )


def building_keys(buildings: DataFrame) -> DataFrame:
    """Lookup keys of the buildings of results: ``key, key_pos``, by file and place in it."""
    return buildings.select(F.col("building_id").alias("key"), place_key("file_pos", "bld_pos").alias("key_pos"))


def pairs_of(
    requests: DataFrame,
    pairs: DataFrame,
    buildings: DataFrame,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    index: KeyIndex | None = None,
) -> DataFrame:
    """Pairs for requested ids (tolerant lookup):
    ``request_id, matched_id, candidate_id, match_pos, index_id, prediction, true_label, confidence,
    total_pairs``; a request without pairs keeps one row with ``total_pairs`` 0.

    Read the rows of a request by ``confidence`` descending, then ``match_pos``. ``index`` is a stored index of
    :func:`building_keys`.
    """
    keys = building_keys(buildings) if index is None else index
    totals = flatten_buildings(buildings).select(
        F.col("building_id").alias("key"), F.col("n_matches").alias("total_pairs")
    )
    found = pair_lookup(requests, keys).join(totals, "key", "left")
    lists = flatten_pairs(pairs, buildings).withColumnRenamed("building_id", "key")
    rows = _project_pairs(found.join(lists, "key", "left"), F.col("request_id"), threshold)
    known = F.col("match_pos").isNotNull()
    return rows.select(
        "request_id",
        F.col("key").alias("matched_id"),
        "candidate_id",
        "match_pos",
        *[F.when(known, F.col(c)).alias(c) for c in ("index_id", "prediction", "true_label", "confidence")],
        F.coalesce("total_pairs", F.lit(0)).alias("total_pairs"),
    )


def predicted_matches(
    pairs: DataFrame, buildings: DataFrame | None = None, threshold: float = C.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Pairs predicted as matches: ``building_id, id, match_id, source, confidence, true_label,
    confidence_text, match_pos``, to be read by confidence descending, then ``match_pos``."""
    return with_prediction(_last_file(pairs, buildings), threshold).where("prediction = 1").select(
        "building_id",
        F.col("index_id").alias("id"),
        F.coalesce("index_id", F.lit("")).alias("match_id"),
        F.lit(C.INDEX_SOURCE_LABEL).alias("source"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "true_label",
        percent(F.col("confidence")).alias("confidence_text"),
        "match_pos",
    )


def matches_of(
    requests: DataFrame,
    pairs: DataFrame,
    buildings: DataFrame,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    index: KeyIndex | None = None,
) -> DataFrame:
    """Predicted matches for requested ids: :func:`pairs_of` kept where the prediction is 1."""
    return pairs_of(requests, pairs, buildings, threshold, index).where("prediction = 1").select(
        "request_id",
        F.col("index_id").alias("match_id"),
        F.lit(C.INDEX_SOURCE_LABEL).alias("source"),
        "confidence",
        "true_label",
        "match_pos",
    )


def pair_badges(pairs: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Texts shown for each pair: prediction, true label, correctness, confidence."""
    rows = with_prediction(pairs, threshold)
    return rows.select(
        "building_id",
        "match_pos",
        "index_id",
        labels.prediction_text(F.col("prediction")).alias("prediction_text"),
        labels.label_text(F.col("true_label")).alias("true_label_text"),
        labels.correctness(F.col("prediction"), F.col("true_label")).alias("badge"),
        percent(F.col("confidence")).alias("confidence_text"),
    )


def comparison_verdicts(
    pairs: DataFrame, buildings: DataFrame | None = None, threshold: float = C.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Verdict sentence of each building's pair list: ``building_id, n_pairs, verdict``. With ``buildings``,
    the list of its last file."""
    predicted = F.col("prediction") == 1
    flags = with_prediction(_last_file(pairs, buildings), threshold).groupBy("building_id").agg(
        F.count("*").alias("n_pairs"),
        F.max(predicted).alias("any"),
        F.max(predicted & (F.col("true_label") == 1)).alias("hit"),
        F.max(predicted & (F.col("true_label") == 0)).alias("miss"),
    )
    return flags.select(
        "building_id", "n_pairs", labels.verdict(F.col("any"), F.col("hit"), F.col("miss")).alias("verdict")
    )


def best_match(pairs: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Most confident pair of each (file, building), first in the list on ties, kept only above the
    threshold: ``file_name, building_id, index_id, confidence, true_label``."""
    best = pairs.groupBy("file_name", "building_id").agg(
        F.max(
            F.struct("confidence", (-F.col("match_pos")).alias("place"), "index_id", "true_label")
        ).alias("best")
    )
    return best.select(
        "file_name", "building_id", "best.index_id", "best.confidence", "best.true_label"
    ).where(F.col("confidence") > threshold)
