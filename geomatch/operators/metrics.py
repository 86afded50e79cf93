"""Precision, recall and F1 per file, and the summary record of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch import constants as C
from geomatch.functions.display import percent
from geomatch.functions.ids import base_name
from geomatch.operators.lookup import file_lookup
from geomatch.sources.results import METRIC_FIELDS
from geomatch.storage import stored, tasks_of

THRESHOLDS = tuple(i / 20 for i in range(20))
#: Pairs, candidates and true pairs that one task holds.
TASK_ROWS = 250_000
#: Slots of pairs that one task gets, about; many, so that tasks get the same.
SLOTS_OF_TASK = 32


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _evidence(pairs: DataFrame, candidates: DataFrame, truth: DataFrame | None, deduplicate: bool) -> tuple[DataFrame, DataFrame, int]:
    """The listed candidates, ``file_name, building_id, has_truth``; their pairs, ``file_name, building_id, confidence, match_pos, is_true, _slot``;
    and the number of tasks that hold them.

    ``candidates`` has ``file_name, building_id``; ``truth`` has ``building_id, index_id``. With a
    truth table a pair is true when it is in it; without one ``true_label`` decides, and pairs with
    an unknown label count neither as true nor as false. Pairs meet by ``_slot``, a hash of building and index id, to be
    marked, freed of repeats and combined by candidate in one shuffle; the pairs of a candidate lie in many slots.
    """
    keep = stored(
        pairs.select(
            "file_name", "building_id", "index_id", F.col("confidence").cast("double").alias("confidence"),
            F.col("match_pos").cast("bigint").alias("match_pos"), F.col("true_label").cast("int").alias("is_true"),
        )
    )
    listed = stored(candidates.select("file_name", "building_id"))
    rows = keep.count() + listed.count()
    if truth is None:
        with_truth = keep.where("is_true = 1").select("building_id").distinct()
        known = F.lit(False)
    else:
        marks = stored(truth.select("building_id", "index_id"))
        rows += marks.count()
        with_truth = marks.select("building_id").distinct()
        known = F.col("known")
        # Ids that are null are not equal to any.
        keep = keep.withColumns({"is_true": F.lit(0), "known": F.lit(False)}).unionByName(
            marks.dropna().withColumns({"is_true": F.lit(1), "known": F.lit(True)}), allowMissingColumns=True
        )
    tasks = tasks_of(pairs.sparkSession, rows, TASK_ROWS)
    slot = F.pmod(F.xxhash64("building_id", "index_id"), F.lit(tasks * SLOTS_OF_TASK))
    keep = keep.withColumn("_slot", slot).repartition(tasks, "_slot")
    if deduplicate:
        keep = keep.groupBy("_slot", "building_id", "index_id", "file_name", known.alias("known")).agg(
            F.max("confidence").alias("confidence"), F.min("match_pos").alias("match_pos"), F.max("is_true").alias("is_true")
        )
    if truth is not None:
        pair = Window.partitionBy("_slot", "building_id", "index_id")
        keep = keep.withColumn("is_true", F.max("is_true").over(pair)).where(~known)
    listed = (
        listed.repartition(tasks, "building_id")
        .distinct()
        .join(with_truth.withColumn("has_truth", F.lit(1)), "building_id", "left")
        .select("file_name", "building_id", F.coalesce("has_truth", F.lit(0)).alias("has_truth"))
    )
    return listed, keep.select("file_name", "building_id", "confidence", "match_pos", "is_true", "_slot"), tasks


def _by_candidate(listed: DataFrame, paired: DataFrame, tasks: int, **counts: Column) -> DataFrame:
    """A row for each (file, candidate): ``file_name, building_id, listed, has_truth, blocked, best`` and counts over its pairs.

    Pairs are combined by slot where they lie, then by candidate, so a candidate or file with very many pairs is no problem.
    """
    key = ["file_name", "building_id"]
    combined = paired.groupBy("_slot", *key).agg(F.max("is_true").alias("blocked"), _best_pair(), *[c.alias(n) for n, c in counts.items()])
    combined = combined.drop("_slot").withColumns({"listed": F.lit(0), "has_truth": F.lit(0)})
    rows = combined.unionByName(listed.withColumn("listed", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(tasks, *key).groupBy(*key).agg(
        F.max("listed").alias("listed"),
        F.max("has_truth").alias("has_truth"),
        F.coalesce(F.max("blocked"), F.lit(0)).alias("blocked"),
        F.max("best").alias("best"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
    )


def _best_pair() -> Column:
    """The pair of the highest confidence, the first of equals."""
    pair = F.struct("confidence", (-F.col("match_pos")).alias("place"), F.col("is_true").alias("is_true"))
    return F.max(F.when(F.col("confidence").isNotNull(), pair)).alias("best")


def candidate_outcomes(
    pairs: DataFrame,
    candidates: DataFrame,
    truth: DataFrame | None = None,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    deduplicate: bool = True,
) -> DataFrame:
    """What each (file, candidate) contributes to the metrics of its file.

    Both strategies come out of this one aggregation.
    """
    above = F.col("confidence") > threshold
    grouped = _by_candidate(
        *_evidence(pairs, candidates, truth, deduplicate),
        threshold_true_positives=F.count_if(above & (F.col("is_true") == 1)),
        threshold_false_positives=F.count_if(above & (F.col("is_true") == 0)),
    )
    kept = F.coalesce(F.col("best.confidence") > threshold, F.lit(False))
    return grouped.select(
        "file_name",
        "building_id",
        "listed",
        "has_truth",
        "blocked",
        "threshold_true_positives",
        "threshold_false_positives",
        (kept & F.coalesce(F.col("best.is_true") == 1, F.lit(False))).cast("bigint").alias("best_match_true_positives"),
        (kept & F.coalesce(F.col("best.is_true") == 0, F.lit(False))).cast("bigint").alias("best_match_false_positives"),
    )


def metrics_from_pairs(
    pairs: DataFrame,
    candidates: DataFrame,
    truth: DataFrame | None = None,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    deduplicate: bool = True,
) -> DataFrame:
    """Metrics record of every file (``file_name`` and the metric fields), both strategies."""
    outcomes = candidate_outcomes(pairs, candidates, truth, threshold, deduplicate)
    counted = ("true_positives", "false_positives")
    sums = outcomes.groupBy("file_name").agg(
        F.sum("listed").alias("candidates_in_file"),
        F.sum("has_truth").alias("potential_matches_in_index"),
        F.sum("blocked").alias("potential_matches_in_blocking"),
        *[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in C.STRATEGIES for c in counted],
    )
    return _with_ratios(sums).select("file_name", *METRIC_FIELDS)


def _with_ratios(sums: DataFrame) -> DataFrame:
    """Adds what follows from the counts of a file."""
    m_index, m_block = F.col("potential_matches_in_index"), F.col("potential_matches_in_blocking")
    columns = {}
    for s in C.STRATEGIES:
        tp, fp = F.col(f"{s}_true_positives"), F.col(f"{s}_false_positives")
        missed_in, missed_out = m_block - tp, m_index - m_block
        precision, recall = _ratio(tp, tp + fp), _ratio(tp, m_index)
        columns |= {
            f"{s}_precision": precision,
            f"{s}_recall_overall": recall,
            f"{s}_recall_blocking": _ratio(m_block, m_index),
            f"{s}_recall_matching": _ratio(tp, m_block),
            f"{s}_f1_score": _ratio(2.0 * precision * recall, precision + recall),
            f"{s}_total_false_negatives": missed_in + missed_out,
            f"{s}_false_negatives_in_blocking": missed_in,
            f"{s}_false_negatives_not_in_blocking": missed_out,
        }
    return sums.withColumns(columns)


def threshold_curve(
    pairs: DataFrame,
    candidates: DataFrame,
    truth: DataFrame | None = None,
    thresholds: Sequence[float] = THRESHOLDS,
    deduplicate: bool = True,
) -> DataFrame:
    """:func:`metrics_from_pairs` at every one of the thresholds, from one pass over the pairs: ``file_name, threshold`` and the metric fields.

    Pairs are counted once, by file and by how many thresholds they are above; the best pair of a candidate does not depend on the threshold, so it is
    counted alike. What lies above a threshold is a suffix sum over these counts, a row for each file and threshold. A threshold without pairs above it keeps its row.
    """
    steps = sorted(set(thresholds))
    level = lambda c: F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.coalesce(c > t, F.lit(False))))
    listed, paired, tasks = _evidence(pairs, candidates, truth, deduplicate)
    paired = stored(paired)
    names = [f"{s}_{c}" for s in C.STRATEGIES for c in ("true_positives", "false_positives")]

    def counted(rows: DataFrame, strategy: str, confidence: str, is_true: str) -> DataFrame:
        own = {f"{strategy}_true_positives": F.count_if(F.col(is_true) == 1), f"{strategy}_false_positives": F.count_if(F.col(is_true) == 0)}
        counts = [own.get(n, F.lit(0).cast("bigint")).alias(n) for n in names]
        return rows.groupBy("file_name", level(F.col(confidence)).alias("level")).agg(*counts)

    by_candidate = stored(_by_candidate(listed, paired.repartition(tasks, "_slot"), tasks))
    counts = counted(paired, "threshold", "confidence", "is_true").unionByName(counted(by_candidate, "best_match", "best.confidence", "best.is_true"))
    # A pair above n thresholds counts for the n lowest of them.
    above = counts.where("level > 0").select("file_name", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("step"), *names)
    above = above.groupBy("file_name", "step").agg(*[F.sum(n).alias(n) for n in names])
    totals = by_candidate.groupBy("file_name").agg(
        F.sum("listed").alias("candidates_in_file"), F.sum("has_truth").alias("potential_matches_in_index"), F.sum("blocked").alias("potential_matches_in_blocking")
    )
    every = totals.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("step", "threshold"))
    sums = every.join(above, ["file_name", "step"], "left").fillna(0, names)
    return _with_ratios(sums).select("file_name", "threshold", *METRIC_FIELDS)


def strategy_metrics(metrics: DataFrame, strategy: str) -> DataFrame:
    """The fields of one strategy."""
    if strategy not in C.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return metrics.select(
        "file_name", *C.FILE_COUNTS, *[c for c in METRIC_FIELDS if c.startswith(f"{strategy}_")]
    )


def pair_totals(buildings: DataFrame) -> DataFrame:
    """Pairs of each file: ``file_name, total_pairs``."""
    return buildings.groupBy("file_name").agg(F.sum("n_matches").alias("total_pairs"))


def _summary_columns() -> dict[str, Column]:
    """Fields of the summary record, in their order, over a metrics record and ``total_pairs``."""
    c = F.col
    return {
        "total_buildings": c("candidates_in_file"),
        "total_buildings_in_file": c("candidates_in_file"),
        "potential_true_matches": c("potential_matches_in_blocking"),
        "potential_true_matches_not_in_bkafi": c("potential_matches_in_index") - c("potential_matches_in_blocking"),
        "buildings_with_true_match_in_bkafi": c("potential_matches_in_blocking"),
        "found_true_matches": c("threshold_true_positives"),
        "recall": c("threshold_recall_matching"),
        "precision": c("threshold_precision"),
        "precision_conf_threshold": c("threshold_precision"),
        "precision_highest_conf": c("best_match_precision"),
        "predicted_with_conf_threshold": c("threshold_true_positives") + c("threshold_false_positives"),
        "predicted_highest_conf": c("best_match_true_positives") + c("best_match_false_positives"),
        "true_positive": c("threshold_true_positives"),
        "false_positive": c("threshold_false_positives"),
        "false_negative": c("threshold_total_false_negatives"),
        "false_negative_in_blocking": c("threshold_false_negatives_in_blocking"),
        "false_negative_not_in_blocking": c("threshold_false_negatives_not_in_blocking"),
        "best_match_false_negative_in_blocking": c("best_match_false_negatives_in_blocking"),
        "best_match_false_negative_not_in_blocking": c("best_match_false_negatives_not_in_blocking"),
        "best_match_total_false_negatives": c("best_match_total_false_negatives"),
        "true_matches_not_in_blocking": c("threshold_false_negatives_not_in_blocking"),
        "total_pairs": F.coalesce(c("total_pairs"), F.lit(0)),
        "overall_recall": c("threshold_recall_overall"),
        "blocking_recall": c("threshold_recall_blocking"),
        "matching_recall": c("threshold_recall_matching"),
        "f1_score": c("best_match_f1_score"),
        **{
            name: c(name)
            for name in (
                "best_match_precision",
                "best_match_recall_overall",
                "best_match_recall_blocking",
                "best_match_recall_matching",
                "best_match_f1_score",
                "best_match_true_positives",
                "best_match_false_positives",
            )
        },
    }


def file_summary(
    requests: DataFrame, metrics: DataFrame, buildings: DataFrame, prefer_exact: bool = False
) -> DataFrame:
    """Summary record of each requested file path: ``request_id, metrics_file`` and 33 fields.

    ``metrics`` has ``file_name, file_pos`` and the metric fields. Requests without a metrics record
    drop out. ``total_pairs`` counts the file whose name equals the requested base name.
    """
    found = file_lookup(requests, metrics, prefer_exact).where(F.col("key").isNotNull())
    records = found.select("request_id", F.col("key").alias("file_name")).join(metrics, "file_name")
    totals = pair_totals(buildings).withColumnRenamed("file_name", "_base")
    joined = records.withColumn("_base", base_name(F.col("request_id"))).join(totals, "_base", "left")
    return joined.select(
        "request_id",
        F.col("file_name").alias("metrics_file"),
        *[column.alias(name) for name, column in _summary_columns().items()],
    )


def summary_texts(summary: DataFrame) -> DataFrame:
    """Percentages of a summary as shown: two decimals."""
    shown = ("overall_recall", "blocking_recall", "matching_recall", "precision_conf_threshold",
             "precision_highest_conf", "best_match_f1_score")
    return summary.select("request_id", *[percent(F.col(c), 2).alias(c) for c in shown])
