"""Prediction, label and colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geomatch import constants as C


def label(text: Column) -> Column:
    """A label that may arrive as ``1``, ``1.0``, ``"1"`` or ``true``; NULL stays unknown."""
    word = F.lower(text)
    return (
        F.when(word == "true", 1)
        .when(word == "false", 0)
        .otherwise(text.try_cast("double").try_cast("int"))
    )


def predicted_label(given: Column, confidence: Column, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    """The given label, else 1 when the confidence (missing = 0) is strictly above the threshold."""
    above = (F.coalesce(confidence, F.lit(0.0)) > F.lit(threshold)).cast("int")
    return F.coalesce(given, above)


def correctness(prediction: Column, true_label: Column) -> Column:
    """``Correct`` / ``Incorrect``; empty while the true label is unknown."""
    return (
        F.when(prediction == true_label, "Correct")
        .when(true_label.isNotNull(), "Incorrect")
        .otherwise("")
    )


def prediction_text(prediction: Column) -> Column:
    return F.when(prediction == 1, "Match").otherwise("No Match")


def label_text(true_label: Column) -> Column:
    return F.when(true_label == 1, "Match").when(true_label == 0, "No Match").otherwise("Unknown")


def verdict(has_prediction: Column, has_true: Column, has_false: Column) -> Column:
    """Summary sentence of a candidate's pair list."""
    return (
        F.when(~F.coalesce(has_prediction, F.lit(False)), C.VERDICT_NONE)
        .when(has_true, C.VERDICT_TRUE)
        .when(has_false, C.VERDICT_FALSE)
        .otherwise(C.VERDICT_UNKNOWN)
    )


def stage_colour(stage: int, has_features: Column, has_pairs: Column, match_status: Column) -> Column:
    """Colour name of a building at pipeline stage 1, 2 or 3; blue when nothing is known."""
    if stage not in (1, 2, 3):
        raise ValueError("stage must be 1, 2 or 3")
    colour = F.when(has_features, "orange").otherwise("blue")
    if stage >= 2:
        colour = F.when(has_pairs, "yellow").otherwise(colour)
    if stage == 3:
        colour = (
            F.when(match_status == C.TRUE_MATCH, "green")
            .when(match_status == C.FALSE_POSITIVE, "red")
            .when(match_status == C.NO_MATCH, "darkgray")
            .otherwise(colour)
        )
    return colour


def _rgb(triple: tuple[int, int, int]) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(("red", "green", "blue"), triple)))


def _lookup(key: Column, table: dict[str, tuple[int, int, int]], default: tuple[int, int, int]) -> Column:
    choice = None
    for name, triple in table.items():
        condition = key == name
        choice = F.when(condition, _rgb(triple)) if choice is None else choice.when(condition, _rgb(triple))
    return choice.otherwise(_rgb(default))


def stage_rgb(colour: Column) -> Column:
    """``struct<red, green, blue>`` of a stage colour name."""
    return _lookup(colour, C.STAGE_RGB, C.STAGE_RGB["blue"])


def object_type_rgb(object_type: Column) -> Column:
    """``struct<red, green, blue>`` of a city-object type; grey for any other type."""
    return _lookup(object_type, C.OBJECT_TYPE_RGB, C.OTHER_TYPE_RGB)
