"""Explicit schemas (DDL) of the tables that scans produce and operators take."""

FILE_CATALOG = (
    "source string, file_name string, path string, size bigint, mtime timestamp, version_key string"
)

# One row per CityJSON file, with its text.
DOCUMENT = "source string, file_path string, document string"

# A number is in `value`, an array of numbers in `value_array`, anything else as JSON text in
# `value_json`; `pos` is the place in the dictionary.
FEATURE = (
    "building_id string, feature_name string, value double, value_array array<double>, "
    "value_json string, pos bigint"
)

# One row per pair of a building; `file_pos`, `bld_pos` and `match_pos` are the places of the file,
# the building and the pair in the source, in ascending order.
PAIR = (
    "file_name string, file_pos bigint, building_id string, bld_pos bigint, match_pos bigint, "
    "index_id string, confidence double, true_label int, predicted_label int"
)
RESULT_BUILDING = (
    "file_name string, file_pos bigint, building_id string, bld_pos bigint, n_matches bigint"
)

BUILDING_STATUS = (
    "building_id string, has_features boolean, has_pairs boolean, match_status string"
)
