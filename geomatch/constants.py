"""Names, texts and numbers that results must carry exactly."""

# Prediction threshold; a confidence must be strictly above it.
CONFIDENCE_THRESHOLD = 0.5

# Digits that make a run long enough to count as a building number, and the padded width.
MIN_ID_DIGITS = 10
PADDED_ID_WIDTH = 16
ID_PREFIX = "bag_"

# Label written on every predicted match.
INDEX_SOURCE_LABEL = "Source B"

# Building status values.
TRUE_MATCH = "true_match"
FALSE_POSITIVE = "false_positive"
NO_MATCH = "no_match"

# Verdict texts of a candidate's pair list.
VERDICT_NONE = "No matches were found in the BKAFI pairs"
VERDICT_TRUE = "True match was found"
VERDICT_FALSE = "False positive match was found"
VERDICT_UNKNOWN = "Match predictions found (true labels unknown)"

# Stage colours (name -> red, green, blue).
STAGE_RGB = {
    "blue": (116, 151, 223),
    "orange": (255, 152, 0),
    "yellow": (255, 235, 59),
    "green": (76, 175, 80),
    "red": (244, 67, 54),
    "darkgray": (97, 97, 97),
}

# Colours by city-object type (type -> red, green, blue) and the colour of any other type.
OBJECT_TYPE_RGB = {
    "Building": (116, 151, 223),
    "BuildingPart": (116, 151, 223),
    "BuildingInstallation": (116, 151, 223),
    "Bridge": (153, 153, 153),
    "BridgePart": (153, 153, 153),
    "Road": (153, 153, 153),
    "WaterBody": (77, 166, 255),
    "PlantCover": (57, 172, 57),
    "LandUse": (255, 255, 179),
}
OTHER_TYPE_RGB = (136, 136, 136)

# Height of an object whose attributes or geometry give none.
DEFAULT_HEIGHT = 10.0

# Degrees approximation of metric coordinates around a fixed origin.
ORIGIN_LON = 4.3007
ORIGIN_LAT = 52.0705
METRES_PER_DEGREE = 111320.0

# A side shorter than this many degrees marks geographic bounds as a point.
MIN_BOUNDS_DEGREES = 0.0001

# Footprints outside these sizes are scaled to the target size for display.
SCALE_ABOVE = 100.0
SCALE_BELOW = 0.1
SCALE_TARGET = 50.0

# CityJSON version assumed when a document gives none.
DEFAULT_CITYJSON_VERSION = "1.0"

# Metrics summary: the model read by default and the fields of one file's record.
DEFAULT_MODEL = "XGBClassifier"
STRATEGIES = ("threshold", "best_match")
STRATEGY_RATIOS = ("precision", "recall_overall", "recall_blocking", "recall_matching", "f1_score")
STRATEGY_COUNTS = (
    "true_positives",
    "false_positives",
    "total_false_negatives",
    "false_negatives_in_blocking",
    "false_negatives_not_in_blocking",
)
FILE_COUNTS = ("candidates_in_file", "potential_matches_in_index", "potential_matches_in_blocking")

# Directory layout of a data root: the city folder, then the source folders by priority.
CITY_FOLDER = "RawCitiesData/The Hague"
SOURCE_ROOTS = {
    "A": (f"{CITY_FOLDER}/Source A", f"{CITY_FOLDER}/SourceA", "Source A", "SourceA", ""),
    "B": (f"{CITY_FOLDER}/Source B", f"{CITY_FOLDER}/SourceB", "Source B", "SourceB", ""),
}
# Folders below the city folder in which a bare file name is looked up, in order.
NAME_LOOKUP_FOLDERS = ("Source A", "Source B", "SourceA", "SourceB")
