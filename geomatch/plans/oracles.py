"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

_PAD = "lpad({0}::VARCHAR, 16, '0')"


def _pad(key: str) -> str:
    return _PAD.format(key)


_REQUESTS = f"""
requests AS (
  SELECT unnest(['bag_' || {_pad('c_custkey')}, {_pad('c_custkey')}, c_custkey::VARCHAR, c_name]) AS request_id
  FROM customer)"""


def _numeric(x: str, raw: bool = False) -> str:
    suffix = x if raw else f"CASE WHEN contains({x}, '_') THEN list_last(string_split({x}, '_')) ELSE {x} END"
    run = f"regexp_extract({x}, '[0-9]{{10,}}')"
    return f"CASE WHEN {run} <> '' THEN {run} ELSE {suffix} END"


def _run(x: str) -> str:
    return f"nullif(regexp_extract({x}, '[0-9]{{10,}}'), '')"


# --- pairs -------------------------------------------------------------------------------------

_LINES = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS match_pos FROM lineitem),
truth_keys AS (
  SELECT * FROM (
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN lowest
                            ELSE o_orderkey % (SELECT count(*) FROM part) END AS true_key
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS lowest FROM lineitem GROUP BY 1)
      ON l_orderkey = o_orderkey) WHERE true_key IS NOT NULL)"""

_PAIRS = f"""{_LINES},
raw_pairs AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_linestatus,
    'tile_' || (l_orderkey % 25) || '.json' AS file_name, 'bag_' || {_pad('l_orderkey')} AS building_id,
    match_pos, {_pad('l_partkey')} AS index_id,
    l_discount * 10 AS confidence,
    CASE WHEN l_tax <> 0 THEN CASE WHEN true_key = l_partkey THEN 1 ELSE 0 END END AS true_label,
    CASE WHEN true_key = l_partkey THEN 1 ELSE 0 END AS is_true,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS predicted_label
  FROM lines LEFT JOIN truth_keys ON o_orderkey = l_orderkey),
pairs AS (
  SELECT *, coalesce(predicted_label, CASE WHEN confidence > 0.5 THEN 1 ELSE 0 END) AS prediction
  FROM raw_pairs)"""

_RANKED = f"""WITH {_PAIRS}
SELECT building_id, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, match_pos)::BIGINT AS pair_rank,
  {_pad('k')} AS candidate_id, index_id, prediction, true_label, confidence
FROM pairs"""

# Pairs of the last file of each building, where files are named by the line status.
_LAST = "(SELECT * FROM pairs JOIN (SELECT k, max(l_linestatus) AS l FROM pairs GROUP BY k) AS newest USING (k) WHERE l_linestatus = l) AS pairs"

# Status of building k from its pairs.
_STATUS_CASE = """CASE WHEN bool_or(prediction = 1 AND true_label = 1) THEN 'true_match'
       WHEN bool_or(prediction = 1 AND true_label = 0) THEN 'false_positive' ELSE 'no_match' END"""

_STATUS = f"""{_PAIRS},
by_key AS (SELECT k, {_STATUS_CASE} AS match_status FROM pairs GROUP BY k),
paired AS (SELECT o_orderkey AS k, match_status FROM orders LEFT JOIN by_key ON k = o_orderkey),
named AS (
  SELECT 'bag_' || {_pad('k')} AS building_id, match_status FROM paired
  UNION ALL SELECT {_pad('k')}, match_status FROM paired),
featured AS (SELECT DISTINCT {_pad('vec_id')} AS building_id FROM embeddings),
status AS (
  SELECT coalesce(n.building_id, f.building_id) AS building_id, f.building_id IS NOT NULL AS has_features,
    n.building_id IS NOT NULL AS has_pairs, n.match_status
  FROM named n FULL JOIN featured f ON n.building_id = f.building_id)"""


def _percent(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {_nudged(x + ' * 100.0', digits)}) || '%'"


def _nudged(x: str, digits: int) -> str:
    scaled = f"(({x}) * {2 ** (digits + 1)}.0)"
    return (
        f"CASE WHEN {scaled} = floor({scaled}) AND {scaled} % 2 <> 0 "
        f"THEN ({x}) + sign({x}) * 1e-{digits + 2} ELSE {x} END"
    )


# --- metrics -----------------------------------------------------------------------------------


def _metrics(is_true: str, has_truth: str) -> str:
    """``sums`` per file for a given notion of a true pair and of a candidate with a counterpart."""
    return f"""{_PAIRS},
single AS (
  SELECT k, p, max(confidence) AS confidence, min(match_pos) AS match_pos, max(is_true) AS is_true, max(true_label) AS true_label
  FROM pairs GROUP BY k, p),
cand AS (
  SELECT o_orderkey AS k, 'tile_' || (o_orderkey % 25) || '.json' AS file_name,
    CASE WHEN o_orderkey IN ({has_truth}) THEN 1 ELSE 0 END AS has_truth FROM orders),
best AS (
  SELECT k, CASE WHEN confidence > 0.5 AND {is_true} = 1 THEN 1 ELSE 0 END AS tp,
    CASE WHEN confidence > 0.5 AND {is_true} = 0 THEN 1 ELSE 0 END AS fp
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, match_pos) AS r FROM single) WHERE r = 1),
per_cand AS (
  SELECT k, coalesce(max({is_true}), 0) AS blocked,
    count(*) FILTER (WHERE confidence > 0.5 AND {is_true} = 1) AS tp,
    count(*) FILTER (WHERE confidence > 0.5 AND {is_true} = 0) AS fp
  FROM single GROUP BY k),
sums AS (
  SELECT file_name, count(*) AS candidates_in_file, sum(has_truth)::BIGINT AS potential_matches_in_index,
    coalesce(sum(blocked), 0)::BIGINT AS potential_matches_in_blocking,
    coalesce(sum(p.tp), 0)::BIGINT AS threshold_true_positives, coalesce(sum(p.fp), 0)::BIGINT AS threshold_false_positives,
    coalesce(sum(b.tp), 0)::BIGINT AS best_match_true_positives, coalesce(sum(b.fp), 0)::BIGINT AS best_match_false_positives
  FROM cand LEFT JOIN per_cand p USING (k) LEFT JOIN best b USING (k) GROUP BY file_name)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def _strategy_columns(s: str) -> list[tuple[str, str]]:
    tp, fp = f"{s}_true_positives", f"{s}_false_positives"
    mi, mb = "potential_matches_in_index", "potential_matches_in_blocking"
    p, r = f"({_ratio(tp, f'{tp} + {fp}')})", f"({_ratio(tp, mi)})"
    return [
        (f"{s}_precision", p),
        (f"{s}_recall_overall", r),
        (f"{s}_recall_blocking", _ratio(mb, mi)),
        (f"{s}_recall_matching", _ratio(tp, mb)),
        (f"{s}_f1_score", f"CASE WHEN {p} + {r} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END"),
        (tp, tp),
        (fp, fp),
        (f"{s}_total_false_negatives", f"{mb} - {tp} + ({mi} - {mb})"),
        (f"{s}_false_negatives_in_blocking", f"{mb} - {tp}"),
        (f"{s}_false_negatives_not_in_blocking", f"{mi} - {mb}"),
    ]


_FILE_COUNTS = ["candidates_in_file", "potential_matches_in_index", "potential_matches_in_blocking"]
_BY_TRUTH = _metrics("is_true", "SELECT o_orderkey FROM truth_keys")
_BY_LABEL = _metrics("true_label", "SELECT k FROM pairs WHERE true_label = 1")


def _metric_select(with_clause: str, strategies: tuple[str, ...]) -> str:
    columns = [(c, c) for c in _FILE_COUNTS] + [c for s in strategies for c in _strategy_columns(s)]
    return f"WITH {with_clause} SELECT file_name, " + ", ".join(f"{e} AS {n}" for n, e in columns) + " FROM sums"


# Every threshold counted by itself.
_CURVE = f"""WITH {_BY_TRUTH},
t AS (SELECT unnest([{', '.join(f"{i / 20!r}::DOUBLE" for i in range(20))}]) AS threshold),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, match_pos) AS r FROM single) WHERE r = 1),
curve AS (
  SELECT s.file_name, threshold, candidates_in_file, potential_matches_in_index, potential_matches_in_blocking,
    (SELECT count(*) FROM single WHERE 'tile_' || (k % 25) || '.json' = s.file_name AND confidence > threshold AND is_true = 1) AS threshold_true_positives,
    (SELECT count(*) FROM single WHERE 'tile_' || (k % 25) || '.json' = s.file_name AND confidence > threshold AND is_true = 0) AS threshold_false_positives,
    (SELECT count(*) FROM tops WHERE 'tile_' || (k % 25) || '.json' = s.file_name AND confidence > threshold AND is_true = 1) AS best_match_true_positives,
    (SELECT count(*) FROM tops WHERE 'tile_' || (k % 25) || '.json' = s.file_name AND confidence > threshold AND is_true = 0) AS best_match_false_positives
  FROM sums s, t)
SELECT file_name, threshold, """ + ", ".join(
    f"{e} AS {n}" for n, e in [(c, c) for c in _FILE_COUNTS] + [c for s in ("threshold", "best_match") for c in _strategy_columns(s)]
) + " FROM curve"

_RECORDS = "records AS (" + _metric_select("x AS (SELECT 1)", ("threshold", "best_match")).replace(
    "WITH x AS (SELECT 1) ", ""
) + ")"

# The first record whose name contains, or is contained in, the requested name. File names are
# tile_0.json ... tile_24.json, ordered by number.
_SUMMARY = f"""{_BY_TRUTH},
{_RECORDS},
totals AS (SELECT file_name, count(*) AS total_pairs FROM pairs GROUP BY 1),
names AS (SELECT DISTINCT 'tile_' || (o_orderkey % 25) || '.json' AS base, o_orderkey % 25 AS pos FROM orders),
matched AS (
  SELECT 'RawCitiesData/Source A/' || n.base AS request_id, n.base,
    arg_min(m.base, m.pos) AS metrics_file
  FROM names n JOIN names m ON contains(n.base, m.base) OR contains(m.base, n.base) GROUP BY ALL),
summary AS (
  SELECT request_id, metrics_file, candidates_in_file AS total_buildings, candidates_in_file AS total_buildings_in_file,
    potential_matches_in_blocking AS potential_true_matches,
    potential_matches_in_index - potential_matches_in_blocking AS potential_true_matches_not_in_bkafi,
    potential_matches_in_blocking AS buildings_with_true_match_in_bkafi,
    threshold_true_positives AS found_true_matches, threshold_recall_matching AS recall,
    threshold_precision AS precision, threshold_precision AS precision_conf_threshold,
    best_match_precision AS precision_highest_conf,
    threshold_true_positives + threshold_false_positives AS predicted_with_conf_threshold,
    best_match_true_positives + best_match_false_positives AS predicted_highest_conf,
    threshold_true_positives AS true_positive, threshold_false_positives AS false_positive,
    threshold_total_false_negatives AS false_negative,
    threshold_false_negatives_in_blocking AS false_negative_in_blocking,
    threshold_false_negatives_not_in_blocking AS false_negative_not_in_blocking,
    best_match_false_negatives_in_blocking AS best_match_false_negative_in_blocking,
    best_match_false_negatives_not_in_blocking AS best_match_false_negative_not_in_blocking,
    best_match_total_false_negatives, threshold_false_negatives_not_in_blocking AS true_matches_not_in_blocking,
    coalesce(total_pairs, 0) AS total_pairs, threshold_recall_overall AS overall_recall,
    threshold_recall_blocking AS blocking_recall, threshold_recall_matching AS matching_recall,
    best_match_f1_score AS f1_score, best_match_precision, best_match_recall_overall, best_match_recall_blocking,
    best_match_recall_matching, best_match_f1_score, best_match_true_positives, best_match_false_positives
  FROM matched JOIN records r ON r.file_name = metrics_file LEFT JOIN totals t ON t.file_name = base)"""

# --- lookups -----------------------------------------------------------------------------------

_FEATURE_LOOKUP = f"""WITH {_REQUESTS},
keys AS (SELECT {_pad('vec_id')} AS key, min(vec_id) AS pos FROM embeddings GROUP BY 1),
ids AS (SELECT request_id, {_numeric('request_id')} AS v1 FROM (SELECT DISTINCT request_id FROM requests)),
variants AS (
  SELECT request_id, v1, ltrim(v1, '0') AS v2, CASE WHEN length(v1) < 16 THEN lpad(v1, 16, '0') ELSE v1 END AS v3 FROM ids),
hits AS (
  SELECT request_id, key, pos, 0 AS tier FROM variants JOIN keys ON key = request_id
  UNION ALL SELECT request_id, key, pos, 1 FROM variants JOIN keys ON key = v1
  UNION ALL SELECT request_id, key, pos, 2 FROM variants JOIN keys ON contains(key, v1) OR contains(v1, key) WHERE v1 <> ''
  UNION ALL SELECT request_id, key, pos, 3 FROM variants JOIN keys ON contains(key, v2) OR contains(v2, key) WHERE v2 <> ''
  UNION ALL SELECT request_id, key, pos, 4 FROM variants JOIN keys ON contains(key, v3) OR contains(v3, key) WHERE v3 <> ''),
best AS (SELECT request_id, arg_min(key, (tier, pos)) AS key, min(tier) AS tier FROM hits GROUP BY 1)
SELECT ids.request_id, best.key, best.tier::INT AS tier FROM ids LEFT JOIN best USING (request_id)"""


def _pair_lookup(order: str) -> str:
    return f"""{_REQUESTS},
keys AS (SELECT 'bag_' || {_pad('o_orderkey')} AS key, {order} AS pos, o_orderkey AS k FROM orders),
ids AS (SELECT request_id, {_numeric('request_id')} AS v1 FROM (SELECT DISTINCT request_id FROM requests)),
hits AS (
  SELECT request_id, key, pos, 0 AS tier FROM ids JOIN keys ON key = v1
  UNION ALL SELECT request_id, key, pos, 1 FROM ids JOIN keys ON contains(key, v1) OR contains(v1, key) WHERE v1 <> ''),
best AS (SELECT request_id, arg_min(key, (tier, pos)) AS key, min(tier) AS tier FROM hits GROUP BY 1),
found AS (SELECT ids.request_id, ids.v1, best.key, best.tier::INT AS tier FROM ids LEFT JOIN best USING (request_id))"""


_OBJECTS = f"""
objects AS (
  SELECT 'A' AS source, 'RawCitiesData/The Hague/Source A/tile_' || (o_orderkey // 50) || '.json' AS file_path,
    o_orderkey AS obj_pos, 'bag_' || {_pad('o_orderkey')} AS object_id, o_orderkey % 11 = 10 AS is_empty FROM orders
  UNION ALL
  SELECT 'B', 'RawCitiesData/The Hague/Source B/tile_' || (p_partkey // 50) || '.json',
    p_partkey, {_pad('p_partkey')}, p_partkey % 11 = 10 FROM part)"""

# --- geometry of the boxes ---------------------------------------------------------------------

_BOXES = f"""
boxes AS (
  SELECT *, CASE WHEN turn = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS sc,
    CASE WHEN turn = 1 THEN 0 ELSE 1000 END::DOUBLE AS tx, CASE WHEN turn = 1 THEN 0 ELSE 2000 END::DOUBLE AS ty,
    CASE WHEN turn = 1 THEN 0 ELSE 10 END::DOUBLE AS tz,
    row_number() OVER (PARTITION BY k // 50 ORDER BY k) - 1 AS pos
  FROM (
    SELECT p_partkey AS k, p_size AS s, p_size % 7 AS h, (p_partkey // 50) % 3 AS turn, p_name, p_type,
      'RawCitiesData/The Hague/Source B/tile_' || (p_partkey // 50) || '.json' AS file_path,
      {_pad('p_partkey')} AS object_id, (p_partkey % 1000) * 20 AS x0, (p_partkey // 1000) * 20 AS y0
    FROM part)),
corners AS (
  SELECT b.*, c.j, x0 + c.fx * s + c.ax AS vx, y0 + c.fy * s + c.ay AS vy, c.fz * h + c.az AS vz
  FROM boxes b, (VALUES
    (0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (2, 1, 1, 0, 0, 0, 0), (3, 0, 1, 0, 0, 0, 0),
    (4, 0, 0, 1, 0, 0, 0), (5, 1, 0, 1, 0, 0, 0), (6, 1, 1, 1, 0, 0, 0), (7, 0, 1, 1, 0, 0, 0),
    (8, 0, 0, 0, 1, 1, -5), (9, 0, 0, 0, 2, 1, -5), (10, 0, 0, 0, 1, 2, -5), (11, 0, 0, 0, 1, 1, 100)
  ) AS c(j, fx, fy, fz, ax, ay, az)),
placed AS (
  SELECT *, pos * 12 + j AS vertex_idx, vx * sc + tx AS x, vy * sc + ty AS y, vz * sc + tz AS z FROM corners),
rings AS (
  SELECT * FROM (VALUES
    (0, 'Solid', 0, 0, [0, 1, 2, 3]), (0, 'Solid', 0, 1, [4, 5, 6, 7]), (0, 'Solid', 0, 2, [0, 1, 5, 4]),
    (0, 'Solid', 0, 3, [1, 2, 6, 5]), (0, 'Solid', 0, 4, [2, 3, 7, 6]), (0, 'Solid', 0, 5, [3, 0, 4, 7]),
    (0, 'Solid', 1, 0, [8, 9, 10]), (0, 'Solid', 1, 1, [8, 9, 11]), (0, 'Solid', 1, 2, [9, 10, 11]), (0, 'Solid', 1, 3, [10, 8, 11]),
    (1, 'MultiSurface', NULL, 0, [0, 0, 1, 2, 2, 3]), (1, 'MultiSurface', NULL, 1, [4, 5, 6])
  ) AS r(geom_idx, geom_type, shell, face, idx)),
ring_points AS (
  SELECT geom_idx, geom_type, shell, face, unnest(idx) AS j, generate_subscripts(idx, 1) - 1 AS vpos FROM rings),
spans AS (
  SELECT file_path, object_id, g.geom_idx, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x,
    max(y) AS max_y, max(z) AS max_z, max(z) - min(z) AS height
  FROM placed JOIN (SELECT DISTINCT geom_idx, j FROM ring_points WHERE coalesce(shell, 0) = 0) g USING (j)
  GROUP BY ALL)"""

_KIND = """CASE p_type WHEN 'LARGE' THEN 'Building' WHEN 'SMALL' THEN 'BuildingPart' WHEN 'MEDIUM' THEN 'PlantCover'
  WHEN 'PROMO' THEN 'WaterBody' ELSE p_type END"""

_FILE_BOXES = f"""{_BOXES},
file_boxes AS (
  SELECT file_path, CASE turn WHEN 0 THEN 'urn:ogc:def:crs:EPSG::7415' WHEN 2 THEN 'EPSG:4326' END AS crs,
    CASE WHEN turn = 2 THEN -170.0 ELSE min(x) END::DOUBLE AS min_x, CASE WHEN turn = 2 THEN -80.0 ELSE min(y) END::DOUBLE AS min_y,
    CASE WHEN turn = 2 THEN 0.0 ELSE min(z) END::DOUBLE AS min_z, CASE WHEN turn = 2 THEN 170.0 ELSE max(x) END::DOUBLE AS max_x,
    CASE WHEN turn = 2 THEN 80.0 ELSE max(y) END::DOUBLE AS max_y, CASE WHEN turn = 2 THEN 60.0 ELSE max(z) END::DOUBLE AS max_z
  FROM placed GROUP BY file_path, turn),
geo AS (
  SELECT file_path, crs = 'EPSG:4326' AS g, min_x, min_y, max_x, max_y FROM file_boxes),
bounds AS (
  SELECT file_path, CASE WHEN g THEN min_y ELSE 52.0705::DOUBLE + min_y / 111320.0::DOUBLE END AS min_lat,
    CASE WHEN g THEN min_x ELSE 4.3007::DOUBLE + min_x / 111320.0::DOUBLE END AS min_lon,
    CASE WHEN g THEN max_y ELSE 52.0705::DOUBLE + max_y / 111320.0::DOUBLE END AS max_lat,
    CASE WHEN g THEN max_x ELSE 4.3007::DOUBLE + max_x / 111320.0::DOUBLE END AS max_lon FROM geo)"""

_CITYJSON_HEAD = """CASE WHEN turn <> 0 THEN '"version":"1.1"' ELSE '"version":"1.0"' END"""

_CENTER = "(p0.{a} + p1.{a} + p2.{a} + p3.{a}) / 4"

_EXTRACT = f"""WITH {_BOXES},
own AS (
  SELECT k, '[' || string_agg('[' || vx || ',' || vy || ',' || vz || ']', ',' ORDER BY j) || ']' AS vertices
  FROM placed GROUP BY k)
SELECT 'bag_' || object_id AS request_id, object_id,
  '{{"type":"CityJSON",' || {_CITYJSON_HEAD} || ',"CityObjects":{{"' || object_id || '":{{"type":"' || {_KIND} || '","attributes":{{"height":' || s ||
  CASE WHEN s % 3 <> 0 THEN ',"measuredHeight":' || (s % 5) ELSE '' END ||
  CASE WHEN s % 2 = 0 THEN ',"name":"' || p_name || '"' ELSE '' END ||
  '}},"geometry":[' ||
  '{{"boundaries":[[[[0,1,2,3]],[[4,5,6,7]],[[0,1,5,4]],[[1,2,6,5]],[[2,3,7,6]],[[3,0,4,7]]],[[[8,9,10]],[[8,9,11]],[[9,10,11]],[[10,8,11]]]],"type":"Solid"}},' ||
  '{{"boundaries":[[[0,0,1,2,2,3]],[[4,5,6,-1]]],"type":"MultiSurface"}},' ||
  '{{"boundaries":[[[' || (pos * 12 + 4) || ',' || (pos * 12 + 5) || ',' || (pos * 12 + 6) || ',' || (pos * 12 + 7) || ']]],"type":"CompositeSurface"}}]}}}},' ||
  '"vertices":' || vertices ||
  CASE turn WHEN 0 THEN ',"metadata":{{"referenceSystem":"urn:ogc:def:crs:EPSG::7415"}}'
            WHEN 2 THEN ',"metadata":{{"geographicalExtent":[-170,-80,0,170,80,60],"referenceSystem":"EPSG:4326"}}' ELSE '' END ||
  CASE WHEN turn <> 1 THEN ',"transform":{{"scale":[0.5,0.5,0.5],"translate":[1000,2000,10]}}' ELSE '' END || '}}' AS cityjson
FROM boxes JOIN own USING (k)"""

# The same objects for source A, whose boxes are made from orders.
_EXTRACT_A = (
    _EXTRACT.replace("p_size", "(o_orderkey % 50 + 1)")
    .replace("p_name, p_type,", "o_orderstatus AS p_name, 'Building' AS p_type,")
    .replace(_pad("p_partkey"), "'bag_' || " + _pad("o_orderkey"))
    .replace("p_partkey", "o_orderkey")
    .replace("Source B", "Source A")
    .replace("FROM part", "FROM orders")
)

# Shape of the box of key k with size s, in a document of block k // 50.
_PROFILES = f"""
profiles AS (
  SELECT 'A' AS source, o_orderkey AS k, 'bag_' || {_pad('o_orderkey')} AS object_id, (o_orderkey % 50 + 1) AS s FROM orders
  UNION ALL SELECT 'B', p_partkey, {_pad('p_partkey')}, p_size FROM part),
located AS (
  SELECT k, arg_min(source, source) AS source, arg_min(object_id, source) AS object_id, arg_min(s, source) AS s
  FROM profiles GROUP BY k),
shaped AS (
  SELECT k, source, 'RawCitiesData/The Hague/Source ' || source || '/tile_' || (k // 50) || '.json' AS file_path,
    object_id, 4 AS n_points, s * CASE WHEN (k // 50) % 3 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS max_size,
    CASE WHEN s % 7 = 0 OR (k // 50) % 3 = 1 THEN 10.0::DOUBLE ELSE (s % 7) * 0.5::DOUBLE END AS shown_height
  FROM located)"""

_ANGLE = "(2 * atan(exp(y / 6378137.0)) - pi() / 2)"

_RESOLVE = """WITH files AS (
          SELECT DISTINCT 'RawCitiesData/The Hague/Source A/tile_' || (o_orderkey // 50) || '.json' AS path FROM orders
          UNION SELECT 'RawCitiesData/The Hague/Source B/tile_' || (p_partkey // 50) || '.json' FROM part),
        n AS (SELECT DISTINCT p_partkey // 10 AS n FROM part),
        asked AS (
          SELECT 'tile_' || n || '.json' AS request_path, 'tile_' || n || '.json' AS base, 'tile_' || n || '.json' AS wanted FROM n
          UNION ALL SELECT 'Source B/tile_' || n || '.json', 'tile_' || n || '.json', 'Source B/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'RawCitiesData/The%20Hague/Source%20B/tile_' || n || '.json', 'tile_' || n || '.json',
            'RawCitiesData/The Hague/Source B/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'elsewhere+%zz/tile_' || n || '.json', 'tile_' || n || '.json', 'elsewhere+%zz/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'tile+' || n, 'tile+' || n, 'tile+' || n FROM n),
        tries AS (
          SELECT request_path, 0 AS priority, wanted AS path FROM asked
          UNION ALL SELECT request_path, 1, 'RawCitiesData/The Hague/Source A/' || base FROM asked
          UNION ALL SELECT request_path, 2, 'RawCitiesData/The Hague/Source B/' || base FROM asked
          UNION ALL SELECT request_path, 3, 'RawCitiesData/The Hague/SourceA/' || base FROM asked
          UNION ALL SELECT request_path, 4, 'RawCitiesData/The Hague/SourceB/' || base FROM asked
          UNION ALL SELECT request_path, 5, 'RawCitiesData/The Hague/' || wanted FROM asked),
        hits AS (SELECT request_path, arg_min(path, priority) AS path, min(priority) AS priority FROM tries JOIN files USING (path) GROUP BY 1)
        SELECT request_path, path, priority FROM asked LEFT JOIN hits USING (request_path)"""

_RESOLVE_SELECT = """WITH files AS (
          SELECT DISTINCT 'RawCitiesData/The Hague/Source A/tile_' || (o_orderkey // 50) || '.json' AS path FROM orders
          UNION SELECT 'RawCitiesData/The Hague/Source B/tile_' || (p_partkey // 50) || '.json' FROM part),
        n AS (SELECT DISTINCT p_partkey // 10 AS n FROM part),
        asked AS (
          SELECT 'tile_' || n || '.json' AS request_path, 'tile_' || n || '.json' AS base, 'tile_' || n || '.json' AS wanted FROM n
          UNION ALL SELECT 'Source B/tile_' || n || '.json', 'tile_' || n || '.json', 'Source B/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'RawCitiesData/The%20Hague/Source%20B/tile_' || n || '.json', 'tile_' || n || '.json',
            'RawCitiesData/The%20Hague/Source%20B/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'elsewhere+%zz/tile_' || n || '.json', 'tile_' || n || '.json', 'elsewhere+%zz/tile_' || n || '.json' FROM n
          UNION ALL SELECT 'tile+' || n, 'tile+' || n, 'tile+' || n FROM n),
        tries AS (
          SELECT request_path, 0 AS priority, wanted AS path FROM asked
          UNION ALL SELECT request_path, 1, 'RawCitiesData/The Hague/' || wanted FROM asked),
        hits AS (SELECT request_path, arg_min(path, priority) AS path, min(priority) AS priority FROM tries JOIN files USING (path) GROUP BY 1)
        SELECT request_path, path, priority FROM asked LEFT JOIN hits USING (request_path)"""

_UNPIVOT = f"""SELECT {_pad('vec_id')} AS building_id, 'f' || (n - 1) AS feature_name, embedding[n]::DOUBLE AS value,
          NULL::INT AS n_items, NULL::DOUBLE AS third_item, NULL::VARCHAR AS value_json
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS n FROM embeddings)
        UNION ALL SELECT {_pad('vec_id')}, 'shape', NULL, least(len(embedding), 3)::INT, embedding[3]::DOUBLE, NULL FROM embeddings
        UNION ALL SELECT {_pad('vec_id')}, 'twice', label, NULL, NULL, NULL FROM embeddings
        UNION ALL SELECT {_pad('vec_id')}, 'name', NULL, NULL, NULL, '"class ' || label || '"' FROM embeddings
        UNION ALL SELECT {_pad('vec_id')}, 'meta', NULL, NULL, NULL, '{{"label":' || label || '}}' FROM embeddings
        UNION ALL SELECT {_pad('vec_id')}, 'again', NULL, NULL, NULL, '"{{\\"a\\":1,\\"a\\":2}}"' FROM embeddings"""

_VERDICT = f"""WITH {_PAIRS} SELECT building_id, count(*) AS n_pairs,
        CASE WHEN NOT bool_or(prediction = 1) THEN 'No matches were found in the BKAFI pairs'
             WHEN bool_or(prediction = 1 AND coalesce(true_label = 1, false)) THEN 'True match was found'
             WHEN bool_or(prediction = 1 AND coalesce(true_label = 0, false)) THEN 'False positive match was found'
             ELSE 'Match predictions found (true labels unknown)' END AS verdict
        FROM pairs GROUP BY building_id"""

_PREDICTED = f"""WITH {_PAIRS} SELECT building_id, index_id AS id, 'Source B' AS source, confidence, true_label,
        {_percent('confidence', 1)} AS confidence_text FROM pairs WHERE prediction = 1"""

ORACLES: dict[str, str] = {
    "numeric_id": f"WITH {_REQUESTS} SELECT request_id, {_numeric('request_id')} AS numeric_id FROM requests",
    "numeric_id_raw": f"WITH {_REQUESTS} SELECT request_id, {_numeric('request_id', True)} AS numeric_id FROM requests",
    "strip_prefix": f"""WITH {_REQUESTS} SELECT request_id, CASE WHEN contains(request_id, '_')
        THEN substr(request_id, strpos(request_id, '_') + 1) ELSE request_id END AS stripped FROM requests""",
    "id_variants": f"""WITH {_REQUESTS}, n AS (SELECT request_id, {_numeric('request_id')} AS v FROM requests)
        SELECT request_id, v AS as_is, ltrim(v, '0') AS unpadded,
          CASE WHEN length(v) < 16 THEN repeat('0', 16 - length(v)) || v ELSE v END AS padded,
          CASE WHEN request_id LIKE 'bag\\_%' ESCAPE '\\' THEN substr(request_id, 5) ELSE 'bag_' || request_id END AS toggled
        FROM n""",
    "predicted_label": f"WITH {_PAIRS} SELECT building_id, index_id, prediction FROM pairs",
    "results_scan": f"""WITH {_PAIRS} SELECT file_name, building_id, index_id, confidence, true_label, predicted_label FROM pairs""",
    "results_large": f"""WITH {_PAIRS} SELECT file_name, (k % 25)::BIGINT AS file_pos, building_id, match_pos - 1 AS match_pos, index_id, confidence, true_label, predicted_label FROM pairs""",
    "results_documents": f"""WITH {_PAIRS}, docs AS (SELECT building_id, p // 1000 AS r, count(*) AS n_matches FROM pairs GROUP BY ALL)
        SELECT building_id, n_matches, row_number() OVER (ORDER BY building_id || '/' || r) - 1 AS document_no FROM docs""",
    "metrics_scan": """SELECT 'tile_' || s_suppkey || '.json' AS file_name, s_suppkey AS candidates_in_file,
        0::BIGINT AS potential_matches_in_index, s_suppkey % 7 AS potential_matches_in_blocking,
        s_acctbal / 8 AS threshold_precision, """
    + ", ".join(
        f"0.0::DOUBLE AS {s}_{n}"
        for s in ("threshold", "best_match")
        for n in ("precision", "recall_overall", "recall_blocking", "recall_matching", "f1_score")
        if (s, n) != ("threshold", "precision")
    )
    + ", "
    + ", ".join(
        f"{3 if (s, n) == ('best_match', 'true_positives') else 0}::BIGINT AS {s}_{n}"
        for s in ("threshold", "best_match")
        for n in (
            "true_positives", "false_positives", "total_false_negatives",
            "false_negatives_in_blocking", "false_negatives_not_in_blocking",
        )
    )
    + " FROM supplier",
    "flatten_last_wins": f"""WITH {_PAIRS}, last AS (SELECT k, max(l_linestatus) AS l FROM pairs GROUP BY k)
        SELECT building_id, 'run_' || l || '.json' AS file_name, index_id, confidence
        FROM pairs JOIN last USING (k) WHERE l_linestatus = l""",
    "load_totals": f"""WITH {_PAIRS}, last AS (SELECT k, max(l_linestatus) AS l FROM pairs GROUP BY k)
        SELECT (SELECT count(*) FROM pairs) AS total_pairs,
          (SELECT count(*) FROM (SELECT DISTINCT k, l_linestatus FROM pairs)) AS occurrences,
          (SELECT count(*) FROM pairs JOIN last USING (k) WHERE l_linestatus = l) AS flat_pairs,
          (SELECT count(*) FROM last) AS distinct_candidates""",
    "ranked_pairs": _RANKED,
    "ranked_pairs_last_file": _RANKED.replace("FROM pairs", "FROM " + _LAST),
    "topk_pairs": f"SELECT * FROM ({_RANKED}) WHERE pair_rank <= 3",
    "predicted_matches": _PREDICTED,
    "pair_badges": f"""WITH {_PAIRS} SELECT building_id, index_id,
        CASE WHEN prediction = 1 THEN 'Match' ELSE 'No Match' END AS prediction_text,
        CASE true_label WHEN 1 THEN 'Match' WHEN 0 THEN 'No Match' ELSE 'Unknown' END AS true_label_text,
        CASE WHEN true_label IS NULL THEN '' WHEN prediction = true_label THEN 'Correct' ELSE 'Incorrect' END AS badge,
        {_percent('confidence', 1)} AS confidence_text FROM pairs""",
    "match_status": f"WITH {_PAIRS} SELECT building_id, {_STATUS_CASE} AS match_status FROM pairs GROUP BY building_id",
    "comparison_verdict": _VERDICT,
    "comparison_verdict_last_file": _VERDICT.replace("FROM pairs GROUP", f"FROM {_LAST} GROUP"),
    "predicted_matches_last_file": _PREDICTED.replace("FROM pairs WHERE", f"FROM {_LAST} WHERE"),
    "best_match": f"""WITH {_PAIRS} SELECT file_name, building_id, index_id, confidence, true_label FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, match_pos) AS r FROM pairs)
        WHERE r = 1 AND confidence > 0.5""",
    "building_status": f"WITH {_STATUS} SELECT * FROM status",
    "building_status_of_files": "WITH "
    + _STATUS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders))")
    + " SELECT * FROM status",
    "building_status_last_file": f"""WITH {_PAIRS}, last AS (SELECT k, max(l_linestatus) AS l FROM pairs GROUP BY k),
        by_key AS (SELECT k, {_STATUS_CASE} AS match_status FROM pairs JOIN last USING (k) WHERE l_linestatus = l GROUP BY k),
        named AS (SELECT 'bag_' || {_pad('k')} AS building_id, match_status FROM by_key
          UNION ALL SELECT {_pad('k')}, match_status FROM by_key),
        featured AS (SELECT DISTINCT {_pad('vec_id')} AS building_id FROM embeddings)
        SELECT coalesce(n.building_id, f.building_id) AS building_id, f.building_id IS NOT NULL AS has_features,
          n.building_id IS NOT NULL AS has_pairs, n.match_status
        FROM named n FULL JOIN featured f ON n.building_id = f.building_id""",
    "stage_colours": f"""WITH {_STATUS}, {_OBJECTS},
        ids AS (SELECT DISTINCT object_id FROM objects),
        found AS (
          SELECT object_id, coalesce(s1.has_features, s2.has_features) AS f, coalesce(s1.has_pairs, s2.has_pairs) AS p,
            CASE WHEN s1.building_id IS NOT NULL THEN s1.match_status ELSE s2.match_status END AS m
          FROM ids LEFT JOIN status s1 ON s1.building_id = object_id LEFT JOIN status s2 ON s2.building_id = 'bag_' || object_id),
        coloured AS (
          SELECT object_id, CASE WHEN f THEN 'orange' ELSE 'blue' END AS stage1,
            CASE WHEN p THEN 'yellow' WHEN f THEN 'orange' ELSE 'blue' END AS stage2,
            CASE WHEN m = 'true_match' THEN 'green' WHEN m = 'false_positive' THEN 'red' WHEN m = 'no_match' THEN 'darkgray'
                 WHEN p THEN 'yellow' WHEN f THEN 'orange' ELSE 'blue' END AS stage3 FROM found)
        SELECT object_id, stage1, stage2, stage3, red, green, blue FROM coloured JOIN (VALUES ('blue', 116, 151, 223),
          ('orange', 255, 152, 0), ('yellow', 255, 235, 59), ('green', 76, 175, 80), ('red', 244, 67, 54),
          ('darkgray', 97, 97, 97)) AS c(name, red, green, blue) ON name = stage3""",
    "potential_matches": f"""SELECT 'bag_' || {_pad('o_orderkey')} AS building_id FROM orders
        WHERE o_orderkey IN (SELECT p_partkey FROM part)""",
    "unmatched_candidates": f"""SELECT 'bag_' || {_pad('o_orderkey')} AS building_id FROM orders
        WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)""",
    "file_metrics": _metric_select(_BY_TRUTH, ("threshold", "best_match")),
    "threshold_metrics": _metric_select(_BY_TRUTH, ("threshold",)),
    "best_match_metrics": _metric_select(_BY_TRUTH, ("best_match",)),
    "threshold_curve": _CURVE,
    "labelled_metrics": _metric_select(_BY_LABEL, ("threshold", "best_match")),
    "file_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "summary_texts": f"WITH {_SUMMARY} SELECT request_id, "
    + ", ".join(
        f"{_percent(c, 2)} AS {c}"
        for c in (
            "overall_recall", "blocking_recall", "matching_recall", "precision_conf_threshold",
            "precision_highest_conf", "best_match_f1_score",
        )
    )
    + " FROM summary",
    "feature_unpivot": _UNPIVOT,
    "feature_round_trip": _UNPIVOT,
    "first_feature_maps": f"""SELECT {_pad('vec_id')} AS building_id, (len(embedding) + 5)::INT AS n_features,
        '"class ' || label || '"' AS name, label::DOUBLE AS twice FROM embeddings""",
    "feature_pivot": f"SELECT {_pad('vec_id')} AS building_id, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64))
    + ", " + ", ".join(f"NULL::DOUBLE AS {n}" for n in ("shape", "note", "meta")) + " FROM embeddings",
    "feature_maps": f"""WITH f AS (SELECT vec_id, unnest(list_concat(['meta', 'note', 'shape'], ['f' || (i - 1) FOR i IN range(1, len(embedding) + 1)])) AS name FROM embeddings)
        SELECT {_pad('vec_id')} AS building_id, (len(embedding) + 3)::INT AS n_features, embedding[1]::DOUBLE AS f0,
          embedding[64]::DOUBLE AS f63, least(len(embedding), 3)::INT AS n_shape, '"class ' || label || '"' AS note, names
        FROM embeddings JOIN (SELECT vec_id, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY 1) USING (vec_id)""",
    "feature_listing": f"""WITH f AS (
          SELECT vec_id, 'f' || (n - 1) AS feature_name, printf('%.4f', {_nudged('v', 4)}) AS shown
          FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS n, embedding[n]::DOUBLE AS v FROM embeddings)
          UNION ALL SELECT vec_id, 'shape', '[' || least(len(embedding), 3) || ' items]' FROM embeddings
          UNION ALL SELECT vec_id, 'note', '"class ' || label || '"' FROM embeddings
          UNION ALL SELECT vec_id, 'meta', '{{"label":' || label || '}}' FROM embeddings)
        SELECT {_pad('vec_id')} AS building_id,
          row_number() OVER (PARTITION BY vec_id ORDER BY feature_name)::INT AS feature_no, feature_name, shown FROM f""",
    "feature_counts": f"SELECT {_pad('vec_id')} AS building_id, (len(embedding) + 3)::BIGINT AS n_features FROM embeddings",
    "feature_lookup": _FEATURE_LOOKUP,
    "pair_lookup": f"WITH {_pair_lookup('o_orderkey')} SELECT request_id, key, tier FROM found",
    "pairs_of_request": f"""WITH {_pair_lookup('(o_orderkey % 25, o_orderkey)')}, {_PAIRS},
        totals AS (SELECT k, count(*) AS n FROM pairs GROUP BY k)
        SELECT request_id, found.key AS matched_id, v1 AS candidate_id, index_id, prediction, true_label, confidence,
          coalesce(n, 0) AS total_pairs
        FROM found LEFT JOIN keys USING (key) LEFT JOIN pairs ON pairs.k = keys.k LEFT JOIN totals ON totals.k = keys.k""",
    "matches_of_request": f"""WITH {_pair_lookup('(o_orderkey % 25, o_orderkey)')}, {_PAIRS}
        SELECT request_id, index_id AS match_id, 'Source B' AS source, confidence, true_label
        FROM found JOIN keys USING (key) JOIN pairs ON pairs.k = keys.k WHERE prediction = 1""",
    "object_lookup": f"""WITH {_REQUESTS}, {_OBJECTS},
        asked AS (SELECT DISTINCT request_id, {_numeric('request_id')} AS v1, file_path
          FROM (SELECT *, regexp_replace(request_id, '[^0-9]', '', 'g')::BIGINT AS n FROM requests)
          JOIN (SELECT DISTINCT file_path, obj_pos FROM objects) ON obj_pos = n),
        hits AS (SELECT a.request_id, a.file_path, arg_min(object_id, obj_pos) AS object_id, arg_min(is_empty, obj_pos) AS is_empty
          FROM asked a JOIN objects o ON o.file_path = a.file_path
            AND (object_id = request_id OR object_id = v1 OR {_run('object_id')} = v1 OR {_run('object_id')} = request_id)
          GROUP BY ALL)
        SELECT a.request_id, a.file_path, CASE WHEN NOT is_empty THEN object_id END AS object_id
        FROM asked a LEFT JOIN hits h ON h.request_id = a.request_id AND h.file_path = a.file_path""",
    "find_file": f"""WITH {_REQUESTS}, {_OBJECTS},
        names AS (SELECT source, file_path, obj_pos, object_id, unnest([object_id, {_run('object_id')}]) AS alias FROM objects),
        asked AS (SELECT request_id, unnest([request_id, {_numeric('request_id')}]) AS alias FROM (SELECT DISTINCT request_id FROM requests)),
        hits AS (SELECT request_id, min((source, file_path, obj_pos, object_id)) AS h FROM asked JOIN names USING (alias) GROUP BY 1)
        SELECT DISTINCT request_id, h[1] AS source, h[2] AS file_path, h[4] AS object_id FROM asked LEFT JOIN hits USING (request_id)""",
    "file_lookup": """WITH keys AS (SELECT 'tile_' || s_suppkey || '.json' AS key, s_suppkey AS pos FROM supplier),
        asked AS (SELECT unnest(['x/' || key, 'old_' || key, substr(key, 6)]) AS request_id FROM keys),
        named AS (SELECT request_id, list_last(string_split(request_id, '/')) AS base FROM asked)
        SELECT request_id, arg_min(key, pos) AS key, 0 AS tier
        FROM named JOIN keys ON contains(base, key) OR contains(key, base) GROUP BY request_id""",
    "city_quality": f"""WITH {_BOXES}, files AS (SELECT file_path, (k // 50) % 3 AS kind, count(*) AS n FROM boxes GROUP BY ALL)
        SELECT file_path, kind <> 2 AS is_readable, CASE kind WHEN 0 THEN n * 12 WHEN 1 THEN 5 ELSE 0 END::BIGINT AS n_vertices,
          CASE kind WHEN 1 THEN 3 ELSE 0 END::BIGINT AS n_bad_vertices, CASE kind WHEN 0 THEN n WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n_objects,
          CASE kind WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_repeated_objects, CASE kind WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_repeated_attributes
        FROM files""",
    "object_quality": f"""WITH {_BOXES} SELECT file_path, pos::INT AS obj_pos, object_id, 12::BIGINT AS n_indices,
        CASE WHEN (k // 50) % 3 <> 1 THEN 0 WHEN pos = 0 THEN 9 ELSE 12 END::BIGINT AS n_out_of_range FROM boxes""",
    "vertices_of_odd_files": f"""WITH {_BOXES} SELECT file_path, count(*)::BIGINT AS n_vertices, count(*)::BIGINT AS n_x, count(*)::BIGINT AS n_z, sum(vz)::DOUBLE AS sum_vz
        FROM placed WHERE turn = 0 GROUP BY file_path
        UNION ALL SELECT DISTINCT file_path, 5, 4, 3, 9.0::DOUBLE FROM placed WHERE turn = 1""",
    "file_lookup_exact": """WITH keys AS (SELECT 'tile_' || s_suppkey || '.json' AS key, s_suppkey AS pos FROM supplier),
        asked AS (SELECT unnest(['x/' || key, 'old_' || key, substr(key, 6)]) AS request_id FROM keys),
        named AS (SELECT request_id, list_last(string_split(request_id, '/')) AS base FROM asked)
        SELECT request_id, arg_min(key, (CASE WHEN key = base THEN 0 ELSE 1 END, pos)) AS key, min(CASE WHEN key = base THEN 0 ELSE 1 END)::INT AS tier
        FROM named JOIN keys ON contains(base, key) OR contains(key, base) GROUP BY request_id""",
    "catalog_versions": """WITH f AS (
          SELECT 'A' AS source, 'RawCitiesData/The Hague/Source A/tile_' || n || '.json' AS path, n FROM (SELECT DISTINCT o_orderkey // 50 AS n FROM orders)
          UNION ALL SELECT 'B', 'RawCitiesData/The Hague/Source B/tile_' || n || '.json', n FROM (SELECT DISTINCT p_partkey // 50 AS n FROM part))
        SELECT source, path, (n * 7)::BIGINT AS size, md5(path || '_' || (n * 1000003 + 1600000000000000)) AS version_key FROM f""",
    "cityjson_objects": f"""WITH {_BOXES} SELECT 'B' AS source, file_path, pos::INT AS obj_pos, object_id, {_KIND} AS object_type,
          object_id AS numeric_id, CASE WHEN s % 2 = 0 THEN p_name ELSE object_id END AS display_name, false AS is_empty,
          CASE WHEN s % 3 <> 0 AND s % 5 <> 0 THEN s % 5 WHEN s <> 0 THEN s ELSE 10 END::DOUBLE AS attribute_height FROM boxes""",
    "object_descriptions": f"""WITH e AS (SELECT 'ev_' || {_pad('event_id')} AS object_id, event_type, props FROM events)
        SELECT object_id, object_id AS display_name, 'Type' AS key,
          CASE WHEN event_type = 'click' THEN 'Unknown' ELSE event_type END AS value FROM e
        UNION ALL SELECT object_id, object_id, 'k', props->>'$.k' FROM e WHERE props->>'$.k' IS NOT NULL""",
    "dequantised_vertices": f"""WITH {_BOXES} SELECT file_path, vertex_idx::INT AS vertex_idx, vx::DOUBLE AS vx, vy::DOUBLE AS vy,
        vz::DOUBLE AS vz, x, y, z FROM placed""",
    "ring_vertices": f"""WITH {_BOXES} SELECT file_path, object_id, geom_idx, geom_type, shell, face, 0 AS ring, vpos::INT AS vpos,
        vertex_idx::INT AS vertex_idx, x, y, z FROM placed JOIN ring_points USING (j)""",
    "object_bbox": f"WITH {_BOXES} SELECT file_path, object_id, geom_idx, min_x, min_y, min_z, max_x, max_y, max_z, height FROM spans",
    "object_height": f"""WITH {_BOXES} SELECT object_id, geom_idx, height,
        CASE WHEN height > 0 THEN height ELSE 10.0 END::DOUBLE AS shown_height FROM spans""",
    "drawable_objects": f"""WITH {_BOXES} SELECT object_id, geom_idx, CASE geom_idx WHEN 0 THEN 4 ELSE 6 END AS n_points, height
        FROM spans WHERE height > 0""",
    "footprint": f"""WITH {_BOXES} SELECT object_id, geom_idx, j AS point_no, x, y, z FROM placed, (VALUES (0), (1)) AS g(geom_idx)
        WHERE j < 4""",
    "footprint_stats": f"""WITH {_BOXES}, st AS (
          SELECT b.object_id, h.geom_idx, p0, p1, p2, p3, b.s * b.sc AS size, h.height FROM boxes b JOIN spans h USING (object_id)
          JOIN (SELECT object_id, {{'x': x, 'y': y}} AS p0 FROM placed WHERE j = 0) USING (object_id)
          JOIN (SELECT object_id, {{'x': x, 'y': y}} AS p1 FROM placed WHERE j = 1) USING (object_id)
          JOIN (SELECT object_id, {{'x': x, 'y': y}} AS p2 FROM placed WHERE j = 2) USING (object_id)
          JOIN (SELECT object_id, {{'x': x, 'y': y}} AS p3 FROM placed WHERE j = 3) USING (object_id)),
        shown AS (SELECT *, CASE WHEN height > 0 THEN height ELSE 10.0 END::DOUBLE AS shown_height,
          CASE WHEN size > 100 OR size < 0.1 THEN 50 / size ELSE 1.0 END::DOUBLE AS scale FROM st)
        SELECT object_id, geom_idx, 4 AS n_points, {_CENTER.format(a='x')} AS center_x, {_CENTER.format(a='y')} AS center_y,
          size AS size_x, size AS size_y, size AS max_size, scale, shown_height, shown_height * scale AS scaled_height FROM shown""",
    "file_bbox": f"""WITH {_FILE_BOXES} SELECT *, (min_x + max_x) / 2 AS center_x, (min_y + max_y) / 2 AS center_y,
        (min_z + max_z) / 2 AS center_z FROM file_boxes""",
    "file_counts": f"""WITH {_BOXES} SELECT file_path, CASE WHEN turn <> 0 THEN '1.1' ELSE '' END AS version,
        CASE turn WHEN 0 THEN 'urn:ogc:def:crs:EPSG::7415' WHEN 2 THEN 'EPSG:4326' END AS crs,
        count(*)::INT AS n_objects, (count(*) * 12)::INT AS n_vertices FROM boxes GROUP BY file_path, turn""",
    "geo_bounds": f"""WITH {_FILE_BOXES} SELECT *, (min_lat + max_lat) / 2 AS center_lat, (min_lon + max_lon) / 2 AS center_lon,
        min_lat >= -90 AND max_lat <= 90 AND min_lon >= -180 AND max_lon <= 180 AS is_valid,
        abs(max_lat - min_lat) < 0.0001 OR abs(max_lon - min_lon) < 0.0001 AS is_small FROM bounds""",
    "bounds_ring": f"""WITH {_FILE_BOXES} SELECT file_path, n AS corner_no, CASE WHEN n IN (2, 3) THEN max_lat ELSE min_lat END AS lat,
        CASE WHEN n IN (1, 2) THEN max_lon ELSE min_lon END AS lon FROM bounds, (VALUES (0), (1), (2), (3), (4)) AS c(n)
        WHERE min_lat >= -90 AND max_lat <= 90 AND min_lon >= -180 AND max_lon <= 180""",
    "lonlat_points": f"""WITH p AS (SELECT c_custkey, c_nationkey % 5 AS kind, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer)
        SELECT c_custkey, CASE kind WHEN 0 THEN '7415' WHEN 1 THEN '0' WHEN 2 THEN '4326' WHEN 3 THEN '3857' END AS epsg_first,
          CASE kind WHEN 0 THEN '7415' WHEN 1 THEN '7415' WHEN 2 THEN '4326' WHEN 3 THEN '3857' END AS epsg_last,
          round(CASE kind WHEN 2 THEN x WHEN 3 THEN degrees(x / 6378137.0) ELSE 4.3007::DOUBLE + x / 111320.0 END, 8) AS lon,
          round(CASE kind WHEN 2 THEN y WHEN 3 THEN degrees({_ANGLE}) ELSE 52.0705::DOUBLE + y / 111320.0 END, 8) AS lat FROM p""",
    "extract_object": _EXTRACT,
    "comparison_set": f"""WITH {_PAIRS}, {_PROFILES}
        SELECT index_id, building_id, row_number() OVER (PARTITION BY pairs.k ORDER BY confidence DESC, match_pos)::BIGINT AS pair_rank,
          {_pad('pairs.k')} AS candidate_id, prediction, true_label, confidence,
          c.source AS candidate_source, c.file_path AS candidate_file_path, c.object_id AS candidate_object_id,
          c.n_points AS candidate_n_points, c.max_size AS candidate_max_size, c.shown_height AS candidate_shown_height,
          i.source AS index_source, i.file_path AS index_file_path, i.object_id AS index_object_id,
          i.n_points AS index_n_points, i.max_size AS index_max_size, i.shown_height AS index_shown_height
        FROM {_LAST} LEFT JOIN shaped c ON c.k = pairs.k LEFT JOIN shaped i ON i.k = pairs.p""",
    "comparison_objects": f"""WITH a AS ({_EXTRACT_A.replace("SELECT 'bag_' || object_id AS request_id", "SELECT k")}),
        b AS ({_EXTRACT.replace("SELECT 'bag_' || object_id AS request_id", "SELECT k")}),
        ids AS (SELECT DISTINCT 'bag_' || {_pad('l_orderkey')} AS id, l_orderkey AS k FROM lineitem
          UNION ALL SELECT DISTINCT {_pad('l_partkey')}, l_partkey FROM lineitem)
        SELECT id, CASE WHEN a.k IS NOT NULL THEN 'A' ELSE 'B' END AS source, coalesce(a.object_id, b.object_id) AS object_id,
          coalesce(a.cityjson, b.cityjson) AS cityjson
        FROM ids LEFT JOIN a USING (k) LEFT JOIN b USING (k) WHERE a.k IS NOT NULL OR b.k IS NOT NULL""",
    "object_type_class": f"""WITH t AS (SELECT {_pad('p_partkey')} AS object_id, {_KIND} AS object_type FROM part)
        SELECT object_id, object_type, coalesce(red, 136) AS red, coalesce(green, 136) AS green, coalesce(blue, 136) AS blue
        FROM t LEFT JOIN (VALUES ('Building', 116, 151, 223), ('BuildingPart', 116, 151, 223), ('WaterBody', 77, 166, 255),
          ('PlantCover', 57, 172, 57)) AS c(name, red, green, blue) ON name = object_type""",
    "display_texts": f"""SELECT c_custkey, printf('%.4f', {_nudged('c_acctbal / 32', 4)}) AS fixed4,
        {_percent('c_acctbal / 1024', 1)} AS percent1,
        printf('%.2f', {_nudged('c_custkey * 12345 / 1024.0::DOUBLE / 1024.0::DOUBLE', 2)}) || ' MB' AS megabytes FROM customer""",
    "source_files": """SELECT DISTINCT 'A' AS source, 'RawCitiesData/The Hague/Source A/tile_' || (o_orderkey // 50) || '.json' AS path FROM orders
        UNION ALL SELECT DISTINCT 'B', 'RawCitiesData/The Hague/Source B/tile_' || (p_partkey // 50) || '.json' FROM part""",
    "resolve_paths": _RESOLVE,
    "resolve_paths_select": _RESOLVE_SELECT,
}
# The same rows, whether keys are cut for a lookup or stored as an index.
ORACLES |= {f"indexed_{name}": ORACLES[name] for name in ("feature_lookup", "pair_lookup", "pairs_of_request")}
# The same rows, whether documents are parsed for the query or their tables were refreshed.
ORACLES["refreshed_objects"] = ORACLES["cityjson_objects"]
ORACLES["refresh_states"] = f"""WITH {_BOXES}, f AS (SELECT DISTINCT file_path, regexp_extract(file_path, 'tile_([0-9]+)', 1)::INT AS n FROM boxes)
    SELECT 'B' AS source, file_path, CASE WHEN n % 5 = 0 THEN 'new' WHEN n % 3 = 1 THEN 'changed' ELSE 'same' END AS state FROM f
    UNION ALL SELECT 'B', file_path || '.old', 'removed' FROM f WHERE n % 4 = 2"""
