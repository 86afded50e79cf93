"""Registered queries: ``name -> callable(spark, sf_dir)``, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions import crs as crs_functions
from geomatch.functions import display, ids
from geomatch.functions.labels import object_type_rgb
from geomatch.operators import comparison, extraction, geometry, lookup, matching, metrics, status
from geomatch.operators import features as feature_ops
from geomatch.plans import adapters as A
from geomatch.sources import catalog, cityjson, large, results, snapshots
from geomatch.sources import features as feature_sources
from geomatch.storage import remove, scratch, shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]


# --- ids ---------------------------------------------------------------------------------------


def numeric_id(spark, sf):
    r = F.col("request_id")
    return A.requests(spark, sf).select("request_id", ids.numeric_id(r).alias("numeric_id"))


def numeric_id_raw(spark, sf):
    r = F.col("request_id")
    return A.requests(spark, sf).select("request_id", ids.numeric_id(r, "raw").alias("numeric_id"))


def strip_prefix(spark, sf):
    return A.requests(spark, sf).select("request_id", ids.strip_prefix(F.col("request_id")).alias("stripped"))


def id_variants(spark, sf):
    r = F.col("request_id")
    rows = A.requests(spark, sf).select("request_id", ids.padding_variants(ids.numeric_id(r)).alias("v"))
    return rows.select(
        "request_id",
        F.col("v")[0].alias("as_is"),
        F.col("v")[1].alias("unpadded"),
        F.col("v")[2].alias("padded"),
        ids.toggle_prefix(r).alias("toggled"),
    )


# --- pairs -------------------------------------------------------------------------------------


def predicted_label(spark, sf):
    return matching.with_prediction(A.pairs(spark, sf, labelled=False)).select(
        "building_id", "index_id", "prediction"
    )


def results_scan(spark, sf):
    pairs = results.result_pairs(results.result_buildings(A.results_texts(spark, sf)))
    return pairs.select("file_name", "building_id", "index_id", "confidence", "true_label", "predicted_label")


def results_large(spark, sf):
    """One document of all pairs, read in fragments."""
    rows = large.result_buildings(spark, path := A.results_document(spark, sf))
    remove(spark, path)
    return results.result_pairs(rows).select("file_name", "file_pos", "building_id", "match_pos", "index_id", "confidence", "true_label", "predicted_label")


def results_documents(spark, sf):
    """Several documents, in the order of their paths."""
    rows = results.result_buildings(A.results_texts(spark, sf), several=True)
    return rows.select("building_id", "n_matches", F.shiftright("file_pos", 32).alias("document_no"))


def metrics_scan(spark, sf):
    return results.file_metrics(A.metrics_texts(spark, sf)).drop("model", "file_pos")


def flatten_last_wins(spark, sf):
    pairs = A.pairs(spark, sf, labelled=False, by="run")
    return matching.flatten_pairs(pairs, A.result_buildings(pairs)).select(
        "building_id", "file_name", "index_id", "confidence"
    )


def load_totals(spark, sf):
    return matching.load_totals(A.result_buildings(A.pairs(spark, sf, labelled=False, by="run")))


def ranked_pairs(spark, sf):
    return matching.ranked_pairs(A.pairs(spark, sf))


def ranked_pairs_last_file(spark, sf):
    return matching.ranked_pairs(*_result_tables(spark, sf, by="run"))


def topk_pairs(spark, sf):
    return matching.ranked_pairs(A.pairs(spark, sf), k=3)


def predicted_matches(spark, sf):
    return matching.predicted_matches(A.pairs(spark, sf)).drop("match_id", "match_pos")


def pair_badges(spark, sf):
    return matching.pair_badges(A.pairs(spark, sf)).drop("match_pos")


def match_status(spark, sf):
    return status.match_status(A.pairs(spark, sf)).select("building_id", "match_status")


def comparison_verdict(spark, sf):
    return matching.comparison_verdicts(A.pairs(spark, sf))


def comparison_verdict_last_file(spark, sf):
    return matching.comparison_verdicts(*_result_tables(spark, sf, by="run"))


def predicted_matches_last_file(spark, sf):
    return matching.predicted_matches(*_result_tables(spark, sf, by="run")).drop("match_id", "match_pos")


def best_match(spark, sf):
    return matching.best_match(A.pairs(spark, sf))


def _result_tables(spark, sf, by="tile"):
    """Pairs and their buildings as stored tables, as an ingest leaves them."""
    pairs = stored(A.pairs(spark, sf, by=by))
    return pairs, stored(A.result_buildings(pairs, A.candidates(spark, sf) if by == "tile" else None))


def _status(spark, sf, by="tile"):
    return status.building_status(A.features(spark, sf), *_result_tables(spark, sf, by))


def building_status(spark, sf):
    return _status(spark, sf)


def building_status_last_file(spark, sf):
    return _status(spark, sf, by="run")


def building_status_of_files(spark, sf):
    """Where only features of the candidate files' objects count."""
    objects = A.bare_objects(spark, sf).where("source = 'A'")
    features = feature_ops.features_of_objects(A.features(spark, sf), objects)
    return status.building_status(features, *_result_tables(spark, sf))


def stage_colours(spark, sf):
    return status.stage_colours(A.bare_objects(spark, sf), _status(spark, sf))


# --- metrics -----------------------------------------------------------------------------------


def potential_matches(spark, sf):
    return lookup.shared_ids(A.building_ids(spark, sf, "A"), A.building_ids(spark, sf, "B"))


def unmatched_candidates(spark, sf):
    return lookup.unshared_ids(A.building_ids(spark, sf, "A"), A.building_ids(spark, sf, "B"))


def file_metrics(spark, sf):
    return metrics.metrics_from_pairs(
        A.pairs(spark, sf, labelled=False), A.candidates(spark, sf), A.truth(spark, sf)
    )


def threshold_metrics(spark, sf):
    return metrics.strategy_metrics(file_metrics(spark, sf), "threshold")


def best_match_metrics(spark, sf):
    return metrics.strategy_metrics(file_metrics(spark, sf), "best_match")


def threshold_curve(spark, sf):
    """Both strategies at twenty thresholds."""
    return metrics.threshold_curve(A.pairs(spark, sf, labelled=False), A.candidates(spark, sf), A.truth(spark, sf))


def labelled_metrics(spark, sf):
    """Without a truth table: the pairs' own labels decide."""
    return metrics.metrics_from_pairs(A.pairs(spark, sf), A.candidates(spark, sf))


def _summary(spark, sf):
    pairs = A.pairs(spark, sf, labelled=False)
    listed = A.candidates(spark, sf)
    positions = listed.select("file_name", "file_pos").distinct()
    records = metrics.metrics_from_pairs(pairs, listed, A.truth(spark, sf))
    asked = positions.select(F.concat(F.lit("RawCitiesData/Source A/"), F.col("file_name")).alias("request_id"))
    summary = stored(records.join(positions, "file_name"))
    return metrics.file_summary(asked, summary, A.result_buildings(pairs, listed))


def file_summary(spark, sf):
    return _summary(spark, sf)


def summary_texts(spark, sf):
    return metrics.summary_texts(_summary(spark, sf))


# --- features ----------------------------------------------------------------------------------


def _shown_features(rows):
    items = F.col("value_array")
    return rows.select(
        "building_id", "feature_name", "value", F.size(items).alias("n_items"), F.get(items, F.lit(2)).alias("third_item"), "value_json"
    )


def feature_unpivot(spark, sf):
    return _shown_features(feature_sources.unpivot_properties(A.property_texts(spark, sf)))


def feature_round_trip(spark, sf):
    """Unpivoted, written as Parquet, read back, last value of each."""
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    feature_sources.write_features(feature_sources.unpivot_properties(A.property_texts(spark, sf)), path)
    return _shown_features(feature_ops.latest_features(feature_sources.read_features(spark, path)))


def first_feature_maps(spark, sf):
    """Buildings of the first feature with all their features."""
    first = feature_ops.first_feature_buildings(feature_sources.unpivot_properties(A.property_texts(spark, sf)))
    maps = feature_ops.feature_maps(first)
    return maps.select("building_id", "n_features", F.col("features")["name"]["value_json"].alias("name"), F.col("features")["twice"]["value"].alias("twice"))


def feature_pivot(spark, sf):
    features = A.features(spark, sf)
    return feature_ops.feature_pivot(features, feature_ops.feature_names(features))


def feature_maps(spark, sf):
    maps = feature_ops.feature_maps(A.features(spark, sf))
    return maps.select(
        "building_id",
        "n_features",
        F.col("features")["f0"]["value"].alias("f0"),
        F.col("features")["f63"]["value"].alias("f63"),
        F.size(F.col("features")["shape"]["value_array"]).alias("n_shape"),
        F.col("features")["note"]["value_json"].alias("note"),
        F.array_join(F.map_keys("features"), ",").alias("names"),
    )


def feature_listing(spark, sf):
    return feature_ops.feature_listing(A.features(spark, sf))


def feature_counts(spark, sf):
    return feature_ops.latest_features(A.features(spark, sf)).groupBy("building_id").agg(
        F.count("*").alias("n_features")
    )


# --- lookups -----------------------------------------------------------------------------------


def feature_lookup(spark, sf):
    return lookup.feature_lookup(A.requests(spark, sf), feature_ops.feature_keys(A.features(spark, sf)))


def pair_lookup(spark, sf):
    keys = A.candidates(spark, sf).select(F.col("building_id").alias("key"), F.col("bld_pos").alias("key_pos"))
    return lookup.pair_lookup(A.requests(spark, sf), keys)


def pairs_of_request(spark, sf):
    return matching.pairs_of(A.requests(spark, sf), *_result_tables(spark, sf)).drop("match_pos")


def matches_of_request(spark, sf):
    return matching.matches_of(A.requests(spark, sf), *_result_tables(spark, sf)).drop("match_pos")


def _index(keys):
    """The keys as a stored index, in a folder of its own."""
    return lookup.KeyIndex.write(keys, f"{shared_folder(keys.sparkSession)}/{uuid.uuid4().hex}", slots=64)


def indexed_feature_lookup(spark, sf):
    """As :func:`feature_lookup`, from a stored index."""
    return lookup.feature_lookup(A.requests(spark, sf), _index(feature_ops.feature_keys(A.features(spark, sf))))


def indexed_pair_lookup(spark, sf):
    """As :func:`pair_lookup`, from a stored index."""
    keys = A.candidates(spark, sf).select(F.col("building_id").alias("key"), F.col("bld_pos").alias("key_pos"))
    return lookup.pair_lookup(A.requests(spark, sf), _index(keys))


def indexed_pairs_of_request(spark, sf):
    """As :func:`pairs_of_request`, from a stored index."""
    pairs, buildings = _result_tables(spark, sf)
    index = _index(matching.building_keys(buildings))
    return matching.pairs_of(A.requests(spark, sf), pairs, buildings, index=index).drop("match_pos")


def object_lookup(spark, sf):
    objects = A.bare_objects(spark, sf)
    files = objects.select("file_path", "obj_pos").distinct()
    asked = A.requests(spark, sf).withColumn("obj_pos", F.substring_index(F.regexp_replace("request_id", "[^0-9]", ""), "_", -1).cast("bigint"))
    return lookup.object_lookup(asked.join(files, "obj_pos").drop("obj_pos"), objects)


def find_file(spark, sf):
    return lookup.find_file(A.requests(spark, sf), A.bare_objects(spark, sf))


def file_lookup_exact(spark, sf):
    """As :func:`file_lookup`, where an equal name wins."""
    return file_lookup(spark, sf, prefer_exact=True)


def file_lookup(spark, sf, prefer_exact=False):
    names = A.metrics_texts(spark, sf).select(F.col("doc_path").alias("file_name"))
    keys = names.withColumn("file_pos", F.regexp_extract("file_name", "([0-9]+)", 1).cast("bigint"))
    asked = names.select(F.explode(F.array(F.concat(F.lit("x/"), "file_name"), F.concat(F.lit("old_"), "file_name"), F.substr("file_name", F.lit(6)))).alias("request_id"))
    return lookup.file_lookup(asked, keys, prefer_exact)


# --- CityJSON ----------------------------------------------------------------------------------


def city_quality(spark, sf):
    """Index documents, every other one with odd entries."""
    return cityjson.city_quality(A.odd_documents(spark, sf)).drop("source")


def object_quality(spark, sf):
    """Index documents, every third without most of its vertices."""
    return cityjson.object_quality(A.short_documents(spark, sf)).drop("source")


def vertices_of_odd_files(spark, sf):
    return cityjson.vertices(A.odd_documents(spark, sf)).groupBy("file_path").agg(
        F.count("*").alias("n_vertices"), F.count("x").alias("n_x"), F.count("z").alias("n_z"), F.sum("vz").alias("sum_vz")
    )


def _described(objects):
    return objects.select(
        "source", "file_path", "obj_pos", "object_id", "object_type", "numeric_id", geometry.display_name().alias("display_name"), "is_empty",
        geometry.attribute_height().alias("attribute_height"),
    )


def cityjson_objects(spark, sf):
    return _described(cityjson.city_objects(A.index_documents(spark, sf)))


def _refreshed(spark, sf):
    """Tables of the index documents before a change, refreshed to those of today: their folder, and what became of each file."""
    target = f"{shared_folder(spark)}/city-{uuid.uuid4().hex}"
    today = stored(A.index_documents(spark, sf).select("source", "file_path", "document"))
    for texts in (stored(A.earlier_documents(spark, sf, today)), today):
        listing = texts.select("source", "file_path", F.md5("document").alias("version_key"))
        found = snapshots.refresh(spark, listing, lambda wanted, texts=texts: texts, target)
    return target, found


def refreshed_objects(spark, sf):
    """As :func:`cityjson_objects`, from refreshed tables."""
    return _described(snapshots.read_table(spark, _refreshed(spark, sf)[0], "city_object"))


def refresh_states(spark, sf):
    return _refreshed(spark, sf)[1].select("source", "file_path", "state")


def object_descriptions(spark, sf):
    return geometry.object_descriptions(A.event_objects(spark, sf)).select(
        "object_id", "display_name", "key", "value"
    )


def dequantised_vertices(spark, sf):
    return cityjson.vertices(A.index_documents(spark, sf)).drop("source")


def ring_vertices(spark, sf):
    return cityjson.ring_vertices(cityjson.object_geometries(A.index_documents(spark, sf))).drop("source")


def object_bbox(spark, sf):
    boxes = geometry.object_boxes(cityjson.object_geometries(A.index_documents(spark, sf)))
    return boxes.select(
        "file_path", "object_id", "geom_idx", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "height"
    )


def object_height(spark, sf):
    heights = geometry.object_heights(cityjson.object_geometries(A.index_documents(spark, sf)))
    return heights.select("object_id", "geom_idx", "height", "shown_height")


def drawable_objects(spark, sf):
    drawn = geometry.drawable_objects(cityjson.object_geometries(A.index_documents(spark, sf)))
    return drawn.select("object_id", "geom_idx", "n_points", "height")


def footprint(spark, sf):
    prints = geometry.footprints(cityjson.object_geometries(A.index_documents(spark, sf)))
    return geometry.footprint_points(geometry.distinct_footprints(prints)).select(
        "object_id", "geom_idx", "point_no", "x", "y", "z"
    )


def footprint_stats(spark, sf):
    stats = geometry.footprint_stats(cityjson.object_geometries(A.index_documents(spark, sf)))
    return stats.select(
        "object_id", "geom_idx", "n_points", "center_x", "center_y", "size_x", "size_y", "max_size", "scale",
        "shown_height", "scaled_height",
    )


def file_bbox(spark, sf):
    return geometry.file_boxes(A.index_documents(spark, sf)).drop("source")


def file_counts(spark, sf):
    return cityjson.city_files(A.index_documents(spark, sf)).select(
        "file_path", F.coalesce("version", F.lit("")).alias("version"), "crs", "n_objects", "n_vertices"
    )


def geo_bounds(spark, sf):
    return geometry.geographic_bounds(geometry.file_boxes(A.index_documents(spark, sf))).drop("source")


def bounds_ring(spark, sf):
    bounds = geometry.geographic_bounds(geometry.file_boxes(A.index_documents(spark, sf)))
    return geometry.bounds_ring(bounds).drop("source")


def lonlat_points(spark, sf):
    kind = F.col("c_nationkey") % 5
    text = (
        F.when(kind == 0, "urn:ogc:def:crs:EPSG::7415")
        .when(kind == 1, "https://www.opengis.net/def/crs/EPSG/0/7415")
        .when(kind == 2, "EPSG:4326")
        .when(kind == 3, "EPSG:3857")
    )
    points = A.table(spark, sf, "customer").select("c_custkey", text.alias("crs"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    placed = points.select(
        "c_custkey",
        crs_functions.epsg_code(F.col("crs")).alias("epsg_first"),
        crs_functions.epsg_code(F.col("crs"), "last").alias("epsg_last"),
        crs_functions.to_lonlat(F.col("x"), F.col("y"), F.col("crs")).alias("p"),
    )
    return placed.select(
        "c_custkey", "epsg_first", "epsg_last", F.round("p.lon", 8).alias("lon"), F.round("p.lat", 8).alias("lat")
    )


def extract_object(spark, sf):
    """Index documents under paths that both sources list."""
    index = A.index_documents(spark, sf)
    documents = stored(index.unionByName(index.withColumn("source", F.lit("A"))))
    asked = A.bare_objects(spark, sf).where("source = 'B'").select(
        F.concat(F.lit("bag_"), "object_id").alias("request_id"), "file_path"
    )
    return extraction.extract_objects(asked, documents).select("request_id", "object_id", "cityjson")


def comparison_set(spark, sf):
    # The texts are read once, so the table is what is stored, without what no side of the comparison has.
    objects = cityjson.object_table(A.comparison_documents(spark, sf), first_only=True)
    table = stored(objects.select("source", "file_path", "obj_pos", "object_id", "object_type", "geometries"))
    shapes = cityjson.geometries_of(table, ("Solid", "MultiSurface", "CompositeSurface"), first_only=True)
    pairs, buildings = _result_tables(spark, sf, by="run")
    return comparison.comparison_set(pairs, buildings, table.drop("geometries"), shapes)


def comparison_objects(spark, sf):
    """The object of every candidate and of every index building in a pair."""
    documents = stored(A.both_documents(spark, sf), path=(kept := scratch(spark)), dense=True)
    pairs = A.pairs(spark, sf)
    ids = pairs.select(F.col("building_id").alias("id")).unionByName(pairs.select(F.col("index_id").alias("id")))
    found = comparison.extracted(ids.distinct(), cityjson.city_objects(documents), documents)
    remove(spark, kept)
    return found.select("id", "source", "object_id", "cityjson")


def object_type_class(spark, sf):
    objects = cityjson.city_objects(A.index_documents(spark, sf))
    return objects.select("object_id", "object_type", object_type_rgb(F.col("object_type")).alias("c")).select(
        "object_id", "object_type", "c.red", "c.green", "c.blue"
    )


def display_texts(spark, sf):
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        display.to_fixed(F.col("c_acctbal") / 32, 4).alias("fixed4"),
        display.percent(F.col("c_acctbal") / 1024).alias("percent1"),
        display.megabytes(F.col("c_custkey") * 12345).alias("megabytes"),
    )


# --- catalogue ---------------------------------------------------------------------------------


def source_files(spark, sf):
    return catalog.assign_sources(A.listing(spark, sf))


def resolve_paths(spark, sf):
    return catalog.resolve_paths(A.path_requests(spark, sf), A.listing(spark, sf))


def resolve_paths_select(spark, sf):
    return catalog.resolve_paths(A.path_requests(spark, sf), A.listing(spark, sf), mode="select")


def catalog_versions(spark, sf):
    files = catalog.assign_sources(A.dated_listing(spark, sf))
    return files.select("source", "path", "size", catalog.version_key(F.col("path"), F.col("mtime")).alias("version_key"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        numeric_id, numeric_id_raw, strip_prefix, id_variants,
        predicted_label, results_scan, results_large, results_documents, metrics_scan, flatten_last_wins, load_totals, ranked_pairs, ranked_pairs_last_file, topk_pairs,
        predicted_matches, pair_badges, match_status, comparison_verdict, comparison_verdict_last_file,
        predicted_matches_last_file, best_match,
        building_status, building_status_last_file, building_status_of_files, stage_colours,
        potential_matches, unmatched_candidates, file_metrics, threshold_metrics, best_match_metrics,
        labelled_metrics, threshold_curve, file_summary, summary_texts,
        feature_unpivot, feature_round_trip, feature_pivot, feature_maps, first_feature_maps, feature_listing, feature_counts,
        indexed_feature_lookup, indexed_pair_lookup, indexed_pairs_of_request,
        feature_lookup, pair_lookup, pairs_of_request, matches_of_request, object_lookup, find_file, file_lookup, file_lookup_exact,
        city_quality, object_quality, vertices_of_odd_files, cityjson_objects, refreshed_objects, refresh_states, object_descriptions, dequantised_vertices, ring_vertices, object_bbox, object_height,
        drawable_objects, footprint, footprint_stats, file_bbox, file_counts, geo_bounds, bounds_ring,
        lonlat_points, extract_object, comparison_set, comparison_objects, object_type_class, display_texts,
        source_files, resolve_paths, resolve_paths_select, catalog_versions,
    )
}
