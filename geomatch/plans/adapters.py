"""The driver's tables in the shapes the operators take.

Orders play the candidate buildings (source A), parts the index buildings (source B), line items the
candidate pairs, embeddings the features. Documents are built as real CityJSON / results / property
text, so that the queries run the same parsing path as files do. Each document holds a bounded number
of distinct keys, whatever the table size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomatch.constants import CITY_FOLDER, DEFAULT_MODEL
from geomatch.functions.ids import digit_run
from geomatch.sources import large
from geomatch.storage import remove, scratch, shared_folder, stored, tasks_of

OBJECTS_PER_DOCUMENT = 50
VERTICES_PER_OBJECT = 12
DOCUMENTS_PER_TASK = 16
DOCUMENTS_PER_LARGE_TASK = 64
PARTS_PER_RESULTS_DOCUMENT = 1000
LINES_PER_TASK = 250_000
BUILDINGS_PER_PART = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 16, "0")


def building(key: str) -> Column:
    return F.concat(F.lit("bag_"), padded(key))


# --- pairs -------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items with ``match_pos``, the place of a line in its order, and ``lowest``, the lowest part of its order; repeated parts stay."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    own = Window.partitionBy("l_orderkey")
    lines = table(spark, sf_dir, "lineitem")
    dealt = lines.select("l_orderkey", *order).repartition(tasks_of(spark, lines.count(), LINES_PER_TASK), "l_orderkey")
    return dealt.select(
        "l_orderkey", "l_partkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.row_number().over(own.orderBy(*order)).cast("bigint").alias("match_pos"), F.min("l_partkey").over(own).alias("lowest"),
    )


def _true_key(lowest: Column, other: Column) -> Column:
    """The true counterpart of an order."""
    return F.when(F.col("o_orderpriority") != "5-LOW", lowest).otherwise(other)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, o_orderpriority, other``: the part of an order whose true counterpart is not its lowest one."""
    n_parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % n_parts).alias("other"))


def _truth_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, true_key``: the true counterpart of each order that has one."""
    lines = table(spark, sf_dir, "lineitem")
    lowest = (
        lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        .repartition(tasks_of(spark, lines.count(), LINES_PER_TASK), "o_orderkey")
        .groupBy("o_orderkey")
        .agg(F.min("l_partkey").alias("lowest"))
    )
    return (
        _orders(spark, sf_dir)
        .join(lowest, "o_orderkey", "left")
        .select("o_orderkey", _true_key(F.col("lowest"), F.col("other")).alias("true_key"))
        .where("true_key IS NOT NULL")
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``building_id, index_id``"""
    return _truth_keys(spark, sf_dir).select(
        building("o_orderkey").alias("building_id"), padded("true_key").alias("index_id")
    )


def pairs(spark: SparkSession, sf_dir: str, labelled: bool = True, by: str = "tile") -> DataFrame:
    """The pair table. ``by='tile'`` puts a building into one of 25 files; ``by='run'`` spreads its
    pairs over two files, so that the last one must win. Without ``labelled``, true labels are NULL.
    """
    lines = _lines(spark, sf_dir)
    if labelled:
        # Lines know their order's lowest part, so only the orders are joined.
        true_key = _true_key(F.col("lowest"), F.col("other"))
        lines = lines.join(_orders(spark, sf_dir), (F.col("l_orderkey") == F.col("o_orderkey")) & true_key.isNotNull(), "left")
        is_true = F.coalesce(true_key == F.col("l_partkey"), F.lit(False)).cast("int")
        true_label = F.when(F.col("l_tax") != 0, is_true)
    else:
        true_label = F.lit(None).cast("int")
    if by == "tile":
        file_pos = F.col("l_orderkey") % 25
        file_name = F.concat(F.lit("tile_"), file_pos.cast("string"), F.lit(".json"))
    elif by == "run":
        file_pos = F.when(F.col("l_linestatus") == "F", 0).otherwise(1).cast("bigint")
        file_name = F.concat(F.lit("run_"), F.col("l_linestatus"), F.lit(".json"))
    else:
        raise ValueError(by)
    return lines.select(
        file_name.alias("file_name"),
        file_pos.alias("file_pos"),
        building("l_orderkey").alias("building_id"),
        F.col("l_orderkey").alias("bld_pos"),
        "match_pos",
        padded("l_partkey").alias("index_id"),
        (F.col("l_discount") * 10).alias("confidence"),
        true_label.alias("true_label"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0).alias("predicted_label"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_name, file_pos, building_id, bld_pos`` of every order."""
    file_pos = F.col("o_orderkey") % 25
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tile_"), file_pos.cast("string"), F.lit(".json")).alias("file_name"),
        file_pos.alias("file_pos"),
        building("o_orderkey").alias("building_id"),
        F.col("o_orderkey").alias("bld_pos"),
    )


def result_buildings(pair_table: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Buildings of the pairs, and the ``listed`` ones with an empty list."""
    keys = ["file_name", "file_pos", "building_id", "bld_pos"]
    rows = pair_table.select(*keys, F.lit(1).cast("bigint").alias("n"))
    if listed is not None:
        rows = rows.unionByName(listed.select(*keys, F.lit(0).cast("bigint").alias("n")))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_matches"))


def results_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results documents, one per building and range of part keys; every third confidence is quoted."""
    match = F.struct(
        F.col("index_id"),
        F.col("confidence"),
        F.when(F.col("true_label") == 1, F.lit("1")).when(F.col("true_label") == 0, "0.0").alias("true_label"),
        F.col("predicted_label"),
    )
    rows = pairs(spark, sf_dir).withColumn(
        "_range", F.floor(F.col("index_id").cast("bigint") / PARTS_PER_RESULTS_DOCUMENT)
    )
    # The order's key, too, as pairs already lie by it: no shuffle is needed.
    grouped = rows.groupBy("file_name", "building_id", "bld_pos", "_range").agg(
        F.sort_array(F.collect_list(F.struct("match_pos", match.alias("m")))).alias("items")
    )

    def written(item: Column) -> Column:
        number = item["m"]["confidence"]
        quoted = F.when(item["match_pos"] % 3 == 0, number.cast("string").cast("variant"))
        return item["m"].withField("confidence", F.coalesce(quoted, number.cast("variant")))

    nested = F.create_map(
        "file_name",
        F.create_map(
            "building_id",
            F.struct(F.transform("items", written).alias("possible_matches")),
        ),
    )
    return grouped.select(
        F.concat_ws("/", "building_id", F.col("_range").cast("string")).alias("doc_path"),
        F.to_json(nested).alias("document"),
    )


def results_document(spark: SparkSession, sf_dir: str) -> str:
    """One results document of all pairs, written in parts by many tasks; the folder of the parts."""
    rows = pairs(spark, sf_dir).groupBy("file_pos", "bld_pos", "building_id").agg(
        F.sort_array(F.collect_list(F.struct("match_pos", F.struct("index_id", "confidence", "true_label", "predicted_label").alias("m")))).alias("items")
    )
    listed = F.to_json(F.struct(F.transform("items", lambda i: i["m"]).alias("possible_matches")))
    # Every text is followed by a closing brace when it is written, so each leaves its last one out.
    buildings = rows.select("file_pos", "bld_pos", F.concat(F.lit(',"'), "building_id", F.lit('":'), F.substring(listed, F.lit(1), F.length(listed) - 1)).alias("text"))
    files = spark.range(25).select(F.col("id").alias("file_pos"))
    opened = F.concat(F.when(F.col("file_pos") == 0, "{").otherwise(","), F.lit('"tile_'), F.col("file_pos").cast("string"), F.lit('.json":{"none":{"possible_matches":[]'))
    first = files.select("file_pos", F.lit(-1).cast("bigint").alias("bld_pos"), opened.alias("text"))
    last = files.select("file_pos", F.lit((1 << 62)).cast("bigint").alias("bld_pos"), F.lit("").alias("text"))
    end = spark.range(1).select(F.lit(25).cast("bigint").alias("file_pos"), F.lit(0).cast("bigint").alias("bld_pos"), F.lit("").alias("text"))
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    # The order is sampled before it is sorted: stored, the texts are made once.
    buildings = stored(buildings, path=(kept := scratch(spark)), dense=True)
    order, parts = ("file_pos", "bld_pos"), tasks_of(spark, buildings.count(), BUILDINGS_PER_PART)
    texts = buildings.unionByName(first).unionByName(last).unionByName(end).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    large.write_fragments(texts, path)
    remove(spark, kept)
    return path


def metrics_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics summaries, one per supplier."""
    record = F.struct(
        F.col("s_suppkey").alias("candidates_in_file"),
        (F.col("s_suppkey") % 7).alias("potential_matches_in_blocking"),
        (F.col("s_acctbal") / 8).alias("threshold_precision"),
        F.lit("3").alias("best_match_true_positives"),
    )
    name = F.concat(F.lit("tile_"), F.col("s_suppkey").cast("string"), F.lit(".json"))
    document = F.create_map(
        F.lit(DEFAULT_MODEL), F.struct(F.create_map(name, record).alias("file_metrics"))
    )
    return table(spark, sf_dir, "supplier").select(name.alias("doc_path"), F.to_json(document).alias("document"))


# --- features and requests ---------------------------------------------------------------------


def _more_features(name: str, pos: int, value: Column | None = None, items: Column | None = None, text: Column | None = None) -> list[Column]:
    """Columns of one more feature of every vector."""
    null = F.lit(None)
    return [
        "building_id",
        F.lit(name).alias("feature_name"),
        (null if value is None else value).cast("double").alias("value"),
        (null if items is None else items).cast("array<double>").alias("value_array"),
        (null if text is None else text).cast("string").alias("value_json"),
        (F.col("vec_id") * 1000 + pos).alias("pos"),
    ]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features with ``pos``; embedding 0 of each vector is also written once before, with
    another value, so that the last one must win. Three more features hold an array, a text and an object."""
    vectors = table(spark, sf_dir, "embeddings").select(padded("vec_id").alias("building_id"), "vec_id", "embedding", "label")
    rows = vectors.select("building_id", "vec_id", F.posexplode("embedding").alias("n", "value")).select(
        "building_id",
        F.concat(F.lit("f"), F.col("n").cast("string")).alias("feature_name"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("array<double>").alias("value_array"),
        F.lit(None).cast("string").alias("value_json"),
        (F.col("vec_id") * 1000 + F.col("n") + 1).alias("pos"),
    )
    label = F.col("label").cast("string")
    return (
        rows.unionByName(vectors.select(*_more_features("f0", 0, value=F.lit(-1.0))))
        .unionByName(vectors.select(*_more_features("shape", 900, items=F.slice("embedding", 1, 3))))
        .unionByName(vectors.select(*_more_features("note", 901, text=F.concat(F.lit('"class '), label, F.lit('"')))))
        .unionByName(vectors.select(*_more_features("meta", 902, text=F.concat(F.lit('{"label":'), label, F.lit("}")))))
    )


def property_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property dictionaries, one per vector, with entries that must be skipped, values that are no numbers, a
    building that stands twice in a feature, and an object that repeats a key."""
    vectors = table(spark, sf_dir, "embeddings").select(padded("vec_id").alias("id"), "embedding", "label")
    entries = F.transform(
        "embedding",
        lambda v, n: F.struct(
            F.concat(F.lit("f"), n.cast("string")).alias("k"),
            F.to_variant_object(F.struct(F.create_map(F.col("id"), v.cast("double")).alias("cands"))).alias("v"),
        ),
    )
    others = F.array(
        F.struct(F.lit("note").alias("k"), F.lit("text").cast("variant").alias("v")),
        F.struct(F.lit("shape").alias("k"), F.to_variant_object(F.struct(F.create_map(F.col("id"), F.slice("embedding", 1, 3).cast("array<double>")).alias("cands"))).alias("v")),
        F.struct(F.lit("list").alias("k"), F.to_variant_object(F.struct(F.array(F.lit(1)).alias("cands"))).alias("v")),
    )
    plain = F.to_json(F.map_from_entries(F.concat(entries, others)))
    odd = F.format_string(
        ',"twice":{"cands":{"%1$s":-1,"%1$s":%2$d}},"name":{"cands":{"%1$s":"class %2$d"}},"meta":{"cands":{"%1$s":{"label":%2$d}}},'
        '"again":{"cands":{"%1$s":{"a":1,"a":2}}}}',
        "id", "label",
    )
    return vectors.select(
        F.col("id").alias("doc_path"), F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), odd).alias("document")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in four spellings: prefixed, padded, bare, and by name."""
    spelled = F.array(
        building("c_custkey"), padded("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_name")
    )
    return table(spark, sf_dir, "customer").select(F.explode(spelled).alias("request_id"))


# --- CityJSON documents ------------------------------------------------------------------------


def _solid(base: Column) -> Column:
    """Box (six faces) with an inner shell (four faces)."""
    def face(*corners: int) -> Column:
        return F.array(F.array(*[base + c for c in corners]))

    outer = F.array(
        face(0, 1, 2, 3), face(4, 5, 6, 7), face(0, 1, 5, 4), face(1, 2, 6, 5), face(2, 3, 7, 6), face(3, 0, 4, 7)
    )
    inner = F.array(face(8, 9, 10), face(8, 9, 11), face(9, 10, 11), face(10, 8, 11))
    return F.array(outer, inner)


def _surfaces(base: Column) -> Column:
    """Footprint with repeated points, and a roof with an invalid index."""
    ring = F.array(*[base + c for c in (0, 0, 1, 2, 2, 3)])
    roof = F.array(base + 4, base + 5, base + 6, F.lit(-1))
    return F.array(F.array(ring), F.array(roof))


def _composite(base: Column) -> Column:
    return F.array(F.array(F.array(*[base + c for c in (4, 5, 6, 7)])))


def _corners(item: Column) -> Column:
    """Twelve stored vertices of one object."""
    x, y = (item["k"] % 1000) * 20, F.floor(item["k"] / 1000) * 20
    s, h = item["size"].cast("bigint"), (item["size"] % 7).cast("bigint")
    flat = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    low = [F.array(a, b, F.lit(0).cast("bigint")) for a, b in flat]
    high = [F.array(a, b, h) for a, b in flat]
    deep = F.lit(-5).cast("bigint")
    inner = [
        F.array(x + 1, y + 1, deep),
        F.array(x + 2, y + 1, deep),
        F.array(x + 1, y + 2, deep),
        F.array(x + 1, y + 1, F.lit(100).cast("bigint")),
    ]
    return F.array(*low, *high, *inner)


def _box_documents(items: DataFrame, source: str, prefix: str) -> DataFrame:
    """CityJSON texts of boxes from ``k, size, kind, name``."""
    distinct = items.groupBy("k").agg(
        F.max("size").alias("size"), F.min("kind").alias("kind"), F.min("name").alias("name")
    )
    # Documents are few and dear to parse: their number decides how many tasks get them, not their bytes. Where all cores have
    # several tasks anyway, a task gets more of them, as each writes a file of its own.
    documents = items.count() // OBJECTS_PER_DOCUMENT
    tasks = max(1, min(documents // DOCUMENTS_PER_TASK, max(documents // DOCUMENTS_PER_LARGE_TASK, 4 * items.sparkSession.sparkContext.defaultParallelism)))
    blocks = distinct.withColumn("block", F.floor(F.col("k") / OBJECTS_PER_DOCUMENT)).repartition(tasks, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("k", "size", "kind", "name"))).alias("items")
    )

    def city_object(item: Column, i: Column) -> Column:
        base = i * VERTICES_PER_OBJECT
        geometry = [("Solid", _solid), ("MultiSurface", _surfaces), ("CompositeSurface", _composite)]
        return F.struct(
            F.concat(F.lit(prefix), F.lpad(item["k"].cast("string"), 16, "0")).alias("id"),
            F.struct(
                item["kind"].alias("type"),
                F.struct(
                    F.when(item["size"] % 2 == 0, item["name"]).alias("name"),
                    F.when(item["size"] % 3 != 0, item["size"] % 5).alias("measuredHeight"),
                    item["size"].alias("height"),
                ).alias("attributes"),
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("type"), build(base).cast("variant").alias("boundaries"))
                        for kind, build in geometry
                    ]
                ).alias("geometry"),
            ).alias("value"),
        )

    turn = F.col("block") % 3
    numbers = lambda *values: F.array(*[F.lit(float(v)) for v in values])
    crs = F.when(turn == 0, "urn:ogc:def:crs:EPSG::7415").when(turn == 2, "EPSG:4326")
    document = F.struct(
        F.lit("CityJSON").alias("type"),
        F.when(turn != 0, F.lit("1.1")).alias("version"),
        F.when(turn != 1, F.struct(numbers(0.5, 0.5, 0.5).alias("scale"), numbers(1000, 2000, 10).alias("translate"))).alias("transform"),
        F.when(
            turn != 1,
            F.struct(
                crs.alias("referenceSystem"),
                F.when(turn == 2, numbers(-170, -80, 0, 170, 80, 60)).alias("geographicalExtent"),
            ),
        ).alias("metadata"),
        F.map_from_entries(F.transform("items", city_object)).alias("CityObjects"),
        F.flatten(F.transform("items", _corners)).alias("vertices"),
    )
    return blocks.select(
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{CITY_FOLDER}/Source {source}/tile_"), F.col("block").cast("string"), F.lit(".json")).alias("file_path"),
        F.to_json(document).alias("document"),
    )


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B: one box per part."""
    kind = (
        F.when(F.col("p_type") == "LARGE", "Building")
        .when(F.col("p_type") == "SMALL", "BuildingPart")
        .when(F.col("p_type") == "MEDIUM", "PlantCover")
        .when(F.col("p_type") == "PROMO", "WaterBody")
        .otherwise(F.col("p_type"))
    )
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), kind.alias("kind"), F.col("p_name").alias("name")
    )
    return _box_documents(items, "B", "")


def odd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents, by the number of their block: as they are; with three vertices that are not three numbers, an
    object and an attribute that repeat; with text after the end."""
    number = F.regexp_extract("file_path", "tile_([0-9]+)", 1).cast("int") % 3
    end = F.lit(-1)
    body = F.substring("document", F.lit(1), F.length("document") + end)
    more = F.lit(',"vertices":[[1,2],["3",4,5],null,[1,2,3],[0,"x",1]],"CityObjects":{"a":{"type":"Road"},"a":{"type":"Building","attributes":{"name":"n","name":"m"}}}}')
    odd = F.concat(F.regexp_replace(F.regexp_replace(body, '"vertices":', '"old":'), '"CityObjects":', '"older":'), more)
    text = F.when(number == 1, odd).when(number == 2, F.concat("document", F.lit(" }"))).otherwise(F.col("document"))
    return index_documents(spark, sf_dir).withColumn("document", text)


def short_documents(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Index documents (those given, or built anew); every third has three vertices only, which its objects need more of."""
    number = F.regexp_extract("file_path", "tile_([0-9]+)", 1).cast("int") % 3
    few = F.regexp_replace("document", r'"vertices":\[.*\]\}$', '"vertices":[[0,0,0],[1,1,1],[2,2,2]]}')
    index = index_documents(spark, sf_dir) if index is None else index
    return index.withColumn("document", F.when(number == 1, few).otherwise(F.col("document")))


def earlier_documents(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Index documents before a change: every fifth is not there yet, others are those of :func:`short_documents`, and every fourth has an old
    file beside it."""
    number = F.regexp_extract("file_path", "tile_([0-9]+)", 1).cast("int")
    short = short_documents(spark, sf_dir, index)
    old = short.where(number % 4 == 2).withColumn("file_path", F.concat("file_path", F.lit(".old")))
    return short.where(number % 5 != 0).unionByName(old)


def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A: one box per order."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_orderkey") % 50 + 1).cast("int").alias("size"),
        F.lit("Building").alias("kind"),
        F.col("o_orderstatus").alias("name"),
    )
    return _box_documents(items, "A", "bag_")


def both_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_documents(spark, sf_dir).unionByName(index_documents(spark, sf_dir))


def comparison_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources; in every third document the objects have their CompositeSurface only."""
    number = F.regexp_extract("file_path", "tile_([0-9]+)", 1).cast("int") % 3
    others = r'\{"type":"(?:Solid|MultiSurface)","boundaries":[\[\],0-9-]*\},'
    composite = F.regexp_replace("document", others, "")
    return both_documents(spark, sf_dir).withColumn("document", F.when(number == 1, composite).otherwise(F.col("document")))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of both sources' files, as a listing of the data root gives them."""
    parts = [
        table(spark, sf_dir, name).select(
            F.concat(
                F.lit(f"{CITY_FOLDER}/Source {source}/tile_"),
                F.floor(F.col(key) / OBJECTS_PER_DOCUMENT).cast("string"),
                F.lit(".json"),
            ).alias("path")
        )
        for source, name, key in (("A", "orders", "o_orderkey"), ("B", "part", "p_partkey"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def dated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with ``size`` and ``mtime`` of each file."""
    number = F.regexp_extract("path", "tile_([0-9]+)", 1).cast("bigint")
    return listing(spark, sf_dir).select("path", (number * 7).alias("size"), F.timestamp_micros(number * 1000003 + 1600000000000000).alias("mtime"))


def path_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for files in several spellings, some of which do not exist."""
    number = F.floor(F.col("p_partkey") / 10).cast("string")
    tile = F.concat(F.lit("tile_"), number, F.lit(".json"))
    spelled = F.array(
        tile,
        F.concat(F.lit("Source B/"), tile),
        F.concat(F.lit("RawCitiesData/The%20Hague/Source%20B/"), tile),
        F.concat(F.lit("elsewhere+%zz/"), tile),
        F.concat(F.lit("tile+"), number),
    )
    return table(spark, sf_dir, "part").select(F.explode(spelled).alias("request_path")).distinct()


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose attributes are the properties of events."""
    return table(spark, sf_dir, "events").select(
        F.lit("A").alias("source"),
        F.lit("events").alias("file_path"),
        F.concat(F.lit("ev_"), padded("event_id")).alias("object_id"),
        F.nullif("event_type", F.lit("click")).alias("object_type"),
        F.try_parse_json("props").alias("attributes"),
    )


def building_ids(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """``building_id`` of a source, straight from the tables."""
    if source == "A":
        return table(spark, sf_dir, "orders").select(building("o_orderkey").alias("building_id"))
    return table(spark, sf_dir, "part").select(padded("p_partkey").alias("building_id"))


def bare_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City objects of both sources without geometry, as the object table holds them."""
    def objects(source: str, name: str, key: str, identity: Column) -> DataFrame:
        block = F.floor(F.col(key) / OBJECTS_PER_DOCUMENT)
        return table(spark, sf_dir, name).select(
            F.lit(source).alias("source"),
            F.concat(F.lit(f"{CITY_FOLDER}/Source {source}/tile_"), block.cast("string"), F.lit(".json")).alias("file_path"),
            F.col(key).alias("obj_pos"),
            identity.alias("object_id"),
            (F.col(key) % 11 == 10).alias("is_empty"),
            digit_run(identity).alias("numeric_id"),
        )

    return objects("A", "orders", "o_orderkey", building("o_orderkey")).unionByName(
        objects("B", "part", "p_partkey", padded("p_partkey"))
    )
