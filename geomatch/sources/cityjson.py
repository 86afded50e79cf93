"""CityJSON documents as tables.

A document is one row, and everything an object needs from it (its share of the vertex pool) is
gathered inside that row, before the objects are exploded. So documents become self-contained object
rows in one narrow pass: no shuffle, no join, and no copy of the pool per object.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions.ids import digit_run, own_aliases
from geomatch.functions.objects import dict_entries, unique_map
from geomatch.sources.catalog import decode_path, relative_path

_SURFACE_TYPES = ("MultiSurface", "CompositeSurface")
_GEOMETRIES = "type string, attributes string, geometry array<struct<type: string, boundaries: string>>"


def read_documents(
    spark: SparkSession, roots: Mapping[str, str], data_root: str | None = None, pattern: str = "*.json"
) -> DataFrame:
    """Whole texts of the files below each source root: ``source, file_path, document``."""
    parts = []
    for source, root in roots.items():
        texts = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .text(root, wholetext=True)
        )
        path = relative_path(decode_path(F.col("_metadata.file_path")), data_root or root)
        parts.append(
            texts.select(F.lit(source).alias("source"), path.alias("file_path"), F.col("value").alias("document"))
        )
    documents = parts[0]
    for part in parts[1:]:
        documents = documents.unionByName(part)
    return documents


_END = "end of document"


def _whole(fields: str) -> Column:
    """The parsed document as an array of one, or an empty array if the text is not one JSON object and nothing else.

    The text is read as the first of two array elements: anything after its closing brace would leave another second element, or none. So one
    parse gives the fields and tells whether they are a whole document; it stands in one expression, which no filter can repeat.
    """
    text = F.concat(F.lit("["), "document", F.lit(f',{{"{_END}":true}}]'))
    both = F.from_json(text, f"array<struct<{fields}, `{_END}`: boolean>>")
    ended = lambda d: (F.size(d) == 2) & F.coalesce(F.get(d, F.lit(1))[_END], F.lit(False)) & F.ltrim("document").startswith("{")
    return F.transform(F.filter(F.array(both), ended), lambda d: F.get(d, F.lit(0)))


def well_formed() -> Column:
    """The text is one JSON object and nothing else."""
    return F.coalesce(F.size(_whole("version: string")) == 1, F.lit(False))


def bad_files(documents: DataFrame) -> DataFrame:
    """Files whose text is not a JSON object: ``source, file_path``."""
    return documents.where(~well_formed()).select("source", "file_path")


def parsed_documents(documents: DataFrame, fields: str, *keep: str) -> DataFrame:
    """``source, file_path, doc, document``; malformed documents yield no rows."""
    return documents.select("source", "file_path", F.explode(_whole(fields)).alias("doc"), "document", *keep)


def vertex_pool() -> Column:
    """Vertices as numbers, from ``doc.vertices`` of type ``array<array<double>>``.

    That parse is NULL as a whole if one vertex holds anything else; only then each vertex is read by itself:
    numbers in quotes count, other entries are NULL, and what is no array is a NULL vertex.
    """
    texts = F.from_json("document", "vertices array<string>")["vertices"]
    numbers = F.transform(
        texts, lambda v: F.transform(F.from_json(v, "array<string>"), lambda x: x.try_cast("double"))
    )
    return F.coalesce("doc.vertices", numbers).alias("pool")


def _with_unique_keys(column: str) -> Column:
    """Attributes text as a variant. A variant takes each key once, so of repeated keys the last value counts."""
    members = F.from_json(F.col(column), "map<string, variant>")
    return F.coalesce(F.try_parse_json(column), F.to_variant_object(unique_map(members))).alias("attributes")


def _numbers(column: str, path: str) -> Column:
    return F.try_variant_get(column, path, "array<double>")


def _affine(column: str) -> Column:
    """Scale and translation of a document's transform as one array of six; without a transform, the
    identity.

    One array, because a column that is used once may be merged into the expression using it, and
    inside a per-vertex expression it would then be evaluated for every vertex.
    """
    parts = (("scale", 1.0), ("translate", 0.0))
    return F.array(
        *[
            F.coalesce(F.get(_numbers(column, f"$.{part}"), F.lit(i)), F.lit(default))
            for part, default in parts
            for i in range(3)
        ]
    ).alias("affine")


def _dequantised(vertex: Column) -> list[Column]:
    return [
        (F.get(vertex, F.lit(i)) * F.get("affine", F.lit(i)) + F.get("affine", F.lit(i + 3))).alias(a)
        for i, a in enumerate("xyz")
    ]


def city_files(documents: DataFrame) -> DataFrame:
    """Headers: ``source, file_path, version, crs, scale, translate, extent, n_objects, n_vertices``."""
    parsed = parsed_documents(
        documents,
        "version string, metadata variant, transform variant, "
        "vertices array<string>, CityObjects map<string, string>",
    )
    return parsed.select(
        "source",
        "file_path",
        F.col("doc.version").alias("version"),
        F.try_variant_get("doc.metadata", "$.referenceSystem", "string").alias("crs"),
        _numbers("doc.transform", "$.scale").alias("scale"),
        _numbers("doc.transform", "$.translate").alias("translate"),
        _numbers("doc.metadata", "$.geographicalExtent").alias("extent"),
        F.coalesce(F.size(F.array_distinct(F.map_keys("doc.CityObjects"))), F.lit(0)).alias("n_objects"),
        F.coalesce(F.size("doc.vertices"), F.lit(0)).alias("n_vertices"),
    )


def city_objects(documents: DataFrame) -> DataFrame:
    """Objects in document order: ``source, file_path, obj_pos, object_id, object_type, attributes,
    is_empty, numeric_id`` (the digit run, NULL without one)."""
    objects = (
        parsed_documents(documents, "CityObjects map<string, string>")
        .select("source", "file_path", F.col("doc.CityObjects").alias("members"))
        .select("source", "file_path", F.explode(dict_entries(F.col("members"))).alias("o"))
        .select("source", "file_path", "o.*", F.from_json("o.value", "type string, attributes string").alias("parsed"))
    )
    return objects.select(
        "source",
        "file_path",
        F.col("pos").alias("obj_pos"),
        F.col("key").alias("object_id"),
        F.col("parsed.type").alias("object_type"),
        _with_unique_keys("parsed.attributes"),
        (F.coalesce(F.size(F.json_object_keys("value")), F.lit(0)) <= 0).alias("is_empty"),
        digit_run(F.col("key")).alias("numeric_id"),
    )


def vertices(documents: DataFrame) -> DataFrame:
    """The vertex pool: ``source, file_path, vertex_idx, vx, vy, vz`` as stored and ``x, y, z``
    de-quantised by the document's transform, if it has one."""
    pool = (
        parsed_documents(documents, "transform variant, vertices array<array<double>>")
        .select("source", "file_path", _affine("doc.transform"), vertex_pool())
        .select("source", "file_path", "affine", F.posexplode("pool").alias("vertex_idx", "v"))
    )
    return pool.select(
        "source",
        "file_path",
        "vertex_idx",
        *[F.get("v", F.lit(i)).alias(f"v{a}") for i, a in enumerate("xyz")],
        *_dequantised(F.col("v")),
    )


def _flat(nested: Column) -> Column:
    """``flatten`` that skips missing parts."""
    return F.flatten(F.array_compact(nested))


def nested_indices(boundaries: Column, depth: int, decimals: bool = True) -> Column:
    """Boundaries text as nested arrays of vertex indices; entries that are no whole number are NULL.

    ``decimals`` accepts ``1.0`` as 1: viewing does, extraction does not.
    """

    def kind(element: str) -> str:
        return "array<" * depth + element + ">" * depth

    def whole(part: Column, level: int) -> Column:
        if level == 0:
            number = part.try_cast("double")
            is_whole = number == F.floor(number)
            return F.when(is_whole, number.try_cast("int")) if decimals else part.try_cast("int")
        return F.transform(part, lambda inner: whole(inner, level - 1))

    # One entry that is not an integer makes the typed parse NULL, and only then the texts are read.
    return F.coalesce(
        F.from_json(boundaries, kind("int")), whole(F.from_json(boundaries, kind("string")), depth)
    )


def _rings(geometry: Column, decimals: bool = True) -> Column:
    """All rings of a geometry: ``array<struct<shell, face, ring, idx>>``, dispatched on its type."""
    no_shell = F.lit(None).cast("int")

    def face_rings(shell: Column, face: Column, f: Column) -> Column:
        return F.transform(
            face,
            lambda ring, r: F.struct(
                shell.alias("shell"), f.alias("face"), r.alias("ring"), ring.alias("idx")
            ),
        )

    solid = _flat(
        F.transform(
            nested_indices(geometry["boundaries"], 4, decimals),
            lambda shell, s: _flat(F.transform(shell, lambda face, f: face_rings(s, face, f))),
        )
    )
    surfaces = _flat(
        F.transform(
            nested_indices(geometry["boundaries"], 3, decimals), lambda face, f: face_rings(no_shell, face, f)
        )
    )
    return F.when(geometry["type"] == "Solid", solid).when(geometry["type"].isin(*_SURFACE_TYPES), surfaces)


def _points(ring: Column) -> Column:
    """Points of a ring with their coordinates, from the de-quantised pool ``xyz``; indices outside the pool drop out."""

    def point(idx: Column, pos: Column) -> Column:
        # The pool is named for each axis: named once, it may be merged into this expression and read for every point.
        v = F.get("xyz", idx)
        return F.struct(pos.alias("vpos"), idx.alias("vertex_idx"), *[v[a].alias(a) for a in "xyz"])

    return F.filter(F.transform(ring, point), lambda p: p["x"].isNotNull())


def _object_rows(
    documents: DataFrame, geom_types: Sequence[str], first_only: bool, described: bool
) -> DataFrame:
    """Objects with ``geometries`` gathered; ``described`` adds the columns of :func:`city_objects`."""
    parsed = parsed_documents(
        documents, "transform variant, vertices array<array<double>>, CityObjects map<string, string>"
    ).select(
        "source",
        "file_path",
        _affine("doc.transform"),
        vertex_pool(),
        F.col("doc.CityObjects").alias("members"),
    )
    # A vertex stands in several rings: it is de-quantised once.
    parsed = parsed.select("source", "file_path", "members", F.transform("pool", lambda v: F.struct(*_dequantised(v))).alias("xyz"))

    def typed(o: Column) -> Column:
        empty = F.coalesce(F.size(F.json_object_keys(o["value"])), F.lit(0)) <= 0
        return F.struct(
            o["pos"].alias("pos"),
            o["key"].alias("key"),
            F.from_json(o["value"], _GEOMETRIES).alias("object"),
            *([empty.alias("is_empty")] if described else []),
        )

    def with_geometries(o: Column) -> Column:
        found = o["object"]["geometry"]
        numbered = F.transform(
            F.slice(found, F.lit(1), F.lit(1)) if first_only else found,
            lambda g, i: F.struct(i.alias("geom_idx"), g["type"].alias("type"), g["boundaries"].alias("boundaries")),
        )
        gathered = F.transform(
            F.filter(numbered, lambda g: g["type"].isin(*geom_types)),
            lambda g: F.struct(
                g["geom_idx"].alias("geom_idx"),
                g["type"].alias("geom_type"),
                F.transform(
                    _rings(g),
                    lambda r: F.struct(r["shell"], r["face"], r["ring"], _points(r["idx"]).alias("points")),
                ).alias("rings"),
            ),
        )
        more = [o["object"]["attributes"].alias("attributes"), o["is_empty"].alias("is_empty")] if described else []
        return F.struct(
            o["pos"].alias("obj_pos"),
            o["key"].alias("object_id"),
            o["object"]["type"].alias("object_type"),
            *more,
            gathered.alias("geometries"),
        )

    entries = F.transform(F.transform(dict_entries(F.col("members")), typed), with_geometries)
    rows = parsed.select("source", "file_path", F.explode(entries).alias("o")).select("source", "file_path", "o.*")
    if not described:
        return rows
    return rows.withColumns(
        {"attributes": _with_unique_keys("attributes"), "numeric_id": digit_run(F.col("object_id"))}
    )


def object_table(documents: DataFrame, first_only: bool = False) -> DataFrame:
    """The columns of :func:`city_objects` and ``geometries`` of every type, from one parse of each
    document. This is the table to write; :func:`geometries_of` reads geometries from it. ``first_only``
    keeps the first geometry of each object."""
    return _object_rows(documents, ("Solid", *_SURFACE_TYPES), first_only, True)


def geometries_of(
    objects: DataFrame, geom_types: Sequence[str] = ("Solid", "MultiSurface"), first_only: bool = False
) -> DataFrame:
    """:func:`object_geometries` from a written :func:`object_table`."""
    keys = ["source", "file_path", "obj_pos", "object_id", "object_type"]
    rows = objects.select(*keys, F.explode("geometries").alias("g")).select(*keys, "g.*")
    rows = rows.where(F.col("geom_type").isin(*geom_types))
    return rows.where("geom_idx = 0") if first_only else rows


def object_geometries(
    documents: DataFrame, geom_types: Sequence[str] = ("Solid", "MultiSurface"), first_only: bool = False
) -> DataFrame:
    """One row per geometry of an object: ``source, file_path, obj_pos, object_id, object_type,
    geom_idx, geom_type, rings``; ``rings`` is ``array<struct<shell, face, ring, points>>`` and
    carries the coordinates. ``first_only`` keeps the first geometry of each object.
    """
    return geometries_of(_object_rows(documents, geom_types, first_only, False), geom_types, first_only)


def ring_vertices(geometries: DataFrame) -> DataFrame:
    """:func:`object_geometries` as flat points: ``shell, face, ring, vpos, vertex_idx, x, y, z``."""
    keys = ["source", "file_path", "object_id", "geom_idx", "geom_type"]
    return (
        geometries.select(*keys, F.explode("rings").alias("r"))
        .select(*keys, "r.shell", "r.face", "r.ring", F.explode("r.points").alias("p"))
        .select(*keys, "shell", "face", "ring", "p.*")
    )


def object_cells(documents: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Self-contained objects: each row holds the object, the header of its document and exactly the
    vertices it uses. ``used`` are their indices in the document, in ascending order (also those
    outside the pool, which have no vertex); ``own_vertices`` are stored, quantised coordinates, and
    ``value`` is the object's text.

    ``asked`` (``source, file_path, wanted``: a map from the aliases looked for in a file to the requests that do, one row per file) keeps the objects
    that have one of them, with ``hits``, an array of ``alias, request_id``. Other documents are not parsed, and other objects gather no vertices.
    """
    fields = (
        "version variant, metadata variant, transform variant, "
        "vertices array<array<double>>, CityObjects map<string, string>"
    )
    if asked is None:
        parsed = parsed_documents(documents, fields).withColumn("wanted", F.lit(None).cast("map<string, array<string>>"))
    else:
        # Texts are looked at after the join only: those that nobody wants are not there any more.
        parsed = parsed_documents(documents.join(asked.where(F.size("wanted") > 0), ["source", "file_path"]), fields, "wanted")
    parsed = parsed.select("source", "file_path", "doc", vertex_pool(), "wanted", F.col("doc.CityObjects").alias("members"))

    def used(value: Column) -> Column:
        found = F.from_json(value, _GEOMETRIES)["geometry"]
        indexed = F.filter(found, lambda g: g["type"].isin("Solid", "MultiSurface"))
        rings = _flat(F.transform(indexed, lambda g: _rings(g, decimals=False)))
        indices = F.filter(_flat(F.transform(rings, lambda r: r["idx"])), lambda i: i >= 0)
        return F.sort_array(F.array_distinct(indices))

    def with_used(o: Column) -> Column:
        return F.struct(
            o["pos"].alias("obj_pos"),
            o["key"].alias("object_id"),
            o["value"].alias("value"),
            F.coalesce(used(o["value"]), F.array().cast("array<int>")).alias("used"),
        )

    def with_vertices(o: Column) -> Column:
        inside = F.filter(o["used"], lambda i: i < F.size("pool"))
        own = F.transform(inside, lambda i: F.get("pool", i))
        more = [] if asked is None else [hits(o["object_id"]).alias("hits")]
        return F.struct(o["obj_pos"], o["object_id"], o["value"], o["used"], own.alias("own_vertices"), *more)

    def hits(key: Column) -> Column:
        requests = lambda a: F.coalesce(F.try_element_at("wanted", a), F.array().cast("array<string>"))
        return F.flatten(F.transform(own_aliases(key), lambda a: F.transform(requests(a), lambda r: F.struct(a.alias("alias"), r.alias("request_id")))))

    entries = dict_entries(F.col("members"))
    if asked is not None:
        entries = F.filter(entries, lambda o: F.arrays_overlap(own_aliases(o["key"]), F.map_keys("wanted")))
    cells = F.transform(F.transform(entries, with_used), with_vertices)
    return parsed.select(
        "source", "file_path", "doc.version", "doc.metadata", "doc.transform", F.explode(cells).alias("o")
    ).select("source", "file_path", "version", "metadata", "transform", "o.*")


def city_quality(documents: DataFrame) -> DataFrame:
    """What a scan could not take as it is, one row per file: ``source, file_path, is_readable, n_vertices,
    n_bad_vertices, n_objects, n_repeated_objects, n_repeated_attributes``.

    A bad vertex has fewer than three numbers. A repeated object or attribute is a key that stands more than once in its
    dictionary: the last value counts.
    """
    fields = "vertices array<array<double>>, CityObjects map<string, string>"
    # Unreadable files stay, with a row of their own.
    parsed = documents.select("source", "file_path", F.explode_outer(_whole(fields)).alias("doc"), "document").withColumn("is_readable", F.col("doc").isNotNull())
    parts = parsed.select("source", "file_path", "is_readable", vertex_pool(), F.map_entries("doc.CityObjects").alias("members"))
    whole = lambda v: F.coalesce(F.size(F.filter(F.slice(v, 1, 3), lambda x: x.isNotNull())), F.lit(0)) >= 3
    repeats = lambda keys: F.coalesce(F.size(keys) - F.size(F.array_distinct(keys)), F.lit(0))
    own = F.transform("members", lambda m: repeats(F.json_object_keys(F.get_json_object(m["value"], "$.attributes"))))
    count = lambda c: F.when(F.col("is_readable"), F.greatest(c, F.lit(0))).otherwise(0).cast("bigint")
    return parts.select(
        "source",
        "file_path",
        "is_readable",
        count(F.coalesce(F.size("pool"), F.lit(0))).alias("n_vertices"),
        count(F.coalesce(F.size(F.filter("pool", lambda v: ~F.coalesce(whole(v), F.lit(False)))), F.lit(0))).alias("n_bad_vertices"),
        count(F.coalesce(F.size("members"), F.lit(0))).alias("n_objects"),
        count(repeats(F.transform("members", lambda m: m["key"]))).alias("n_repeated_objects"),
        count(F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0))), F.lit(0))).alias("n_repeated_attributes"),
    )


def object_quality(documents: DataFrame) -> DataFrame:
    """Vertices that each object names and its document lacks: ``source, file_path, obj_pos, object_id, n_indices, n_out_of_range``.

    Counted are the different indices from 0 on; an extracted object keeps those out of range as numbers without a vertex.
    """
    n = F.size("used").cast("bigint")
    return object_cells(documents).select(
        "source", "file_path", "obj_pos", "object_id", n.alias("n_indices"), (n - F.size("own_vertices")).alias("n_out_of_range")
    )


#: Tables of a set of documents: headers, objects with their geometries, vertex pools, bad files and the quality of each file.
TABLES = {
    "city_file": city_files,
    "city_object": object_table,
    "vertex": vertices,
    "bad_file": bad_files,
    "quality": city_quality,
}


def write_tables(documents: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Write :data:`TABLES` as Parquet below ``target``; ``snapshots.refresh`` also keeps them up to date.

    Whole-text JSON cannot be split, so a file is one task here; later queries read these tables
    with column pruning and row-group skipping instead.
    """
    for name, make in TABLES.items():
        make(documents).write.mode(mode).parquet(f"{target.rstrip('/')}/{name}")
