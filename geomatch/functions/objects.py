"""JSON objects as ordered dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dict_entries(mapping: Column) -> Column:
    """``array<struct<key, pos, value>>`` of a parsed JSON object, read like a dictionary: a
    repeated key keeps the place of its first occurrence and the value of its last.

    ``mapping`` must be a plain column. Everything happens inside the row, so no shuffle is needed;
    the sort runs only in rows that do repeat a key.
    """
    keys = F.map_keys(mapping)
    plain = F.transform(
        F.map_entries(mapping),
        lambda e, i: F.struct(e["key"].alias("key"), i.alias("pos"), e["value"].alias("value")),
    )
    tagged = F.sort_array(
        F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos")))
    )
    n = F.size(keys)
    none = F.array(F.lit(None).cast("struct<key: string, pos: int>"))
    with_next = F.arrays_zip(tagged, F.concat(F.slice(tagged, F.lit(2), n), none))
    with_previous = F.arrays_zip(tagged, F.concat(none, F.slice(tagged, F.lit(1), n - 1)))

    def edge(z: Column) -> Column:
        return z["1"]["key"].isNull() | (z["1"]["key"] != z["0"]["key"])

    firsts = F.filter(with_previous, edge)
    lasts = F.filter(with_next, edge)
    merged = F.transform(
        F.arrays_zip(firsts, lasts),
        lambda z: F.struct(
            z["0"]["0"]["key"].alias("key"),
            z["0"]["0"]["pos"].alias("pos"),
            F.get(F.map_values(mapping), z["1"]["0"]["pos"]).alias("value"),
        ),
    )
    return F.when(F.size(F.array_distinct(keys)) == n, plain).otherwise(merged)


def unique_map(mapping: Column) -> Column:
    """The mapping with each key once, by the rule of :func:`dict_entries`."""
    return F.map_from_entries(
        F.transform(dict_entries(mapping), lambda e: F.struct(e["key"], e["value"]))
    )
