"""Block properties: k=v,k=v strings as maps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import RELEVANT_PROPERTIES


def as_map(raw: Column) -> Column:
    """The map of a property string; empty for the string None, an empty string or null."""
    none = F.create_map().cast("map<string,string>")
    return F.when(raw.isNull() | raw.isin("None", ""), none).otherwise(F.str_to_map(raw, F.lit(","), F.lit("=")))


def canonical(properties: Column) -> Column:
    """The string of a map with its keys in order; None for an empty map."""
    parts = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(properties) == 0, F.lit("None")).otherwise(F.array_join(parts, ","))


def axis(raw: Column) -> Column:
    """x, y or z, or null where the properties have no axis."""
    found = F.regexp_extract(raw, r"axis=([xyz])", 1)
    return F.when(found != "", found)


def relevant(properties: Column) -> Column:
    """Only the properties that shapes depend on."""
    return F.map_filter(properties, lambda k, _: k.isin(*RELEVANT_PROPERTIES))
