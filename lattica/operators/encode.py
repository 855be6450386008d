"""Dictionary codes for names and properties: needed only where block files are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import fresh

#: What stands for nulls in dictionaries: no name, no properties, no namespace.
NULL_NAME, NULL_PROPERTIES, NULL_SPACE = "other", "None", "minecraft"


def dictionary(values: DataFrame, column: str, code: str = "id", null: str | None = None) -> DataFrame:
    """(code, column): a code for each distinct value, from 0 in the order of the values. Rows are few: one per value.

    null: the value that stands for nulls, if any is there; without it nulls have no code.
    """
    distinct = values.select((F.col(column) if null is None else F.coalesce(column, F.lit(null))).alias(column)).where(F.col(column).isNotNull()).distinct()
    return distinct.select((F.row_number().over(Window.orderBy(column)) - 1).alias(code), column)


def dictionaries(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Dictionaries (id, name), (prop, raw) and, if blocks have namespaces (column ns), (ns, space), with codes for nulls too."""
    spaces = dictionary(blocks.select(F.col("ns").alias("space")), "space", "ns", NULL_SPACE) if "ns" in blocks.columns else None
    return dictionary(blocks, "name", null=NULL_NAME), dictionary(blocks.select(F.col("prop").alias("raw")), "raw", "prop", NULL_PROPERTIES), spaces


def encoded(blocks: DataFrame, names: DataFrame, props: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """(id, prop, x, y, z), and ns with spaces, by the dictionaries (id, name), (prop, raw) and (ns, space).

    blocks carry name, prop and ns as strings; nulls count as NULL_NAME, NULL_PROPERTIES and NULL_SPACE. No row is lost: what
    a dictionary lacks gets a null code, which a file does not take (see write_world).
    """
    own = [F.coalesce("name", F.lit(NULL_NAME)).alias("name"), F.coalesce("prop", F.lit(NULL_PROPERTIES)).alias("raw")]
    rows = blocks.select("x", "y", "z", *own, *[F.coalesce("ns", F.lit(NULL_SPACE)).alias("space")] * (spaces is not None))
    rows = rows.join(names.select("id", "name"), "name", "left").join(props.select("prop", "raw"), "raw", "left")
    if spaces is not None:
        rows = rows.join(spaces.select("ns", "space"), "space", "left")
    return rows.select(*["ns"] * (spaces is not None), "id", "prop", "x", "y", "z")


def code_of(names: DataFrame, name: str) -> int:
    """A name's code; LookupError if the dictionary has none."""
    row = names.where(F.col("name") == name).select(F.min("id").alias("id")).first()
    if row.id is None:
        raise LookupError(f"the dictionary has no {name}")
    return row.id


def decoded(rows: DataFrame, names: DataFrame, props: DataFrame | None = None, missing: str = "other") -> DataFrame:
    """rows with name (missing where the code is unknown) and, with props, prop_raw. Left joins: no row is lost."""
    out = rows.join(names, "id", "left").withColumn("name", F.coalesce("name", F.lit(missing) if missing != "id" else F.concat(F.lit("unknown_"), "id")))
    if props is not None:
        out = out.join(props.select("prop", F.col("raw").alias("prop_raw")), "prop", "left")
    return out


def remapped(rows: DataFrame, old: DataFrame, new: DataFrame, column: str = "name", code: str = "id") -> DataFrame:
    """rows with their codes of one dictionary replaced by those of another for the same values.

    Left joins: no row is lost. A null code, and one whose value the new dictionary lacks or that the old one does not know, becomes null.
    """
    to = fresh(rows, "_new")[0]
    pairs = old.join(new.select(F.col(code).alias(to), column), column, "left").select(code, to)
    return rows.join(pairs, code, "left").withColumn(code, F.col(to)).drop(to)


def with_markers(names: DataFrame, *markers: str) -> DataFrame:
    """The dictionary (id, name) and, from the greatest code on, markers that it does not hold yet."""
    top = names.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    known = {r.name for r in names.where(F.col("name").isin(*markers)).select("name").collect()}
    new = [m for m in markers if m not in known]
    rows = [top.select((F.col("top") + 1 + k).cast("int").alias("id"), F.lit(m).alias("name")) for k, m in enumerate(new)]
    out = names.select(F.col("id").cast("int").alias("id"), "name")
    for row in rows:
        out = out.unionByName(row)
    return out
