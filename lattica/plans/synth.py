"""A block table derived from lineitem rows, for queries and tests where no block file is at hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("oak_log", "oak_leaves", "birch_log", "birch_leaves", "oak_wood", "stone", "dirt", "grass_block", "sand", "sandstone", "terracotta", "oak_planks", "glass", "cobblestone", "oak_stairs", "short_grass", "stripped_oak_log", "iron_ore", "red_terracotta", "azalea_leaves")
#: Properties by l_returnflag.
PROPS = {"A": "axis=x,waterlogged=false", "N": "axis=y,half=top,powered=true", "R": "axis=z"}

#: Rows up to which the table lies in a square of 96 by 96 columns; with more, its sides grow so that as many rows fall on a place.
ROWS = 1_000_000
#: The sides' factor, as SQL.
GROWN = f"(SELECT CAST(greatest(1, ceil(sqrt(count(*) / {ROWS}.0))) AS BIGINT) FROM lineitem)"

X = "CAST((l_orderkey * 7 + l_linenumber * 13) % (96 * {grown}) - 48 * {grown} AS INT)"
Y = "CAST((l_suppkey * 5 + l_linenumber) % 32 - 8 AS INT)"
Z = "CAST((l_partkey * 11 + l_linenumber) % (96 * {grown}) - 48 * {grown} AS INT)"
NAME = "CASE CAST(l_partkey % 20 AS INT) " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"
PROP = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROPS.items()) + " ELSE 'None' END"

#: The same table in SQL, as a common table expression named vox.
VOX = f"""vox AS (SELECT x, y, z, name, prop FROM (
  SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) AS rn
  FROM (SELECT {X.format(grown=GROWN)} AS x, {Y} AS y, {Z.format(grown=GROWN)} AS z, {NAME} AS name, {PROP} AS prop, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)
) WHERE rn = 1)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per lineitem row, coordinates repeating: its place and, in row, the order in which later rows win, with name and prop."""
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.expr(NAME).alias("name"), F.expr(PROP).alias("prop"))
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grown = max(1, math.ceil(math.sqrt(table.count() / ROWS)))  # the count comes from the files' footers
    return table.select(F.expr(X.format(grown=grown)).alias("x"), F.expr(Y).alias("y"), F.expr(Z.format(grown=grown)).alias("z"), row.alias("row"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, name, prop), one per place, the last row winning: a grouped maximum.

    Few rows share a place, so they are dealt by place first: tasks sort their share of the places then, and not the whole of a file's part.
    """
    last = rows(spark, sf_dir).repartition("x", "y", "z").groupBy("x", "y", "z").agg(F.max("row").alias("row"))
    return last.select("x", "y", "z", "row.name", "row.prop")
