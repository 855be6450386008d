"""Region files as a Spark data source: files and chunks that a filter rules out are never opened.

    read_saved(spark, folder).where("cx between 4 and 9 and section < 4")

Filters on cx, cz and section become ranges. A region file's name says which chunks it can hold, so files out of range get no
partition; of the others only the chunks in range are read, and only sections in range are decoded. Spark applies the filters again.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .regions import SECTIONS, sections_of
from .world import _system

#: Chunks along a region's side.
REGION = 32
NAME = re.compile(r"r\.(-?\d+)\.(-?\d+)\.mca", re.IGNORECASE)


@dataclass
class RegionFile(InputPartition):
    path: str
    rx: int
    rz: int


class RegionReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        #: Least and greatest values that are asked for.
        self.ranges = {c: (-math.inf, math.inf) for c in ("cx", "cz", "section")}

    def _narrow(self, column: str, low: float, high: float) -> None:
        a, b = self.ranges[column]
        self.ranges[column] = (max(a, low), min(b, high))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.ranges and getattr(f, "value", None) is not None:
                if isinstance(f, (EqualTo, EqualNullSafe)):
                    self._narrow(column, f.value, f.value)
                elif isinstance(f, In):
                    values = [v for v in f.value if v is not None]
                    self._narrow(column, min(values, default=math.inf), max(values, default=-math.inf))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._narrow(column, f.value + isinstance(f, GreaterThan), math.inf)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._narrow(column, -math.inf, f.value - isinstance(f, LessThan))
            yield f  # a chunk that cannot be read has no section, so Spark looks at every row again

    def _wanted(self, column: str, low: int, high: int) -> bool:
        a, b = self.ranges[column]
        return a <= high and low <= b

    def partitions(self) -> list[RegionFile]:
        system, own = _system(self.folder)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(own, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and (m := NAME.fullmatch(info.base_name)):
                rx, rz = int(m[1]), int(m[2])
                if all(self._wanted(c, REGION * r, REGION * r + REGION - 1) for c, r in (("cx", rx), ("cz", rz))):
                    found.append(RegionFile(self.folder[: len(self.folder) - len(own)] + info.path if self.folder.endswith(own) else info.path, rx, rz))
        return found

    def read(self, partition: RegionFile | None):
        if partition is None:  # no file is in range
            return
        chunk = lambda cx, cz: self._wanted("cx", cx, cx) and self._wanted("cz", cz, cz)
        yield from sections_of(partition.path, partition.rx, partition.rz, chunk, lambda y: self._wanted("section", y, y))


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lattica_regions"

    def schema(self) -> str:
        return SECTIONS

    def reader(self, schema) -> RegionReader:
        return RegionReader(self.options["path"].rstrip("/"))


def read_saved(spark: SparkSession, folder: str) -> DataFrame:
    """SECTIONS of the region files below a folder, as regions.read_sections() has them, with filters pushed into the files.

    Python data sources take filters only if the session allows it, so this sets spark.sql.python.filterPushdown.enabled.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionSource)
    return spark.read.format(RegionSource.name()).load(folder)
