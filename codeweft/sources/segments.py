"""Tables whose files are ranges of a key, with the list of those ranges.

A lookup by keys, by prefixes or by position reads only files that may hold what it
asks for. The list has one entry a file (lowest key, highest key, rows), so a table
of 100 TB has some hundred thousand entries; it is held by the driver once used.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweft.sources.scratch import Workspace

#: Rows of a file, at most.
ROWS = 1_000_000


class Segment:
    """One written table, sorted by ``key``; lookups are by the first column of it, a string."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)

    @classmethod
    def write(cls, df: DataFrame, path: str, key: Sequence[str], rows: int = ROWS, ready: bool = False, few: bool = False) -> Segment:
        """``ready``: the rows are read from a table, so that taking them twice (ranges are sampled first) costs little.

        ``few``: one task may sort them all.
        """
        spark, ws, ready = df.sparkSession, Workspace(df.sparkSession, "segment"), ready or few
        given = df if ready else ws.put(df)
        dealt = given.coalesce(1) if few else given.repartitionByRange(*key)
        dealt.sortWithinPartitions(*key).write.option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
        out = cls(spark, path, given.schema, key)
        first = F.col(key[0])
        files = out.all().groupBy(F.col("_metadata.file_name").alias("file"))
        files.agg(F.min(first).alias("low"), F.max(first).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")
        if not ready:
            ws.drop(given)
        return out

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @cached_property
    def ranges(self) -> list[tuple[str, str | None, str | None, int]]:
        """``(file, low, high, rows)`` in the order of keys; files of null keys come first."""
        rows = self.spark.read.schema("file string, low string, high string, n long").parquet(f"{self.path}/ranges").collect()
        return sorted(map(tuple, rows), key=lambda r: (r[1] is not None, *(x.encode() for x in r[1:3] if x is not None), r[0]))

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        if len(files) == len(self.ranges):
            return self.all()
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f in files])

    def files_near(self, keys: Iterable[str] = (), prefixes: Iterable[str] = ()) -> list[str]:
        """Files whose range holds one of the keys, or meets a prefix."""
        wanted, starts = sorted(k.encode() for k in keys), [p.encode() for p in prefixes]
        out = []
        for file, low, high, _ in self.ranges:
            if low is None:
                continue
            lo, hi = low.encode(), high.encode()
            at = bisect_left(wanted, lo)
            if (at < len(wanted) and wanted[at] <= hi) or any(lo[: len(p)] <= p <= hi[: len(p)] for p in starts):
                out.append(file)
        return out

    def near(self, keys: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
        """Rows of the keys and prefixes, from the files that may hold them."""
        column = F.col(self.key[0])
        tests = [column.isin(list(keys))] if keys else []
        tests += [column.startswith(p) for p in prefixes]
        rows = self._read(self.files_near(keys, prefixes))
        return rows.where(reduce(lambda a, b: a | b, tests, F.lit(False)))

    def files_at(self, offset: int, limit: int) -> tuple[list[str], int]:
        """Files that hold the rows from ``offset`` on, and how many rows stand before those files."""
        before, skipped, out = 0, None, []
        for file, _, _, n in self.ranges:
            if before + n > offset and before < offset + limit:
                out.append(file)
                skipped = before if skipped is None else skipped
            before += n
        return out, skipped or 0

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` by the whole key, from the files that hold them."""
        files, skipped = self.files_at(offset, limit)
        return self._read(files).orderBy(*self.key).offset(offset - skipped).limit(limit)
