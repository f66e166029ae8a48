"""An ordered list that is kept: ranges of its rows with their counts.

A list is sorted once and written in ranges, each a partition of a Parquet table, with the number of rows before every
range. After that the row at a place, the rows between two places and the neighbours of a row are read from the ranges they
lie in; nothing is sorted again. The table of ranges has a row for each range: it is bounded by their number, which grows
with the rows by `ROWS` a range."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 500_000


def build(rows: DataFrame, path: str, *order: str, ranges: int | None = None) -> KeptList:
    """Writes the list of rows (column id and the order's; they should tell rows apart) to a new folder."""
    names = order or ("id",)
    n = ranges or max(1, rows.count() // ROWS + 1)
    dealt = rows.repartitionByRange(n, *names).sortWithinPartitions(*names)
    marked = dealt.withColumn("_m", F.monotonically_increasing_id())
    marked.select(*rows.columns, F.shiftright("_m", 33).cast("int").alias("range"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).write.partitionBy("range").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(_schema(rows)).parquet(f"{path}/rows")
    sizes = written.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*names)).alias("first"))
    sizes.coalesce(1).write.parquet(f"{path}/ranges")
    return KeptList(rows.sparkSession, path, rows.schema, *names)


def _schema(rows) -> str:
    fields = rows.schema.fields if isinstance(rows, DataFrame) else rows.fields
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "at long, range int"])


class KeptList:
    """A list that `build` wrote. schema and order are those it was built with."""

    def __init__(self, spark: SparkSession, path: str, schema, *order: str):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order or ("id",)
        found = spark.read.parquet(f"{path}/ranges").orderBy("range").collect()  # a row a range
        self.ranges, self.firsts = [r["range"] for r in found], [r["first"] for r in found]
        self.before = [0]
        for r in found:
            self.before.append(self.before[-1] + r.n)

    def __len__(self) -> int:
        return self.before[-1]

    def rows(self, places: tuple[int, int] | None = None) -> DataFrame:
        """The rows, with index, of the ranges that hold places from the first to the last given; of all for None."""
        table = self.spark.read.schema(_schema(self.schema)).parquet(f"{self.path}/rows")
        if places is not None:
            low, high = (bisect_right(self.before, p) - 1 for p in places)
            table = table.where(F.col("range").isin(self.ranges[max(low, 0) : high + 1]))
        starts = F.create_map(*(F.lit(x) for pair in zip(self.ranges, self.before, strict=False) for x in pair)) if self.ranges else None
        index = (starts[F.col("range")] + F.col("at")).cast("long") if starts is not None else F.lit(None).cast("long")
        return table.withColumn("index", index).drop("at", "range")

    def between(self, first: int, last: int) -> DataFrame:
        """Rows between two places, both included, whichever comes first."""
        low, high = max(min(first, last), 0), min(max(first, last), len(self) - 1)
        return self.rows((low, high)).where(F.col("index").between(low, high)) if low <= high else self.rows().where(F.lit(False))

    def at(self, index: int) -> DataFrame:
        """The row at a place; none outside the list."""
        return self.between(index, index) if 0 <= index < len(self) else self.rows().where(F.lit(False))

    def position(self, *key) -> int | None:
        """The place of the row with this key of the order: one range is read."""
        at = bisect_right([tuple(f) for f in self.firsts], tuple(key)) - 1
        if at < 0:
            return None
        own = self.rows((self.before[at], self.before[at]))
        for c, k in zip(self.order, key, strict=True):
            own = own.where(F.col(c) == F.lit(k))
        found = own.select("index").first()
        return found and found[0]

    def neighbours(self, index: int) -> DataFrame:
        """The rows before, at and after a place, with index; fewer at the ends."""
        return self.between(index - 1, index + 1) if 0 <= index < len(self) else self.rows().where(F.lit(False))
