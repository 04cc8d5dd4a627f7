"""A table of sums that streams add to, kept as a few levels of deltas.

Batch ``n`` writes one folder of sums. Whenever FANOUT folders of a level are there, they are summed into one folder
of the next level, and sums that came to nothing leave the table. So after ``n`` batches some ``FANOUT * log(n)``
folders are read, and a key stands in few of them, however many batches it was in.

Which folders make up the table after batch ``n`` follows from ``n`` alone. A batch that is repeated after a failure
replaces its own folder and the merges that it caused; what it merged is removed only by the next batch, when it is
certain that it will not come again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FANOUT = 4


class Levels:
    """Sums of the columns ``sums`` per ``keys`` (both as DDL) below the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, keys: str, sums: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.keys, self.sums = StructType.fromDDL(keys), StructType.fromDDL(sums)
        self.schema = StructType([*self.keys.fields, *self.sums.fields])

    def write(self, deltas: DataFrame, number: int) -> None:
        """Add the rows of batch ``number``; batches are numbered from 0 without a gap."""
        if number:
            self._remove_merged(number - 1)
        self._save(deltas, 0, number)
        level, width = 1, self.fanout
        while (number + 1) % width == 0:
            parts = [self._folder(level - 1, number - k * width // self.fanout) for k in range(self.fanout)]
            self._save(self._scan(parts), level, number)
            level, width = level + 1, width * self.fanout

    def read(self, upto: int | None = None) -> DataFrame:
        """The deltas of all batches up to ``upto`` (the newest complete one); a key may stand in several rows."""
        number = self.newest() if upto is None else upto
        return self._scan(self.live(number))

    def live(self, number: int) -> list[str]:
        """Folders that hold batches 0 to ``number``, oldest first."""
        folders, start, level = [], 0, 0
        while self.fanout ** (level + 1) <= number + 1:
            level += 1
        for at in range(level, -1, -1):
            while start + self.fanout**at <= number + 1:
                start += self.fanout**at
                folders.append(self._folder(at, start - 1))
        return folders

    def newest(self) -> int:
        """The last batch whose folders are all complete, -1 if there is none."""
        path, files = self._hadoop(f"{self.root}/level=*/upto=*/_SUCCESS")
        found = {str(f.getPath().getParent().toUri().getPath()) for f in files.globStatus(path) or []}
        numbers = sorted({int(f.rsplit("=", 1)[1]) for f in found}, reverse=True)
        whole = lambda n: all(self._hadoop(f)[0].toUri().getPath() in found for f in self.live(n))
        return next((n for n in numbers if whole(n)), -1)

    def _folder(self, level: int, upto: int) -> str:
        return f"{self.root}/level={level}/upto={upto}"

    def _scan(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _save(self, rows: DataFrame, level: int, upto: int) -> None:
        kinds = {f.name: f.dataType for f in self.sums.fields}
        summed = rows.groupBy(*self.keys.names).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in kinds.items()])
        left = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in kinds])
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        summed.filter(left).select(*cast).write.mode("overwrite").parquet(self._folder(level, upto))

    def _remove_merged(self, number: int) -> None:
        """Remove what batch ``number``, which is committed, merged."""
        level, width = 1, self.fanout
        while (number + 1) % width == 0:
            for k in range(self.fanout):
                path, files = self._hadoop(self._folder(level - 1, number - k * width // self.fanout))
                files.delete(path, True)
            level, width = level + 1, width * self.fanout

    def _hadoop(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
