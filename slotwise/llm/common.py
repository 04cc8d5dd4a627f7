"""What the operators of this subpackage share: reading tables, null handling, streaming over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], batch: int = 2048) -> DataFrame:
    """Run a generator over the rows of each partition; tuples in, tuples out, Arrow batches between.

    The generator sees one partition as one stream, so sorted rows of a key arrive together and
    nothing but what the generator itself keeps is held in memory.
    """
    target = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in rows(_tuples(batches)):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str, list, np.ndarray)))
            if len(out) >= batch or size > 4_000_000:
                yield _batch(out, target)
                out, size = [], 0
        if out:
            yield _batch(out, target)

    return df.mapInArrow(run, schema)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        # Small slices, so that Python objects exist only for a few megabytes of a batch at a time.
        step = max(1, min(len(b) or 1, int(2_000_000 * len(b) / max(b.nbytes, 1)) or 1))
        for start in range(0, len(b), step):
            part = b.slice(start, step)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (field.strip().split(" ") for field in schema.split(","))])
