"""Cutting long lineages so that a lost executor costs one step, not the whole history."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """A folder for the steps of this process, removed at its end; for sessions on one machine only."""
    folder = tempfile.mkdtemp(prefix="slotwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the one that the session names in ``spark.checkpoint.dir``.

    Where it names none, as in tests, a session that runs in one process gets a folder of its own.
    On a cluster that is an error: executors would each write to their own disk, and rows be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root}/{purpose}-{uuid.uuid4().hex}"


def written_once(tables, *names: str):
    """``tables`` where those of ``names`` are written in that order, for jobs that read what they are made from many times."""
    for name in names:
        tables = tables.replaced(**{name: cut_lineage(tables[name])})
    return tables


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder under the shared one and read on from there.

    A written table is used rather than a checkpoint because that hands the constraints of its plan
    on, which grow with every round.
    """
    folder = shared_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
