"""Table loads: every projected table, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures_sql import CTES
from .registry import query

# Long texts and fixed dimensions are read by other queries.
_NOT_ALONE = {"system_settings"}


def _register(name: str) -> None:
    columns = "*"
    if name == "shops":
        columns = "* EXCLUDE (sub_categories), array_to_string(sub_categories, ',') AS sub_categories"
    if name == "announcements":
        columns = "* EXCLUDE (target_user_type), array_to_string(target_user_type, ',') AS target_user_type"

    @query(f"load_{name}", f"SELECT {columns} FROM {name}")
    def load(t, name=name):
        df = t[name]
        for array in ("sub_categories", "target_user_type"):
            if array in df.columns:
                df = df.withColumn(array, F.array_join(array, ","))
        return df


for _name in CTES:
    if _name not in _NOT_ALONE:
        _register(_name)
