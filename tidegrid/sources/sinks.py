"""Results as files."""

from __future__ import annotations

import datetime
import importlib.metadata
import json
import math
import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a report that one task writes as one CSV file.
ONE_FILE = 200_000


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for formats that have none."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def write_table(df: DataFrame, folder: str, name: str, csv: bool = True) -> None:
    """Parquet, and beside it CSV with a header: one file for up to ONE_FILE rows, as many as there are parts beyond."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if csv:
        rows = flat(df.sparkSession.read.parquet(f"{folder}/{name}"))
        rows = rows.coalesce(1) if rows.count() <= ONE_FILE else rows
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")


def as_json(value) -> str:
    """JSON text; what is no finite number becomes null."""
    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [clean(v) for v in x]
        if isinstance(x, float) and not math.isfinite(x):
            return None
        return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)

    return json.dumps(clean(value), indent=2, sort_keys=True)


def write_json(spark, value, folder: str, name: str) -> None:
    spark.createDataFrame([(as_json(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def manifest(fingerprint: str) -> dict:
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return {"created": now, "python": platform.python_version(), "platform": platform.platform(), "spark": pyspark.__version__, **{m: importlib.metadata.version(m) for m in ("numpy", "pandas", "pyarrow")}, "settings": fingerprint}
