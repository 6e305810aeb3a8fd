"""Compare registered queries with their DuckDB SQL: python -m workloads.check SF_DIR [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from feedloom.operators.staging import release
from workloads.oracles import ORACLES
from workloads.queries import QUERIES
from workloads.views import SPREAD


_SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double",
}


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='feedloom-')}")
        .config(SPREAD, cores)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows as texts, columns by name, in a fixed order."""
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    frame = frame.map(lambda v: "NULL" if v is None else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """What differs between the query and its SQL; None if they agree."""
    result = QUERIES[name](spark, sf_dir)
    types = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    expected = {column: _SPARK_TYPES.get(kind, kind) for column, kind, *_ in types}
    if dict(result.dtypes) != expected:
        return f"types {dict(result.dtypes)} instead of {expected}"
    got = normalized(result.toPandas())
    want = normalized(con.execute(ORACLES[name]).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} instead of {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    unequal = (got != want).any(axis=1)
    if not unequal.any():
        return None
    row = unequal.idxmax()
    cells = [
        f"{c}: {got.at[row, c][:300]!r} instead of {want.at[row, c][:300]!r}"
        for c in got.columns if got.at[row, c] != want.at[row, c]
    ]
    return f"{int(unequal.sum())} of {len(got)} rows, first: " + "; ".join(cells)


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {str(error)[:800]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    release(spark)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
