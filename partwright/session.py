"""Session settings and helpers shared by all operators."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in rows, that an operator may broadcast after having counted it.
BROADCAST_ROWS = 200_000
# Largest side in bytes.
BROADCAST_BYTES = 128 << 20


def local_session(cores: int | str = "*", shuffle: int = 8, app: str = "partwright") -> SparkSession:
    """A local session as tests and bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once a session, so that Python workers find it whatever their folder."""
    sc = spark.sparkContext
    if getattr(sc, "_partwright_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "partwright"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(made)
    sc._partwright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset and one machine runs everything (tests) a local folder is made and set; on a
    cluster an unset folder is an error, since a folder of one machine is another one on the next.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None and not re.match(r"local(\[|$)", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"partwright-{os.getpid()}"))
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> int:
    """What a row of the frame takes at most in memory, texts and arrays by an allowance."""
    sizes = {"string": 160, "binary": 160, "array": 400, "struct": 400, "map": 800}
    return 16 + sum(next((n for kind, n in sizes.items() if f.dataType.simpleString().startswith(kind)), 16) for f in df.schema)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS, each: int | None = None) -> DataFrame:
    """Broadcast a side whose row count was measured if rows and bytes lie within the bounds; else leave the join to the planner.

    ``each`` is the measured size of a row where texts may be long.
    """
    return F.broadcast(df) if rows <= bound and rows * (each or row_bytes(df)) <= BROADCAST_BYTES else df


def spread(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """The frame in as many partitions as its rows call for; small rows with much work each would else be joined into one task."""
    return df.repartition(max(1, -(-rows // per_task)))


def salted(key: str, buckets: int, *by: str):
    """A salt column for hot keys: a hash of the row's own columns, so that a repeated task gives the same rows."""
    return F.pmod(F.xxhash64(key, *by), F.lit(buckets)).cast("int")


def join_values(rows: DataFrame, mapping: DataFrame, on: list[str], count: str, total: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a table of their distinct values (with ``count`` rows each) without a hot value in one task.

    A mapping within the bound is broadcast.  Beyond it the values that hold at least a thousandth of
    the rows (there can be no more than a thousand) are broadcast and only the others are shuffled.
    """
    n = mapping.count()
    if n <= bound and n * row_bytes(mapping) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(mapping.drop(count)), on)
    hot = mapping.filter(F.col(count) >= total / 1000)
    cold = mapping.filter(F.col(count) < total / 1000)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot.drop(count)), on).unionByName(rest.join(cold.drop(count), on))
