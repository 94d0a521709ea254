"""Tables that several queries derive from the same input, written once for a session to the folder that driver and executors share.

The folder is the session's spark.checkpoint.dir; a temporary one serves only where that is unset and all run on one machine. What is written cuts the lineage, outlives lost
executors and goes when the session's process ends. A table is known by the session, the input folder and its name: an input that
changes within a session needs forget(). close() deletes all tables of a session before it stops.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Times that tables of ids are larger in memory than their files are.
PACKED = 20
#: Bytes of rows that a join may broadcast unasked.
BROADCAST = 1 << 20
_OWN: list[str] = []
_MADE: dict[tuple, tuple] = {}
_SCRATCH: list[tuple[str, str]] = []


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tripleforge-"))
    return _OWN[0]


def _bytes(size: str) -> int:
    """A size as Spark's settings have it."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def unpacked(spark: SparkSession) -> None:
    """Has Spark plan with the size of tables in memory from now on, not with that of their files, and broadcast none above BROADCAST bytes: tables of ids pack well, and a join's hash table is over ten times as large as
    their rows, so at 10 MB of file hundreds of MB pass through the driver. Narrower settings stay."""
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor, "1.0")) < PACKED:
        spark.conf.set(factor, str(float(PACKED)))
    for key, default in (("spark.sql.autoBroadcastJoinThreshold", "10m"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")):
        if _bytes(spark.conf.get(key, default) or "-1") > BROADCAST:
            spark.conf.set(key, str(BROADCAST))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table, deleted at the end."""
    unpacked(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark.sparkContext.applicationId, path))
    atexit.register(_drop, spark, path)
    return path


def close(spark: SparkSession) -> None:
    """Deletes all that was written for this session. To be called before the session stops, as later there is nothing to delete it with."""
    app = spark.sparkContext.applicationId
    for source in {key[1] for key in _MADE if key[0] == app}:
        forget(spark, source)
    for path in [p for a, p in _SCRATCH if a == app]:
        _drop(spark, path)
    _SCRATCH[:] = [x for x in _SCRATCH if x[0] != app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is temporary either way
        pass


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() gives, written at the first call for this session, source and name."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _MADE:
        df = build()
        path = scratch(spark, name)
        df.write.parquet(path)
        _MADE[key] = (path, df.schema)
    path, schema = _MADE[key]
    return spark.read.schema(schema).parquet(path)


def has(spark: SparkSession, source: str, name: str) -> bool:
    """Has once() or kept() made this already?"""
    return (spark.sparkContext.applicationId, source, name) in _MADE


def kept(spark: SparkSession, source: str, name: str, build: Callable):
    """What build() gives, made at the first call for this session, source and name; it has a drop() of its own."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]


def forget(spark: SparkSession, source: str) -> None:
    """Tables of a source are derived anew at their next use."""
    for key in [k for k in _MADE if k[:2] == (spark.sparkContext.applicationId, source)]:
        made = _MADE.pop(key)
        made.drop() if hasattr(made, "drop") else _drop(spark, made[0])
