"""What the text operators share: shared storage for cut lineage, tokens, ids and connected components."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
_OWN: list[str] = []
_WRITTEN: list[tuple[str, str]] = []
#: Rows of one batch of texts for Python.
BATCH_ROWS = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir; a temporary folder is set only where that is unset and all run on one machine (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tripleforge-"))
        found = _OWN[0]
    return found


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that materialize() wrote."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def close(spark: SparkSession) -> None:
    """Deletes all tables that the text operators have written in this session; nothing that reads them works afterwards. To be called before the session stops, as later there is nothing to delete them with."""
    for path in [p for app, p in _WRITTEN if app == spark.sparkContext.applicationId]:
        drop(spark, path)
    _WRITTEN[:] = [x for x in _WRITTEN if x[0] != spark.sparkContext.applicationId]


def _drop_late(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may have ended; the folder is temporary either way
        pass


class Kept:
    """A table written to the shared folder: it cuts the lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        _WRITTEN.append((self.spark.sparkContext.applicationId, self.path))
        df.write.parquet(self.path)
        atexit.register(_drop_late, self.spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    return Kept(df, name).df


def lean(spark: SparkSession) -> None:
    """Has texts sent to Python workers in small batches from now on, so that a worker holds a few MB of them at a time. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def regrouped(batches, size, most: int, rows: int = 10_000):
    """Batches put together until they have about `most` by size(batch), or so many rows."""
    held, n, m = [], 0, 0
    for pdf in batches:
        held.append(pdf)
        n, m = n + size(pdf), m + len(pdf)
        if n >= most or m >= rows:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held, n, m = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with lines before it, that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(c: Column) -> Column:
    """Number of words between WS; 0 for null and for blank texts."""
    text = F.coalesce(c, F.lit(""))
    edge = lambda at: F.when(F.substring(text, at, 1).rlike(f"^{WS}"), 1).otherwise(0)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, WS)) - edge(1) - edge(-1)).cast("long")


def words(c: Column) -> Column:
    """The words of a text, in order; empty for null and blank texts."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS), "")


def fold(c: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes, as JSON, of a table that is sent to every executor.
SMALL_BYTES = 64 << 20


def small_enough(df: DataFrame, limit: int, most: int = SMALL_BYTES) -> bool:
    """Whether df has at most limit rows and, where it has columns whose values have no greatest length, at most so many bytes; reads no more than it must to know."""
    some = df.limit(limit + 1)
    if not any(kind.startswith(("string", "binary", "array", "map", "struct")) for _, kind in df.dtypes):
        return some.count() <= limit
    found = some.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes")).first()
    return found["n"] <= limit and found["bytes"] <= most


#: Rows of a key that meet in one task, and keys of more rows than that which are sent to every executor.
KEY_ROWS, HOT_KEYS = 1000, 50_000


def meet(rows: DataFrame, groups: DataFrame, on: list[str], copies: str, row: Column) -> DataFrame:
    """rows joined with groups, a row for each key, which tell by `copies` how many rows the key has. Null keys are equal.

    A key of more than KEY_ROWS rows (or a HOT_KEYS-th of all, if that is more) is salted: its rows are dealt by the hash of `row`, and its group is repeated as often. Only keys of so many
    rows are broadcast, so there are HOT_KEYS of them at most.
    """
    total = groups.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    bound = max(KEY_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col(copies) / bound)
    hot = F.broadcast(groups.where(F.col(copies) > bound).select(*[F.col(c).alias(f"_hot_{c}") for c in on], salts.alias("_salts")))
    other = groups.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in groups.columns if c not in on], F.explode(F.sequence(F.lit(1), salts)).alias("_own"))
    match = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in on]
    dealt = rows.join(hot, match("_hot_"), "left").withColumn("_salt", F.pmod(F.xxhash64(row), F.coalesce("_salts", F.lit(1))) + 1).drop("_salts", *[f"_hot_{c}" for c in on])
    return dealt.join(other.hint("merge"), [*match("_on_"), F.col("_salt") == F.col("_own")]).drop("_salt", "_own", *[f"_on_{c}" for c in on])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (v, root), root the least vertex reachable.

    Roots hook onto the least root across an edge, then pointers are halved, until nothing changes: the number of rounds
    grows with the logarithm of a component's length. Only tables of the vertices and edges are shuffled, partial minima
    go before each shuffle, and each round is written to the shared folder. Nothing is collected.
    """
    e = Kept(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    parent = Kept(e.df.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root")), f"{name}-0")
    live = e
    for i in itertools.count(1):
        p = parent.df
        hooked = live.df.join(p.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(p.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb").select(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi")).distinct()
        rest = Kept(hooked, f"{name}-live{i}")
        hooks = rest.df.groupBy(F.col("hi").alias("root")).agg(F.min("lo").alias("to"))
        if rest.df.isEmpty():
            break
        jumps = Kept(hooks, f"{name}-hooks{i}")
        # Pointers among roots are shortened until each root points at a root that stays.
        while True:
            h = jumps.df
            nxt = h.alias("x").join(h.select(F.col("root").alias("r2"), F.col("to").alias("to2")), F.col("to") == F.col("r2"), "left").select("root", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved"))
            n = Kept(nxt, f"{name}-jump{i}")
            moved = not n.df.where("moved").isEmpty()
            jumps.drop()
            jumps = Kept(n.df.select("root", "to"), f"{name}-hooks{i}")
            n.drop()
            if not moved:
                break
        new = Kept(p.join(jumps.df, "root", "left").select("v", F.coalesce("to", "root").alias("root")), f"{name}-{i}")
        parent.drop()
        jumps.drop()
        if live is not e:
            live.drop()
        live, parent = Kept(rest.df.select(F.col("lo").alias("a"), F.col("hi").alias("b")), f"{name}-next{i}"), new
        rest.drop()
        # The next round's edges join roots; roots are vertices of their own in parent.
    return parent.df
