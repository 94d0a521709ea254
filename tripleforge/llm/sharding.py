"""Sharding by a two-pass external shuffle: seeded hashes scatter rows over memory-sized buckets, each bucket is shuffled, the buckets make up the shards.

Pass one numbers the rows, writes them, and gives each the bucket that a seeded hash of its key names; there are as many buckets as hold about bucket_bytes of rows each. Rows of
one key (a third of all rows, perhaps) are told apart by their number among them, which is part of the hash, so no bucket grows with a key. Pass two ranks a bucket's rows by another hash and permutes the ranks by Spark's
shuffle(), which is the Fisher-Yates shuffle, seeded by the partition it runs in: repartitionById() puts every bucket into a partition that follows from its number, where buckets stand in
order, so reruns and lost executors give the same permutation. Only numbers are permuted; a bucket's memory is that of its ranks. The places before a bucket are sums of
the buckets' counts, in two steps.

Law `rows`: of n rows in shuffled order, shard s has those from ceil(s*n/shards) on, so counts are at most one apart. slot is a row's place in its shard.

Null ids and texts are values like others; a null text has no bytes. Equal rows are rows of their own and may stand for each other. Long texts are moved once for
the join with their places and once for writing, never held together. An empty table gives an empty result, or an empty folder. Extra columns stay in shuffled(); shard and slot get lines before their names where
the rows have such columns. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, fresh

SHARDS, BUCKET_BYTES, SEED = 40, 16 << 20, 20240229
#: Numbers of rows (of a chunk, for keys of many rows) and of buckets (of a partition, and of a step of the sums).
CHUNK_BITS, RUN = 13, 64


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null: 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """rows (key, row, ..) with copy: the number of the row among those of its key; 0 throughout where no key repeats."""
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    chunked = rows.withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    before = chunked.groupBy("key", "chunk").count().select("key", "chunk", (F.sum("count").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    within = chunked.withColumn("within", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("row")) - 1)
    return within.join(before, ["key", "chunk"]).withColumn("copy", F.col("before") + F.col("within")).drop("chunk", "before", "within")


def permutations(counts: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """(bucket, rank, position): where each rank of a bucket of n rows goes among all rows, from counts (bucket, n)."""
    runs = counts.withColumn("run", F.expr(f"bucket div {RUN}"))
    inner = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    first = runs.groupBy("run").agg(F.sum("n").alias("m"))
    first = first.select("run", (F.sum("m").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("first"))
    placed = runs.withColumn("offset", F.sum("n").over(inner) - F.col("n")).join(first, "run").select("bucket", "n", (F.col("first") + F.col("offset")).alias("first"))
    dealt = placed.repartitionById(-(-buckets // RUN), F.expr(f"cast(bucket div {RUN} as int)")).sortWithinPartitions("bucket")
    ranks = dealt.select("bucket", "first", F.shuffle(F.sequence(F.lit(1), F.col("n").cast("int")), seed).alias("ranks"))
    return ranks.select("bucket", "first", F.posexplode("ranks").alias("at", "rank")).select("bucket", "rank", (F.col("first") + F.col("at")).alias("position"))


def shuffled(docs: DataFrame, key: Column | None = None, size: Column | None = None, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with shard and slot, and bucket (the part of the order that a row was shuffled in). key: what a row is known by (doc_id and text); size: its bytes."""
    key = F.xxhash64("doc_id", "text") if key is None else key
    size = text_bytes(F.col("text")) if size is None else size
    kept = Kept(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), key.alias("key"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "shard-rows").df
    all_ = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, buckets = max(1, all_["n"]), all_["bytes"] // bucket_bytes + 1
    told = _copy_numbers(kept.select("key", "row")).select("row", F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(buckets)).alias("bucket"), F.xxhash64(F.lit(seed + 1), "key", "copy").alias("draw"))
    scattered = Kept(told, "scattered").df
    ranked = scattered.select("row", "bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "row")).alias("rank"))
    places = Kept(permutations(scattered.groupBy("bucket").agg(F.count("*").alias("n")), buckets, seed), "permutations").df
    shard, slot, bucket = (fresh(docs, c) for c in ("shard", "slot", "bucket"))
    where = ranked.join(places, ["bucket", "rank"]).select("row", "bucket", "position", F.expr(f"position * {shards} div {n}").alias("shard"))
    where = where.select("row", "bucket", "shard", (F.col("position") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).alias("slot"))
    return kept.select("row", "whole").join(where, "row").select(*[F.col("whole")[c].alias(c) for c in docs.columns], F.col("shard").cast("int").alias(shard), F.col("slot").alias(slot), F.col("bucket").alias(bucket))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes docs in shuffled order: a folder for each shard and bucket, whose files have the rows by slot."""
    out = shuffled(docs, **options)
    shard, slot, bucket = out.columns[-3:]
    out.repartition(shard, bucket).sortWithinPartitions(shard, bucket, slot).write.partitionBy(shard, bucket).parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """doc_id, size (bytes and 16), text_crc32, law, shard, slot, grown_shard (null, as the law is not by key) of each document."""
    text = F.coalesce("text", F.lit(""))
    some = docs.select("doc_id", (text_bytes(F.col("text")) + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("key"))
    placed = shuffled(some, F.col("key"), F.col("size"), shards, bucket_bytes, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
