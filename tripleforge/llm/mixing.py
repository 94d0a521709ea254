"""Mixing sources to target weights in fixed-length blocks.

Every source's words are one stream, its documents in a fixed pseudorandom order, cut into blocks of block_words words.
The mix is a list of slots of one block each, in output shards of shard_slots slots. For each shard the counts of the sources
are a multinomial draw, of a generator keyed by the seed and the shard, with the targets as probabilities. Summed over the shards, draws
stray from the targets by about the square root of a source's slots, and could take a source beyond its cap; so of what a source has
drawn, in order of shards, the slots beyond its target go to the sources that have drawn too few, in their order. The slots of a source are numbered through all
shards; slot i takes, in epoch i div n of the source's n blocks, block perm(i mod n), the permutation
keyed by source and epoch. Slots and blocks are then joined by (source, block). A shard's slots are in an order of their own, by a permutation keyed by the shard.

Nulls, empty texts: size 0, taken 0. A very long text is many blocks; its words are counted, never moved. A null source is a source of its own; more than MAX_SOURCES sources are refused. Repeated rows are rows of their own. An empty
table gives an empty result. All extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, small_enough, word_count

WEIGHTS, CAP, BLOCK_WORDS, SHARD_SLOTS, SEED = (5.0, 2.0, 1.0), 3.0, 256, 4096, 20240229
#: Sources that the driver plans for: one row each.
MAX_SOURCES = 100_000
#: Shards whose counts are summed together first.
SHARDS = 1024


def targets(sizes: list[float], weights: list[float], cap: float = CAP, total: float | None = None) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is cut off goes to the others by weight."""
    total, open_, out = float(sum(sizes)) if total is None else float(total), list(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """splitmix64 of x under a key."""
    with np.errstate(over="ignore"):
        z = x + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 sends i: a Feistel network, walked until it is within n."""
    x, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.uint64(1) + np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for r in range(4):
            left, right = right, left ^ (_mixed(right, k * np.uint64(8) + np.uint64(r)) & m)
        x[todo] = (left << h) | right
        todo = x >= n
    return x.astype(np.int64)


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> dict[str, DataFrame]:
    """documents: a row per row of docs with what the mix takes of it; slots: shard, slot, source, block in output order;
    blocks: the pieces of documents (doc_id, first word, words) that make up each block."""
    spark = docs.sparkSession
    sizes = Kept(docs.select("doc_id", F.xxhash64("text").alias("digest"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    # One row for each source: the only table that the driver sees.
    if not small_enough(sizes.df.select("source").distinct(), MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = sorted(sizes.df.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    aim = targets([r["size"] for r in per], [weights[k % len(weights)] for k in range(len(per))], cap)
    plan, start = [], 0
    for k, (r, t) in enumerate(zip(per, aim, strict=True)):
        n = -(-r["size"] // block_words)
        slots = min(round(t * n / r["size"]), int(cap * n)) if n else 0
        plan.append((k, r["source"], r["size"], float(t), n, start, slots))
        start += slots
    total, shards = start, -(-start // shard_slots)
    sources = spark.createDataFrame(plan, "sid int, source string, source_size long, target double, n_blocks long, first long, slots long")

    # Places of documents in their source's stream: sums within buckets of a hash, then over the buckets, so that a source that holds most rows is no single task.
    buckets = min(100_000, sizes.df.count() // 256 + 1)
    keyed = sizes.df.alias("d").join(F.broadcast(sources.select("sid", F.col("source").alias("src"), "source_size", "target")), F.col("d.source").eqNullSafe(F.col("src")))
    # The text's digest is part of the hash, so that rows of one id, or of none, are spread too.
    keyed = keyed.select("doc_id", "digest", "sid", "size", "source_size", "target", F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    inner = Window.partitionBy("sid", "bucket").orderBy("doc_id", "digest", "size")
    placed = keyed.select("*", F.row_number().over(inner).alias("rn"), (F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("within"))
    before = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    placed = Kept(placed.join(before, ["sid", "bucket"]).select("doc_id", "sid", "bucket", "rn", "size", "source_size", "target", (F.col("offset") + F.col("within")).alias("at")), "mix-places")
    b = F.lit(block_words)
    blocks = (
        placed.df.where("size > 0")
        .select("*", F.explode(F.sequence((F.col("at") / b).cast("long"), ((F.col("at") + F.col("size") - 1) / b).cast("long"))).alias("block"))
        .withColumn("lo", F.greatest(F.col("at"), F.col("block") * b))
        .select("sid", "block", "doc_id", "bucket", "rn", (F.col("lo") - F.col("at")).alias("first_word"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - F.col("lo")).alias("n_words"))
    )
    n_blocks, wanted = (np.array([p[i] for p in plan], dtype=np.int64) for i in (4, 6))
    share = wanted / max(1, total)

    def draw(batches):
        for pdf in batches:
            for shard in pdf["id"].tolist():
                size = min(shard_slots, total - shard * shard_slots)
                n = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, shard])).multinomial(size, share)
                sid = np.flatnonzero(n)
                n = n[sid]
                yield pd.DataFrame({"shard": shard, "sid": sid.astype(np.int32), "n": n, "base": np.cumsum(n) - n, "size": size})

    counts = Kept(spark.range(shards).mapInPandas(draw, "shard long, sid int, n long, base long, size long").withColumn("part", (F.col("shard") / SHARDS).cast("long")), "mix-draws")
    drawn = np.zeros(len(plan), np.int64)
    for r in counts.df.groupBy("sid").agg(F.sum("n").alias("n")).collect():
        drawn[r["sid"]] = r["n"]
    # What is too much, one source after another, fills what is too little, one source after another.
    over, under = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    over_first, under_first = np.cumsum(over) - over, np.cumsum(under) - under
    # Numbers of slots within their source: sums within parts, then over the parts.
    part = Window.partitionBy("sid", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = counts.df.groupBy("sid", "part").agg(F.sum("n").alias("m")).select("sid", "part", (F.sum("m").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"))
    numbered = counts.df.withColumn("within", F.sum("n").over(part) - F.col("n")).join(parts, ["sid", "part"]).select("shard", "sid", "n", "base", "size", (F.col("before") + F.col("within")).alias("first"))

    def fill(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            shard, size, sid = (pdf[c].to_numpy()[row] for c in ("shard", "size", "sid"))
            i = pdf["first"].to_numpy()[row] + within
            slot = permuted(pdf["base"].to_numpy()[row] + within, size, np.uint64(seed) + np.uint64(1 << 63) + shard.astype(np.uint64))
            much = i >= wanted[sid]
            if much.any():
                e = over_first[sid[much]] + i[much] - wanted[sid[much]]
                to = np.searchsorted(under_first, e, side="right") - 1  # sources without a want share their place with the next one, which wins
                sid = sid.copy()
                sid[much] = to
                i[much] = drawn[to] + e - under_first[to]
            m = n_blocks[sid]
            block = permuted(i % m, m, np.uint64(seed) + (sid.astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 32) + (i // m).astype(np.uint64))
            yield pd.DataFrame({"shard": shard, "slot": slot, "sid": sid.astype(np.int32), "block": block})

    slots = numbered.mapInPandas(fill, "shard long, slot long, sid int, block long")
    draws = slots.groupBy("sid", "block").agg(F.count("*").alias("draws"))
    # Spark knows no size of what Python makes; without the hint it takes the draws for as small as the counts and sends them everywhere.
    taken = blocks.join(draws.hint("merge"), ["sid", "block"]).groupBy("sid", "bucket", "rn").agg(F.sum(F.col("n_words") * F.col("draws")).alias("taken"))
    out = placed.df.join(taken, ["sid", "bucket", "rn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    named = F.broadcast(sources.select("sid", "source"))
    return {"documents": out, "slots": slots.join(named, "sid").select("shard", "slot", "source", "block"), "blocks": blocks.join(named, "sid").select("source", "block", "doc_id", "first_word", "n_words")}
