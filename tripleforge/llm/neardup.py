"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

1. Every text's shingle set, its digest and its sketch are computed in one pass. Equal sets become one vertex.
2. Sketches are cut into bands; vertices with an equal band share a bucket. Each bucket links its members to the one of
   least doc_id only (a star, not all pairs), and each pair is verified on the full sets, read again for the vertices in question.
3. In buckets whose members are not yet in one component, pairs between different components are compared too: in small groups of buckets each pair is
   verified, in large ones blocks of members are compared on their full sets, and only links leave the task. So no link between members of a
   bucket is lost that could join two components.
4. Components are found by hooking and pointer jumping, never on the driver.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows and equal texts are linked
by their equal sets. A very long text is handled alone, its shingles as one array. A null doc_id ranks after all others. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, components, lean, meet
from .shingles import chunks, fast_sketches, set_digests, shingle_sets

BINS, BAND = 112, 4
BROADCAST_IDS = 300_000
SMALL_GROUP, BLOCK = 48, 256
#: Shingles of a block, on average: long texts make blocks of fewer members.
BLOCK_ITEMS = 1 << 20
LAST = 2**63 - 1
#: Vertices are decimal(38): the least doc_id of their rows times this, plus a remainder of their set's digest.
SPAN = 10**12


def _signed(docs: DataFrame, width: int, bins: int) -> DataFrame:
    def sign(batches):
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(np.int64), [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in pdf["text"]]
            for a, b in chunks(texts):
                with np.errstate(over="ignore"):
                    n, sets = shingle_sets(texts[a:b], width)
                    hi, lo = set_digests(n, sets)
                    sk = fast_sketches(n, sets, bins)
                yield pd.DataFrame({"id": ids[a:b], "n": n, "hi": hi, "lo": lo, "sketch": [r.tobytes() for r in sk]})

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), "text").mapInPandas(sign, "id long, n long, hi long, lo long, sketch binary")


def _sets(docs: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """(v, set) of vertices (id, hi, lo, v), from the texts of their rows."""
    ids = vertices.select("id").distinct()
    few = vertices.count() <= BROADCAST_IDS
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def build(batches):
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(np.int64), [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in pdf["text"]]
            for a, b in chunks(texts):
                with np.errstate(over="ignore"):
                    n, sets = shingle_sets(texts[a:b], width)
                    hi, lo = set_digests(n, sets)
                end = np.cumsum(n)
                yield pd.DataFrame({"id": ids[a:b], "hi": hi, "lo": lo, "items": [sets[e - m : e].view(np.int64) for e, m in zip(end, n, strict=True)]})

    made = rows.mapInPandas(build, "id long, hi long, lo long, items array<long>")
    return made.join(F.broadcast(vertices) if few else vertices, ["id", "hi", "lo"]).select("v", "items")


def _verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, percent: int, name: str) -> Kept:
    """The pairs (a, b) of vertices that are links."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(reps.select("v", "id", "hi", "lo"), "v")
    ends = Kept(ends, f"{name}-ends")
    sets = Kept(_sets(docs, ends.df, width).dropDuplicates(["v"]), f"{name}-sets")
    s = sets.df
    both = F.size(F.array_intersect("x", "y"))
    # A star's hub may have any number of pairs: its set is repeated, and its pairs are dealt.
    hubs = s.select(F.col("v").alias("a"), F.col("items").alias("x")).join(pairs.groupBy("a").agg(F.count("*").alias("pairs")), "a")
    hit = meet(pairs.join(s.select(F.col("v").alias("b"), F.col("items").alias("y")), "b"), hubs, ["a"], "pairs", F.col("b")).where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    out = Kept(hit.select("a", "b"), f"{name}-links")
    ends.drop(), sets.drop()
    return out


def _block_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components within large groups (hub, v, root): for each vertex outside the hub's component and each other component, one at least if there is any.

    Both the vertices outside and all vertices are dealt into blocks; a task holds the full sets of two blocks, counts their common shingles by an index of
    one of them, and returns links only, never the pairs that it compares.
    """
    known = Kept(groups.select("v").distinct().join(reps.select("v", "id", "hi", "lo"), "v"), "group-ends")
    sets = Kept(_sets(docs, known.df, width).dropDuplicates(["v"]), "group-sets").df
    outside = F.col("root") != F.col("hub")
    items = groups.join(sets.select("v", F.size("items").cast("long").alias("s")), "v").groupBy("hub").agg(F.sum("s").alias("items_n"), F.sum(F.when(outside, F.col("s")).otherwise(0)).alias("items_n_out"))
    rows = meet(groups, sizes.join(items, "hub"), ["hub"], "n", F.col("v"))
    blocks = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(f"items_{n}") / BLOCK_ITEMS)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("v"), blocks(n)).cast("int")
    text = [F.col(c).cast("string").alias(c) for c in ("v", "root")]
    out = rows.where("root <> hub").select("hub", F.lit(0).alias("side"), place("n_out").alias("i"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("j"), "v", "root")
    all_ = rows.select("hub", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), blocks("n_out") - 1)).alias("i"), place("n").alias("j"), "v", "root")
    dealt = out.unionByName(all_).join(sets, "v").select("hub", "side", "i", "j", *text, "items")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = []
        if len(left) and len(right):
            sizes = np.array([len(x) for x in right["items"]])
            flat = np.concatenate(list(right["items"]))
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            names, roots = right["v"].to_numpy(), right["root"].to_numpy()
            for v, root, s in zip(left["v"], left["root"], left["items"], strict=True):
                lo, n = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n -= lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sizes))
                hit = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (roots != root))
                found += [(v, names[k]) for k in hit[np.unique(roots[hit].astype(str), return_index=True)[1]]]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("hub", "i", "j").applyInPandas(compare, "a string, b string").select(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = BINS, band: int = BAND) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    lean(docs.sparkSession)
    signed = Kept(_signed(docs, width, bins), "signed")
    d38 = "decimal(38,0)"
    reps = signed.df.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"))
    reps = Kept(reps.select("hi", "lo", "id", (F.col("id").cast("decimal(19,0)") * F.lit(SPAN).cast("decimal(13,0)") + F.pmod("hi", F.lit(SPAN)).cast("decimal(12,0)")).cast(d38).alias("v")), "reps")
    own = signed.df.where("n > 0").join(reps.df, ["id", "hi", "lo"])
    bytes_ = 2 * band
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * bytes_, bytes_)) for k in range(bins // band)])
    banded = own.select("v", F.explode(keys).alias("key"))
    mark = F.xxhash64("v")
    shared = Kept(banded.groupBy("key").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("key"), "buckets")
    few = shared.df.count() <= BROADCAST_IDS
    members = Kept(banded.join(F.broadcast(shared.df) if few else shared.df, "key"), "members")

    stars = members.df.join(members.df.groupBy("key").agg(F.min("v").alias("a")), "key").where("v <> a").select("a", F.col("v").alias("b")).distinct()
    stars = Kept(stars, "stars")
    links = _verify(docs, stars.df, reps.df, width, percent, "stars").df
    found = components(links, "star-parts")

    # Buckets that hold more than one component, by their commonest one, the hub; buckets of one hub form a group.
    rooted = Kept(members.df.join(found, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root")), "rooted").df
    open_ = rooted.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", (-F.col("root")).alias("r"))).alias("hub"), F.count("*").alias("parts")).where("parts > 1").select("key", "hub")
    open_ = Kept(rooted.join(open_, "key"), "open").df
    groups = Kept(open_.select("hub", "v", "root").distinct(), "groups").df
    sizes = Kept(groups.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(F.expr("root <> hub")).alias("n_out")), "group-sizes").df
    large = sizes.where(F.col("n") > SMALL_GROUP)
    few = open_.join(sizes.where(F.col("n") <= SMALL_GROUP).select("hub"), "hub")
    pairs = few.alias("p").join(few.alias("q"), F.expr("p.key = q.key and p.v < q.v and p.root <> q.root")).select(F.col("p.v").alias("a"), F.col("q.v").alias("b")).distinct()
    pairs = Kept(pairs.join(stars.df, ["a", "b"], "left_anti"), "rest")
    more = _verify(docs, pairs.df, reps.df, width, percent, "rest").df
    if not large.isEmpty():
        more = Kept(more.unionByName(_block_links(docs, groups.join(large.select("hub"), "hub"), large, reps.df, width, percent)), "more").df
    if not more.isEmpty():
        found = components(links.unionByName(more), "parts")

    # A quotient of decimals is rounded to six places, so the remainder goes first and the division is one of whole numbers.
    classes = reps.df.join(found, "v", "left").select("hi", "lo", F.coalesce("root", "v").alias("x")).select("hi", "lo", F.expr(f"(x - pmod(x, cast({SPAN} as decimal(13,0)))) div cast({SPAN} as decimal(13,0))").alias("part"))
    out = signed.df.select("id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    real = lambda c: F.when(c == LAST, None).otherwise(c)
    part = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("part"))
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(part).alias("component_id"), (F.col("id") == part).alias("kept"))
