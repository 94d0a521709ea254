"""Features and scores of evidence triples, and the choice of a small subgraph that keeps its candidates covered.

A choice runs in passes: each offers triples in an order of its own, and takes them until the target is reached. As passes only add and stop by
size alone, giving each triple the least (pass, place) at which it is offered and taking the first `target` of them gives the same set without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import KEY, band_weight


def touches(triples: DataFrame, cands: DataFrame) -> DataFrame:
    """(KEY, idx, cand, pos) for each candidate at an end of a triple. The ends are listed and joined; a self-loop counts once."""
    ends = triples.select(*KEY, "idx", F.explode(F.array_distinct(F.array("h", "t"))).alias("cand"))
    return ends.join(cands.select(*KEY, "cand", "pos"), [*KEY, "cand"])


def triple_features(triples: DataFrame, cands: DataFrame) -> DataFrame:
    """Triples (KEY, query_id, idx, h, r, t) with how they touch the query and the candidates, and degrees within their subgraph."""
    hit = touches(triples, cands).groupBy(*KEY, "idx").agg(F.min("pos").alias("best_pos"), F.count("*").alias("touched"))
    ends = triples.select(*KEY, F.explode(F.array("h", "t")).alias("node")).groupBy(*KEY, "node").agg(F.count("*").alias("degree"))
    out = triples.join(hit, [*KEY, "idx"], "left").fillna({"touched": 0})
    for end in ("h", "t"):
        out = out.join(ends.select(*KEY, F.col("node").alias(end), F.col("degree").alias(f"deg_{end}")), [*KEY, end])
    query = ((F.col("h") == F.col("query_id")) | (F.col("t") == F.col("query_id"))).cast("int")
    direct = ((F.col("touched") > 0) & (query == 1)).cast("int")
    same = F.count("*").over(Window.partitionBy(*KEY, "h", "r", "t"))
    return out.select(*KEY, "query_id", "idx", "h", "r", "t", "best_pos", "touched", query.alias("touches_query"), direct.alias("direct"), "deg_h", "deg_t", same.alias("frequency"))


def score_linear(f: dict | None = None) -> Column:
    """Best band + touch + query - direct + capped density, rounded before ranking."""
    w = {"touch": 0.35, "query": 0.05, "direct": 0.8, "density": 0.05} | (f or {})
    best = F.when(F.col("touched") > 0, band_weight(F.col("best_pos"))).otherwise(0.0)
    dense = F.least(F.col("deg_h") + F.col("deg_t"), F.lit(10)) / 10.0
    return F.bround(best + w["touch"] * (F.col("touched") > 0).cast("int") + w["query"] * F.col("touches_query") - w["direct"] * F.col("direct") + w["density"] * dense, 6)


def score_family(family: Column, weights: dict | None = None) -> Column:
    """Family weight + band of the best candidate + query + log density + first band - direct."""
    w = {"CG": 0.3, "DG": 0.3, "GG": 0.2, "direct": 0.05, "other": 0.05} | (weights or {})
    base = F.coalesce(*[F.when(family == k, F.lit(v)) for k, v in w.items()], F.lit(w["other"]))
    band = F.when(F.col("touched") > 0, band_weight(F.col("best_pos"))).otherwise(0.0)
    dense = (F.log1p("deg_h") + F.log1p("deg_t")) / 10.0
    return base + 0.35 * band + 0.10 * F.col("touches_query") + 0.05 * dense + 0.05 * F.coalesce((F.col("best_pos") <= 5).cast("int"), F.lit(0)) - 0.5 * (family == "direct").cast("int")


def target_size(n: Column, ratio: float, least: int, most: int | None = None) -> Column:
    """Triples to keep of n: the rounded share (half to even), at least `least`, at most n and `most`."""
    size = F.least(n, F.greatest(F.lit(least), F.rint(n * F.lit(ratio)).cast("int")))
    return F.least(size, F.lit(most)) if most else size


def select(scored: DataFrame, touched: DataFrame, ratio: float, least: int, most: int | None = None, passes: tuple = ("candidate", "fill"), uncapped: bool = False, family_min: dict | None = None) -> DataFrame:
    """The chosen triples of scored (KEY, idx, score, touches_query, family). passes, in order: candidate (the best triple of each candidate, candidates by
    place), query (the best triple at the query), family (the first of each family that is to have some), fill (all by score)."""
    order = [F.desc("score"), F.asc("idx")]
    w = Window.partitionBy(*KEY)
    offers = []
    for k, name in enumerate(passes):
        if name == "candidate":
            best = touched.join(scored.select(*KEY, "idx", "score"), [*KEY, "idx"])
            best = best.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "cand").orderBy(*order))).where("_n = 1")
            offers.append(best.select(*KEY, "idx", F.lit(k).alias("pass"), F.col("pos").cast("long").alias("place")))
        elif name == "family":
            for j, (fam, n) in enumerate((family_min or {}).items()):
                one = scored.where(F.col("family") == fam).withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n)
                offers.append(one.select(*KEY, "idx", F.lit(k).alias("pass"), (F.col("_n") + j * 1_000_000).cast("long").alias("place")))
        else:
            some = scored.where("touches_query = 1") if name == "query" else scored
            some = some.select(*KEY, "idx", F.lit(k).alias("pass"), F.row_number().over(w.orderBy(*order)).cast("long").alias("place"))
            offers.append(some.where("place = 1") if name == "query" else some)
    offered = offers[0]
    for o in offers[1:]:
        offered = offered.unionByName(o)
    first = offered.groupBy(*KEY, "idx").agg(F.min(F.struct("pass", "place")).alias("at"))
    n = scored.groupBy(*KEY).agg(F.count("*").cast("int").alias("n_source"))
    ranked = first.join(n, KEY).withColumn("rn", F.row_number().over(w.orderBy("at.pass", "at.place", "idx"))).withColumn("target", target_size(F.col("n_source"), ratio, least, most))
    keep = F.col("rn") <= F.col("target")
    return ranked.where(keep | (F.col("at.pass") == 0) if uncapped else keep).select(*KEY, "idx", "n_source", "target")


def evidence(stages: list[DataFrame], budget: int, before: DataFrame | None = None, start: int = 0) -> DataFrame:
    """Union of stages of triples (KEY, h, r, t, o1, o2, o3), earlier stages first, each in its order; the first of equal triples stays; at most budget for a query.

    before: what evidence() chose of the first `start` stages, where it is known. Rows of a query go to one place, where equal triples and the order are settled together.
    """
    order = ("o1", "o2", "o3")
    out = None if before is None else before.select(*KEY, "h", "r", "t", "stage", F.col("idx").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"))
    for k, s in enumerate(stages):
        s = s.select(*KEY, "h", "r", "t", F.lit(start + k).alias("stage"), *[(F.col(c) if c in s.columns else F.lit(0)).cast("long").alias(c) for c in order])
        out = s if out is None else out.unionByName(s)
    return first_triples(out.repartition(*KEY), budget)


def first_triples(rows: DataFrame, budget: int) -> DataFrame:
    """The first `budget` different triples of each query by stage, o1, o2, o3. Rows (KEY, h, r, t, stage, o1, o2, o3) that are dealt by KEY are not moved."""
    order = ("o1", "o2", "o3")
    first = rows.groupBy(*KEY, "h", "r", "t").agg(F.min(F.struct("stage", *order)).alias("at"))
    idx = F.row_number().over(Window.partitionBy(*KEY).orderBy("at.stage", *[f"at.{c}" for c in order], "h", "r", "t")) - 1
    return first.withColumn("idx", idx).where(F.col("idx") < budget).select(*KEY, "idx", "h", "r", "t", F.col("at.stage").alias("stage"))


def gene_stages(direct: DataFrame, theirs: DataFrame, mine: DataFrame, budget: int) -> DataFrame:
    """evidence() of four stages: direct edges (KEY, h, r, t, o1), edges of candidates (theirs) and of the query (mine) to genes that both have, the query's other genes, the candidates' others.

    theirs (KEY, pos, gene, h, r, t, place), mine (the same without pos). All rows of a query go to one place once; there each sees whether the other side has its gene.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    none = F.lit(None).cast("long")
    rows = direct.select(*KEY, none.alias("gene"), "h", "r", "t", F.lit("direct").alias("side"), F.col("o1").cast("long").alias("pos"), none.alias("place"))
    rows = rows.unionByName(theirs.select(*KEY, "gene", "h", "r", "t", F.lit("theirs").alias("side"), long("pos"), long("place")))
    rows = rows.unionByName(mine.select(*KEY, "gene", "h", "r", "t", F.lit("mine").alias("side"), none.alias("pos"), long("place")))
    # As many partitions as shuffles have: the rows compress well, and fewer that look small would spill when they are sorted.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    gene = Window.partitionBy(*KEY, "gene")
    pos = F.min(F.when(F.col("side") == "theirs", F.col("pos"))).over(gene)
    rows = rows.withColumn("_pos", pos).withColumn("_mine", F.max(F.col("side") == "mine").over(gene))
    at = lambda stage, *o: F.struct(F.lit(stage).alias("stage"), *[x.cast("long").alias(f"o{k}") for k, x in enumerate(o, 1)])
    pos, place, zero, one = F.col("pos"), F.col("place"), F.lit(0), F.lit(1)
    own = F.when(F.col("_mine"), at(1, pos, zero, place)).otherwise(at(3, pos, place, zero))
    query = F.when(F.col("_pos").isNotNull(), at(1, F.col("_pos"), one, place)).otherwise(at(2, place, zero, zero))
    at_ = F.when(F.col("side") == "direct", at(0, pos, zero, zero)).when(F.col("side") == "theirs", own).otherwise(query)
    return first_triples(rows.withColumn("at", at_).select(*KEY, "h", "r", "t", "at.*"), budget)


def filled(nodes: DataFrame, edges: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` edges (node, .., place from 1) of each row's different nodes (KEY, node, order), nodes by order, edges by place.

    A triple stands at two of a row's nodes at most, its ends; so the first n different triples are among the first 2 n edges.
    """
    sizes = edges.groupBy("node").agg(F.max("place").alias("_size"))
    upto = Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = nodes.join(sizes, "node").withColumn("_before", F.coalesce(F.sum("_size").over(upto), F.lit(0))).where(F.col("_before") < most)
    return met.drop("_size").join(edges, "node").where(F.col("place") + F.col("_before") <= most).drop("_before")


def score_counts(weights: dict | None = None) -> Column:
    """Best band + touch + query - direct + density, where density is the number of touched candidates and of the query (0 or 1)."""
    w = {"touch": 0.35, "query": 0.05, "direct": 0.8, "density": 0.05} | (weights or {})
    best = F.when(F.col("touched") > 0, band_weight(F.col("best_pos"))).otherwise(0.0)
    return best + w["touch"] * (F.col("touched") > 0).cast("int") + w["query"] * F.col("touches_query") - w["direct"] * F.col("direct") + w["density"] * (F.col("touched") + F.col("touches_query"))


def score_status(family: Column) -> Column:
    """As score_family, with approved and failed pairs of their own: failed ones pay once more."""
    base = F.coalesce(*[F.when(family == k, F.lit(v)) for k, v in {"approved": 0.1, "failed": 0.02, "CG": 0.35, "GG": 0.25}.items()], F.lit(0.05))
    band = F.when(F.col("touched") > 0, band_weight(F.col("best_pos"))).otherwise(0.0)
    dense = (F.log1p("deg_h") + F.log1p("deg_t")) / 10.0
    top = F.coalesce((F.col("best_pos") <= 5).cast("int"), F.lit(0))
    return base + 0.35 * band + 0.10 * F.col("touches_query") + 0.05 * dense + 0.05 * top - 0.4 * family.isin("approved", "failed", "direct").cast("int") - 0.15 * (family == "failed").cast("int")
