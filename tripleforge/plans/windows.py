"""Ranks, top-k choices, set operations and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import greedy
from ..operators import ranking as k
from ..operators import splits
from ..sources.derived import SQL, Graph
from .features import FEATURES, WHOLE_FEATURES, gene_sets, soft_ranked
from .metrics import METRICS_SQL, METRIC_COLUMNS, RANKS_SQL, both_ranks, rounded
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY

BINARY = "(1.0::DOUBLE * (shared > 0)::INT - 0.5::DOUBLE * direct - 0.1::DOUBLE * (degree > 8)::INT)"


def formula(touch: str = "shared", evidence: float = 1.0, direct: float = 0.5, contra: float = 0.1, cap: int | None = None):
    """Support by formula: evidence (binary, or capped and scaled) less direct link and contradiction."""
    e = F.least(F.col(touch), F.lit(cap)) / float(max(cap, 1)) if cap else (F.col(touch) > 0).cast("double")
    return evidence * e - direct * F.col("direct") - contra * (F.col("degree") > 8).cast("int")


@query("win01_soft_rank", f"WITH {FEATURES}, s AS (SELECT * EXCLUDE (score), round({BINARY}, 6) AS score FROM soft) SELECT split, row_index, cand, score, row_number() OVER (PARTITION BY split, row_index ORDER BY score DESC, pos) AS rank FROM s")
def _(spark, sf):
    kg = Graph(spark, sf)
    s = soft_ranked(kg).withColumn("score", R(formula()))
    return k.rank_by(s, F.desc("score"), "pos").select(*KEY, "cand", "score", "rank")


@query("win01_formula_sweep", f"WITH {FEATURES}, v(variant, direct_w, contra_w, cap) AS (VALUES ('b025', 0.25, 0.05, 0), ('b050', 0.5, 0.1, 0), ('bcap', 0.5, 0.1, 2)), s AS (SELECT variant, split, row_index, cand, pos, gold_id, round(CASE WHEN cap > 0 THEN least(shared, cap) / 2.0 ELSE (shared > 0)::INT END - direct_w * direct - contra_w * (degree > 8)::INT, 6) AS score FROM soft, v), r AS (SELECT *, row_number() OVER (PARTITION BY variant, split, row_index ORDER BY score DESC, pos) AS rank FROM s) SELECT variant, split, round(sum(CASE WHEN cand = gold_id THEN 1.0 / rank ELSE 0 END) / count(DISTINCT row_index), 6) AS mrr FROM r GROUP BY variant, split")
def _(spark, sf):
    kg = Graph(spark, sf)
    configs = spark.createDataFrame([("b025", 0.25, 0.05, 0), ("b050", 0.5, 0.1, 0), ("bcap", 0.5, 0.1, 2)], "variant string, direct_w double, contra_w double, cap int")
    s = soft_ranked(kg).crossJoin(F.broadcast(configs))
    e = F.when(F.col("cap") > 0, F.least("shared", "cap") / 2.0).otherwise((F.col("shared") > 0).cast("double"))
    s = s.withColumn("score", R(e - F.col("direct_w") * F.col("direct") - F.col("contra_w") * (F.col("degree") > 8).cast("int")))
    r = k.rank_by(s, F.desc("score"), "pos", key=["variant", *KEY])
    return r.groupBy("variant", "split").agg(R(F.sum(F.when(F.col("cand") == F.col("gold_id"), 1.0 / F.col("rank")).otherwise(0.0)) / F.countDistinct("row_index")).alias("mrr"))


@query("win02_four_key_rank", f"WITH {WHOLE_FEATURES} SELECT split, row_index, cand, soft_rank, round(support, 6) AS support FROM soft")
def _(spark, sf):
    kg = Graph(spark, sf)
    return soft_ranked(kg, whole=True).select(*KEY, "cand", "soft_rank", R("support").alias("support"))


BLEND = "WITH {f}, m AS (SELECT *, min(support) OVER w AS lo, max(support) OVER w AS hi FROM soft WINDOW w AS (PARTITION BY split, row_index)), n AS (SELECT *, CASE WHEN abs(hi - lo) < 1e-12 THEN 0.5 ELSE (support - lo) / (hi - lo) END AS norm FROM m), b AS (SELECT *, round(0.65 * (20 - pos + 1) / 20 + 0.35 * norm, 9) AS final FROM n)"


@query("win03_minmax", BLEND.format(f=WHOLE_FEATURES) + " SELECT split, row_index, cand, round(norm, 6) AS norm FROM b")
def _(spark, sf):
    kg = Graph(spark, sf)
    return soft_ranked(kg, whole=True).select(*KEY, "cand", R(k.minmax(F.col("support"))).alias("norm"))


def blended(kg, raw: float = 0.65, whole: bool = False):
    s = soft_ranked(kg, whole).withColumn("final", F.round(raw * k.rank_prior(F.col("pos")) + (1 - raw) * k.minmax(F.col("support")), 9))
    return k.rank_by(s, F.desc("final"), F.desc(F.round("support", 9)), "pos")


@query("win04_blend_rank", BLEND.format(f=WHOLE_FEATURES) + " SELECT split, row_index, cand, round(final, 6) AS final, row_number() OVER (PARTITION BY split, row_index ORDER BY final DESC, round(support, 9) DESC, pos) AS rank FROM b")
def _(spark, sf):
    return blended(Graph(spark, sf), whole=True).select(*KEY, "cand", R("final").alias("final"), "rank")


@query("win05_bands", f"WITH {WHOLE_FEATURES} SELECT split, row_index, cand, CASE WHEN soft_rank <= 5 THEN 'top' WHEN soft_rank <= 10 THEN 'mid' ELSE 'tail' END AS band, CASE WHEN pos <= 5 THEN 'top' WHEN pos <= 10 THEN 'mid' ELSE 'tail' END AS position_band FROM soft")
def _(spark, sf):
    kg = Graph(spark, sf)
    return soft_ranked(kg, whole=True).select(*KEY, "cand", k.band(F.col("soft_rank")).alias("band"), k.band(F.col("pos")).alias("position_band"))


@query("win07_capped_neighbours", f"WITH {FEATURES} SELECT node, near, place FROM cgn")
def _(spark, sf):
    return gene_sets(Graph(spark, sf))[0].select("node", "near", "place")


@query("win08_display_names", f"WITH {SQL}, n AS (SELECT id, kind, 'part ' || (id % 50) AS name FROM nodes WHERE kind = 'Gene') SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' [' || id || ']' ELSE name END AS display FROM n")
def _(spark, sf):
    n = Graph(spark, sf).nodes().where("kind = 'Gene'").withColumn("name", F.concat(F.lit("part "), (F.col("id") % 50).cast("string")))
    size = F.count("*").over(Window.partitionBy("name"))
    return n.select("id", F.when(size > 1, F.concat("name", F.lit(" ["), F.col("id").cast("string"), F.lit("]"))).otherwise(F.col("name")).alias("display"))


@query("win09_positional_prior", f"WITH {FEATURES}, x AS (SELECT *, max(degree) OVER w AS top, count(*) OVER w AS n FROM soft WINDOW w AS (PARTITION BY split, row_index)), y AS (SELECT *, round(0.7 * (CASE WHEN n > 1 THEN 1 - (pos - 1) / (n - 1) ELSE 1 END) + 0.3 * (CASE WHEN top > 0 THEN degree / top ELSE 0 END) - 0.15 * direct, 9) AS s FROM x) SELECT split, row_index, cand, round(s, 6) AS score, row_number() OVER (PARTITION BY split, row_index ORDER BY s DESC, pos) AS rank FROM y")
def _(spark, sf):
    kg, w = Graph(spark, sf), Window.partitionBy(*KEY)
    s = soft_ranked(kg).withColumn("top", F.max("degree").over(w)).withColumn("n", F.count("*").over(w))
    prior = F.when(F.col("n") > 1, 1 - (F.col("pos") - 1) / (F.col("n") - 1)).otherwise(1.0)
    bonus = F.when(F.col("top") > 0, F.col("degree") / F.col("top")).otherwise(0.0)
    s = s.withColumn("s", F.round(0.7 * prior + 0.3 * bonus - 0.15 * F.col("direct"), 9))
    return k.rank_by(s, F.desc("s"), "pos").select(*KEY, "cand", R("s").alias("score"), "rank")


@query("win10_gold_rank", f"WITH {SQL} SELECT q.split, q.row_index, coalesce(min(pos), 21)::INT AS gold_rank FROM q LEFT JOIN cand c ON c.split = q.split AND c.row_index = q.row_index AND c.cand = q.gold_id GROUP BY ALL")
def _(spark, sf):
    kg = Graph(spark, sf)
    return k.gold_ranks(kg.candidates(), kg.queries()).select(*KEY, "gold_rank")


@query("win11_delta", f"WITH {FEATURES}, {RANKS_SQL}, m AS ({METRICS_SQL.format(by='row_name, split', source='gr')}) SELECT row_name, split, mrr, round(mrr - first_value(mrr) OVER (PARTITION BY split ORDER BY row_name), 6) AS delta FROM m")
def _(spark, sf):
    m = rounded(k.ranking_metrics(both_ranks(Graph(spark, sf)), ("row_name", "split")), *METRIC_COLUMNS)
    ref = F.max(F.when(F.col("row_name") == "raw", F.col("mrr"))).over(Window.partitionBy("split"))
    return m.select("row_name", "split", "mrr", R(F.col("mrr") - ref).alias("delta"))


@query("win12_id_maps", f"WITH {SQL}, n AS (SELECT DISTINCT kind || '::' || (id // 3) AS entity FROM nodes) SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS entity_id FROM n")
def _(spark, sf):
    n = Graph(spark, sf).nodes().select(F.concat("kind", F.lit("::"), (F.col("id") / 3).cast("long").cast("string")).alias("entity")).distinct()
    return splits.dense_ids(n, "entity", "entity_id")


@query("win13_group_caps", f"WITH {SQL}, e AS (SELECT h, t, row_number() OVER (PARTITION BY h ORDER BY t, r) AS n, r FROM cg) SELECT h, r, t FROM e WHERE n <= 80")
def _(spark, sf):
    return g.first_per(Graph(spark, sf).compound_gene(), ["h"], ["t", "r"], 80, "n").select("h", "r", "t")


@query("topk01_candidates", f"WITH {SQL} SELECT split, row_index, pos, cand, score FROM cand")
def _(spark, sf):
    return Graph(spark, sf).candidates().select(*KEY, "pos", "cand", "score")


@query("topk02_force_gold", f"WITH {SQL}, x AS (SELECT *, max((cand = gold_id)::INT) OVER w AS hit, max(pos) OVER w AS n, min(score) OVER w AS low FROM cand WINDOW w AS (PARTITION BY split, row_index)) SELECT split, row_index, pos, CASE WHEN hit = 0 AND pos = n THEN gold_id ELSE cand END AS cand, CASE WHEN hit = 0 AND pos = n THEN low - 1e-6 ELSE score::DOUBLE END AS score FROM x")
def _(spark, sf):
    w = Window.partitionBy(*KEY)
    x = Graph(spark, sf).candidates().withColumn("hit", F.max((F.col("cand") == F.col("gold_id")).cast("int")).over(w)).withColumn("n", F.max("pos").over(w)).withColumn("low", F.min("score").over(w))
    put = (F.col("hit") == 0) & (F.col("pos") == F.col("n"))
    return x.select(*KEY, "pos", F.when(put, F.col("gold_id")).otherwise(F.col("cand")).alias("cand"), F.when(put, F.col("low") - 1e-6).otherwise(F.col("score").cast("double")).alias("score"))


@query("topk03_supervised", f"WITH {SQL}, u AS (SELECT cand, row_number() OVER (ORDER BY score DESC, cand) AS o FROM pop), x AS (SELECT train.h AS gold, train.t AS query_id, cand, row_number() OVER (PARTITION BY train.h, train.t ORDER BY o) AS n FROM train, u WHERE cand <> train.h) SELECT query_id, gold, n + 1 AS pos, cand FROM x WHERE n <= 19 UNION ALL SELECT t, h, 1, h FROM train")
def _(spark, sf):
    kg = Graph(spark, sf)
    u = kg.ranked().where("place <= 20").select("cand", F.col("place").alias("o"))
    t = kg.train().select(F.col("t").alias("query_id"), F.col("h").alias("gold"))
    x = t.crossJoin(F.broadcast(u)).where("cand <> gold").withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "gold").orderBy("o")) + 1).where("pos <= 20")
    return x.select("query_id", "gold", "pos", "cand").unionByName(t.select("query_id", "gold", F.lit(1).alias("pos"), F.col("gold").alias("cand")))


@query("topk05_graph_trim", f"WITH {SQL} SELECT h, r, t FROM (SELECT h, r, t, row_number() OVER (ORDER BY CASE WHEN r = 'CtD' THEN 0 WHEN r = 'CpD' THEN 1 WHEN r LIKE 'C%' THEN 2 WHEN r LIKE 'D%' THEN 3 ELSE 4 END, r, h, t) AS n FROM edges) WHERE n <= 5000")
def _(spark, sf):
    p = F.when(F.col("r") == "CtD", 0).when(F.col("r") == "CpD", 1).when(F.col("r").startswith("C"), 2).when(F.col("r").startswith("D"), 3).otherwise(4)
    return Graph(spark, sf).edges().orderBy(p, "r", "h", "t").limit(5000)


@query("topk06_case_ranking", f"WITH {FEATURES}, x AS (SELECT split, row_index, cand, CASE WHEN soft_rank < pos THEN 'improved' WHEN soft_rank > pos THEN 'worsened' ELSE 'same' END AS bucket, abs(soft_rank - pos) AS shift, pos FROM soft) SELECT bucket, split, row_index, cand, shift, row_number() OVER (PARTITION BY bucket ORDER BY shift DESC, split, row_index, pos) AS n FROM x QUALIFY n <= 25")
def _(spark, sf):
    kg = Graph(spark, sf)
    x = soft_ranked(kg).withColumn("bucket", F.when(F.expr("soft_rank < pos"), "improved").when(F.expr("soft_rank > pos"), "worsened").otherwise("same")).withColumn("shift", F.abs(F.col("soft_rank") - F.col("pos")))
    return g.first_per(x, ["bucket"], [F.desc("shift"), "split", "row_index", "pos"], 25, "n").select("bucket", *KEY, "cand", "shift", "n")


@query("topk07_leaderboard", f"WITH {FEATURES}, {RANKS_SQL}, m AS ({METRICS_SQL.format(by='row_name, split', source='gr')}) SELECT split, row_name, mrr, hits_10, row_number() OVER (PARTITION BY split ORDER BY mrr DESC, hits_10 DESC, gold_at_20 DESC, row_name) AS place FROM m")
def _(spark, sf):
    m = rounded(k.ranking_metrics(both_ranks(Graph(spark, sf)), ("row_name", "split")), *METRIC_COLUMNS)
    return k.rank_by(m, F.desc("mrr"), F.desc("hits_10"), F.desc("gold_at_20"), "row_name", name="place", key=["split"]).select("split", "row_name", "mrr", "hits_10", "place")


SWEEP = BLEND.format(f=WHOLE_FEATURES).replace("0.65 *", "w *").replace("0.35 *", "(1 - w) *").replace("FROM n)", "FROM n, (VALUES (0.5::DOUBLE), (0.65::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(w))")
SWEEP += ", r AS (SELECT w, split, row_index, cand, gold_id, row_number() OVER (PARTITION BY w, split, row_index ORDER BY final DESC, round(support, 9) DESC, pos) AS rank FROM b), t1 AS (SELECT w, split, max(n) / sum(n) AS dom FROM (SELECT w, split, cand, count(*) AS n FROM r WHERE rank = 1 GROUP BY ALL) GROUP BY w, split), mm AS (SELECT w, split, round(sum(CASE WHEN cand = gold_id THEN 1.0 / rank ELSE 0 END) / count(DISTINCT row_index), 6) AS mrr FROM r GROUP BY w, split), e AS (SELECT w, split, mrr, round(dom, 6) AS dominance, (dom <= 0.7)::INT AS eligible FROM mm JOIN t1 USING (w, split))"


@query("topk08_constrained_selection", SWEEP + " SELECT split, w, mrr, dominance, eligible FROM e QUALIFY row_number() OVER (PARTITION BY split ORDER BY eligible DESC, mrr DESC, dominance, w) = 1")
def _(spark, sf):
    kg = Graph(spark, sf)
    ws = spark.createDataFrame([(0.5,), (0.65,), (0.8,), (0.9,)], "w double")
    s = soft_ranked(kg, whole=True).withColumn("norm", k.minmax(F.col("support"))).crossJoin(F.broadcast(ws))
    s = s.withColumn("final", F.round(F.col("w") * k.rank_prior(F.col("pos")) + (1 - F.col("w")) * F.col("norm"), 9))
    r = k.rank_by(s, F.desc("final"), F.desc(F.round("support", 9)), "pos", key=["w", *KEY])
    mrr = r.groupBy("w", "split").agg(R(F.sum(F.when(F.col("cand") == F.col("gold_id"), 1.0 / F.col("rank")).otherwise(0.0)) / F.countDistinct("row_index")).alias("mrr"))
    both = mrr.join(k.top1_dominance(r, "rank", ("w", "split")), ["w", "split"]).withColumn("eligible", (F.col("dominance") <= 0.7).cast("int"))
    return k.best_of(both, F.desc("eligible"), F.desc("mrr"), R("dominance"), "w", by=["split"]).select("split", "w", "mrr", R("dominance").alias("dominance"), "eligible")


@query("set01_dedup_sort", f"WITH {SQL} SELECT DISTINCT l_suppkey*3 AS h, l_returnflag AS r, l_partkey*3+1 AS t FROM lineitem")
def _(spark, sf):
    return Graph(spark, sf).table("lineitem").select((F.col("l_suppkey") * 3).alias("h"), F.col("l_returnflag").alias("r"), (F.col("l_partkey") * 3 + 1).alias("t")).dropDuplicates()


@query("set02_keep_first", "SELECT c, p, ln FROM (SELECT l_suppkey AS c, l_partkey AS p, l_orderkey * 10 + l_linenumber AS ln, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(spark, sf):
    rows = Graph(spark, sf).table("lineitem").select(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ln"))
    return rows.groupBy("c", "p").agg(F.min("ln").alias("ln"))


@query("set03_set_operations", f"WITH {SQL}, a AS (SELECT DISTINCT h, t FROM cg WHERE r = 'CbG'), b AS (SELECT DISTINCT h, t FROM cg WHERE r = 'CdG') SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_only_a, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_any")
def _(spark, sf):
    e = Graph(spark, sf).compound_gene()
    sides = e.where("r in ('CbG', 'CdG')").groupBy("h", "t").agg(F.max((F.col("r") == "CbG").cast("int")).alias("a"), F.max((F.col("r") == "CdG").cast("int")).alias("b"))
    return sides.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("n_both"), F.count_if(F.expr("a = 1 and b = 0")).alias("n_only_a"), F.count("*").alias("n_any"))


@query("set04_graph_jaccard", f"WITH {SQL}, a AS (SELECT DISTINCT h, t FROM cg WHERE r = 'CbG'), b AS (SELECT DISTINCT h, t FROM cg WHERE r = 'CdG') SELECT h AS row_index, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT h, t, max(s = 'a') AS a, max(s = 'b') AS b FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY h, t) GROUP BY h")
def _(spark, sf):
    e = Graph(spark, sf).compound_gene().withColumn("row_index", F.col("h"))
    a, b = (e.where(F.col("r") == r).select("row_index", "h", F.lit("x").alias("r"), "t") for r in ("CbG", "CdG"))
    return g.jaccard(a, b, ["row_index"]).select("row_index", R("jaccard").alias("jaccard"))


@query("set06_concatenate_splits", f"WITH {SQL} SELECT split, h, r, t FROM target")
def _(spark, sf):
    t = Graph(spark, sf).target()
    parts = [t.where(F.col("split") == s) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", "h", "r", "t")


SPARE = "SELECT *, count(*) OVER (PARTITION BY h) - 1 AS dh, count(*) OVER (PARTITION BY t) - 1 AS dt, count(*) OVER () // 20 AS m FROM (SELECT h, t FROM target)"
ORDER = f"{splits.drawn_sql(2026, 'h', 't')}, h, t"


@query("smp01_coverage_safe_split", f"WITH RECURSIVE {SQL}, {greedy.loop_sql('ho', SPARE, ORDER, 'e.dh', 'e.dt', '2 * e.m')} SELECT e.h, e.t, CASE WHEN n IS NULL THEN 'train' WHEN n < m THEN 'valid' ELSE 'test' END AS split FROM target e LEFT JOIN ho USING (h, t)")
def _(spark, sf):
    """One in twenty triples for validation and as many for the test, whose ends keep another one in training. The SQL goes through the first order only, which reaches both."""
    target = Graph(spark, sf).target().select("h", "t")
    n = target.count() // 20
    return greedy.coverage_safe_split(target, n, n, seed=2026)


SIZES = (500, 400, 300, 250, 200, 100, 50, 20, 5)


@query("smp02_split_ladder", f"WITH RECURSIVE {SQL}, {greedy.loop_sql('ho', SPARE, ORDER, 'e.dh', 'e.dt')}, n AS (SELECT (SELECT count(*) FROM target) AS n_edges, (SELECT count(*) FROM ho) AS can) SELECT n_edges, coalesce(max(s) FILTER (2 * s < n_edges AND 2 * s <= can), 0) AS size FROM n, (VALUES {', '.join(f'({s})' for s in SIZES)}) v(s) GROUP BY n_edges")
def _(spark, sf):
    """The largest size of the ladder that a split reaches. The SQL tries the first order only; the others matter where that falls short of a size by little."""
    return greedy.split_ladder(Graph(spark, sf).target().select("h", "t"), SIZES, seed=2026)


@query("smp03_fixed_sample", f"WITH {SQL} SELECT h, t FROM target ORDER BY {splits.drawn_sql(7, 'h', 't')}, h, t LIMIT 40")
def _(spark, sf):
    return splits.fixed_sample(Graph(spark, sf).target().select("h", "t"), 40, seed=7)


@query("smp04_filter_chain", f"WITH {SQL}, u AS (SELECT DISTINCT h FROM train), v AS (SELECT DISTINCT t FROM train), x AS (SELECT target.*, u.h IS NOT NULL AS in_h, v.t IS NOT NULL AS in_t FROM target LEFT JOIN u ON u.h = target.h LEFT JOIN v ON v.t = target.t WHERE split <> 'train') SELECT split, count(*) AS n_before, count(*) FILTER (in_h) AS n_head, count(*) FILTER (in_h AND in_t) AS n_both FROM x GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    u, v = kg.train().select("h").distinct().withColumn("in_h", F.lit(True)), kg.train().select("t").distinct().withColumn("in_t", F.lit(True))
    x = kg.target().where("split <> 'train'").join(u, "h", "left").join(v, "t", "left")
    return x.groupBy("split").agg(F.count("*").alias("n_before"), F.count_if("in_h").alias("n_head"), F.count_if(F.expr("in_h and in_t")).alias("n_both"))


@query("smp05_negative_sampling", f"WITH {SQL}, p AS (SELECT h, r, t, (r = 'CtD' OR {splits.drawn_sql(5, 'h', 'r', 't')} % 2 = 0) AS head FROM (SELECT * FROM train UNION ALL SELECT * FROM aux)), hs AS (SELECT cand AS new_h, row_number() OVER (ORDER BY cand) - 1 AS i FROM pop), ts AS (SELECT id AS new_t, row_number() OVER (ORDER BY id) - 1 AS j FROM nodes) SELECT coalesce(new_h, h) AS h, r, coalesce(new_t, t) AS t, h AS from_h, t AS from_t FROM p LEFT JOIN hs ON head AND i = {splits.drawn_sql(6, 'h', 'r', 't')} % (SELECT count(*) FROM hs) LEFT JOIN ts ON NOT head AND j = {splits.drawn_sql(7, 'h', 'r', 't')} % (SELECT count(*) FROM ts)")
def _(spark, sf):
    kg = Graph(spark, sf)
    return splits.negatives(kg.train().unionByName(kg.auxiliary().select("h", "r", "t")), kg.popularity().select(F.col("cand").alias("h")), kg.nodes().select(F.col("id").alias("t")), "CtD", seed=5)


SIDE = "SELECT {n} AS is_target, h, r, t, row_number() OVER (ORDER BY h, r, t) - 1 AS i, count(*) OVER () AS n FROM edges WHERE {w}"


@query("smp06_balanced_sampling", f"WITH {SQL}, a AS ({SIDE.format(n='true', w="r = 'CtD'")}), b AS ({SIDE.format(n='false', w="r <> 'CtD'")}) SELECT d AS draw, is_target, h, r, t FROM range(1000) x(d) JOIN a ON i = {splits.drawn_sql(10, 'd')} % n UNION ALL SELECT d, is_target, h, r, t FROM range(1000) x(d) JOIN b ON i = {splits.drawn_sql(9, 'd')} % n")
def _(spark, sf):
    return splits.balanced(Graph(spark, sf).edges(), F.col("r") == "CtD", 1000, seed=9)
