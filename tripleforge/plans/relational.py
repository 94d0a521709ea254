"""Joins, projections and comparisons of row sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import ranking as k
from ..operators import retrieval as r
from ..operators import splits
from ..sources.derived import SQL, Graph
from .evidence import CANDIDATE, FILL, scored, select_sql
from .features import FEATURES, WHOLE_FEATURES, soft_ranked
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY


@query("jn01_last_duplicate_wins", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def _(spark, sf):
    kg = Graph(spark, sf)
    last = kg.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("o"))
    return kg.table("customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("jn03_positional_join", f"WITH {WHOLE_FEATURES} SELECT a.split, a.row_index, a.pos, a.cand AS raw_cand, b.cand AS soft_cand FROM soft a JOIN soft b ON a.split = b.split AND a.row_index = b.row_index AND a.pos = b.soft_rank")
def _(spark, sf):
    kg = Graph(spark, sf)
    s = soft_ranked(kg, whole=True).select(*KEY, "pos", "soft_rank", "cand")
    return s.select(*KEY, "pos", F.col("cand").alias("raw_cand")).join(s.select(*KEY, F.col("soft_rank").alias("pos"), F.col("cand").alias("soft_cand")), [*KEY, "pos"])


@query("jn07_semi_join", f"WITH {SQL} SELECT h, t, split FROM target WHERE h IN (SELECT cand FROM pop) AND t IN (SELECT t FROM train)")
def _(spark, sf):
    kg = Graph(spark, sf)
    return kg.target().join(kg.popularity().select(F.col("cand").alias("h")), "h", "left_semi").join(kg.train().select("t").distinct(), "t", "left_semi").select("h", "t", "split")


@query("jn08_anti_join", f"WITH {SQL} SELECT h, t FROM aux WHERE NOT EXISTS (SELECT 1 FROM target x WHERE x.h = aux.h AND x.t = aux.t)")
def _(spark, sf):
    kg = Graph(spark, sf)
    return kg.auxiliary().select("h", "t").join(kg.target().select("h", "t"), ["h", "t"], "left_anti")


@query("jn09_unmapped_keys", f"WITH {SQL} SELECT count(*) AS n_edges, count(*) FILTER (h NOT IN (SELECT id FROM nodes) OR t NOT IN (SELECT id FROM nodes)) AS n_unmapped FROM edges")
def _(spark, sf):
    kg = Graph(spark, sf)
    e, n = kg.edges(), kg.nodes().select("id")
    bad = e.join(n.withColumnRenamed("id", "h"), "h", "left_anti").select("h", "r", "t").unionByName(e.join(n.withColumnRenamed("id", "t"), "t", "left_anti").select("h", "r", "t")).distinct()
    return e.agg(F.count("*").alias("n_edges")).crossJoin(bad.agg(F.count("*").alias("n_unmapped")))


@query("jn10_dictionary_encode", f"WITH {SQL}, rid AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS rid FROM (SELECT DISTINCT r FROM edges)) SELECT rid, count(*) AS n, sum(h + t)::BIGINT AS ids FROM edges JOIN rid USING (r) GROUP BY rid")
def _(spark, sf):
    e = Graph(spark, sf).edges()
    rid = e.select("r").distinct().withColumn("rid", F.row_number().over(Window.orderBy("r")) - 1)
    return e.join(rid, "r").groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.col("h") + F.col("t")).alias("ids"))


@query("jn11_dynamic_ids", f"WITH {SQL}, n AS (SELECT max(id) AS m FROM nodes), u AS (SELECT props AS tok, min(event_id) AS f FROM events GROUP BY props) SELECT tok, m + row_number() OVER (ORDER BY f) AS id FROM u, n")
def _(spark, sf):
    kg = Graph(spark, sf)
    u = kg.table("events").groupBy(F.col("props").alias("tok")).agg(F.min("event_id").alias("f"))
    m = kg.nodes().agg(F.max("id").alias("m"))
    return splits.dense_ids(u, "f", "n").crossJoin(F.broadcast(m)).select("tok", (F.col("m") + F.col("n") + 1).alias("id"))


PAIRS = "WITH p AS (SELECT DISTINCT l_suppkey AS c, o_custkey AS d, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%')"


def status_pairs(kg: Graph):
    o = kg.table("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("d"))
    return kg.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("c"), F.col("l_returnflag").alias("f")).join(o, "l_orderkey").select("c", "d", "f").distinct()


@query("jn12_conflicts", PAIRS + " SELECT c, d, bool_or(f = 'R') AS approved, bool_or(f = 'A') AS failed, bool_or(f = 'R') AND bool_or(f = 'A') AS conflict FROM p WHERE f IN ('A', 'R') GROUP BY c, d")
def _(spark, sf):
    p = status_pairs(Graph(spark, sf)).where("f in ('A', 'R')")
    yes, no = F.bool_or(F.col("f") == "R"), F.bool_or(F.col("f") == "A")
    return p.groupBy("c", "d").agg(yes.alias("approved"), no.alias("failed"), (yes & no).alias("conflict"))


@query("jn15_score_universe", f"WITH {SQL} SELECT split, row_index, count(*) AS n, max(score) AS best FROM q, pop GROUP BY ALL")
def _(spark, sf):
    """Size and best score of the universe for each query; as scores do not depend on the query, one row of sums meets all queries."""
    kg = Graph(spark, sf)
    return kg.queries().select(*KEY).crossJoin(F.broadcast(kg.popularity().agg(F.count("*").alias("n"), F.max("score").alias("best"))))


@query("jn16_pairs_among_allowed", f"WITH {SQL}, a AS (SELECT cand AS id FROM pop UNION SELECT query_id FROM q) SELECT h, r, t FROM edges WHERE h IN (SELECT id FROM a) AND t IN (SELECT id FROM a)")
def _(spark, sf):
    kg = Graph(spark, sf)
    a = kg.popularity().select(F.col("cand").alias("id")).unionByName(kg.queries().select(F.col("query_id").alias("id"))).distinct()
    return kg.edges().join(a.withColumnRenamed("id", "h"), "h", "left_semi").join(a.withColumnRenamed("id", "t"), "t", "left_semi").select("h", "r", "t")


@query("jn18_mapping_probe", "SELECT form, count(*) AS n, count(*) FILTER (hit) AS mapped FROM (SELECT form, k IN (SELECT s_suppkey::VARCHAR FROM supplier) AS hit FROM (SELECT 'raw' AS form, c_custkey::VARCHAR AS k FROM customer UNION ALL SELECT 'half', (c_custkey // 2)::VARCHAR FROM customer)) GROUP BY form")
def _(spark, sf):
    kg = Graph(spark, sf)
    forms = kg.table("customer").select(F.explode(F.create_map(F.lit("raw"), F.col("c_custkey").cast("string"), F.lit("half"), (F.col("c_custkey") / 2).cast("long").cast("string"))).alias("form", "k"))
    s = kg.table("supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.lit(1).alias("hit"))
    return forms.join(s, "k", "left").groupBy("form").agg(F.count("*").alias("n"), F.count("hit").alias("mapped"))


@query("jn19_query_set_check", f"WITH {SQL} SELECT split, count(*) AS n, bool_and(query_id % 3 = 2 AND gold_id % 3 = 0) AS same FROM q GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    a, b = kg.queries(), kg.target().where("split <> 'train'").select(F.col("split").alias("s2"), F.col("t").alias("query_id"), F.col("h").alias("gold_id"))
    j = a.join(b, ["query_id", "gold_id"], "full")
    return j.groupBy(F.coalesce("split", "s2").alias("split")).agg(F.count("*").alias("n"), F.bool_and(F.col("split").eqNullSafe(F.col("s2"))).alias("same"))


@query("prj01_target_only", f"WITH {SQL} SELECT h, t FROM edges WHERE r = 'CtD'")
def _(spark, sf):
    return Graph(spark, sf).edges().where("r = 'CtD'").select("h", "t")


@query("prj03_first_value", "SELECT event_id, coalesce(NULLIF(json_extract_string(props, '$.missing'), ''), NULLIF(json_extract_string(props, '$.k'), ''), event_type) AS v FROM events")
def _(spark, sf):
    p = lambda path: F.nullif(F.get_json_object("props", path), F.lit(""))
    return Graph(spark, sf).table("events").select("event_id", F.coalesce(p("$.missing"), p("$.k"), "event_type").alias("v"))


@query("prj04_safe_casts", "SELECT p_partkey, try_cast(split_part(p_name, ' ', 2) AS INTEGER) AS n, try_cast(p_name AS DOUBLE) AS x FROM part")
def _(spark, sf):
    return Graph(spark, sf).table("part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).try_cast("int").alias("n"), F.col("p_name").try_cast("double").alias("x"))


@query("prj07_schema_valid", f"WITH {SQL}, s(r, hk, tk) AS (VALUES ('CbG', 0, 1), ('CdG', 0, 1), ('DaG', 2, 1), ('GiG', 1, 1), ('CtD', 0, 2), ('CpD', 0, 1)) SELECT edges.r, count(*) AS n, count(*) FILTER (h % 3 = hk AND t % 3 = tk) AS valid, count(*) FILTER (hk IS NULL) AS unknown FROM edges LEFT JOIN s ON s.r = edges.r GROUP BY edges.r")
def _(spark, sf):
    s = spark.createDataFrame([("CbG", 0, 1), ("CdG", 0, 1), ("DaG", 2, 1), ("GiG", 1, 1), ("CtD", 0, 2), ("CpD", 0, 1)], "r string, hk int, tk int")
    e = Graph(spark, sf).edges().join(F.broadcast(s), "r", "left")
    flag = (F.col("h") % 3 == F.col("hk")) & (F.col("t") % 3 == F.col("tk"))
    return e.groupBy("r").agg(F.count("*").alias("n"), F.count_if(flag).alias("valid"), F.count_if(F.col("hk").isNull()).alias("unknown"))


@query("prj10_hard_filter", f"WITH {FEATURES}, x AS (SELECT *, (shared > 0)::INT AS keep, sum((shared > 0)::INT) OVER (PARTITION BY split, row_index) AS kept FROM soft) SELECT split, row_index, cand, row_number() OVER (PARTITION BY split, row_index ORDER BY pos) AS new_pos FROM x WHERE keep = 1 OR kept = 0")
def _(spark, sf):
    kg = Graph(spark, sf)
    s = soft_ranked(kg).withColumn("keep", (F.col("shared") > 0).cast("int")).withColumn("kept", F.sum("keep").over(Window.partitionBy(*KEY)))
    return k.rank_by(s.where("keep = 1 or kept = 0"), "pos", name="new_pos").select(*KEY, "cand", "new_pos")


ORDER = f"{FEATURES}, om AS (SELECT a.split, a.row_index, min((a.cand = b.cand)::INT) AS exact, min((a.cand = b.cand)::INT) FILTER (a.pos <= 5) AS top5, min((a.cand = b.cand)::INT) FILTER (a.pos = 1) AS top1 FROM soft a JOIN soft b ON a.split = b.split AND a.row_index = b.row_index AND a.pos = b.soft_rank GROUP BY ALL)"


@query("cmp02_order_match", f"WITH {ORDER} SELECT split, round(avg(exact), 6) AS exact, round(avg(top5), 6) AS top5, round(avg(top1), 6) AS top1 FROM om GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    s = soft_ranked(kg)
    m = k.order_match(s.select(*KEY, "cand", F.col("pos").alias("rank")), s.select(*KEY, "cand", F.col("soft_rank").alias("rank")))
    return m.groupBy("split").agg(*[R(F.avg(c)).alias(c) for c in ("exact", "top5", "top1")])


PLUS = select_sql("round(score - 0.2 * direct, 6)", 0.55, 18, "", f"{CANDIDATE} UNION ALL {FILL.format(p=1)}", False)
TIGHT = select_sql("score", 0.55, 18, "", f"{CANDIDATE} UNION ALL {FILL.format(p=1)}", False)


@query("cmp03_subgraph_identity", f"WITH a AS (SELECT split, row_index, string_agg(idx, ',' ORDER BY idx) AS s FROM ({TIGHT}) GROUP BY ALL), b AS (SELECT split, row_index, string_agg(idx, ',' ORDER BY idx) AS s FROM ({PLUS}) GROUP BY ALL) SELECT split, round(avg((a.s = b.s)::INT), 6) AS identical FROM a JOIN b USING (split, row_index) GROUP BY split")
def _(spark, sf):
    """How often two variants (the second with a heavier penalty of direct edges) choose the same triples in the same order."""
    f, t = scored(Graph(spark, sf))
    sign = lambda score, name: r.select(f.withColumn("score", score), t, 0.55, 18).groupBy(*KEY).agg(F.array_sort(F.collect_list("idx")).alias(name))
    a, b = sign(r.score_linear(), "a"), sign(F.round(r.score_linear() - 0.2 * F.col("direct"), 6), "b")
    return a.join(b, KEY).groupBy("split").agg(R(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("identical"))


@query("fn30_support_shift", f"WITH {FEATURES} SELECT split, row_index, CASE WHEN row_index % 4 = 1 THEN NULL ELSE round(avg(abs(0.1::DOUBLE * (cand % 7))), 6) END AS shift FROM soft GROUP BY split, row_index")
def _(spark, sf):
    """Mean absolute difference of the scores of two runs, place by place; none where their candidates differ or stand in another order."""
    s = soft_ranked(Graph(spark, sf))
    run = lambda score, name, order="pos": s.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), "cand", score.alias("x")))).alias(name))
    base, other = run(F.col("support"), "a"), run(F.col("support") + 0.1 * (F.col("cand") % 7), "b")
    j = base.join(other, KEY).withColumn("b", F.when(F.expr("row_index % 4 = 1"), F.reverse("b")).otherwise(F.col("b")))
    gap = F.aggregate(F.zip_with("a.x", "b.x", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / F.size("a")
    return j.select(*KEY, F.when(F.col("a.cand") == F.col("b.cand"), R(gap)).alias("shift"))


@query("ghost04_hub_cap", f"WITH {SQL}, d AS (SELECT t, count(*) AS n FROM cg GROUP BY t) SELECT count(*) AS kept FROM cg JOIN d USING (t) WHERE n <= 30")
def _(spark, sf):
    e = Graph(spark, sf).compound_gene()
    hubs = e.groupBy("t").agg(F.count("*").alias("n")).where("n > 30").select("t")
    return e.join(hubs, "t", "left_anti").agg(F.count("*").alias("kept"))


@query("ghost05_direction_audit", f"WITH {SQL}, e AS (SELECT h, t FROM gg UNION ALL SELECT t, h FROM gg WHERE (h + t) % 2 = 0) SELECT count(*) AS directed, count(DISTINCT (least(h, t), greatest(h, t))) AS unordered, count(*) - count(DISTINCT (least(h, t), greatest(h, t))) AS mutual FROM e")
def _(spark, sf):
    gg = Graph(spark, sf).gene_gene().select("h", "t")
    e = gg.unionByName(gg.where((F.col("h") + F.col("t")) % 2 == 0).select(F.col("t").alias("h"), F.col("h").alias("t")))
    u = e.groupBy(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).agg(F.count("*").alias("n"))
    return u.agg(F.sum("n").alias("directed"), F.count("*").alias("unordered"), (F.sum("n") - F.count("*")).alias("mutual"))


@query("ghost02_ontology_filter", f"WITH {FEATURES}, x AS (SELECT *, (direct = 1 OR shared > 0 OR bridges > 0)::INT AS keep FROM soft), y AS (SELECT *, sum(keep) OVER (PARTITION BY split, row_index) AS kept FROM x) SELECT split, count(*) FILTER (keep = 1 OR kept = 0) AS n_kept, count(DISTINCT row_index) FILTER (kept = 0) AS fallbacks FROM y GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    y = soft_ranked(kg).withColumn("keep", F.expr("cast(direct = 1 or shared > 0 or bridges > 0 as int)")).withColumn("kept", F.sum("keep").over(Window.partitionBy(*KEY)))
    return y.groupBy("split").agg(F.count_if(F.expr("keep = 1 or kept = 0")).alias("n_kept"), F.countDistinct(F.when(F.col("kept") == 0, F.col("row_index"))).alias("fallbacks"))
