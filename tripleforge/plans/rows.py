"""Projections of candidate rows, lookups between row sets, and alignment checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import ranking as k
from ..operators import retrieval as r
from ..operators import rows as w
from ..sources.derived import SQL, Graph
from .evidence import TF, scored, subgraph_sql, subgraphs
from .features import BRIDGE_CAP, BRIDGE_GENES, FEATURES, WHOLE_FEATURES, gene_sets, soft_ranked
from .metrics import METRIC_COLUMNS, METRICS_SQL, RANKS_SQL, both_ranks
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY
#: Candidates with names, and each query with its gold's rank.
NAMES = SQL + """, cw AS (SELECT cand.*, name FROM cand JOIN nodes ON id = cand),
g0 AS (SELECT q.split, q.row_index, q.query_id, q.gold_id, coalesce(min(pos), 21) AS rank FROM q LEFT JOIN cand c ON c.split = q.split AND c.row_index = q.row_index AND c.cand = q.gold_id GROUP BY ALL)"""


def named(kg: Graph):
    return kg.candidates().join(kg.nodes().select(F.col("id").alias("cand"), "name"), "cand")


def ranks(kg: Graph):
    return k.gold_ranks(kg.candidates(), kg.queries()).select(*KEY, "query_id", "gold_id", F.col("gold_rank").alias("rank"))


def wide(kg: Graph):
    """A row for each query, with names and ids of its candidates in order."""
    lists = named(kg).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "cand"))).alias("c"))
    return ranks(kg).join(lists.select(*KEY, F.col("c.name").alias("names"), F.col("c.cand").alias("ids")), KEY)


@query("prj02_raw_rows", f"WITH {NAMES}, rk AS (SELECT cand, row_number() OVER (ORDER BY score DESC, cand) AS place FROM pop) SELECT g0.split, g0.row_index, (SELECT count(*) FROM cw WHERE cw.split = g0.split AND cw.row_index = g0.row_index) AS n, (SELECT min_by(name, pos) FROM cw WHERE cw.split = g0.split AND cw.row_index = g0.row_index) AS first_name, CASE WHEN gold_id % 2 = 0 THEN coalesce(place, rank) ELSE rank END AS full_rank, CASE WHEN g0.row_index % 2 = 0 THEN rank <= 20 ELSE false END AS in_topk FROM g0 LEFT JOIN rk ON rk.cand = gold_id")
def _(spark, sf):
    kg = Graph(spark, sf)
    full = kg.ranked().select(F.col("cand").alias("gold_id"), "place")
    raw = wide(kg).join(full, "gold_id", "left").withColumn("full", F.when(F.col("gold_id") % 2 == 0, F.col("place"))).withColumn("flag", F.when(F.col("row_index") % 2 == 0, F.col("rank") <= 20))
    return w.raw_rows(raw, "names", "ids", rank=("full", "rank"), flag="flag").select(*KEY, F.size("ids").cast("long").alias("n"), F.get("names", F.lit(0)).alias("first_name"), F.col("full_rank").cast("long").alias("full_rank"), "in_topk")


@query("prj05_extract_ids", f"WITH {SQL} SELECT split, row_index, gold_id AS gold, CASE WHEN row_index % 2 = 0 OR row_index % 3 = 1 THEN query_id END AS query, CASE row_index % 4 WHEN 3 THEN 0 ELSE 1 END AS n_candidates FROM q")
def _(spark, sf):
    q, n = Graph(spark, sf).queries(), F.col("row_index")
    gold, query_ = F.col("gold_id").cast("string"), F.col("query_id").cast("string")
    ids = F.when(n % 4 == 1, F.array(F.lit("x"))).when(n % 4 != 3, F.array(F.lit("12"), F.lit("y")))
    raw = q.select(*KEY, F.when(n % 3 == 0, gold).alias("gold_entity_id"), F.when(n % 2 == 0, query_).alias("query_entity_id"), F.when(n % 3 == 1, F.array(gold, F.lit("7"), query_)).alias("triple_id"), F.struct(F.when(n % 3 == 2, F.col("gold_id")).alias("gold_entity_id")).alias("row_metrics"), ids.alias("ids"), F.struct(F.when(n % 4 == 1, F.array(F.lit("9"))).alias("ids")).alias("row"))
    return w.extract_ids(raw).select(*KEY, "gold", "query", F.size("candidates").alias("n_candidates"))


SHOWN = {"raw": ("Backbone", "candidates"), "soft": ("Soft support", "candidates")}


@query("prj06_metric_subset", f"WITH {FEATURES}, {RANKS_SQL}, m AS ({METRICS_SQL.format(by='row_name, split', source='gr')}) SELECT row_name, split, CASE row_name WHEN 'raw' THEN 'Backbone' ELSE 'Soft support' END AS display_name, 'candidates' AS family, gold_at_20 AS gold_present_at20, mrr AS reviewer_safe_mrr_at20, mrr_present AS mrr_present_only, hits_1 AS hits1_at20, hits_3 AS hits3_at20, hits_10 AS hits10_at20, hits_20 AS hits20_at20, avg_rank AS avg_gold_rank_absent_as_21, rank21 AS gold_rank_21_count FROM m")
def _(spark, sf):
    """Metrics under the names and in the order of the published tables."""
    names = dict(zip((*METRIC_COLUMNS, "rank21"), ("gold_present_at20", "reviewer_safe_mrr_at20", "mrr_present_only", "hits1_at20", "hits3_at20", "hits10_at20", "hits20_at20", "avg_gold_rank_absent_as_21", "gold_rank_21_count"), strict=True))
    m = k.ranking_metrics(both_ranks(Graph(spark, sf)), ("row_name", "split"))
    look = lambda i: F.create_map(*[F.lit(x) for n, v in SHOWN.items() for x in (n, v[i])])[F.col("row_name")]
    return m.select("row_name", "split", F.coalesce(look(0), "row_name").alias("display_name"), F.coalesce(look(1), F.lit("")).alias("family"), *[(F.col(c) if c == "rank21" else R(c)).alias(names[c]) for c in names])


@query("prj08_schema_tristate", f"WITH {SQL}, ru(r, d, g) AS (VALUES ('CbG', 'Compound', 'Gene'), ('CtD', 'Compound', 'Disease'), ('CpD', 'Compound', 'Gene'), ('GiG', 'Gene', NULL)), kd AS (SELECT id, kind FROM nodes WHERE id % 7 <> 0), e AS (SELECT edges.r, CASE WHEN d IS NULL OR g IS NULL OR a.kind IS NULL OR b.kind IS NULL THEN NULL ELSE a.kind = d AND b.kind = g END AS ok FROM edges LEFT JOIN ru ON ru.r = edges.r LEFT JOIN kd a ON a.id = h LEFT JOIN kd b ON b.id = t) SELECT r, count(*) FILTER (ok) AS yes, count(*) FILTER (NOT ok) AS no, count(*) FILTER (ok IS NULL) AS unknown FROM e GROUP BY r")
def _(spark, sf):
    kg = Graph(spark, sf)
    rules = spark.createDataFrame([("CbG", "Compound", "Gene"), ("CtD", "Compound", "Disease"), ("CpD", "Compound", "Gene"), ("GiG", "Gene", None)], "r string, domain string, range string")
    e = w.tri_state(kg.edges(), kg.nodes().where("id % 7 <> 0"), rules)
    return e.groupBy("r").agg(F.count_if("consistent").alias("yes"), F.count_if(~F.col("consistent")).alias("no"), F.count_if(F.col("consistent").isNull()).alias("unknown"))


@query("prj09_debug_flags", f"WITH {FEATURES} SELECT split, sum((direct > 0)::INT)::BIGINT AS direct, sum((shared > 0 OR bridges > 0 OR (cand_genes > 0 AND row_index % 2 = 0))::INT)::BIGINT AS evidence, sum((degree > 8)::INT)::BIGINT AS contra FROM soft GROUP BY split")
def _(spark, sf):
    s = soft_ranked(Graph(spark, sf)).withColumn("aligned", F.when(F.col("row_index") % 2 == 0, F.col("cand_genes") > 0)).withColumn("contra_flag", F.when(F.col("degree") > 8, F.lit(True)))
    return s.groupBy("split").agg(F.count_if(w.any_positive(F.col("direct"))).alias("direct"), F.count_if(w.any_positive(F.col("shared"), F.col("bridges"), F.col("aligned"))).alias("evidence"), F.count_if(w.any_positive(F.col("contra_flag"))).alias("contra"))


@query("prj11_stage_payload", f"WITH {FEATURES}{subgraph_sql()[len(SQL):]}, s1 AS (SELECT split, row_index, sum(score)::DOUBLE AS raw, sum(support) AS soft FROM soft GROUP BY ALL), s2 AS (SELECT split, row_index, count(*)::DOUBLE AS retrieval FROM sub GROUP BY ALL) SELECT split, row_index, row_name, round(CASE row_name WHEN 'raw' THEN raw WHEN 'soft' THEN soft ELSE retrieval END, 6) AS value FROM s1 JOIN s2 USING (split, row_index), (VALUES ('raw'), ('soft'), ('retrieval')) t(row_name)")
def _(spark, sf):
    """What each stage's rows carry: score sums of the backbone, supports, sizes of the evidence."""
    kg = Graph(spark, sf)
    s = soft_ranked(kg).groupBy(*KEY).agg(F.sum("score").cast("double").alias("raw"), F.sum("support").alias("soft"))
    n = subgraphs(kg).groupBy(*KEY).agg(F.count("*").cast("double").alias("retrieval"))
    return s.join(n, KEY).unpivot(KEY, ["raw", "soft", "retrieval"], "row_name", "value").withColumn("value", R("value"))


@query("prj12_reorder_fields", f"WITH {NAMES} SELECT split, row_index, pos, CASE WHEN cand % 2 = 0 THEN 'Compound' END AS kind, CASE WHEN cand % 2 = 0 THEN (cand % 5 = 0)::INT WHEN split = 'test' THEN 0 END AS contra FROM cw")
def _(spark, sf):
    """Annotations that come in an order of their own, and for some candidates only, in the order of the candidates; what is missing is null in valid, 0 in test."""
    c = named(Graph(spark, sf))
    notes = c.where("cand % 2 = 0").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("name", F.when(F.expr("cand % 5 = 0"), 1).otherwise(0).alias("contra"))), asc=False).alias("n"))
    found = w.zip_lookup(notes.select(*KEY, F.col("n.name").alias("names"), F.col("n.contra").alias("flags")), KEY, "names", "flags")
    j = c.join(found, [*KEY, "name"], "left")
    return j.select(*KEY, "pos", F.when(F.col("value").isNotNull(), "Compound").alias("kind"), F.coalesce("value", F.when(F.col("split") == "test", F.lit(0))).alias("contra"))


@query("prj13_choose_split", f"WITH {SQL} SELECT row_index, query_id, gold_id FROM q WHERE split = 'valid'")
def _(spark, sf):
    return Graph(spark, sf).queries().where("split = 'valid'").select("row_index", "query_id", "gold_id")


@query("prj14_safety_samples", f"WITH {NAMES} SELECT split, row_index, pos, name, CASE WHEN row_index % 2 = 0 THEN (cand % 3 = 0 AND cand % 4 = 0)::INT ELSE (cand % 5 = 0)::INT END AS flag FROM cw")
def _(spark, sf):
    """Samples of either shape: names with a set of contraindicated ones, or with flags of their own."""
    rows = wide(Graph(spark, sf))
    bad = F.transform(F.filter(F.arrays_zip("names", "ids"), lambda x: x["ids"] % 4 == 0), lambda x: F.concat(F.lit(" "), x["names"]))
    own = F.transform("ids", lambda i: (i % 5 == 0).cast("int"))
    flags = F.when(F.col("row_index") % 2 == 0, w.mock_flags(F.col("names"), bad)).otherwise(w.checked(own, F.size("names") != F.size("ids"), "names and flags differ in length"))
    return rows.withColumn("flags", flags).select(*KEY, F.posexplode(F.arrays_zip("names", "flags")).alias("at", "x")).select(*KEY, (F.col("at") + 1).alias("pos"), F.col("x.names").alias("name"), F.col("x.flags").alias("flag"))


@query("jn02_zip_lookup", f"WITH {NAMES} SELECT split, row_index, (cand % 7)::VARCHAR AS name, max_by(cand, pos) AS value FROM cw WHERE pos <= 15 GROUP BY split, row_index, cand % 7")
def _(spark, sf):
    rows = wide(Graph(spark, sf)).select(*KEY, F.transform("ids", lambda i: (i % 7).cast("string")).alias("keys"), F.slice("ids", 1, 15).alias("values"))
    return w.zip_lookup(rows, KEY, "keys", "values")


@query("jn04_pair_key_join", f"WITH {FEATURES}{subgraph_sql()[len(SQL):]}, n AS (SELECT split, row_index, count(*) AS size FROM sub GROUP BY ALL), m AS (SELECT split, query_id, gold_id, min(size) AS size FROM n JOIN q USING (split, row_index) GROUP BY ALL) SELECT q.split, q.row_index, m.size FROM q JOIN m ON m.split = q.split AND m.query_id = q.query_id AND m.gold_id = q.gold_id")
def _(spark, sf):
    """Evidence is copied to the rows of the same query and gold; a row without is an error."""
    kg = Graph(spark, sf)
    sizes = subgraphs(kg).groupBy(*KEY).agg(F.count("*").alias("size")).join(kg.queries(), KEY).groupBy("split", "query_id", "gold_id").agg(F.min("size").alias("size"))
    return w.matched(kg.queries(), sizes, ["split", "query_id", "gold_id"]).select(*KEY, "size")


@query("jn05_row_index_join", f"WITH {FEATURES}{subgraph_sql()[len(SQL):]} SELECT split, row_index, best, size FROM (SELECT split, row_index, min_by(cand, soft_rank) AS best FROM soft GROUP BY ALL) JOIN (SELECT split, row_index, count(*) AS size FROM sub GROUP BY ALL) USING (split, row_index)")
def _(spark, sf):
    kg = Graph(spark, sf)
    best = soft_ranked(kg).where("soft_rank = 1").select(*KEY, F.col("cand").alias("best"))
    return best.join(subgraphs(kg).groupBy(*KEY).agg(F.count("*").alias("size")), KEY)


@query("jn06_case_join", f"WITH {FEATURES}{subgraph_sql()[len(SQL):]}, a AS (SELECT split, row_index, min_by(cand, pos) AS raw_top, min_by(cand, soft_rank) AS soft_top, coalesce(min(pos) FILTER (cand = gold_id), 21) AS raw_rank, coalesce(min(soft_rank) FILTER (cand = gold_id), 21) AS soft_rank FROM soft GROUP BY ALL), b AS (SELECT split, row_index, count(*) AS size FROM sub GROUP BY ALL) SELECT split, row_index, qn.name AS query, gn.name AS gold, raw_top, soft_top, raw_rank, soft_rank, size FROM q JOIN a USING (split, row_index) JOIN b USING (split, row_index) JOIN nodes qn ON qn.id = query_id JOIN nodes gn ON gn.id = gold_id")
def _(spark, sf):
    """One row of every table for each query, side by side."""
    kg = Graph(spark, sf)
    gold = F.col("cand") == F.col("gold_id")
    a = soft_ranked(kg).groupBy(*KEY).agg(F.min_by("cand", "pos").alias("raw_top"), F.min_by("cand", "soft_rank").alias("soft_top"), F.coalesce(F.min(F.when(gold, F.col("pos"))), F.lit(21)).alias("raw_rank"), F.coalesce(F.min(F.when(gold, F.col("soft_rank"))), F.lit(21)).alias("soft_rank"))
    n = kg.nodes().select("id", "name")
    j = kg.queries().join(a, KEY).join(subgraphs(kg).groupBy(*KEY).agg(F.count("*").alias("size")), KEY)
    return j.join(n.select(F.col("id").alias("query_id"), F.col("name").alias("query")), "query_id").join(n.select(F.col("id").alias("gold_id"), F.col("name").alias("gold")), "gold_id").select(*KEY, "query", "gold", "raw_top", "soft_top", "raw_rank", "soft_rank", "size")


@query("jn13_shared_genes", f"WITH {FEATURES} SELECT a AS cand, b AS query_id, shared FROM sh")
def _(spark, sf):
    kg = Graph(spark, sf)
    pairs = kg.candidates().select(F.col("cand").alias("a"), F.col("query_id").alias("b")).distinct()
    return g.shared(*gene_sets(kg, pairs=pairs), pairs).select(F.col("a").alias("cand"), F.col("b").alias("query_id"), "shared")


@query("jn14_gene_bridges", f"WITH {FEATURES} SELECT a AS cand, b AS query_id, bridges FROM br")
def _(spark, sf):
    kg = Graph(spark, sf)
    pairs = kg.candidates().select(F.col("cand").alias("a"), F.col("query_id").alias("b")).distinct()
    cg, dg = gene_sets(kg, pairs=pairs)
    return g.bridges(cg.where(F.col("place") <= BRIDGE_GENES), dg, kg.gene_gene(), pairs, BRIDGE_CAP).select(F.col("a").alias("cand"), F.col("b").alias("query_id"), "bridges")


@query("jn17_touch_join", f"WITH {subgraph_sql()}{TF} SELECT split, row_index, idx, cand, pos FROM tch")
def _(spark, sf):
    return scored(Graph(spark, sf))[1].select(*KEY, "idx", "cand", "pos")


@query("topk04_best_triple", f"WITH {subgraph_sql()}{TF}, b AS (SELECT c.split, c.row_index, c.cand, c.idx, row_number() OVER (PARTITION BY c.split, c.row_index, c.cand ORDER BY score DESC, c.idx) AS n FROM tch c JOIN ts s ON s.split = c.split AND s.row_index = c.row_index AND s.idx = c.idx) SELECT split, row_index, cand, idx FROM b WHERE n = 1")
def _(spark, sf):
    f, t = scored(Graph(spark, sf))
    best = t.join(f.select(*KEY, "idx", r.score_linear().alias("score")), [*KEY, "idx"])
    return best.groupBy(*KEY, "cand").agg(F.min_by("idx", F.struct((-F.col("score")).alias("s"), "idx")).alias("idx"))


@query("jn20_row_alignment", f"WITH {SQL}, a AS (SELECT * FROM q WHERE row_index % 11 <> 3), b AS (SELECT split, row_index, query_id, CASE WHEN row_index % 13 = 5 THEN -1 ELSE gold_id END AS gold_id FROM q WHERE row_index % 17 <> 4) SELECT coalesce(a.split, b.split) AS split, coalesce(a.row_index, b.row_index) AS row_index, a.gold_id AS a_gold_id, b.gold_id AS b_gold_id FROM a FULL JOIN b ON a.split = b.split AND a.row_index = b.row_index WHERE a.split IS NULL OR b.split IS NULL OR a.gold_id <> b.gold_id")
def _(spark, sf):
    q = Graph(spark, sf).queries()
    other = q.where("row_index % 17 <> 4").withColumn("gold_id", F.when(F.expr("row_index % 13 = 5"), -1).otherwise(F.col("gold_id")))
    return w.mismatches(q.where("row_index % 11 <> 3"), other, KEY, ["query_id", "gold_id"]).select(*KEY, "a_gold_id", "b_gold_id")


@query("jn21_endpoint_kinds", f"WITH {SQL} SELECT r, a.kind AS head_kind, b.kind AS tail_kind, count(*) AS n FROM edges JOIN nodes a ON a.id = h JOIN nodes b ON b.id = t GROUP BY ALL")
def _(spark, sf):
    kg = Graph(spark, sf)
    n = kg.nodes().select("id", "kind")
    return kg.edges().join(n.select(F.col("id").alias("h"), F.col("kind").alias("head_kind")), "h").join(n.select(F.col("id").alias("t"), F.col("kind").alias("tail_kind")), "t").groupBy("r", "head_kind", "tail_kind").agg(F.count("*").alias("n"))


@query("fn24_reorder_lists", f"WITH {WHOLE_FEATURES} SELECT split, row_index, soft_rank AS pos, cand, score, round(support, 6) AS support FROM soft")
def _(spark, sf):
    s = soft_ranked(Graph(spark, sf), whole=True)
    order = s.select(*KEY, "pos", F.col("soft_rank").alias("new_pos"))
    return w.reordered(s.select(*KEY, "pos", "cand", "score", R("support").alias("support")), order, ["cand", "score", "support"])


@query("set05_unique_rules", f"WITH {SQL}, x AS (SELECT h AS id, '_' || r AS rule, 0 AS side FROM edges UNION ALL SELECT t, r, 1 FROM edges), y AS (SELECT DISTINCT id, rule, side FROM x), z AS (SELECT id, ltrim(rule, '_') AS rule, min((side, rule)) AS f FROM y GROUP BY id, ltrim(rule, '_')) SELECT id, string_agg(rule, ' ' ORDER BY f) AS rules FROM z GROUP BY id")
def _(spark, sf):
    """Rules of a node without the mark of the reverse direction, each once, in the order of first appearance."""
    e = Graph(spark, sf).edges()
    x = e.select(F.col("h").alias("id"), F.struct(F.lit(0).alias("side"), F.concat(F.lit("_"), "r").alias("rule")).alias("x")).unionByName(e.select(F.col("t").alias("id"), F.struct(F.lit(1).alias("side"), F.col("r").alias("rule")).alias("x")))
    lists = x.groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return lists.select("id", F.array_join(F.array_distinct(F.transform("x.rule", lambda r: F.ltrim(r, F.lit("_")))), " ").alias("rules"))


@query("gr19_density_hint", f"WITH {subgraph_sql()}{TF} SELECT split, row_index, idx, deg_h + deg_t AS density FROM tf")
def _(spark, sf):
    return scored(Graph(spark, sf))[0].select(*KEY, "idx", (F.col("deg_h") + F.col("deg_t")).alias("density"))


@query("gr29_support_formulas", f"WITH {FEATURES}, x AS (SELECT soft.*, (train.h IS NOT NULL)::INT AS known, (failed.h IS NOT NULL)::INT AS bad FROM soft LEFT JOIN train ON train.h = cand AND train.t = query_id LEFT JOIN failed ON failed.h = cand AND failed.t = query_id) SELECT split, row_index, cand, round((shared > 0)::INT - 0.25 * (direct > 0)::INT - 0.05 * bad, 6) AS light, round((shared > 0)::INT - 0.5 * (direct > 0)::INT - 0.1 * bad, 6) AS heavy, round(least(shared, 2) / 2.0 - 0.5 * (direct > 0)::INT - 0.1 * bad, 6) AS capped, round((shared + bridges > 0)::INT - 0.5 * known, 6) AS by_target, round(evidence - 0.5 * penalty, 6) AS by_penalty FROM x")
def _(spark, sf):
    """Support by each of the formulas: binary evidence with light or heavy penalties, capped evidence, known target pairs, and evidence less the shortcut penalty."""
    kg = Graph(spark, sf)
    flag = lambda df, name: df.select(F.col("h").alias("cand"), F.col("t").alias("query_id"), F.lit(1).alias(name))
    s = soft_ranked(kg).join(flag(kg.train(), "known"), ["cand", "query_id"], "left").join(flag(kg.failed(), "bad"), ["cand", "query_id"], "left").fillna(0, ["known", "bad"])
    one = lambda c: (c > 0).cast("int")
    two = one(F.col("shared"))
    less = lambda a, b: a * one(F.col("direct")) + b * F.col("bad")
    return s.select(*KEY, "cand", R(two - less(0.25, 0.05)).alias("light"), R(two - less(0.5, 0.1)).alias("heavy"), R(F.least("shared", F.lit(2)) / 2.0 - less(0.5, 0.1)).alias("capped"), R(one(F.col("shared") + F.col("bridges")) - 0.5 * F.col("known")).alias("by_target"), R(F.col("evidence") - 0.5 * F.col("penalty")).alias("by_penalty"))


@query("ghost01_type_filter", f"WITH {NAMES}, t AS (SELECT split, row_index, count(*) AS n, count(*) FILTER (kind = 'Compound') AS kept FROM cand JOIN nodes ON id = CASE WHEN row_index % 5 = 0 AND pos > 15 THEN query_id ELSE cand END GROUP BY ALL) SELECT split, sum(n)::BIGINT AS candidates, sum(kept)::BIGINT AS kept, count(*) FILTER (kept < n) AS changed_rows FROM t GROUP BY split")
def _(spark, sf):
    """Candidates of the wrong type go; how many, and of how many rows."""
    kg = Graph(spark, sf)
    c = kg.candidates().withColumn("cand", F.when(F.expr("row_index % 5 = 0 and pos > 15"), F.col("query_id")).otherwise(F.col("cand")))
    right = kg.nodes().where("kind = 'Compound'").select(F.col("id").alias("cand"), F.lit(1).alias("ok"))
    per = c.join(right, "cand", "left").groupBy(*KEY).agg(F.count("*").alias("n"), F.count("ok").alias("kept"))
    return per.groupBy("split").agg(F.sum("n").alias("candidates"), F.sum("kept").alias("kept"), F.count_if(F.expr("kept < n")).alias("changed_rows"))


@query("ghost03_schema_scan", f"WITH {subgraph_sql()}, ru(r, d, g) AS (VALUES ('CbG', 'Compound', 'Gene'), ('CdG', 'Compound', 'Gene'), ('DaG', 'Disease', 'Gene'), ('GiG', 'Gene', 'Gene'), ('CtD', 'Compound', 'Disease')), s AS (SELECT sub.split, sub.row_index, sub.r, h, t, CASE WHEN d IS NULL THEN NULL ELSE a.kind = d AND b.kind = g END AS ok FROM sub LEFT JOIN ru ON ru.r = sub.r JOIN nodes a ON a.id = h JOIN nodes b ON b.id = t), p AS (SELECT x.split, count(*) AS paths, count(*) FILTER (x.ok AND y.ok) AS valid_paths FROM s x JOIN s y ON x.split = y.split AND x.row_index = y.row_index AND x.t = y.t AND x.h % 3 = 0 AND y.h % 3 = 2 GROUP BY x.split) SELECT split, n, valid, unknown, paths, valid_paths FROM (SELECT split, count(*) AS n, count(*) FILTER (ok) AS valid, count(*) FILTER (ok IS NULL) AS unknown FROM s GROUP BY split) LEFT JOIN p USING (split)")
def _(spark, sf):
    """Evidence triples that meet their relation's schema, and compound-gene-disease paths of two such triples."""
    kg = Graph(spark, sf)
    rules = spark.createDataFrame([("CbG", "Compound", "Gene"), ("CdG", "Compound", "Gene"), ("DaG", "Disease", "Gene"), ("GiG", "Gene", "Gene"), ("CtD", "Compound", "Disease")], "r string, domain string, range string")
    s = w.tri_state(subgraphs(kg).select(*KEY, "h", "r", "t"), kg.nodes().select("id", "kind"), rules)
    a = s.where("h % 3 = 0").select(*KEY, "t", F.col("consistent").alias("x"))
    b = s.where("h % 3 = 2").select(*KEY, "t", F.col("consistent").alias("y"))
    p = a.join(b, [*KEY, "t"]).groupBy("split").agg(F.count("*").alias("paths"), F.count_if(F.expr("x and y")).alias("valid_paths"))
    n = s.groupBy("split").agg(F.count("*").alias("n"), F.count_if("consistent").alias("valid"), F.count_if(F.col("consistent").isNull()).alias("unknown"))
    return n.join(p, "split", "left")


@query("ghost06_evidence_alignment", f"WITH {NAMES}{subgraph_sql()[len(SQL):]}, n AS (SELECT q.split, q.query_id, q.gold_id, q.row_index, count(sub.idx) AS size FROM q LEFT JOIN sub ON sub.split = q.split AND sub.row_index = q.row_index GROUP BY ALL) SELECT split, row_index, 'Options for ' || name || ': ' || (SELECT string_agg(name, ', ' ORDER BY pos) FROM cw WHERE cw.split = n.split AND cw.row_index = n.row_index) AS prompt, size FROM n JOIN nodes ON nodes.id = query_id")
def _(spark, sf):
    """Prompts rebuilt from the row's own candidates, the evidence copied by query and gold."""
    kg = Graph(spark, sf)
    size = subgraphs(kg).groupBy(*KEY).agg(F.count("*").alias("size")).join(kg.queries(), KEY).groupBy("split", "query_id", "gold_id").agg(F.max("size").alias("size"))
    rows = w.matched(wide(kg), size, ["split", "query_id", "gold_id"])
    q = kg.nodes().select(F.col("id").alias("query_id"), F.col("name").alias("query_name"))
    return rows.join(q, "query_id").select(*KEY, F.concat(F.lit("Options for "), "query_name", F.lit(": "), F.array_join("names", ", ")).alias("prompt"), "size")
