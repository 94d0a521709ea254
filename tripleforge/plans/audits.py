"""Data-quality audits: leaks, coverage, schema, ids, decisions, triple files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as k
from ..sources.derived import SQL, Graph
from .evidence import subgraph_sql, subgraphs
from .registry import query
from .texts import NAMED, prompts

R = lambda c: F.round(c, 6)
KEY = k.KEY


@query("aud01_exact_leaks", f"WITH {subgraph_sql()}, gl AS (SELECT split, row_index, count(*) AS n FROM sub JOIN q USING (split, row_index, query_id) WHERE h = gold_id AND t = query_id AND r = 'CtD' GROUP BY ALL) SELECT q.split, count(*) AS n_queries, count(gl.n) AS subgraph_leaks, count(*) FILTER ((gold_id, query_id) IN (SELECT (h, t) FROM train)) AS train_leaks FROM q LEFT JOIN gl USING (split, row_index) GROUP BY q.split")
def _(spark, sf):
    kg = Graph(spark, sf)
    q = kg.queries()
    inside = subgraphs(kg).where("r = 'CtD'").select(*KEY, F.col("h").alias("gold_id"), F.col("t").alias("query_id")).distinct().withColumn("leak", F.lit(1))
    train = kg.train().select(F.col("h").alias("gold_id"), F.col("t").alias("query_id"), F.lit(1).alias("known"))
    j = q.join(inside, [*KEY, "gold_id", "query_id"], "left").join(train, ["gold_id", "query_id"], "left")
    return j.groupBy("split").agg(F.count("*").alias("n_queries"), F.count("leak").alias("subgraph_leaks"), F.count("known").alias("train_leaks"))


@query("aud02_leak_checks", f"WITH {SQL}, x AS (SELECT (SELECT count(*) FROM target a JOIN target b ON a.h = b.h AND a.t = b.t WHERE a.split = 'train' AND b.split <> 'train') AS overlap, (SELECT count(*) FROM target WHERE split <> 'train' AND h NOT IN (SELECT cand FROM pop)) AS outside, (SELECT count(*) FROM target WHERE h % 3 <> 0 OR t % 3 <> 2) AS wrong_type) SELECT overlap, outside, wrong_type, concat_ws(',', CASE WHEN overlap > 0 THEN 'overlap' END, CASE WHEN outside > 0 THEN 'outside' END, CASE WHEN wrong_type > 0 THEN 'wrong_type' END) AS failures FROM x")
def _(spark, sf):
    kg = Graph(spark, sf)
    t = kg.target()
    known = kg.popularity().select(F.col("cand").alias("h"), F.lit(1).alias("known"))
    per = t.groupBy("h", "t").agg(F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") != "train").alias("he")).agg(F.coalesce(F.sum(F.col("tr") * F.col("he")), F.lit(0)).alias("overlap"))
    out = t.where("split <> 'train'").join(known, "h", "left").agg(F.count_if(F.col("known").isNull()).alias("outside"))
    kind = t.agg(F.count_if(F.expr("h % 3 <> 0 or t % 3 <> 2")).alias("wrong_type"))
    x = per.crossJoin(out).crossJoin(kind)
    named = [F.when(F.col(c) > 0, c) for c in ("overlap", "outside", "wrong_type")]
    return x.select("overlap", "outside", "wrong_type", F.concat_ws(",", *named).alias("failures"))


@query("aud03_coverage", f"WITH {SQL} SELECT split, count(DISTINCT h) FILTER (h NOT IN (SELECT h FROM train)) AS heads_missing, count(DISTINCT t) FILTER (t NOT IN (SELECT t FROM train)) AS tails_missing FROM target WHERE split <> 'train' GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    held = kg.target().where("split <> 'train'")
    h = kg.train().select("h").distinct().withColumn("kh", F.lit(1))
    t = kg.train().select("t").distinct().withColumn("kt", F.lit(1))
    j = held.join(h, "h", "left").join(t, "t", "left")
    return j.groupBy("split").agg(F.countDistinct(F.when(F.col("kh").isNull(), F.col("h"))).alias("heads_missing"), F.countDistinct(F.when(F.col("kt").isNull(), F.col("t"))).alias("tails_missing"))


PROMPT = "'Options: (' || opts || ') References: ([QUERY], ' || rtrim(repeat('[ENTITY], ', n), ', ') || ') Question: Which compound treats ' || qn || '? Answer:'"


@query("aud04_package_schema", f"WITH {NAMED}{subgraph_sql()[len(SQL):]}, p2 AS (SELECT split, row_index, n, CASE WHEN row_index % 6 = 5 THEN replace({PROMPT}, '[QUERY]', '') ELSE {PROMPT} END AS p FROM pr), t2 AS (SELECT split, row_index, bool_and(h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL) AS ok FROM sub GROUP BY ALL) SELECT p2.split, count(*) AS n, count(*) FILTER (n = 20) AS k_ok, count(*) FILTER ((length(p) - length(replace(p, '[QUERY]', ''))) / 7 = 1) AS one_query, count(*) FILTER ((length(p) - length(replace(p, '[ENTITY]', ''))) / 8 = 20) AS entities_ok, count(*) FILTER (ok) AS triples_ok FROM p2 JOIN t2 ON t2.split = p2.split AND t2.row_index = p2.row_index GROUP BY p2.split")
def _(spark, sf):
    """Rows of 20 candidates, with one query and 20 entity references in their prompt, and whole triples in their evidence."""
    kg = Graph(spark, sf)
    p = prompts(kg).withColumn("prompt", F.when(F.expr("row_index % 6 = 5"), F.replace("prompt", F.lit("[QUERY]"), F.lit(""))).otherwise(F.col("prompt")))
    whole = subgraphs(kg).groupBy(*KEY).agg(F.bool_and(F.expr("size(filter(array(string(h), r, string(t)), x -> x is not null)) = 3")).alias("ok"))
    p = p.join(whole, KEY)
    return p.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.size("names") == 20).alias("k_ok"), F.count_if(F.regexp_count("prompt", F.lit(r"\[QUERY\]")) == 1).alias("one_query"), F.count_if(F.regexp_count("prompt", F.lit(r"\[ENTITY\]")) == 20).alias("entities_ok"), F.count_if("ok").alias("triples_ok"))


@query("aud06_id_ranges", f"WITH {SQL} SELECT r, min(h) AS min_h, max(h) AS max_h, min(t) AS min_t, max(t) AS max_t, count(*) FILTER (h = t) AS loops FROM edges GROUP BY r")
def _(spark, sf):
    return Graph(spark, sf).edges().groupBy("r").agg(F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.count_if(F.expr("h = t")).alias("loops"))


@query("aud09_decision", f"WITH {SQL}, s AS (SELECT count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM target) SELECT n, CASE WHEN n >= 500 AND heads >= 50 AND tails >= 100 THEN 'GO' WHEN n >= 50 THEN 'PARTIAL' ELSE 'NO_GO' END AS decision FROM s")
def _(spark, sf):
    s = Graph(spark, sf).target().agg(F.count("*").alias("n"), F.countDistinct("h").alias("heads"), F.countDistinct("t").alias("tails"))
    return s.select("n", F.when(F.expr("n >= 500 and heads >= 50 and tails >= 100"), "GO").when(F.col("n") >= 50, "PARTIAL").otherwise("NO_GO").alias("decision"))


@query("aud10_triple_inspection", f"WITH {SQL}, c AS (SELECT r, count(*) AS n, (lower(r) LIKE '%g')::INT AS gene FROM edges GROUP BY r) SELECT r, n, gene, row_number() OVER (ORDER BY n DESC, r) AS place FROM c")
def _(spark, sf):
    c = Graph(spark, sf).edges().groupBy("r").agg(F.count("*").alias("n")).withColumn("gene", F.lower("r").endswith("g").cast("int"))
    return k.rank_by(c, F.desc("n"), "r", name="place", key=[F.lit(0)])
