"""Sources and sinks in one round trip each: what is written is read again and must be the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.derived import SQL, Graph
from ..sources.store import scratch
from .registry import query


@query("src03_triple_tsv", f"WITH {SQL} SELECT h::VARCHAR AS head, r AS relation, t::VARCHAR AS tail, 'train' AS split FROM train")
def _(spark, sf):
    path = scratch(spark, "triples")
    files.write_triples(Graph(spark, sf).train().select(F.col("h").cast("string").alias("head"), F.col("r").alias("relation"), F.col("t").cast("string").alias("tail")), path)
    return files.read_triples(spark, path, "train")


@query("src06_id_triples", f"WITH {SQL} SELECT h::INT AS h, 7 AS r, t::INT AS t FROM train")
def _(spark, sf):
    path = scratch(spark, "ids")
    files.write_triples(Graph(spark, sf).train().select("h", F.lit(7).alias("r"), "t"), path, ("h", "r", "t"))
    return files.read_id_triples(spark, path)


@query("src07_encode", f"WITH {SQL} SELECT r.rid AS r, count(*) AS n FROM edges JOIN (SELECT r, row_number() OVER (ORDER BY r) - 1 AS rid FROM (SELECT DISTINCT r FROM edges)) r USING (r) GROUP BY r.rid")
def _(spark, sf):
    from pyspark.sql import Window

    kg = Graph(spark, sf)
    e = kg.edges()
    rel = e.select(F.col("r").alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")) - 1)
    good, _bad = files.encode(e.select(F.col("h").alias("head"), F.col("r").alias("relation"), F.col("t").alias("tail")), kg.nodes().select(F.col("id").alias("name"), "id"), rel)
    return good.groupBy("r").agg(F.count("*").alias("n"))


@query("src08_node_table", f"WITH {SQL} SELECT kind || '::' || id AS node_id, name, kind FROM nodes WHERE name IS NOT NULL")
def _(spark, sf):
    path = scratch(spark, "nodes")
    n = Graph(spark, sf).nodes().select(F.concat("kind", F.lit("::"), F.col("id").cast("string")).alias("id"), "name")
    files.write_table(n, path, ["id", "name"])
    return files.read_nodes(spark, path)


@query("src01_json_rows", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders")
def _(spark, sf):
    path = scratch(spark, "rows")
    files.write_rows(Graph(spark, sf).table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), path)
    return spark.read.schema("k long, s string").json(path)


@query("snk08_package", f"WITH {SQL} SELECT split, count(*) AS n FROM target GROUP BY split")
def _(spark, sf):
    path = scratch(spark, "package")
    files.write_package(Graph(spark, sf).target(), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("snk05_upsert", "SELECT n_name AS model_name, CASE WHEN n_nationkey % 2 = 0 THEN -1.0 ELSE n_nationkey END::DOUBLE AS mrr FROM nation")
def _(spark, sf):
    old = Graph(spark, sf).table("nation").select(F.col("n_name").alias("model_name"), F.col("n_nationkey").cast("double").alias("mrr"), F.col("n_nationkey").alias("k"))
    new = old.where("k % 2 = 0").select("model_name", F.lit(-1.0).alias("mrr"))
    return files.upsert(old.select("model_name", "mrr"), new, "model_name")


@query("snk06_markdown", "SELECT 0 AS n, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 2, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def _(spark, sf):
    return files.markdown(Graph(spark, sf).table("region"))


@query("snk06_latex", r"SELECT 0 AS n, '\begin{tabular}{ll}' AS line UNION ALL SELECT 1, '\toprule' UNION ALL SELECT 2, 'r\_regionkey & r\_name \\' UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey), r_regionkey || ' & ' || r_name || '\% \\' FROM region UNION ALL SELECT 2147483646, '\bottomrule' UNION ALL SELECT 2147483647, '\end{tabular}'")
def _(spark, sf):
    return files.latex(Graph(spark, sf).table("region").select("r_regionkey", F.concat("r_name", F.lit("%")).alias("r_name")), ["r_regionkey"])


@query("snk06_case_report", "SELECT n_nationkey * 3 + i AS n, CASE i WHEN 0 THEN '## ' || n_name WHEN 1 THEN '- region: ' || n_regionkey ELSE '- note: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'n/a' END END AS line FROM nation, range(3) t(i)")
def _(spark, sf):
    n = Graph(spark, sf).table("nation")
    return files.case_report(n.select(F.col("n_nationkey").alias("n"), "n_name", F.col("n_regionkey").alias("region"), F.when(F.expr("n_nationkey % 2 = 0"), "even").alias("note")), "n_name", ["region", "note"])
