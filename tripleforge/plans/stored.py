"""Files of a knowledge-graph package: what is written is read again and must be the same; audits of rows, tables and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as k
from ..operators import rows as w
from ..sources import files
from ..sources.derived import SQL, Graph
from ..sources.store import scratch
from .evidence import subgraph_sql, subgraphs
from .metrics import METRICS_SQL, RANKS_SQL, both_ranks
from .features import FEATURES
from .registry import query
from .rows import NAMES, ranks, wide
from .texts import NAMED, prompts

R = lambda c: F.round(c, 6)
KEY = k.KEY


def text_file(df, path: str) -> str:
    df.write.mode("overwrite").text(path)
    return path


@query("src01_json_array", "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders")
def _(spark, sf):
    path = scratch(spark, "array")
    files.write_array(Graph(spark, sf).table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p")), path, ["k"])
    return files.read_lines(spark, path, "k long, s string, p double")


@query("src02_wrapped_rows", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    """Rows of a bare array, and of an object that holds them under a usual name; both are written and read by lines."""
    kg = Graph(spark, sf)
    bare, wrapped = scratch(spark, "bare"), scratch(spark, "wrapped")
    files.write_array(kg.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), bare, ["k"])
    files.write_array(kg.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name")), wrapped, ["k"], "results")
    return files.read_lines(spark, bare, "k long, name string").unionByName(files.read_lines(spark, wrapped, "k long, name string"))


@query("src04_sif_edges", f"WITH {SQL} SELECT h::VARCHAR AS head, r AS relation, t::VARCHAR AS tail FROM aux")
def _(spark, sf):
    """A gzipped edge file with a header, short rows and further fields."""
    e = Graph(spark, sf).auxiliary()
    lines = e.select(F.concat_ws("\t", F.concat(F.col("h").cast("string"), F.lit(" ")), "r", F.col("t").cast("string"), F.when(F.expr("h % 2 = 0"), F.lit("more"))).alias("value"))
    odd = spark.createDataFrame([("source\tmetaedge\ttarget",), ("a\tb",), ("",), ("a\t \tc",)], "value string")
    path = scratch(spark, "sif")
    odd.unionByName(lines).write.mode("overwrite").option("compression", "gzip").text(path)
    return files.read_edges(spark, path)


@query("src05_tsv_edges", f"WITH {SQL} SELECT h::VARCHAR AS head, r AS relation, t::VARCHAR AS tail FROM train WHERE h % 5 <> 0")
def _(spark, sf):
    e = Graph(spark, sf).train()
    path = scratch(spark, "tsv")
    lines = e.select(F.concat_ws("\t", F.concat(F.lit(" "), F.col("h").cast("string")), F.when(F.expr("h % 5 = 0"), F.lit(" ")).otherwise(F.col("r")), F.col("t").cast("string")).alias("value"))
    text_file(spark.createDataFrame([("head\trelation\ttail",)], "value string").unionByName(lines), path)
    return files.read_triples(spark, path)


TYPES_SQL = "SELECT '{p}' AS policy, s_suppkey AS k, {e} AS type FROM supplier"


@query("src09_type_maps", " UNION ALL ".join(TYPES_SQL.format(p=p, e=e) for p, e in (("best", "CASE WHEN s_suppkey % 2 = 0 THEN 'F' || s_nationkey WHEN s_suppkey % 3 = 0 THEN 'T' || s_nationkey ELSE 'Unknown' END"), ("second", "'R' || s_nationkey"), ("final", "CASE WHEN s_suppkey % 2 = 0 THEN 'F' || s_nationkey ELSE 'Unknown' END"))))
def _(spark, sf):
    """One type map read by each of the three policies."""
    s, n = Graph(spark, sf).table("supplier"), F.col("s_nationkey").cast("string")
    path = scratch(spark, "types")
    t = s.select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("R"), n).alias("other"), F.when(F.expr("s_suppkey % 3 = 0"), F.concat(F.lit("T"), n)).alias("type"), F.when(F.expr("s_suppkey % 2 = 0"), F.concat(F.lit("F"), n)).alias("final_type"))
    files.write_table(t, path, t.columns)
    out = None
    for policy in ("best", "second", "final"):
        m = files.read_type_map(spark, path, policy).select(F.lit(policy).alias("policy"), F.col("entity").cast("long").alias("k"), "type")
        out = m if out is None else out.unionByName(m)
    return out


@query("src10_id_maps", "SELECT c_name AS key, c_custkey AS value FROM customer")
def _(spark, sf):
    """A JSON object of names and ids, by lines; ids are numbers again."""
    path = scratch(spark, "map")
    files.write_json_map(Graph(spark, sf).table("customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value")), path)
    return files.read_map_lines(spark, path).select("key", F.col("value").cast("long").alias("value"))


@query("src11_relation_dictionary", f"WITH {SQL}, d AS (SELECT r AS name, row_number() OVER (ORDER BY r) - 1 AS id FROM (SELECT DISTINCT r FROM edges)) SELECT id, name FROM d")
def _(spark, sf):
    from pyspark.sql import Window

    path = scratch(spark, "relations")
    d = Graph(spark, sf).edges().select(F.col("r").alias("key")).distinct().withColumn("value", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))
    files.write_map(d, path)
    return files.inverted(spark.read.parquet(path).select(F.col("key").alias("name"), F.col("value").alias("id")))


@query("src12_candidate_universe", f"WITH {SQL} SELECT name, cand AS id FROM pop JOIN nodes ON id = cand UNION ALL SELECT name, id FROM nodes WHERE kind = 'Gene'")
def _(spark, sf):
    """Names and ids of the candidates and of all genes, each as an object of two lists, by lines."""
    kg, out = Graph(spark, sf), None
    nodes = kg.nodes().select("name", "id", "kind")
    for u in (nodes.join(kg.popularity().select(F.col("cand").alias("id")), "id", "left_semi"), nodes.where("kind = 'Gene'")):
        path = scratch(spark, "universe")
        files.write_universe(u.select("name", "id"), path)
        one = files.read_universe_lines(spark, path)
        out = one if out is None else out.unionByName(one)
    return out


@query("src13_delimiters", "SELECT 'comma' AS file, ',' AS sep, count(*) AS n_lines FROM customer UNION ALL SELECT 'bar', '|', count(*) FROM supplier UNION ALL SELECT 'tab', chr(9), count(*) FROM part UNION ALL SELECT 'none', chr(9), count(*) FROM nation")
def _(spark, sf):
    """Tables written with one delimiter and another, found from the first line of each file."""
    kg, folder = Graph(spark, sf), scratch(spark, "delimited")
    lines = {"comma": ("customer", F.concat_ws(",", "c_custkey", F.lit("x;y"), "c_nationkey")), "bar": ("supplier", F.concat_ws("|", "s_suppkey", "s_name", F.lit("a,b"))), "tab": ("part", F.concat_ws("\t", "p_partkey", F.lit("a,b,c,d"))), "none": ("nation", F.col("n_nationkey").cast("string"))}
    for name, (table, line) in lines.items():
        kg.table(table).select(line.alias("value")).coalesce(1).write.text(f"{folder}/{name}")
    found = files.sniffed(spark, folder)
    return found.select(F.element_at(F.split("file", "/"), -2).alias("file"), "sep", "n_lines")


@query("src14_sniffed_table", "SELECT r_regionkey::VARCHAR AS k, r_name AS name, '' AS empty FROM region UNION ALL SELECT n_nationkey::VARCHAR, n_name, '' FROM nation")
def _(spark, sf):
    kg, out = Graph(spark, sf), None
    for (t, p), sep in zip((("region", "r"), ("nation", "n")), ("\t", ","), strict=True):
        path = scratch(spark, t)
        files.write_table(kg.table(t).select(F.col(f"{p}_{t}key").alias("k"), F.col(f"{p}_name").alias("name"), F.lit(None).cast("string").alias("empty")), path, ["k", "name", "empty"], sep)
        df = files.read_table(spark, path)
        out = df if out is None else out.unionByName(df)
    return out


@query("src15_table_sample", "SELECT n_nationkey AS k, n_name AS name, 'k,name' AS fields, (SELECT count(*) FROM nation) AS n_rows FROM nation ORDER BY n_nationkey LIMIT 5")
def _(spark, sf):
    n = Graph(spark, sf).table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return files.sample_table(n, 5, ["k"])


@query("src16_free_edges", f"WITH {SQL} SELECT h::VARCHAR AS head, CASE WHEN h % 2 = 0 THEN 'treats_x' ELSE 'binds' END AS relation, t::VARCHAR AS tail FROM aux WHERE h % 5 <> 0")
def _(spark, sf):
    """Lines whose relation stands in any column, by tabs or commas; lines without a known one are left out."""
    e = Graph(spark, sf).auxiliary()
    rel = F.when(F.expr("h % 5 = 0"), "unknown").when(F.expr("h % 2 = 0"), "Treats-X").otherwise(" binds")
    h, t, n = F.col("h").cast("string"), F.col("t").cast("string"), (F.col("h") / 3).cast("long") % 4
    line = F.when(n == 0, F.concat_ws("\t", h, rel, t)).when(n == 1, F.concat_ws(",", h, t, rel)).when(n == 2, F.concat_ws("\t", rel, h, t)).otherwise(F.concat_ws(",", h, rel, t, F.lit("x")))
    path = text_file(e.select(line.alias("value")), scratch(spark, "free"))
    return files.read_free_edges(spark, path, ["treats_x", "binds"])


@query("src17_best_file", "SELECT p AS folder, n AS score, length FROM (SELECT regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS p, sum(strlen(o_orderkey::VARCHAR) + 1)::BIGINT AS length FROM orders GROUP BY 1), LATERAL (SELECT 10 * contains(p, 'medium')::INT + 10 * contains(p, 'low')::INT + 5 * contains(p, 'urgent')::INT AS n) ORDER BY n DESC, length DESC, p LIMIT 1")
def _(spark, sf):
    """Of the files below a folder, orders by priority, the one that its name and then its size speak for."""
    base, o = scratch(spark, "files"), Graph(spark, sf).table("orders")
    named = o.select(F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_").alias("of"), F.col("o_orderkey").cast("string").alias("value"))
    named.repartition("of").write.partitionBy("of").text(base)
    best = files.best_file(spark, base, {"medium": 10, "low": 10, "urgent": 5})
    return best.select(F.regexp_extract("path", "/of=([^/]+)/", 1).alias("folder"), "score", "length")


@query("src21_manifest", "SELECT t, n AS lines, size, 'txt' AS suffix FROM (SELECT 'nation' AS t, count(*) AS n, sum(strlen(n_name) + 1)::BIGINT AS size FROM nation UNION ALL SELECT 'region', count(*), sum(strlen(r_name) + 1)::BIGINT FROM region)")
def _(spark, sf):
    base, kg = scratch(spark, "manifest"), Graph(spark, sf)
    text_file(kg.table("nation").select("n_name").coalesce(1), f"{base}/nation")
    text_file(kg.table("region").select("r_name").coalesce(1), f"{base}/region")
    m = files.manifest(spark, base).where("suffix = 'txt' and size > 0")
    return m.select(F.element_at(F.split("path", "/"), -2).alias("t"), "lines", "size", "suffix")


@query("src22_vectors", "SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def _(spark, sf):
    """Vectors as (id, vec) Parquet; one of another length is an error."""
    path = scratch(spark, "vectors")
    Graph(spark, sf).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).write.parquet(path)
    v = spark.read.parquet(path)
    vec = w.checked(F.col("vec"), F.size("vec") != 64, "a vector has another length")
    return v.select("id", F.size(vec).alias("dim"), F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("src23_data_module", f"WITH {SQL} SELECT split, count(*) AS n, count(DISTINCT h) AS heads FROM target GROUP BY split")
def _(spark, sf):
    """The three splits, each read from its own JSON rows."""
    base, t = scratch(spark, "module"), Graph(spark, sf).target()
    out = None
    for split in ("train", "valid", "test"):
        files.write_rows(t.where(F.col("split") == split).select("h", "r", "t"), f"{base}/{split}")
        df = spark.read.schema("h long, r string, t long").json(f"{base}/{split}").withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("h").alias("heads"))


CONFIGS = "SELECT c_mktsegment AS variant_name, unnest(['customers', 'first_nation', 'last_nation']) AS name, unnest([count(*)::VARCHAR, min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR]) AS value FROM customer GROUP BY c_mktsegment"


def configs(kg: Graph):
    """Settings of every market segment, written as a folder of JSON configurations, one a file, and read again."""
    base = scratch(kg.spark, "configs")
    c = kg.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_nationkey").alias("a"), F.max("c_nationkey").alias("b"))
    params = F.create_map(*[x for name, v in (("customers", "n"), ("first_nation", "a"), ("last_nation", "b")) for x in (F.lit(name), F.col(v).cast("string"))])
    text = F.to_json(F.struct(F.col("c_mktsegment").alias("variant_name"), params.alias("params")))
    c.select(F.col("c_mktsegment").alias("of"), text.alias("value")).write.partitionBy("of").text(base)
    return files.read_config(kg.spark, f"{base}/*")


@query("src24_configs", CONFIGS)
def _(spark, sf):
    return configs(Graph(spark, sf))


@query("src25_selected_config", f"SELECT * FROM ({CONFIGS}) WHERE variant_name = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def _(spark, sf):
    """The configuration that a manifest names: of the segment of most customers."""
    kg = Graph(spark, sf)
    most = kg.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(1).select(F.col("c_mktsegment").alias("selected"))
    return files.selected_config(most, configs(kg))


@query("src27_adjacency", f"WITH {SQL} SELECT node, count(*) AS edges, count(DISTINCT neighbour) AS neighbours FROM (SELECT h AS node, t AS neighbour FROM edges UNION ALL SELECT t, h FROM edges WHERE h <> t) GROUP BY node")
def _(spark, sf):
    a = files.adjacency(Graph(spark, sf).edges())
    return a.groupBy("node").agg(F.count("*").alias("edges"), F.countDistinct("neighbour").alias("neighbours"))


@query("snk02_named_triples", f"WITH {SQL} SELECT a.name AS head, r AS relation, b.name AS tail FROM train JOIN nodes a ON a.id = h JOIN nodes b ON b.id = t")
def _(spark, sf):
    kg, path = Graph(spark, sf), scratch(spark, "named")
    n = kg.nodes().select("id", "name")
    t = kg.train().join(n.select(F.col("id").alias("h"), F.col("name").alias("head")), "h").join(n.select(F.col("id").alias("t"), F.col("name").alias("tail")), "t")
    files.write_triples(t.withColumnRenamed("r", "relation"), path)
    return files.read_triples(spark, path)


@query("snk03_table", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(spark, sf):
    path = scratch(spark, "table")
    files.write_table(Graph(spark, sf).table("supplier"), path, ["s_suppkey", "s_name"], ",")
    return files.read_table(spark, path)


@query("snk04_maps", "SELECT p_partkey AS key, p_brand AS value FROM part")
def _(spark, sf):
    path = scratch(spark, "maps")
    files.write_map(Graph(spark, sf).table("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), path)
    return spark.read.parquet(path)


@query("snk07_side_files", "SELECT 'regions' AS file, r_name AS value FROM region UNION ALL SELECT 'nations', n_name FROM nation")
def _(spark, sf):
    """Files that go from one package to the next as they are; those that are not there are left out."""
    a, b, kg = scratch(spark, "package"), scratch(spark, "next"), Graph(spark, sf)
    text_file(kg.table("region").select("r_name"), f"{a}/regions")
    text_file(kg.table("nation").select("n_name"), f"{a}/nations")
    found = files.copy_files(spark, a, b, ["regions", "nations", "missing"])
    out = None
    for n in found:
        df = spark.read.text(f"{b}/{n}").select(F.lit(n).alias("file"), "value")
        out = df if out is None else out.unionByName(df)
    return out


@query("snk09_predictions", f"WITH {NAMES} SELECT split, row_index, rank, (SELECT count(*) FROM g0) AS n, 'n: ' || (SELECT count(*) FROM g0) AS line FROM g0")
def _(spark, sf):
    path, r = scratch(spark, "predictions"), ranks(Graph(spark, sf)).select(*KEY, "rank")
    files.write_predictions(r, r.agg(F.count("*").alias("n"), R(F.avg("rank")).alias("avg_rank")), path)
    m = spark.read.schema("n long").json(f"{path}/metrics")
    line = spark.read.text(f"{path}/metrics_text").where("value like 'n:%'").select(F.col("value").alias("line"))
    return spark.read.schema("split string, row_index long, rank int").json(f"{path}/predictions").crossJoin(m).crossJoin(line)


@query("snk11_dimension_tables", f"WITH {SQL}, r AS (SELECT DISTINCT r FROM edges) SELECT 'lexicon' AS t, r AS key, 'What is related to {{}} by ' || r || '?' AS value FROM r UNION ALL SELECT 'schema', r, a.kind || '>' || b.kind FROM (SELECT r, min(h) AS h, min(t) AS t FROM edges GROUP BY r) JOIN nodes a ON a.id = h JOIN nodes b ON b.id = t UNION ALL SELECT 'rules', r, r || ' _' || r FROM r")
def _(spark, sf):
    """Lexicon, schema and rules of a package's relations, as its small tables."""
    kg, base = Graph(spark, sf), scratch(spark, "dimensions")
    e = kg.edges().groupBy("r").agg(F.min("h").alias("h"), F.min("t").alias("t"))
    n = kg.nodes().select("id", "kind")
    e = e.join(n.select(F.col("id").alias("h"), F.col("kind").alias("hk")), "h").join(n.select(F.col("id").alias("t"), F.col("kind").alias("tk")), "t")
    rows = e.select(F.col("r").alias("key"), F.concat(F.lit("What is related to {} by "), "r", F.lit("?")).alias("lexicon"), F.concat("hk", F.lit(">"), "tk").alias("schema"), F.concat("r", F.lit(" _"), "r").alias("rules"))
    out = None
    for t in ("lexicon", "schema", "rules"):
        files.write_map(rows.select("key", F.col(t).alias("value")), f"{base}/{t}")
        df = spark.read.parquet(f"{base}/{t}").select(F.lit(t).alias("t"), "key", "value")
        out = df if out is None else out.unionByName(df)
    return out


@query("aud05_row_summary", f"WITH {NAMED} SELECT split, count(*) AS n, count(*) FILTER (row_index % 7 = 3) AS missing_gold, min(n) AS min_candidates, max(n) AS max_candidates, count(*) FILTER (row_index % 5 = 2) AS without_question FROM pr GROUP BY split")
def _(spark, sf):
    """Rows that lack a required field, or a question in their prompt, and the lengths of candidate lists."""
    p = prompts(Graph(spark, sf))
    p = p.withColumn("gold", F.when(F.expr("row_index % 7 <> 3"), F.col("gold"))).withColumn("prompt", F.when(F.expr("row_index % 5 = 2"), F.replace("prompt", F.lit("Question:"), F.lit(""))).otherwise(F.col("prompt")))
    return p.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.coalesce("gold", F.lit("")) == "").alias("missing_gold"), F.min(F.size("names")).cast("long").alias("min_candidates"), F.max(F.size("names")).cast("long").alias("max_candidates"), F.count_if(~F.contains("prompt", F.lit("Question:"))).alias("without_question"))


@query("aud06_row_validation", f"WITH {NAMES}{subgraph_sql()[len(SQL):]}, v AS (SELECT split, row_index, count(*) FILTER (cand < 0 OR cand > (SELECT max(id) FROM nodes)) AS bad_ids FROM cand GROUP BY ALL), x AS (SELECT split, row_index, count(*) FILTER (r NOT IN ('CbG', 'CdG', 'CuG', 'DaG', 'DdG', 'GiG', 'CpD')) AS bad_relations FROM sub GROUP BY ALL) SELECT g0.split, count(*) AS n, sum(bad_ids)::BIGINT AS bad_ids, count(*) FILTER (CASE WHEN g0.row_index % 9 = 4 THEN 1 ELSE rank END <> rank) AS bad_ranks, sum(bad_relations)::BIGINT AS bad_relations FROM g0 JOIN v ON v.split = g0.split AND v.row_index = g0.row_index JOIN x ON x.split = g0.split AND x.row_index = g0.row_index GROUP BY g0.split")
def _(spark, sf):
    """Ids within the entities, stored ranks that agree with the candidate lists, relations that the graph has."""
    kg = Graph(spark, sf)
    top = kg.nodes().agg(F.max("id").alias("top"))
    ids = kg.candidates().crossJoin(top).groupBy(*KEY).agg(F.count_if(F.expr("cand < 0 or cand > top")).alias("bad_ids"))
    known = ["CbG", "CdG", "CuG", "DaG", "DdG", "GiG", "CpD"]
    rel = subgraphs(kg).groupBy(*KEY).agg(F.count_if(~F.col("r").isin(known)).alias("bad_relations"))
    stored = wide(kg).withColumn("stored", F.when(F.expr("row_index % 9 = 4"), 1).otherwise(F.col("rank")))
    at = F.array_position("ids", F.col("gold_id"))
    listed = F.when(at > 0, at).otherwise(21)
    j = stored.withColumn("bad", F.col("stored") != listed).join(ids, KEY).join(rel, KEY)
    return j.groupBy("split").agg(F.count("*").alias("n"), F.sum("bad_ids").alias("bad_ids"), F.count_if("bad").alias("bad_ranks"), F.sum("bad_relations").alias("bad_relations"))


@query("aud07_table_validation", f"WITH {FEATURES}, {RANKS_SQL}, m AS ({METRICS_SQL.format(by='row_name, split', source='gr')}) SELECT row_name, split, CASE WHEN row_name = 'soft' THEN 'hits_3' ELSE '' END AS missing, mrr BETWEEN 0 AND 1 AND hits_1 <= hits_3 AND hits_3 <= hits_10 AND mrr <= gold_at_20 AS consistent FROM m")
def _(spark, sf):
    """Required metrics that a table's rows lack, and whether those that are there can be true together."""
    m = k.ranking_metrics(both_ranks(Graph(spark, sf)), ("row_name", "split"))
    shown = m.withColumn("shown", F.when(F.col("row_name") == "soft", F.lit(None).cast("double")).otherwise(F.col("hits_3")))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(n)) for n, c in (("mrr", "mrr"), ("hits_1", "hits_1"), ("hits_3", "shown"), ("hits_10", "hits_10"))])
    fine = F.expr("mrr between 0 and 1 and hits_1 <= hits_3 and hits_3 <= hits_10 and mrr <= gold_at_20 + 1e-12")
    return shown.select("row_name", "split", missing.alias("missing"), fine.alias("consistent"))


@query("aud08_artifacts", "SELECT s AS run, a AS artifact, coalesce(there, false) AS there, last FROM (SELECT * FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT o_orderpriority AS a FROM orders)) LEFT JOIN (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS a, true AS there FROM orders WHERE o_totalprice > 290000) USING (s, a) LEFT JOIN (SELECT o_orderstatus AS s, strftime(max(o_orderdate), '%Y') AS last FROM orders WHERE o_totalprice > 290000 GROUP BY 1) USING (s)")
def _(spark, sf):
    """Which expected files the runs have left, and the last checkpoint of each: large orders by status, priority and year stand for what a run writes."""
    base, kg = scratch(spark, "runs"), Graph(spark, sf)
    o = kg.table("orders")
    left = o.where("o_totalprice > 290000").select(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("artifact"), F.date_format("o_orderdate", "yyyy").alias("step"), F.col("o_orderkey").cast("string").alias("value"))
    left.repartition("run", "artifact").write.partitionBy("run", "artifact", "step").text(base)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.url_decode("path").alias("path")).where("path like '%.txt'")
    f = f.select(*[F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("run", "artifact", "step")])
    want = w.run_matrix(o.select(F.col("o_orderstatus").alias("run")), o.select(F.col("o_orderpriority").alias("artifact")))
    there = f.select("run", "artifact", F.lit(True).alias("there")).distinct()
    return want.join(there, ["run", "artifact"], "left").join(f.groupBy("run").agg(F.max("step").alias("last")), "run", "left").select("run", "artifact", F.coalesce("there", F.lit(False)).alias("there"), "last")


@query("orc01_run_matrix", "WITH runs AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS variant FROM customer), (SELECT DISTINCT o_orderpriority AS split FROM orders), (SELECT DISTINCT o_orderstatus AS config FROM orders)), done AS (SELECT DISTINCT c_mktsegment AS variant, o_orderpriority AS split, o_orderstatus AS config FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000) SELECT variant || '/' || split || '/' || config AS run, CASE WHEN d.variant IS NULL THEN 'run' ELSE 'done' END AS state FROM runs LEFT JOIN done d USING (variant, split, config)")
def _(spark, sf):
    """Every run of variants, splits and settings that the tables name, and whether its result is there already: a large order of that kind."""
    kg = Graph(spark, sf)
    c, o = kg.table("customer").select("c_custkey", F.col("c_mktsegment").alias("variant")), kg.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("config"), "o_totalprice")
    runs = w.run_matrix(c.select("variant"), o.select("split"), o.select("config"))
    done = o.where("o_totalprice > 200000").join(c, "c_custkey").select("variant", "split", "config").distinct().withColumn("state", F.lit("done"))
    return runs.join(done, ["variant", "split", "config"], "left").select(F.concat_ws("/", "variant", "split", "config").alias("run"), F.coalesce("state", F.lit("run")).alias("state"))


@query("orc02_decoding_configs", "SELECT 'b' || beams || '_p' || (penalty * 100)::INT || '_t' || tokens AS config, beams, penalty, tokens FROM (SELECT DISTINCT l_linenumber AS beams FROM lineitem), (SELECT DISTINCT 1 + l_tax AS penalty FROM lineitem), (SELECT DISTINCT 16 * (1 + n_regionkey) AS tokens FROM nation)")
def _(spark, sf):
    """A decoding configuration for every combination of the beams, penalties and lengths that the tables name."""
    kg = Graph(spark, sf)
    line = kg.table("lineitem")
    a = w.run_matrix(line.select(F.col("l_linenumber").alias("beams")), line.select((1 + F.col("l_tax")).alias("penalty")), kg.table("nation").select((16 * (1 + F.col("n_regionkey"))).alias("tokens")))
    return a.select(F.concat(F.lit("b"), "beams", F.lit("_p"), F.round(F.col("penalty") * 100).cast("int"), F.lit("_t"), "tokens").alias("config"), "beams", "penalty", "tokens")
