"""Evidence subgraphs start from lines at queries and candidates, and the first stages meet in one place."""

import duckdb
import pytest

from tripleforge.operators import graph as g
from tripleforge.operators import ranking as k
from tripleforge.operators import retrieval as r
from tripleforge.plans import evidence, registry
from tripleforge.sources import store
from tripleforge.sources.derived import Graph

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "part", "customer", "orders", "lineitem")


@pytest.fixture
def odd(tmp_path):
    """sf0.001 with lines whose order is missing, nulls in keys and flags."""
    con = duckdb.connect()
    changes = {"orders": "replace (if(o_orderkey % 13 = 0, null, o_custkey) as o_custkey, if(o_orderkey % 17 = 0, null, o_orderpriority) as o_orderpriority)", "lineitem": "replace (if(l_partkey % 11 = 0, null, l_partkey) as l_partkey, if(l_suppkey % 7 = 3 and l_linenumber = 2, null, l_returnflag) as l_returnflag, if(l_orderkey % 19 = 0, null, l_discount) as l_discount, if(l_partkey % 5 = 0, null, l_linestatus) as l_linestatus)"}
    for t in TABLES:
        keep = "where o_orderkey % 10 <> 4" if t == "orders" else ""
        con.sql(f"copy (select * {changes.get(t, '')} from '{SF}/{t}.parquet' {keep}) to '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_pair_key_join_moves_no_whole_table_of_lines(spark, odd):
    """jn04 has the rows of its SQL, with no table of all lines, of all compounds' genes or of all diseases' genes."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{odd}/{t}.parquet'")
    got = registry.QUERIES["jn04_pair_key_join"](spark, odd).select("split", "row_index", "size")
    want = con.sql(f"select split, row_index, size from ({registry.ORACLES['jn04_pair_key_join']})").fetchall()
    assert rows(got) == sorted(map(repr, want)) != []
    made = {name for _app, source, name in store._MADE if source == odd}
    assert "near-train" in made and not made & {"lines", "compound_gene", "disease_gene"}


def edges_at(kg, graph, queries, cands):
    """Edges at queries and candidates, from all edges of a graph."""
    nodes = queries.selectExpr("query_id as src").union(cands.selectExpr("cand as src")).distinct()
    return rows(g.both_ways(kg.edges_of(graph)).where("src % 3 <> 1").join(nodes, "src", "left_semi").select("src", "dst", "h", "r", "t"))


@pytest.mark.parametrize("setting, graph", [("D", "train"), ("F", "status")])
def test_edges_at_queries_and_candidates(spark, odd, setting, graph):
    """They are those of the whole graph, be its tables written before or not."""
    kg = Graph(spark, odd)
    alone = rows(evidence.near(kg, setting).drop("kinds"))
    assert not store.has(spark, odd, "compound_gene")
    assert alone == edges_at(kg, graph, kg.queries(), kg.candidates()) != []
    assert store.has(spark, odd, "compound_gene")
    compounds, diseases = (spark.createDataFrame(df.distinct().collect(), "h long") for df in (kg.candidates().select("cand"), kg.queries().select("query_id")))
    after = rows(kg.compound_gene_at(compounds)), rows(kg.disease_gene_at(diseases))
    store.forget(spark, odd)
    assert after == (rows(kg.compound_gene_at(compounds)), rows(kg.disease_gene_at(diseases)))


def test_gene_stages_are_the_stages_by_joins(spark):
    key = k.KEY
    direct = spark.createDataFrame([("t", 0, 9, "d", 1, 2), ("t", 1, 9, "d", 4, 1)], "split string, row_index long, h long, r string, t long, o1 int")
    theirs = spark.createDataFrame([("t", q, p, x, c, "x", x, n) for q in range(3) for p, c in ((1, 100), (2, 101), (3, 102)) for n, x in enumerate((p + q, p + 2, 7 - q), 1)], "split string, row_index long, pos int, gene long, h long, r string, t long, place int")
    mine = spark.createDataFrame([("t", q, x, 200 + q, r_, x, n) for q in range(3) for n, (r_, x) in enumerate((("y", 3), ("y", 20 + q), ("z", 3), ("z", 5)), 1) if q != 2 or x != 5], "split string, row_index long, gene long, h long, r string, t long, place int")
    left = theirs.join(mine.select(*key, "gene").distinct(), [*key, "gene"], "left_semi").selectExpr(*key, "h", "r", "t", "pos as o1", "0 as o2", "place as o3")
    right = mine.join(theirs.select(*key, "pos", "gene").distinct(), [*key, "gene"]).selectExpr(*key, "h", "r", "t", "pos as o1", "1 as o2", "place as o3")
    stages = [direct, left.unionByName(right), mine.selectExpr(*key, "h", "r", "t", "place as o1"), theirs.selectExpr(*key, "h", "r", "t", "pos as o1", "place as o2")]
    for budget in (3, 6, 50):
        assert rows(r.gene_stages(direct, theirs, mine, budget)) == rows(r.evidence(stages, budget)) != []
