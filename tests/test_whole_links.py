"""All gene-gene edges, counted by groups."""

import itertools

import duckdb

from tripleforge.operators import graph as g
from tripleforge.plans import registry
from tripleforge.sources.derived import WHOLE_SQL


def test_bridges_in_groups_are_those_of_listed_links(spark):
    group = {x: x % 3 for x in range(20)}
    links = spark.createDataFrame([(x, "x", y) for x, y in itertools.combinations(range(20), 2) if group[x] == group[y]], "h long, r string, t long")
    groups = spark.createDataFrame([(x, k) for x, k in group.items()], "gene long, k int")
    left = spark.createDataFrame([(a, (a * 7 + j * 5) % 20) for a in range(4) for j in range(a + 1)], "node long, near long")
    right = spark.createDataFrame([(b, (b * 3 + j) % 20) for b in range(4) for j in range(b + 1)], "node long, near long")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a long, b long")
    rows = lambda df: sorted((x["a"], x["b"], x["bridges"]) for x in df.collect())
    assert rows(g.bridges_in_groups(left, right, groups, pairs, 5)) == rows(g.bridges(left, right, links, pairs, 5))


def test_relation_roles_have_every_link(spark):
    sf = "/root/testdata/sf0.01"
    n = duckdb.connect().execute(f"select count(*) from '{sf}/part.parquet' a join '{sf}/part.parquet' b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey").fetchone()[0]
    assert registry.QUERIES["agg11_relation_roles"](spark, sf).where("r = 'GiG'").first()["n"] == n
    assert "BETWEEN 1 AND" not in WHOLE_SQL
