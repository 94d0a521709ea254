"""Annotated triples, path templates, and the diagnostics that need both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotations as a
from ..operators import graph as g
from ..operators import ranking as k
from ..operators import templates as tp
from ..sources import store
from ..sources.derived import SQL, Graph
from .evidence import subgraph_sql, subgraphs
from .features import FEATURES, soft_ranked
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY
AT = "x.split = y.split AND x.row_index = y.row_index"

#: Kinds of the ends of relations; a relation without a row has no rule, one without a range no full rule.
RULES = [("CtD", "Compound", "Disease"), ("CpD", "Disease", "Compound"), ("CbG", "Compound", "Gene"), ("GiG", "Gene", None)]

CG, DG = ("CbG", "CdG", "CuG"), ("DaG", "DdG")
#: Paths that explain a treatment, edges of the task itself, and what must not explain one.
TEMPLATES = [
    ("treats", "direct", [("Compound", ("CtD",), "Disease")]),
    ("palliates", "direct", [("Compound", ("CpD",), "Disease")]),
    ("shared_gene", "valid", [("Compound", CG, "Gene"), ("Gene", DG, "Disease")]),
    ("linked_genes", "valid", [("Compound", CG, "Gene"), ("Gene", ("GiG",), "Gene"), ("Gene", DG, "Disease")]),
    ("failed_pair", "invalid", [("Compound", ("CfD",), "Disease")]),
]


def notes(kg: Graph):
    """(KEY, pos, name, flag): annotations of the candidates by name, in the order of names: those whose pair failed are contra. Every third row lacks its last one."""
    c = kg.candidates().join(kg.nodes().select(F.col("id").alias("cand"), "name"), "cand").join(kg.failed().select(F.col("h").alias("cand"), F.col("t").alias("query_id"), F.lit("Yes ").alias("flag")), ["cand", "query_id"], "left")
    n = k.rank_by(c, "name", name="at").withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
    return n.where("row_index % 3 <> 0 or at < n").select(*KEY, F.col("at").alias("pos"), "name", F.coalesce("flag", F.lit("no")).alias("flag"))


def annotated_candidates(kg: Graph, mode: str = "name"):
    """The candidates with soft_rank as rank, and contra by name or by position."""
    def build():
        c = soft_ranked(kg).select(*KEY, "query_id", "gold_id", "pos", "cand", F.col("soft_rank").alias("rank"), "support", "direct", "shared").join(kg.nodes().select(F.col("id").alias("cand"), "name"), "cand")
        return a.aligned(c, notes(kg), mode)

    return store.once(kg.spark, kg.sf_dir, f"annotated-candidates-{mode}", build)


def annotated(kg: Graph, mode: str = "name"):
    """The evidence triples of setting D with their annotations and score."""
    def build():
        rules = kg.spark.createDataFrame(RULES, "r string, domain string, range string")
        return a.annotate(subgraphs(kg).select(*KEY, "query_id", "idx", "h", "r", "t"), annotated_candidates(kg, mode), rules, "Disease", "Compound").withColumn("score", a.score())

    return store.once(kg.spark, kg.sf_dir, f"annotated-triples-{mode}", build)


NOTES = """,
nm AS (SELECT c.split, c.row_index, c.pos, c.cand, n.name, fl.h IS NOT NULL AS bad, row_number() OVER (PARTITION BY c.split, c.row_index ORDER BY n.name) AS ord, count(*) OVER (PARTITION BY c.split, c.row_index) AS n FROM cand c JOIN nodes n ON n.id = c.cand LEFT JOIN failed fl ON fl.h = c.cand AND fl.t = c.query_id),
nt AS (SELECT split, row_index, ord, name, bad FROM nm WHERE row_index % 3 <> 0 OR ord < n),
ac AS (SELECT s.*, coalesce(nt.bad, false) AS contra, coalesce(s.row_index % 3 <> 0 AND np.bad, false) AS contra_at FROM soft s JOIN nm ON nm.split = s.split AND nm.row_index = s.row_index AND nm.cand = s.cand
 LEFT JOIN nt ON nt.split = s.split AND nt.row_index = s.row_index AND nt.name = nm.name LEFT JOIN nt np ON np.split = s.split AND np.row_index = s.row_index AND np.ord = s.pos)"""
RULE_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in RULES)
ANNOTATED = f"""{FEATURES}{subgraph_sql()[len(SQL):]}{NOTES}, ru(r, d, g) AS (VALUES {RULE_ROWS}),
an AS (SELECT s.split, s.row_index, s.idx, s.h, s.r, s.t, s.query_id, a.pos AS ph, b.pos AS pt, least(coalesce(a.soft_rank, 99), coalesce(b.soft_rank, 99)) AS best, s.h = s.query_id OR s.t = s.query_id AS tq, a.pos IS NOT NULL OR b.pos IS NOT NULL AS tc,
 coalesce(a.contra, false) OR coalesce(b.contra, false) AS contra, coalesce(a.contra_at, false) OR coalesce(b.contra_at, false) AS contra_at,
 CASE WHEN ru.d IS NULL OR ru.g IS NULL OR NOT (s.h = s.query_id OR a.pos IS NOT NULL) OR NOT (s.t = s.query_id OR b.pos IS NOT NULL) THEN NULL ELSE ru.d = CASE WHEN s.h = s.query_id THEN 'Disease' ELSE 'Compound' END AND ru.g = CASE WHEN s.t = s.query_id THEN 'Disease' ELSE 'Compound' END END AS ontology,
 dh.n + dt.n AS density FROM sub s LEFT JOIN ac a ON a.split = s.split AND a.row_index = s.row_index AND a.cand = s.h LEFT JOIN ac b ON b.split = s.split AND b.row_index = s.row_index AND b.cand = s.t LEFT JOIN ru ON ru.r = s.r
 JOIN dg2 dh ON dh.split = s.split AND dh.row_index = s.row_index AND dh.node = s.h JOIN dg2 dt ON dt.split = s.split AND dt.row_index = s.row_index AND dt.node = s.t),
sa AS (SELECT *, {{score}} AS score, {{score_at}} AS score_at FROM an)"""
_SCORE = "round(CASE WHEN NOT tc THEN 0 WHEN best <= 5 THEN 1.0 WHEN best <= 10 THEN 0.6 ELSE 0.25 END::DOUBLE + 0.35::DOUBLE * tc::INT + 0.05::DOUBLE * tq::INT - 0.8::DOUBLE * (tc AND tq)::INT - 0.1::DOUBLE * {c}::INT + 0.05::DOUBLE * least(density, 10) / 10.0::DOUBLE, 6)"
_DEGREES = "an AS (SELECT s.split"
ANNOTATED = ANNOTATED.format(score=_SCORE.format(c="contra"), score_at=_SCORE.format(c="contra_at")).replace(_DEGREES, "dg2 AS (SELECT split, row_index, node, count(*) AS n FROM (SELECT split, row_index, unnest([h, t]) AS node FROM sub) GROUP BY ALL),\n" + _DEGREES, 1)


@query("gr20_annotated_triples", f"WITH {ANNOTATED} SELECT split, row_index, idx, array_to_string(list_filter([ph, pt], lambda x: x IS NOT NULL), ',') AS positions, tq AS touches_query, tc AS touches_candidate, tc AND best <= 5 AS top_band, tq AND tc AS direct, contra, ontology, count(*) OVER (PARTITION BY split, row_index, h, r, t) AS frequency, density FROM sa")
def _(spark, sf):
    """All annotations of the evidence triples: candidates touched, contra by name, the three-valued schema flag, frequency and density."""
    t = annotated(Graph(spark, sf))
    return t.select(*KEY, "idx", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "touches_query", "touches_candidate", "top_band", "direct", "contra", "ontology", "frequency", "density")


@query("gr22_contra_scores", f"WITH {ANNOTATED} SELECT split, row_index, idx, score, score_at AS score_by_position FROM sa")
def _(spark, sf):
    """Scores of triples with the contra term, the flags aligned by name and by position."""
    kg = Graph(spark, sf)
    return annotated(kg).select(*KEY, "idx", "score").join(annotated(kg, "position").select(*KEY, "idx", F.col("score").alias("score_by_position")), [*KEY, "idx"])


FINAL = f"""{ANNOTATED}, mx AS (SELECT *, greatest(max(score) OVER (PARTITION BY split, row_index), 0) AS top FROM sa),
bo AS (SELECT split, row_index, p AS pos, greatest(max(score / CASE WHEN top > 0 THEN top ELSE 1 END), 0) AS bonus, max((tc AND tq)::INT) AS direct FROM (SELECT *, unnest(list_distinct(list_filter([ph, pt], lambda x: x IS NOT NULL))) AS p FROM mx) GROUP BY split, row_index, p),
fi AS (SELECT x.*, round(0.7::DOUBLE * CASE WHEN count(*) OVER w > 1 THEN 1 - (x.pos - 1) / (count(*) OVER w - 1) ELSE 1 END + 0.3::DOUBLE * coalesce(bonus, 0) - 0.15::DOUBLE * coalesce(y.direct, 0) - 0.05::DOUBLE * x.contra::INT, 9) AS s FROM ac x LEFT JOIN bo y ON {AT} AND y.pos = x.pos WINDOW w AS (PARTITION BY x.split, x.row_index))"""


@query("win09_evidence_bonus", f"WITH {FINAL} SELECT split, row_index, cand, round(s, 6) AS score, row_number() OVER (PARTITION BY split, row_index ORDER BY s DESC, pos) AS rank FROM fi")
def _(spark, sf):
    """Candidates by place, the best triple that touches them as a share of the row's best, direct edges and contra flags."""
    kg = Graph(spark, sf)
    c = a.rescored(annotated_candidates(kg).drop("direct"), a.touched(annotated(kg)))
    return k.rank_by(c, F.desc("final"), "pos").select(*KEY, "cand", R("final").alias("score"), "rank")


def evidence_edges(kg: Graph):
    """(KEY, src, r, dst): the row's evidence with the failed pairs of its candidates, from either end."""
    failed = kg.candidates().join(kg.failed().select(F.col("h").alias("cand"), F.col("t").alias("query_id"), "h", "r", "t"), ["cand", "query_id"]).select(*KEY, "h", "r", "t")
    return g.both_ways(subgraphs(kg).select(*KEY, "h", "r", "t").unionByName(failed), KEY).select(*KEY, "src", "r", "dst")


def supported(kg: Graph):
    """The candidates with their support by templates and whether the filter keeps them."""
    def build():
        c = kg.candidates()
        pairs = c.select(*KEY, F.col("cand").alias("a"), F.col("query_id").alias("b"))
        return tp.kept(c, tp.matched(pairs, evidence_edges(kg), kg.nodes(), TEMPLATES, KEY), TEMPLATES, KEY)

    return store.once(kg.spark, kg.sf_dir, "supported", build)


def edges_sql() -> str:
    """ev (split, row_index, src, r, dst) and, by joins written out for each template, mt (split, row_index, cand, kind)."""
    parts = []
    for _, kind, steps in TEMPLATES:
        joins = " ".join(f"JOIN ev e{i} ON e{i}.split = c.split AND e{i}.row_index = c.row_index AND e{i}.src = {'c.cand' if not i else f'e{i - 1}.dst'} AND e{i}.r IN ({', '.join(repr(x) for x in rels)}) AND e{i}.dst % 3 = {['Compound', 'Gene', 'Disease'].index(far)}" for i, (_, rels, far) in enumerate(steps))
        parts.append(f"SELECT DISTINCT c.split, c.row_index, c.cand, '{kind}' AS kind FROM cand c {joins} WHERE e{len(steps) - 1}.dst = c.query_id")
    return f""", et AS (SELECT split, row_index, h, r, t FROM sub UNION ALL SELECT split, row_index, h, r, t FROM cand JOIN failed ON h = cand AND t = query_id),
ev AS (SELECT split, row_index, h AS src, r, t AS dst FROM et UNION ALL SELECT split, row_index, t, r, h FROM et), mt AS ({" UNION ALL ".join(parts)}),
su AS (SELECT x.*, min(CASE y.kind WHEN 'direct' THEN 0 WHEN 'valid' THEN 1 END) AS best FROM cand x LEFT JOIN mt y ON {AT} AND y.cand = x.cand GROUP BY ALL),
kp AS (SELECT *, count(best) OVER (PARTITION BY split, row_index) = 0 AS fallback FROM su)"""


@query("ghost02_template_filter", f"WITH {subgraph_sql()}{edges_sql()} SELECT split, row_index, cand, CASE best WHEN 0 THEN 'direct' WHEN 1 THEN 'valid' END AS support, best IS NOT NULL OR fallback AS kept, fallback FROM kp")
def _(spark, sf):
    """Candidates that an edge of the task or a path of a valid template supports; all of a row where none has support."""
    return supported(Graph(spark, sf)).select(*KEY, "cand", "support", "kept", "fallback")


SEQUENCES = f"""{subgraph_sql()}{edges_sql()},
p1 AS (SELECT c.split, c.row_index, c.cand, c.query_id, [e.r] AS rels, [c.cand % 3, e.dst % 3] AS kinds, e.dst AS last, [c.cand, e.dst] AS nodes FROM cand c JOIN ev e ON e.split = c.split AND e.row_index = c.row_index AND e.src = c.cand WHERE e.dst <> c.cand),
p2 AS (SELECT p.split, p.row_index, p.cand, query_id, list_append(rels, e.r) AS rels, list_append(kinds, e.dst % 3) AS kinds, e.dst AS last, list_append(nodes, e.dst) AS nodes FROM p1 p JOIN ev e ON e.split = p.split AND e.row_index = p.row_index AND e.src = p.last WHERE p.last <> query_id AND NOT list_contains(nodes, e.dst)),
p3 AS (SELECT p.split, p.row_index, p.cand, query_id, list_append(rels, e.r) AS rels, list_append(kinds, e.dst % 3) AS kinds, e.dst AS last FROM p2 p JOIN ev e ON e.split = p.split AND e.row_index = p.row_index AND e.src = p.last WHERE p.last <> query_id AND e.dst = query_id),
ps AS (SELECT split, rels, kinds FROM p1 WHERE last = query_id UNION ALL SELECT split, rels, kinds FROM p2 WHERE last = query_id UNION ALL SELECT split, rels, kinds FROM p3),
vd AS (SELECT split, array_to_string(rels, ' -> ') AS pattern, CASE WHEN kinds = [0, 2] AND rels[1] IN ('CtD', 'CpD') THEN 'direct' WHEN kinds = [0, 1, 2] AND rels[1] LIKE 'C_G' AND rels[2] LIKE 'D_G' THEN 'valid' WHEN kinds = [0, 1, 1, 2] AND rels[1] LIKE 'C_G' AND rels[2] = 'GiG' AND rels[3] LIKE 'D_G' THEN 'valid' WHEN kinds = [0, 2] AND rels[1] = 'CfD' THEN 'invalid' ELSE 'unsupported' END AS verdict FROM ps)"""


@query("ghost03_template_scan", f"WITH {SEQUENCES} SELECT split, pattern, verdict, count(*) AS n FROM vd GROUP BY ALL")
def _(spark, sf):
    """Every path of at most three edges of evidence from a candidate to its query, by its relations and the verdict of the templates."""
    kg = Graph(spark, sf)
    pairs = kg.candidates().select(*KEY, F.col("cand").alias("a"), F.col("query_id").alias("b"))
    p = tp.sequences(pairs, evidence_edges(kg), KEY)
    kind = lambda i: F.element_at(F.array(F.lit("Compound"), F.lit("Gene"), F.lit("Disease")), (F.get("nodes", F.lit(i)) % 3 + 1).cast("int"))
    v = tp.classified(p, [kind(i) for i in range(4)], TEMPLATES)
    return v.groupBy("split", F.array_join("rels", " -> ").alias("pattern"), "verdict").agg(F.count("*").alias("n"))


@query("agg08_top5_flags", f"WITH {FEATURES}{subgraph_sql()[len(SQL):]}{NOTES}{edges_sql()}, pe AS (SELECT x.split, x.row_index, avg((x.direct > 0)::INT) AS d, avg((shared > 0)::INT) AS e, avg((best IS NOT NULL)::INT) AS o, avg(contra::INT) AS c FROM ac x JOIN kp y ON {AT} AND y.cand = x.cand WHERE x.soft_rank <= 5 GROUP BY x.split, x.row_index) SELECT split, round(avg(d), 6) AS direct_rate, round(avg(e), 6) AS evidence_rate, round(avg(o), 6) AS ontology_rate, round(avg(c), 6) AS contra_rate FROM pe GROUP BY split")
def _(spark, sf):
    """Shares of flagged candidates among each query's first five by support, averaged over queries: direct edge, evidence, support by templates, contra."""
    kg = Graph(spark, sf)
    c = annotated_candidates(kg).where("rank <= 5").join(supported(kg).select(*KEY, "cand", F.col("support").isNotNull().alias("keep")), [*KEY, "cand"])
    share = lambda x: F.avg(x.cast("double"))
    per = c.groupBy(*KEY).agg(share(F.col("direct") > 0).alias("d"), share(F.col("shared") > 0).alias("e"), share(F.col("keep")).alias("o"), share(F.col("contra")).alias("c"))
    return per.groupBy("split").agg(R(F.avg("d")).alias("direct_rate"), R(F.avg("e")).alias("evidence_rate"), R(F.avg("o")).alias("ontology_rate"), R(F.avg("c")).alias("contra_rate"))


@query("agg20_row_diagnostics", f"""WITH {ANNOTATED}{edges_sql()},
tr AS (SELECT split, row_index, count(*) AS n, avg(score) AS score, avg((tc AND tq)::INT) AS direct, avg(contra::INT) AS contra FROM sa WHERE idx < 40 GROUP BY split, row_index),
cv AS (SELECT split, row_index, count(DISTINCT p) FILTER (idx < 40) / count(DISTINCT p) AS covered FROM (SELECT split, row_index, idx, unnest(list_filter([ph, pt], lambda x: x IS NOT NULL)) AS p FROM sa) GROUP BY split, row_index),
rt AS (SELECT x.split, avg(n) AS n, avg(score) AS score, avg(direct) AS direct, avg(contra) AS contra, avg(covered) AS covered FROM tr x LEFT JOIN cv y ON {AT} GROUP BY x.split),
og AS (SELECT split, avg(n) AS n, count(*) FILTER (hit = 0) AS absent, count(*) FILTER (fb) AS fallbacks FROM (SELECT split, row_index, count(*) AS n, max((cand = gold_id)::INT) AS hit, any_value(fallback) AS fb FROM kp WHERE best IS NOT NULL OR fallback GROUP BY split, row_index) GROUP BY split),
bb AS (SELECT q.split, avg(place) AS place FROM q LEFT JOIN (SELECT cand, row_number() OVER (ORDER BY score DESC, cand) AS place FROM pop) u ON u.cand = q.gold_id GROUP BY q.split)
SELECT rt.split, round(rt.n, 6) AS avg_subgraph_size, round(score, 6) AS avg_triple_score, round(direct, 6) AS direct_shortcut_rate, round(contra, 6) AS contradiction_rate, round(coalesce(covered, 0), 6) AS coverage_rate, round(og.n, 6) AS avg_candidates_after_filter, absent AS gold_absent, fallbacks, round(coalesce(place, 0), 6) AS avg_gold_place FROM rt JOIN og USING (split) JOIN bb USING (split)""")
def _(spark, sf):
    """What each stage's rows say of themselves, by split: the first 40 triples of the evidence (size, score, direct and contra shares, candidates still covered), the template filter, and the gold's place in the whole universe. Nulls are left out of means."""
    kg = Graph(spark, sf)
    t = annotated(kg)
    first = t.where("idx < 40").groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg(F.col("direct").cast("double")).alias("direct"), F.avg(F.col("contra").cast("double")).alias("contra"))
    covered = t.select(*KEY, "idx", F.explode("positions").alias("p")).groupBy(*KEY).agg((F.countDistinct(F.when(F.col("idx") < 40, F.col("p"))) / F.countDistinct("p")).alias("covered"))
    one = first.join(covered, KEY, "left").groupBy("split").agg(R(F.avg("n")).alias("avg_subgraph_size"), R(F.avg("score")).alias("avg_triple_score"), R(F.avg("direct")).alias("direct_shortcut_rate"), R(F.avg("contra")).alias("contradiction_rate"), R(F.coalesce(F.avg("covered"), F.lit(0.0))).alias("coverage_rate"))
    rows = supported(kg).where("kept").groupBy(*KEY).agg(F.count("*").alias("n"), F.max((F.col("cand") == F.col("gold_id")).cast("int")).alias("hit"), F.max("fallback").alias("fb"))
    two = rows.groupBy("split").agg(R(F.avg("n")).alias("avg_candidates_after_filter"), F.count_if(F.col("hit") == 0).alias("gold_absent"), F.count_if("fb").alias("fallbacks"))
    places = kg.queries().join(kg.ranked().select(F.col("cand").alias("gold_id"), "place"), "gold_id", "left")
    three = places.groupBy("split").agg(R(F.coalesce(F.avg("place"), F.lit(0.0))).alias("avg_gold_place"))
    return one.join(two, "split").join(three, "split")
