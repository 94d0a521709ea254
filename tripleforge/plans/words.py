"""Text and name columns: row normalisation, questions, hints, roles, families, fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as k
from ..operators import text as x
from ..sources.derived import SQL, Graph
from .registry import query
from .texts import NAMED, PRED_SQL, evaluated, prompts

R = lambda c: F.round(c, 6)
KEY = k.KEY

RAW_SQL = "raw AS (SELECT c_custkey AS i, CASE c_custkey % 3 WHEN 0 THEN 'Answer: \"' || c_name || '\".' WHEN 1 THEN 'x ANSWER:  (' || c_name || ');' || chr(10) || 'more' ELSE 'answer: no Answer: [' || c_name || ']' END AS raw FROM customer)"


@query("fn04_answer_extraction", f"WITH {RAW_SQL}, c AS (SELECT * FROM customer) SELECT i, c_name AS answer FROM raw JOIN c ON c_custkey = i")
def _(spark, sf):
    """The answer behind any spelling of the marker."""
    c, n = Graph(spark, sf).table("customer"), F.col("c_custkey") % 3
    raw = F.when(n == 0, F.concat(F.lit('Answer: "'), "c_name", F.lit('".'))).when(n == 1, F.concat(F.lit("x ANSWER:  ("), "c_name", F.lit(");\nmore"))).otherwise(F.concat(F.lit("answer: no Answer: ["), "c_name", F.lit("]")))
    return c.select(F.col("c_custkey").alias("i"), x.answer(raw).alias("answer"))


@query("fn06_canonical_ids", "SELECT c_custkey AS i, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Compound::DB' || lpad(c_custkey::VARCHAR, 5, '0') END AS compound, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Disease::C' || lpad(c_custkey::VARCHAR, 7, '0') END AS disease FROM customer")
def _(spark, sf):
    c = Graph(spark, sf).table("customer")
    n = lambda w: F.lpad(F.col("c_custkey").cast("string"), w, "0")
    drug = F.when(F.expr("c_custkey % 4 = 0"), F.lit("none")).otherwise(F.concat(F.lit("see db"), n(5), F.lit(".")))
    cui = F.when(F.expr("c_custkey % 5 = 0"), F.lit("C12")).otherwise(F.concat(F.lit("(CUI: c"), n(7), F.lit(")")))
    return c.select(F.col("c_custkey").alias("i"), x.canonical("Compound", x.drug_id(drug)).alias("compound"), x.canonical("Disease", x.concept_id(cui)).alias("disease"))


@query("fn08_row_normalisation", "SELECT c_custkey AS i, trim(c_name) AS drug_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'DB' || lpad(c_custkey::VARCHAR, 5, '0') END AS drug_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Compound::DB' || lpad(c_custkey::VARCHAR, 5, '0') END AS compound, CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'failed_like' ELSE 'other' END AS status, c_custkey % 7 <> 0 AS valid FROM customer")
def _(spark, sf):
    """Rows of a drug table: the id from either column, the name from either, the rest of the column's text cut off, the status of two columns."""
    n = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    no_id, i = F.expr("c_custkey % 7 = 0"), F.col("c_custkey") % 3
    raw = Graph(spark, sf).table("customer").select(
        F.col("c_custkey").alias("i"),
        F.when((F.col("c_custkey") % 2 == 0) & ~no_id, F.concat(F.lit("db"), n)).alias("drug_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.lit(" ")).alias("drug_name"),
        F.concat(F.col("c_name"), F.when(no_id, F.lit("")).otherwise(F.concat(F.lit(" (DBID: DB"), n, F.lit(")")))).alias("Drug"),
        F.when(i == 0, "Approved").when(i == 1, "x").alias("status"),
        F.when(i == 1, "Terminated early").alias("TrialStatus"),
    )
    return x.normalised_rows(raw)


FAMILY_SQL = "CASE WHEN r IN ('CbG', 'CdG', 'CuG') THEN 'compound_gene' WHEN r IN ('DaG', 'DdG') THEN 'disease_gene' WHEN r = 'GiG' THEN 'gene_gene' WHEN r = 'CtD' THEN 'target' WHEN r = 'CpD' THEN 'pair' ELSE 'other' END"


@query("fn10_relation_family", f"WITH {SQL} SELECT r, {FAMILY_SQL} AS by_code, {FAMILY_SQL} AS by_name, CASE WHEN r IN ('CtD', 'CpD') THEN 'pair' ELSE {FAMILY_SQL} END AS by_kinds, count(*) AS n FROM edges GROUP BY r")
def _(spark, sf):
    """Families by relation code, by the name of the relation, and by the kinds of its ends."""
    e = Graph(spark, sf).edges()
    code = F.col("r")
    kinds = F.create_map(*[F.lit(v) for kv in enumerate(("Compound", "Gene", "Disease")) for v in kv])
    name = F.concat(kinds[(F.col("h") % 3).cast("int")], F.lit(":"), kinds[(F.col("t") % 3).cast("int")])
    return e.groupBy("r", x.family_by_code(code).alias("by_code"), x.family_by_name(F.concat(F.lit("X::"), code, F.lit("::"), name), code == "CtD").alias("by_name"), x.family_by_kinds(F.col("h") % 3, F.col("t") % 3).alias("by_kinds")).agg(F.count("*").alias("n"))


@query("fn11_family_weights", f"WITH {SQL}, w(family, weight) AS (VALUES ('compound_gene', 0.3), ('disease_gene', 0.3), ('gene_gene', 0.2), ('target', 0.05)) SELECT f.family, coalesce(weight, 0.05)::DOUBLE AS weight, string_agg(r, ',' ORDER BY r) AS relations FROM (SELECT DISTINCT r, {FAMILY_SQL} AS family FROM edges) f LEFT JOIN w ON w.family = f.family GROUP BY ALL")
def _(spark, sf):
    """Each family with its weight and its relations; a family without a weight of its own has that of the others."""
    w = spark.createDataFrame([("compound_gene", 0.3), ("disease_gene", 0.3), ("gene_gene", 0.2), ("target", 0.05)], "family string, weight double")
    f = Graph(spark, sf).edges().select("r").distinct().withColumn("family", x.family_by_code(F.col("r")))
    return f.groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("relations")).join(F.broadcast(w), "family", "left").select("family", F.coalesce("weight", F.lit(0.05)).alias("weight"), "relations")


ROLE_TABLES = ("customer", "orders", "lineitem", "part")
ROLES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS tab, column_name AS col, lower(regexp_replace(column_name, '[^A-Za-z0-9]+', '_', 'g')) AS n FROM (DESCRIBE SELECT * FROM {t})" for t in ROLE_TABLES)


@query("fn13_column_roles", f"WITH c AS ({ROLES_SQL}), r(role, part) AS (VALUES ('status', 'status'), ('date', 'date'), ('id', 'key'), ('name', 'name'), ('price', 'price'), ('price', 'cost'), ('line', 'line')) SELECT DISTINCT tab, role, col FROM c JOIN r ON contains(n, part)")
def _(spark, sf):
    """Which columns play a role, by what their normalised names contain; one may play several."""
    kg = Graph(spark, sf)
    names = spark.createDataFrame([(t, c) for t in ROLE_TABLES for c in kg.table(t).columns], "tab string, col string")
    return x.column_roles(names, {"status": ["status"], "date": ["date"], "id": ["key"], "name": ["name"], "price": ["price", "cost"], "line": ["line"]})


LEXICON = [("CtD", "tail", "What does {} treat?"), ("CtD", "head", "Which compound treats {}?"), ("CpD", "head", "Which compound palliates {}?")]


@query("fn15_lexicon_questions", f"WITH {SQL}, lx(r, side, template) AS (VALUES {', '.join(repr(v) for v in LEXICON)}), e AS (SELECT h, r, t, CASE WHEN (h + t) % 2 = 0 THEN 'tail' ELSE 'head' END AS side FROM (SELECT h, r, t FROM train UNION ALL SELECT h, r, t FROM aux)) SELECT e.h, e.r, e.t, replace(coalesce(template, 'What is related to {{}}?'), '{{}}', name) AS question FROM e LEFT JOIN lx ON lx.r = e.r AND lx.side = e.side JOIN nodes ON id = CASE WHEN e.side = 'tail' THEN h ELSE t END")
def _(spark, sf):
    """The question of a triple by its relation and by which end is asked for; a general one where the lexicon has none."""
    kg = Graph(spark, sf)
    lexicon = spark.createDataFrame(LEXICON, "r string, side string, template string")
    e = kg.train().unionByName(kg.auxiliary().select("h", "r", "t")).withColumn("side", F.when((F.col("h") + F.col("t")) % 2 == 0, "tail").otherwise("head"))
    e = e.withColumn("id", F.when(F.col("side") == "tail", F.col("h")).otherwise(F.col("t"))).join(kg.nodes().select("id", "name"), "id")
    return x.questions(e, lexicon, "name").select("h", "r", "t", "question")


@query("fn17_template_question", f"WITH {NAMED} SELECT split, row_index, 'For ' || qn || ', name a compound.' AS question FROM pr")
def _(spark, sf):
    return prompts(Graph(spark, sf)).select(*KEY, F.replace(F.lit("For {query_entity}, name a compound."), F.lit("{query_entity}"), "qn").alias("question"))


@query("fn19_display_names", f"WITH {SQL} SELECT id, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN name WHEN id % 2 = 0 THEN lower(name) ELSE kind || '::' || id END AS shown FROM nodes")
def _(spark, sf):
    """The name to show: display name, raw name, or the entity itself; empty ones count as missing."""
    n = Graph(spark, sf).nodes()
    shown = x.display_name(F.when(F.expr("id % 3 = 0"), F.when(F.expr("id % 5 = 0"), F.lit("")).otherwise(F.col("name"))), F.when(F.expr("id % 2 = 0"), F.lower("name")).otherwise(F.lit("")), F.concat("kind", F.lit("::"), F.col("id").cast("string")))
    return n.select("id", shown.alias("shown"))


@query("fn20_edge_keys", f"WITH {SQL} SELECT h, t, CASE WHEN h % 4 = 3 THEN NULL ELSE 7 END::BIGINT AS r FROM aux")
def _(spark, sf):
    """Keys of edges stored as lists or as objects under any of the usual field names; what is no edge has none."""
    a, n = Graph(spark, sf).auxiliary(), F.col("h") % 4
    h, t = F.col("h").cast("string"), F.col("t").cast("string")
    text = F.when(n == 0, F.concat(F.lit("["), h, F.lit(", 7, "), t, F.lit("]"))).when(n == 1, F.concat(F.lit('{"head": '), h, F.lit(', "relation": 7, "tail": '), t, F.lit("}"))).when(n == 2, F.concat(F.lit('{"src": '), h, F.lit(', "rel": 7, "dst": '), t, F.lit("}"))).otherwise(F.lit("edge"))
    key = x.edge_key(text)
    return a.select("h", "t", key.alias("k")).select("h", "t", F.when((F.col("k.h") == F.col("h")) & (F.col("k.t") == F.col("t")), F.col("k.r")).alias("r"))


@query("fn21_placeholders", f"WITH {NAMED} SELECT split, row_index, n AS entities, 1 AS queries FROM pr")
def _(spark, sf):
    p = prompts(Graph(spark, sf))
    return p.select(*KEY, x.placeholders(F.col("prompt"), "[ENTITY]").alias("entities"), x.placeholders(F.col("prompt"), "[QUERY]").alias("queries"))


COMMAS = "(length(pred) - length(replace(pred, ',', ''))) >= 2 OR length(pred) > 120 OR (length(pred) - length(replace(pred, '''', ''))) >= 4 OR hits >= 3"


@query("fn22_list_fragments", f"WITH {PRED_SQL}, p AS (SELECT split, row_index, hits, CASE WHEN row_index % 4 = 0 THEN pred || '####' WHEN row_index % 4 = 1 THEN pred || ',' ELSE pred END AS pred FROM ev) SELECT split, row_index, ({COMMAS} OR contains(pred, '####')) AS marked, ({COMMAS}) AS plain, (trim(pred) = '' OR hits >= 2 OR contains(pred, ',') OR contains(pred, ';') OR contains(lower(pred), 'candidate') OR contains(lower(pred), 'entity')) AS strict FROM p")
def _(spark, sf):
    """Does an answer look like a piece of the candidate list? By each of the three rules."""
    e = evaluated(Graph(spark, sf))
    n = F.col("row_index") % 4
    e = e.withColumn("pred", F.when(n == 0, F.concat("pred", F.lit("####"))).when(n == 1, F.concat("pred", F.lit(","))).otherwise(F.col("pred")))
    return e.select(*KEY, x.fragment(F.col("pred"), F.col("hits")).alias("marked"), x.fragment(F.col("pred"), F.col("hits"), marker=False).alias("plain"), x.suspicious(F.col("pred"), F.col("hits")).alias("strict"))


HINTS = "WITH {s}, c(r, rel, n) AS (SELECT r, CASE r WHEN 'CtD' THEN 'Alpha::treats::Compound:Disease' WHEN 'CpD' THEN 'Beta::palliates::Compound:Disease' WHEN 'CbG' THEN 'Alpha::associates_effect::x' ELSE 'contra_' || lower(r) END, count(*) FROM edges GROUP BY r)"


def relation_names(kg: Graph):
    r = F.col("r")
    rel = F.when(r == "CtD", "Alpha::treats::Compound:Disease").when(r == "CpD", "Beta::palliates::Compound:Disease").when(r == "CbG", "Alpha::associates_effect::x").otherwise(F.concat(F.lit("contra_"), F.lower("r")))
    return kg.edges().groupBy("r").agg(F.count("*").alias("n")).withColumn("rel", rel)


@query("fn27_relation_hints", HINTS.format(s=SQL) + " SELECT r, CASE WHEN contains(rel, '::') THEN split_part(rel, '::', 1) ELSE 'UNKNOWN' END AS source, contains(lower(rel), 'treat') AS treat, contains(lower(rel), 'palliat') AS palliate, contains(lower(rel), 'associat') AS association, contains(lower(rel), 'contra') AS contra, contains(lower(rel), 'side') OR contains(lower(rel), 'effect') AS side_effect FROM c")
def _(spark, sf):
    return relation_names(Graph(spark, sf)).select("r", *x.relation_hints(F.col("rel")))


@query("fn28_auxiliary_roles", HINTS.format(s=SQL) + " SELECT r, CASE WHEN contains(lower(rel), 'contra') THEN 'possible_contradiction_or_safety' ELSE 'direct_cd_auxiliary' END AS role, concat_ws(',', CASE WHEN split_part(rel, '::', 1) = 'Alpha' THEN 'overlaps_with_other_source' END, CASE WHEN n > 5000 THEN 'very_large_relation' END) AS caution FROM c WHERE r <> 'CtD'")
def _(spark, sf):
    """How relations beside the target may be used: their role, and what to beware of."""
    c = relation_names(Graph(spark, sf)).where("r <> 'CtD'")
    return c.select("r", *x.auxiliary_role(F.col("rel"), F.col("n"), "Alpha", 5000))
