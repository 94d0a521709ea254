"""Scalar functions over names, statuses, prompts and predictions; evaluation of generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as k
from ..operators import text as x
from ..sources import store
from ..sources.derived import SQL, Graph
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY


@query("fn01_clean_text", "SELECT doc_id, md5(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS cleaned FROM documents")
def _(spark, sf):
    return Graph(spark, sf).table("documents").select("doc_id", F.md5(x.clean(F.col("text")).cast("binary")).alias("cleaned"))


#: Answers with markers, quotes within and around, and several lines.
LOOSE_SQL = """SELECT o_orderkey, 'Question: x Answer: no' || chr(10) || 'Answer: ' || CASE o_orderkey % 4 WHEN 0 THEN '"Crohn''s  no ' || o_custkey || '  ' || o_orderpriority || '".' WHEN 1 THEN '''"`' || o_orderpriority || '`"'' ;' || chr(10) || 'more' WHEN 2 THEN chr(10) || ' ''' || o_orderpriority || ''' or "' || o_custkey || '"' ELSE '' END AS raw FROM orders"""


@query("fn02_loose_answer", f"""WITH raws AS ({LOOSE_SQL}), line AS (SELECT o_orderkey, rtrim(split_part(ltrim(list_last(string_split(raw, 'Answer:')), ' ' || chr(10)), chr(10), 1)) AS line FROM raws)
SELECT o_orderkey, lower(trim(regexp_replace(trim(trim(trim(line, ''''), '"'), '`'), '\\s+', ' ', 'g'), ' .,:;')) AS answer FROM line""")
def _(spark, sf):
    who, level, n = F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey") % 4
    shape = F.when(n == 0, F.concat(F.lit("\"Crohn's  no "), who, F.lit("  "), level, F.lit('".'))).when(n == 1, F.concat(F.lit("'\"`"), level, F.lit("`\"' ;\nmore"))).when(n == 2, F.concat(F.lit("\n '"), level, F.lit("' or \""), who, F.lit('"'))).otherwise("")
    return Graph(spark, sf).table("orders").select("o_orderkey", x.loose(F.concat(F.lit("Question: x Answer: no\nAnswer: "), shape)).alias("answer"))


@query("fn03_strict_answer", "SELECT c_custkey, lower(trim(replace('\"' || c_name || '.</s>', '</s>', ''), ' \"''`.,:;')) AS answer FROM customer")
def _(spark, sf):
    return Graph(spark, sf).table("customer").select("c_custkey", x.strict(F.concat(F.lit('"'), "c_name", F.lit(".</s>"))).alias("answer"))


@query("fn05_identifiers", "SELECT o_orderkey, 'DB' || lpad((o_custkey % 100000)::VARCHAR, 5, '0') AS drug, CASE WHEN o_orderkey % 2 = 0 THEN 'C' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') ELSE '' END AS concept, 'Compound::DB' || lpad((o_custkey % 100000)::VARCHAR, 5, '0') AS entity FROM orders")
def _(spark, sf):
    o = Graph(spark, sf).table("orders")
    raw = F.concat(F.lit("id db"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"), F.lit(";"))
    raw2 = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "c").otherwise("x"), F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0"))
    return o.select("o_orderkey", x.drug_id(raw).alias("drug"), x.concept_id(raw2).alias("concept"), F.concat(F.lit("Compound::"), x.drug_id(raw)).alias("entity"))


@query("fn07_status", "SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'failed_like' ELSE 'other' END AS status FROM orders) GROUP BY status")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "P", "Phase 2, Terminated").otherwise("Phase 1")
    return Graph(spark, sf).table("orders").select(x.status(raw, F.lit("")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("fn09_entity_types", f"WITH {SQL} SELECT kind AS type, count(*) AS n FROM nodes GROUP BY kind")
def _(spark, sf):
    e = Graph(spark, sf).nodes().select(F.concat("kind", F.lit("::"), F.col("id").cast("string")).alias("e"))
    return e.groupBy(x.entity_type(F.col("e")).alias("type")).agg(F.count("*").alias("n"))


@query("fn12_normalised_names", "SELECT DISTINCT regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g') AS name FROM part")
def _(spark, sf):
    return Graph(spark, sf).table("part").select(x.snake(F.col("p_type")).alias("name")).distinct()


NAMED = f"{SQL}, nc AS (SELECT cand.*, name FROM cand JOIN nodes ON id = cand), pr AS (SELECT nc.split, nc.row_index, any_value(d.name) AS qn, any_value(gold.name) AS gold, string_agg('''' || nc.name || '''', ', ' ORDER BY pos) AS opts, count(*) AS n FROM nc JOIN nodes d ON d.id = query_id JOIN nodes gold ON gold.id = gold_id GROUP BY nc.split, nc.row_index)"


def prompts(kg: Graph):
    return store.once(kg.spark, kg.sf_dir, "prompts", lambda: _prompts(kg))


def _prompts(kg: Graph):
    names = kg.nodes()
    c = kg.candidates().join(names.select(F.col("id").alias("cand"), "name"), "cand")
    lists = c.groupBy(*KEY, "query_id", "gold_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))
    q = names.select(F.col("id").alias("query_id"), F.col("name").alias("qn"))
    g = names.select(F.col("id").alias("gold_id"), F.col("name").alias("gold"))
    p = lists.join(q, "query_id").join(g, "gold_id")
    return p.withColumn("prompt", x.prompt(F.col("names"), F.concat(F.lit("Which compound treats "), "qn", F.lit("?"))))


@query("fn14_prompts", f"WITH {NAMED} SELECT split, row_index, md5('Options: (' || opts || ') References: ([QUERY], ' || rtrim(repeat('[ENTITY], ', n), ', ') || ') Question: Which compound treats ' || qn || '? Answer:') AS prompt FROM pr")
def _(spark, sf):
    return prompts(Graph(spark, sf)).select(*KEY, F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("fn16_question_block", f"WITH {NAMED} SELECT split, row_index, 'Which compound treats ' || qn || '?' AS question, n AS entities, 1 AS queries FROM pr")
def _(spark, sf):
    p = prompts(Graph(spark, sf))
    return p.select(*KEY, x.question_block(F.col("prompt")).alias("question"), F.regexp_count("prompt", F.lit(r"\[ENTITY\]")).alias("entities"), F.regexp_count("prompt", F.lit(r"\[QUERY\]")).alias("queries"))


@query("fn18_row_uid", f"WITH {SQL} SELECT split || '::' || row_index AS uid, split || '|||' || query_id || '|||' || gold_id AS pair_key FROM q")
def _(spark, sf):
    return Graph(spark, sf).queries().select(F.concat_ws("::", "split", F.col("row_index").cast("string")).alias("uid"), F.concat_ws("|||", "split", F.col("query_id").cast("string"), F.col("gold_id").cast("string")).alias("pair_key"))


@query("fn25_rounding", "SELECT l_orderkey, l_linenumber, round(x, 4) AS r4, round(x, 6) AS r6, round(x, 8) AS r8, round(x, 12) AS r12, round_even(l_quantity * 0.55::DOUBLE, 0)::INT AS kept FROM (SELECT *, l_quantity / 7 + l_discount AS x FROM lineitem)")
def _(spark, sf):
    """Values to 4, 6, 8 and 12 places, and counts as shares rounded half to even."""
    x = F.col("l_quantity") / 7 + F.col("l_discount")
    return Graph(spark, sf).table("lineitem").select("l_orderkey", "l_linenumber", *[F.round(x, n).alias(f"r{n}") for n in (4, 6, 8, 12)], F.rint(F.col("l_quantity") * F.lit(0.55)).cast("int").alias("kept"))


@query("fn26_numeric", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log_q, round(least(l_quantity, 10) / 10, 6) AS capped, round(cos(l_discount) + sin(l_tax), 6) AS trig, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS norm FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return Graph(spark, sf).table("lineitem").select("l_orderkey", "l_linenumber", R(F.log1p(q)).alias("log_q"), R(F.least(q, F.lit(10.0)) / 10).alias("capped"), R(F.cos("l_discount") + F.sin("l_tax")).alias("trig"), R(F.sqrt(q * q + F.col("l_tax") * F.col("l_tax"))).alias("norm"))


#: Predictions by rule: by row, the gold, the first candidate, another one, two names, nothing or something else.
PRED_SQL = NAMED + """, pd AS (SELECT *, CASE (row_index * 7 + length(split)) % 6 WHEN 0 THEN gold WHEN 1 THEN first_name WHEN 2 THEN third WHEN 3 THEN first_name || ', ' || third || ', x' WHEN 4 THEN '' ELSE 'unknown thing' END AS pred FROM (SELECT pr.*, (SELECT name FROM nc WHERE nc.split = pr.split AND nc.row_index = pr.row_index AND pos = 1) AS first_name, (SELECT name FROM nc WHERE nc.split = pr.split AND nc.row_index = pr.row_index AND pos = 3) AS third FROM pr)),
mt AS (SELECT pd.split, pd.row_index, pd.pred, pd.gold, pd.first_name, min(CASE WHEN lower(nc.name) = lower(pred) THEN pos ELSE 100 + pos END) FILTER (pred <> '' AND (lower(nc.name) = lower(pred) OR contains(' ' || trim(regexp_replace(lower(pred), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(nc.name), '[^a-z0-9]+', ' ', 'g')) || ' '))) AS best, count(*) FILTER (pred <> '' AND contains(' ' || trim(regexp_replace(lower(pred), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(nc.name), '[^a-z0-9]+', ' ', 'g')) || ' ')) AS hits, coalesce(min(pos) FILTER (cand = gold_id), 21) AS gold_rank FROM pd JOIN nc ON nc.split = pd.split AND nc.row_index = pd.row_index GROUP BY ALL),
ev AS (SELECT *, CASE WHEN best > 100 THEN best - 100 ELSE best END AS pred_pos, pred <> '' AND lower(pred) = lower(gold) AS exact FROM mt)"""


def predictions(kg: Graph):
    p = prompts(kg)
    one, three = F.get("names", F.lit(0)), F.get("names", F.lit(2))
    n = (F.col("row_index") * 7 + F.length("split")) % 6
    pred = F.when(n == 0, F.col("gold")).when(n == 1, one).when(n == 2, three).when(n == 3, F.concat(one, F.lit(", "), three, F.lit(", x"))).when(n == 4, "").otherwise("unknown thing")
    return p.withColumn("pred", pred).withColumn("first_name", one)


def evaluated(kg: Graph):
    return store.once(kg.spark, kg.sf_dir, "evaluated", lambda: _evaluated(kg))


def _evaluated(kg: Graph):
    """Predictions with the candidate they name (exactly, else the first whose name stands in them), the gold's rank and flags."""
    c = kg.candidates().join(kg.nodes().select(F.col("id").alias("cand"), "name"), "cand")
    m = predictions(kg).select(*KEY, "pred", "gold", "first_name").join(c, KEY)
    same = F.lower("name") == F.lower("pred")
    inside = F.contains(x.alnum(F.col("pred")), x.alnum(F.col("name")))
    some = F.col("pred") != ""
    m = m.groupBy(*KEY, "pred", "gold", "first_name").agg(F.min(F.when(some & same, F.col("pos")).when(some & inside, F.col("pos") + 100)).alias("best"), F.count_if(some & inside).alias("hits"), F.coalesce(F.min(F.when(F.expr("cand = gold_id"), F.col("pos"))), F.lit(21)).alias("gold_rank"))
    return m.withColumn("pred_pos", F.when(F.col("best") > 100, F.col("best") - 100).otherwise(F.col("best"))).withColumn("exact", some & (F.lower("pred") == F.lower("gold")))


@query("e2e01_match_candidate", f"WITH {PRED_SQL} SELECT split, row_index, pred_pos, hits, exact FROM ev")
def _(spark, sf):
    return evaluated(Graph(spark, sf)).select(*KEY, "pred_pos", "hits", "exact")


#: From the rules in words: absent gold 21; the gold itself 1; no candidate, or one that is not before the gold ({op}: by places from 1 or from 0), one place down; else as it was.
ADJ = "CASE WHEN gold_rank > 20 THEN 21 WHEN exact THEN 1 WHEN pred_pos IS NOT NULL AND NOT pred_pos {op} gold_rank THEN gold_rank ELSE least(21, 1 + gold_rank) END"


@query("e2e03_adjusted_rank", f"WITH {PRED_SQL} SELECT split, row_index, {ADJ.format(op='>=')} AS rank, {ADJ.format(op='>')} AS rank_from_zero FROM ev")
def _(spark, sf):
    """Ranks of the gold after an answer: the rule that counts places from 1, and the one that holds a place from 0 against the rank."""
    e = evaluated(Graph(spark, sf))
    rank = lambda rule: x.adjusted_rank(F.col("pred_pos"), F.col("gold_rank"), F.col("exact"), rule)
    return e.select(*KEY, rank("at").alias("rank"), rank("after").alias("rank_from_zero"))


CAT = "CASE WHEN trim(pred) = '' THEN 'empty' WHEN exact THEN 'exact' WHEN pred = first_name THEN 'top1_copy' WHEN best < 100 THEN 'other_candidate' WHEN length(pred) > 120 OR length(pred) - length(replace(pred, ',', '')) >= 2 OR hits >= 3 THEN 'list_fragment' ELSE 'invalid' END"


@query("fn23_prediction_category", f"WITH {PRED_SQL} SELECT split, {CAT} AS category, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    e = evaluated(Graph(spark, sf))
    c = x.category(F.col("pred"), F.col("exact"), F.col("pred") == F.col("first_name"), F.coalesce(F.col("best") < 100, F.lit(False)), x.fragment(F.col("pred"), F.col("hits")))
    return e.groupBy("split", c.alias("category")).agg(F.count("*").alias("n"))


@query("e2e05_summary", f"""WITH {PRED_SQL}, rr AS (SELECT *, {ADJ.format(op='>')} AS r FROM ev)
SELECT split, count(*) AS n, round(avg(CASE WHEN r <= 20 THEN 1.0 / r ELSE 0 END), 12) AS mrr, round(avg((r <= 1)::INT), 12) AS hits_1, round(avg((r <= 3)::INT), 12) AS hits_3, round(avg((r <= 10)::INT), 12) AS hits_10,
round(avg((gold_rank <= 20)::INT), 12) AS gold_present, round(avg((pred_pos IS NOT NULL)::INT), 12) AS in_candidates, round(avg(exact::INT), 12) AS exact_rate, round(avg((pred_pos IS NULL)::INT), 12) AS invalid_rate, count(*) FILTER (gold_rank > 20) AS absent FROM rr GROUP BY split""")
def _(spark, sf):
    """Metrics of generated answers, to 12 places; ranks by the rule that holds places from 0 against the gold's rank."""
    e = evaluated(Graph(spark, sf)).withColumn("r", x.adjusted_rank(F.col("pred_pos"), F.col("gold_rank"), F.col("exact"), "after"))
    share = lambda c: F.round(F.avg(c.cast("double")), 12)
    hits = [share(F.col("r") <= k).alias(f"hits_{k}") for k in (1, 3, 10)]
    mrr = F.round(F.avg(F.when(F.col("r") <= 20, 1.0 / F.col("r")).otherwise(0.0)), 12)
    return e.groupBy("split").agg(F.count("*").alias("n"), mrr.alias("mrr"), *hits, share(F.col("gold_rank") <= 20).alias("gold_present"), share(F.col("pred_pos").isNotNull()).alias("in_candidates"), share(F.col("exact")).alias("exact_rate"), share(F.col("pred_pos").isNull()).alias("invalid_rate"), F.count_if(F.col("gold_rank") > 20).alias("absent"))


@query("sens05_template_variants", f"WITH {NAMED}, t(variant, template) AS (VALUES ('T0', 'Which compound treats {{}}?'), ('T1', 'Name the compound for {{}}.'), ('T2', '{{}}: which compound?'), ('T3', 'What is related to {{}}?')) SELECT split, row_index, variant, replace(template, '{{}}', qn) AS question FROM pr, t")
def _(spark, sf):
    t = spark.createDataFrame([("T0", "Which compound treats {}?"), ("T1", "Name the compound for {}."), ("T2", "{}: which compound?"), ("T3", "What is related to {}?")], "variant string, template string")
    return prompts(Graph(spark, sf)).select(*KEY, "qn").crossJoin(F.broadcast(t)).select(*KEY, "variant", F.replace("template", F.lit("{}"), "qn").alias("question"))
