"""Choice of variants and settings, comparisons of rankings and tables, case mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choice as ch
from ..operators import ranking as k
from ..operators import text as x
from ..sources import store
from ..sources.derived import SQL, Graph
from .evidence import scored, subgraph_sql
from .features import FEATURES, soft_ranked
from .metrics import RANKS_SQL, both_ranks
from .registry import query
from .texts import ADJ, PRED_SQL, evaluated

R = lambda c: F.round(c, 6)
KEY = k.KEY

#: Metrics of the raw ranking, the soft one and blends of both, in one table.
WEIGHTS = (0.0, 0.35, 0.65, 1.0)
VARIANTS_SQL = f"""WITH {FEATURES}, v(variant, weight) AS (VALUES ('w0', 0.0), ('w35', 0.35), ('w65', 0.65), ('w100', 1.0)),
bl AS (SELECT variant, soft.*, row_number() OVER (PARTITION BY variant, split, row_index ORDER BY round(weight * (20 - pos + 1) / 20.0::DOUBLE + (1 - weight) * support::DOUBLE, 9) DESC, pos) AS rank FROM soft, v),
rk AS (SELECT variant, split, row_index, coalesce(min(rank) FILTER (cand = gold_id), 21) AS gold_rank, min_by(cand, rank) AS top, avg(direct) FILTER (rank <= 5) AS direct5, coalesce(min(pos) FILTER (cand = gold_id), 21) AS base_rank FROM bl GROUP BY ALL),
tp AS (SELECT variant, split, max(n) / sum(n) AS dominance FROM (SELECT variant, split, top, count(*) AS n FROM rk GROUP BY ALL) GROUP BY ALL),
vm AS (SELECT variant, split, round(avg(CASE WHEN gold_rank <= 20 THEN 1.0 / gold_rank ELSE 0 END), 9) AS mrr, round(avg((gold_rank <= 10)::INT), 9) AS hits_10, round(avg(direct5), 9) AS direct_rate, count(*) FILTER (gold_rank > base_rank) AS worsened, round(any_value(dominance), 9) AS dominance FROM rk JOIN tp USING (variant, split) GROUP BY ALL)"""


def variants(kg: Graph):
    """(variant, split, mrr, hits_10, direct_rate, worsened, dominance) of blends of the raw place and the support."""
    def build():
        w = kg.spark.createDataFrame([(f"w{round(100 * v)}", v) for v in WEIGHTS], "variant string, weight double")
        s = soft_ranked(kg).crossJoin(F.broadcast(w))
        score = F.round(F.col("weight") * (20 - F.col("pos") + 1) / 20.0 + (1 - F.col("weight")) * F.col("support"), 9)
        s = k.rank_by(s.withColumn("final", score), F.desc("final"), "pos", key=["variant", *KEY])
        gold = F.col("cand") == F.col("gold_id")
        r = s.groupBy("variant", *KEY).agg(F.coalesce(F.min(F.when(gold, F.col("rank"))), F.lit(21)).alias("gold_rank"), F.min_by("cand", "rank").alias("top"), F.avg(F.when(F.col("rank") <= 5, F.col("direct"))).alias("direct5"), F.coalesce(F.min(F.when(gold, F.col("pos"))), F.lit(21)).alias("base_rank"))
        tops = r.groupBy("variant", "split", "top").agg(F.count("*").alias("n")).groupBy("variant", "split").agg(F.round(F.max("n") / F.sum("n"), 9).alias("dominance"))
        m = r.groupBy("variant", "split").agg(F.round(F.avg(F.when(F.col("gold_rank") <= 20, 1.0 / F.col("gold_rank")).otherwise(0.0)), 9).alias("mrr"), F.round(F.avg((F.col("gold_rank") <= 10).cast("double")), 9).alias("hits_10"), F.round(F.avg("direct5"), 9).alias("direct_rate"), F.count_if(F.expr("gold_rank > base_rank")).alias("worsened"))
        return m.join(tops, ["variant", "split"])

    return store.once(kg.spark, kg.sf_dir, "variants", build)


@query("topk09_main_variant", VARIANTS_SQL + ", p AS (SELECT vm.*, b.mrr AS base FROM vm JOIN vm b ON b.variant = 'w100' AND b.split = vm.split) SELECT variant, round(mrr, 6) AS mrr, round(direct_rate, 6) AS direct_rate FROM p WHERE split = 'valid' AND mrr >= base - 0.001 ORDER BY direct_rate, worsened, dominance, variant, -mrr LIMIT 1")
def _(spark, sf):
    """The variant of least shortcuts among those that lose no more than a thousandth of the reference's reciprocal rank; five keys decide."""
    v = variants(Graph(spark, sf)).where("split = 'valid'")
    v = ch.versus(v, "variant", "w100", ["split"], ["mrr"])
    best = ch.first_eligible(v, F.col("delta_mrr") >= -0.001, ["direct_rate", "worsened", "dominance", "variant", F.desc("mrr")])
    return best.select("variant", R("mrr").alias("mrr"), R("direct_rate").alias("direct_rate"))


@query("topk10_decoding_choice", VARIANTS_SQL + " SELECT variant, round(mrr, 6) AS mrr, dominance <= 0.9 AS eligible FROM vm WHERE split = 'valid' ORDER BY dominance <= 0.9 DESC, mrr DESC, worsened, hits_10 DESC, direct_rate, variant LIMIT 1")
def _(spark, sf):
    """The best setting by four keys, of those whose answers do not collapse to one; of all, where all do."""
    v = variants(Graph(spark, sf)).where("split = 'valid'")
    best = ch.first_eligible(v, F.col("dominance") <= 0.9, [F.desc("mrr"), "worsened", F.desc("hits_10"), "direct_rate", "variant"], strict=False)
    return best.select("variant", R("mrr").alias("mrr"), "eligible")


@query("topk11_named_variant", VARIANTS_SQL + " SELECT split, round(mrr, 6) AS mrr FROM vm WHERE variant = 'w35'")
def _(spark, sf):
    """The metrics of a variant that a configuration names."""
    return variants(Graph(spark, sf)).where("variant = 'w35'").select("split", R("mrr").alias("mrr"))


@query("topk12_source_choice", VARIANTS_SQL + " SELECT v.variant AS requested, round(v.mrr, 6) AS requested_mrr, (SELECT variant FROM vm WHERE split = 'valid' ORDER BY mrr DESC, variant LIMIT 1) AS best_valid, (SELECT variant FROM vm WHERE split = 'test' ORDER BY mrr DESC, variant LIMIT 1) AS best_test, 'SOURCE_SELECTED' AS decision FROM vm v WHERE v.split = 'test' AND v.variant = 'w35'")
def _(spark, sf):
    """The requested source with the best ones of either split beside it."""
    v = variants(Graph(spark, sf))
    best = v.groupBy().agg(*[F.min_by("variant", F.when(F.col("split") == s, F.struct((-F.col("mrr")).alias("m"), "variant"))).alias(f"best_{s}") for s in ("valid", "test")])
    own = v.where("split = 'test' and variant = 'w35'").select(F.col("variant").alias("requested"), R("mrr").alias("requested_mrr"))
    return own.crossJoin(best).withColumn("decision", F.lit("SOURCE_SELECTED"))


@query("cmp01_change_rates", f"WITH {FEATURES}, {RANKS_SQL}, p AS (SELECT a.split, a.row_index, a.gold_rank AS a, b.gold_rank AS b FROM gr a JOIN gr b ON a.split = b.split AND a.row_index = b.row_index WHERE a.row_name = 'raw' AND b.row_name = 'soft'), o AS (SELECT split, row_index, bool_or(pos <> soft_rank) AS moved FROM soft GROUP BY ALL) SELECT split, round(avg(moved::INT), 6) AS order_changed, count(*) FILTER (b < a) AS improved, count(*) FILTER (b > a) AS worsened, count(*) FILTER (a = b) AS unchanged FROM p JOIN o USING (split, row_index) GROUP BY split")
def _(spark, sf):
    kg = Graph(spark, sf)
    ranks = both_ranks(kg).groupBy(*KEY).pivot("row_name", ["raw", "soft"]).agg(F.min("gold_rank"))
    moved = soft_ranked(kg).groupBy(*KEY).agg(F.bool_or(F.col("pos") != F.col("soft_rank")).alias("moved"))
    j = ranks.join(moved, KEY)
    return j.groupBy("split").agg(R(F.avg(F.col("moved").cast("double"))).alias("order_changed"), F.count_if(F.expr("soft < raw")).alias("improved"), F.count_if(F.expr("soft > raw")).alias("worsened"), F.count_if(F.expr("soft = raw")).alias("unchanged"))


@query("cmp04_prediction_changes", f"WITH {PRED_SQL}, t AS (SELECT split, row_index, v AS variant, CASE WHEN (row_index + v) % 4 = 0 THEN first_name WHEN v = 0 THEN pred ELSE upper(pred) END AS p FROM ev, range(4) r(v)) SELECT split, variant, round(avg((lower(p) <> lower(base))::INT), 6) AS change_rate FROM (SELECT t.*, b.p AS base FROM t JOIN t b ON b.split = t.split AND b.row_index = t.row_index AND b.variant = 0) GROUP BY split, variant")
def _(spark, sf):
    """How often a template's answer differs from the canonical template's, once both are normalised."""
    e = evaluated(Graph(spark, sf)).withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    p = F.when((F.col("row_index") + F.col("variant")) % 4 == 0, F.col("first_name")).when(F.col("variant") == 0, F.col("pred")).otherwise(F.upper("pred"))
    t = e.select(*KEY, "variant", F.lower(p).alias("p"))
    base = t.where("variant = 0").select(*KEY, F.col("p").alias("base"))
    return t.join(base, KEY).groupBy("split", "variant").agg(R(F.avg((F.col("p") != F.col("base")).cast("double"))).alias("change_rate"))


@query("cmp05_metric_equality", VARIANTS_SQL + " SELECT a.variant, a.split, abs(a.mrr - b.mrr) < 1e-12 AND abs(a.hits_10 - b.hits_10) < 1e-12 AS equal FROM vm a JOIN vm b ON b.variant = 'w100' AND b.split = a.split")
def _(spark, sf):
    v = variants(Graph(spark, sf))
    base = v.where("variant = 'w100'").drop("variant").crossJoin(v.select("variant").distinct())
    return ch.equal_metrics(v, base, ["variant", "split"], ["mrr", "hits_10"])


CASES = f"WITH {FEATURES}, {RANKS_SQL}, p AS (SELECT split, row_index, min(gold_rank) FILTER (row_name = 'raw') AS a, min(gold_rank) FILTER (row_name = 'soft') AS b FROM gr GROUP BY ALL), d AS (SELECT split, row_index, max(direct) FILTER (soft_rank = 1) AS d FROM soft GROUP BY ALL), c AS (SELECT *, unnest(list_filter([CASE WHEN b < a THEN 'improved' END, CASE WHEN b > a THEN 'worsened' END, CASE WHEN a = b AND a <= 20 THEN 'kept' END, CASE WHEN b = 21 THEN 'absent' END, CASE WHEN d = 1 THEN 'shortcut' END], lambda x: x IS NOT NULL)) AS bucket FROM p JOIN d USING (split, row_index))"


@query("cmp06_case_buckets", CASES + " SELECT bucket, split, row_index, row_number() OVER (PARTITION BY bucket ORDER BY a - b DESC, split, row_index) AS place FROM c QUALIFY place <= 15")
def _(spark, sf):
    """Cases by what happened to the gold; a case may be in several buckets, 15 to each, the largest gains first."""
    kg = Graph(spark, sf)
    p = both_ranks(kg).groupBy(*KEY).pivot("row_name", ["raw", "soft"]).agg(F.min("gold_rank"))
    p = p.join(soft_ranked(kg).where("soft_rank = 1").select(*KEY, "direct"), KEY)
    buckets = {"improved": F.expr("soft < raw"), "worsened": F.expr("soft > raw"), "kept": F.expr("soft = raw and raw <= 20"), "absent": F.expr("soft = 21"), "shortcut": F.expr("direct = 1")}
    return ch.bucketed(p, buckets, [F.desc(F.col("raw") - F.col("soft")), "split", "row_index"], 15).select("bucket", *KEY, "place")


@query("cmp07_ablation_deltas", VARIANTS_SQL + " SELECT a.variant, a.split, round(a.mrr - b.mrr, 6) AS delta_mrr, round(a.hits_10 - b.hits_10, 6) AS delta_hits_10, round(a.dominance - b.dominance, 6) AS delta_dominance, abs(a.mrr - b.mrr) < 1e-12 AND abs(a.hits_10 - b.hits_10) < 1e-12 AS ranking_preserved FROM vm a JOIN vm b ON b.variant = 'w100' AND b.split = a.split")
def _(spark, sf):
    v = ch.versus(variants(Graph(spark, sf)), "variant", "w100", ["split"], ["mrr", "hits_10", "dominance"])
    same = (F.abs("delta_mrr") < 1e-12) & (F.abs("delta_hits_10") < 1e-12)
    return v.select("variant", "split", *[R(f"delta_{c}").alias(f"delta_{c}") for c in ("mrr", "hits_10", "dominance")], same.alias("ranking_preserved"))


STRICT = "CASE WHEN exact AND gold_rank <= 20 THEN 1 WHEN gold_rank > 20 THEN 21 WHEN pred_pos IS NULL OR pred_pos < gold_rank THEN least(21, gold_rank + 1) ELSE gold_rank END"


@query("e2e04_strict_rank", f"WITH {PRED_SQL} SELECT split, row_index, {STRICT} AS rank, round(CASE WHEN exact AND gold_rank <= 20 THEN 1.0 WHEN {STRICT} <= 20 THEN 1.0 / {STRICT} ELSE 0 END, 6) AS rr, (exact AND gold_rank <= 20)::INT AS strict_rr FROM ev")
def _(spark, sf):
    """Rank of the gold by the second rule set: an answer before it, or none at all, costs a place; the strict reciprocal rank counts exact answers only."""
    e = evaluated(Graph(spark, sf)).withColumn("rank", x.strict_rank(F.col("pred_pos"), F.col("gold_rank"), F.col("exact")))
    right = F.col("exact") & (F.col("gold_rank") <= 20)
    return e.select(*KEY, "rank", R(F.when(F.col("rank") <= 20, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), right.cast("int").alias("strict_rr"))


@query("e2e06_inference_rank", f"WITH {PRED_SQL} SELECT ev.split, ev.row_index, CASE WHEN pred = gold THEN 1 WHEN p.pos IS NULL OR p.pos - 1 >= gold_rank THEN gold_rank + 1 ELSE gold_rank END AS rank FROM ev LEFT JOIN (SELECT split, row_index, name, min(pos) AS pos FROM nc GROUP BY ALL) p ON p.split = ev.split AND p.row_index = ev.row_index AND p.name = ev.pred")
def _(spark, sf):
    """The rank that inference writes: 1 for the target itself; one more where the answer is no candidate or stands after the gold's place. An absent gold can get 22."""
    kg = Graph(spark, sf)
    c = kg.candidates().join(kg.nodes().select(F.col("id").alias("cand"), F.col("name").alias("pred")), "cand").groupBy(*KEY, "pred").agg(F.min("pos").alias("place"))
    e = evaluated(kg).join(c, [*KEY, "pred"], "left")
    return e.select(*KEY, x.inference_rank(F.col("pred") == F.col("gold"), F.col("place"), F.col("gold_rank")).alias("rank"))


@query("e2e02_tiered_match", f"WITH {PRED_SQL}, n2 AS (SELECT nc.*, 'Compound::' || cand AS canonical FROM nc), p2 AS (SELECT split, row_index, CASE WHEN row_index % 3 = 0 THEN 'Answer: ' || pred || '.' WHEN row_index % 3 = 1 THEN 'Compound::' || (SELECT cand FROM nc WHERE nc.split = ev.split AND nc.row_index = ev.row_index AND pos = 2) ELSE 'perhaps compound::' || (SELECT cand FROM nc WHERE nc.split = ev.split AND nc.row_index = ev.row_index AND pos = 4) || ' it is' END AS raw FROM ev), a2 AS (SELECT *, trim(regexp_replace(lower(raw), '.*answer:', ''), ' .') AS ans FROM p2), t2 AS (SELECT a2.split, a2.row_index, min((CASE WHEN ans = lower(name) THEN 1 WHEN ans = lower(canonical) THEN 2 WHEN contains(' ' || trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ') THEN 3 WHEN contains(' ' || trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(canonical), '[^a-z0-9]+', ' ', 'g')) || ' ') THEN 4 ELSE 9 END, pos)) AS m FROM a2 JOIN n2 ON n2.split = a2.split AND n2.row_index = a2.row_index GROUP BY ALL) SELECT split, row_index, CASE WHEN m[1] < 9 THEN m[1] END AS tier, CASE WHEN m[1] < 9 THEN m[2] ELSE 21 END AS pos FROM t2")
def _(spark, sf):
    """The candidate an answer names: by its shown name, by its canonical id, else contained in the answer in that order; 21 without any."""
    kg = Graph(spark, sf)
    c = kg.candidates().join(kg.nodes().select(F.col("id").alias("cand"), "name"), "cand").withColumn("canonical", F.concat(F.lit("Compound::"), F.col("cand").cast("string")))
    at = lambda n: c.where(F.col("pos") == n).select(*KEY, F.col("cand").cast("string").alias(f"c{n}"))
    n = F.col("row_index") % 3
    raw = F.when(n == 0, F.concat(F.lit("Answer: "), "pred", F.lit("."))).when(n == 1, F.concat(F.lit("Compound::"), "c2")).otherwise(F.concat(F.lit("perhaps compound::"), "c4", F.lit(" it is")))
    p = evaluated(kg).join(at(2), KEY, "left").join(at(4), KEY, "left").select(*KEY, raw.alias("raw"))
    return x.tiered_match(p, c, KEY)


@query("e2e07_variant_summaries", f"""WITH {PRED_SQL}, rr AS (SELECT *, {ADJ.format(op='>=')} AS r, row_index % 3 AS variant FROM ev)
SELECT split, variant, count(*) AS n, round(avg((gold_rank <= 20)::INT), 6) AS gold_at_20, round(avg(CASE WHEN gold_rank <= 20 THEN 1.0 / gold_rank ELSE 0 END), 6) AS candidate_mrr, round(avg(CASE WHEN r <= 20 THEN 1.0 / r ELSE 0 END), 6) AS mrr, round(avg((r <= 1)::INT), 6) AS hits_1, round(avg((r <= 3)::INT), 6) AS hits_3, round(avg((r <= 10)::INT), 6) AS hits_10,
count(*) FILTER (gold_rank > 20) AS absent_before, count(*) FILTER (r > 20) AS absent_after, round(avg(exact::INT), 6) AS exact_rate, round(avg((pred_pos IS NULL)::INT), 6) AS invalid_rate, round(avg(coalesce(pred_pos = 1, false)::INT), 6) AS top1_copy FROM rr GROUP BY split, variant""")
def _(spark, sf):
    """Metrics of candidates and of answers for each variant of rules, noise or templates."""
    e = evaluated(Graph(spark, sf)).withColumn("variant", F.col("row_index") % 3).withColumn("r", x.adjusted_rank(F.col("pred_pos"), F.col("gold_rank"), F.col("exact")))
    share = lambda c: R(F.avg(c.cast("double")))
    rr = lambda c: R(F.avg(F.when(F.col(c) <= 20, 1.0 / F.col(c)).otherwise(0.0)))
    hits = [share(F.col("r") <= k).alias(f"hits_{k}") for k in (1, 3, 10)]
    return e.groupBy("split", "variant").agg(F.count("*").alias("n"), share(F.col("gold_rank") <= 20).alias("gold_at_20"), rr("gold_rank").alias("candidate_mrr"), rr("r").alias("mrr"), *hits, F.count_if(F.col("gold_rank") > 20).alias("absent_before"), F.count_if(F.col("r") > 20).alias("absent_after"), share(F.col("exact")).alias("exact_rate"), share(F.col("pred_pos").isNull()).alias("invalid_rate"), share(F.coalesce(F.col("pred_pos") == 1, F.lit(False))).alias("top1_copy"))


@query("agg05_candidate_ceiling", f"WITH {PRED_SQL} SELECT split, count(*) AS n, round(avg((gold_rank <= 20)::INT), 6) AS ceiling, round(avg((pred_pos IS NOT NULL)::INT), 6) AS in_candidates, round(avg((pred_pos IS NULL)::INT), 6) AS invalid, round(avg((pred_pos = 1)::INT), 6) AS top1_copy, round(avg((trim(pred) = '')::INT), 6) AS empty, round(avg(exact::INT) / nullif(avg((gold_rank <= 20)::INT), 0), 6) AS of_ceiling FROM (SELECT * REPLACE (coalesce(pred_pos, NULL) AS pred_pos), FROM ev) GROUP BY split")
def _(spark, sf):
    """What answers reach of what their candidate lists allow."""
    e = evaluated(Graph(spark, sf))
    rate = lambda c: F.avg(c.cast("double"))
    top = rate(F.col("gold_rank") <= 20)
    return e.groupBy("split").agg(F.count("*").alias("n"), R(top).alias("ceiling"), R(rate(F.col("pred_pos").isNotNull())).alias("in_candidates"), R(rate(F.col("pred_pos").isNull())).alias("invalid"), R(rate(F.col("pred_pos") == 1)).alias("top1_copy"), R(rate(F.trim("pred") == "")).alias("empty"), R(F.try_divide(rate(F.col("exact")), top)).alias("of_ceiling"))


@query("sens04_rule_variants", f"WITH {subgraph_sql()}, v(variant) AS (VALUES ('main'), ('none'), ('random')), x AS (SELECT variant, sub.*, CASE variant WHEN 'none' THEN 0 ELSE 1 END AS keep FROM sub, v), m AS (SELECT *, row_number() OVER (PARTITION BY variant, split, row_index ORDER BY CASE WHEN variant = 'random' THEN md5(split || ':' || row_index || ':' || idx) ELSE lpad(idx::VARCHAR, 6, '0') END) AS n FROM x WHERE keep = 1) SELECT variant, split, row_index, idx, n FROM m WHERE variant = 'main' OR n <= 20")
def _(spark, sf):
    """Evidence by rule: all of it, none of it, or 20 triples drawn by a hash as the control."""
    f = scored(Graph(spark, sf))[0].select(*KEY, "idx")
    v = spark.createDataFrame([("main",), ("none",), ("random",)], "variant string")
    rows = f.crossJoin(F.broadcast(v)).where("variant <> 'none'")
    order = F.when(F.col("variant") == "random", F.md5(F.concat_ws(":", "split", F.col("row_index").cast("string"), F.col("idx").cast("string")).cast("binary"))).otherwise(F.lpad(F.col("idx").cast("string"), 6, "0"))
    return k.rank_by(rows.withColumn("o", order), "o", name="n", key=["variant", *KEY]).where("variant = 'main' or n <= 20").select("variant", *KEY, "idx", "n")


@query("sens06_noise_configs", f"WITH {FEATURES}, v(config, std, dropout) AS (VALUES ('N0', 0.0, 0), ('N1', 0.05, 0), ('N2', 0.1, 0), ('N3', 0.0, 10), ('N4', 0.0, 30), ('N5', 0.05, 10), ('N6', 0.1, 30)), n AS (SELECT config, dropout, soft.*, round(support + std * (('0x' || substr(md5(config || ':' || split || ':' || row_index || ':' || cand), 1, 6))::INT / 16777215.0::DOUBLE - 0.5), 9) AS noisy, ('0x' || substr(md5('d' || ':' || config || ':' || split || ':' || row_index || ':' || cand), 1, 6))::INT % 100 AS draw FROM soft, v), r AS (SELECT *, row_number() OVER (PARTITION BY config, split, row_index ORDER BY noisy DESC, pos) AS rank FROM n WHERE draw >= dropout) SELECT config, split, count(*) AS n, round(avg(CASE WHEN cand = gold_id THEN 1.0 / rank END), 6) AS mrr_present FROM r GROUP BY ALL")
def _(spark, sf):
    """Each noise setting over all rows: supports moved by a hash within +-std/2, a share of candidates dropped by another."""
    configs = spark.createDataFrame([("N0", 0.0, 0), ("N1", 0.05, 0), ("N2", 0.1, 0), ("N3", 0.0, 10), ("N4", 0.0, 30), ("N5", 0.05, 10), ("N6", 0.1, 30)], "config string, std double, dropout int")
    s = soft_ranked(Graph(spark, sf)).crossJoin(F.broadcast(configs))
    key = [F.col("config"), F.col("split"), F.col("row_index").cast("string"), F.col("cand").cast("string")]
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 6), 16, 10).cast("long")
    s = s.withColumn("noisy", F.round(F.col("support") + F.col("std") * (number(*key) / 16777215.0 - 0.5), 9)).where(number(F.lit("d"), *key) % 100 >= F.col("dropout"))
    r = k.rank_by(s, F.desc("noisy"), "pos", key=["config", *KEY])
    return r.groupBy("config", "split").agg(F.count("*").alias("n"), R(F.avg(F.when(F.col("cand") == F.col("gold_id"), 1.0 / F.col("rank")))).alias("mrr_present"))
