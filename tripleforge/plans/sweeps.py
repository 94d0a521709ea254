"""Sweeps of support settings, seeded noise, aliases and the inventory of tables."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from ..operators import aliases, inventory, sweep
from ..operators import ranking as k
from ..sources import files, store
from ..sources.derived import Graph
from .annotated import NOTES, annotated_candidates
from .features import FEATURES, SETTINGS, features_sql, soft_ranked, support_of
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY

#: Weights of the direct penalty, of the old place and of contradictions that are tried; dominance that a choice may have, and the share of the raw mrr that it must reach.
BETAS, WEIGHTS, GAMMAS = (0.05, 0.1, 0.2, 0.35, 0.5), (0.35, 0.5, 0.65, 0.8, 0.9), (0.0, 0.1)
TOP1, RATIO = 0.7, 0.95


def swept(kg: Graph):
    def build():
        c = annotated_candidates(kg).select(*KEY, "cand", F.col("contra").cast("double").alias("x"))
        c = soft_ranked(kg).select(*KEY, "gold_id", "pos", "cand", F.col("evidence").alias("e"), F.col("penalty").alias("d")).join(c, [*KEY, "cand"])
        return sweep.swept(c, sweep.grid(BETAS, WEIGHTS, GAMMAS))

    return store.once(kg.spark, kg.sf_dir, "swept", build)


def raw_ranks(kg: Graph):
    c = kg.candidates()
    return c.groupBy(*KEY, "gold_id").agg(F.coalesce(F.min(F.when(F.col("cand") == F.col("gold_id"), F.col("pos"))), F.lit(21)).alias("rank"), F.max(F.when(F.col("pos") == 1, F.col("cand"))).alias("top"))


_VALUES = lambda name, xs: f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x in enumerate(xs))}) t(i, v))"
SWEEP = f"""{FEATURES}{NOTES}, {_VALUES('bs', BETAS)}, {_VALUES('ws', WEIGHTS)}, {_VALUES('gs', GAMMAS)},
st AS (SELECT (bs.i * {len(WEIGHTS)} + ws.i) * {len(GAMMAS)} + gs.i AS setting, bs.v AS beta, ws.v AS weight, gs.v AS gamma FROM bs, ws, gs),
s1 AS (SELECT setting, weight, split, row_index, gold_id, pos, cand, evidence - beta * penalty - gamma * contra::INT::DOUBLE AS s FROM ac, st),
s2 AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM s1 WINDOW w AS (PARTITION BY setting, split, row_index)),
s3 AS (SELECT *, weight * ((20.0::DOUBLE - pos + 1) / 20.0::DOUBLE) + (1.0::DOUBLE - weight) * CASE WHEN abs(hi - lo) < 1e-12 THEN 0.5 ELSE (s - lo) / (hi - lo) END AS f FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY setting, split, row_index ORDER BY round(f, 9) DESC, round(s, 9) DESC, pos) AS rank FROM s3),
rs AS (SELECT setting, split, row_index, coalesce(min(rank) FILTER (cand = gold_id), 21) AS rank, min(cand) FILTER (rank = 1) AS top FROM s4 GROUP BY setting, split, row_index),
sm AS (SELECT setting, split, count(*) AS n, avg(CASE WHEN rank <= 20 THEN 1.0 / rank ELSE 0 END) AS mrr, avg((rank <= 10)::INT) AS hits_10 FROM rs GROUP BY setting, split),
sd AS (SELECT setting, split, max(t) / sum(t) AS dominance FROM (SELECT setting, split, top, count(*) AS t FROM rs GROUP BY ALL) GROUP BY setting, split)"""


@query("topk08_sweep", f"WITH {SWEEP} SELECT split, beta, weight, gamma, n, round(mrr, 6) AS mrr, round(hits_10, 6) AS hits_10, round(dominance, 6) AS dominance FROM sm JOIN sd USING (setting, split) JOIN st USING (setting)")
def _(spark, sf):
    """Metrics of all settings of the direct penalty, the old place's weight and the contradiction penalty."""
    settings = spark.createDataFrame([(i, *s) for i, s in enumerate(sweep.grid(BETAS, WEIGHTS, GAMMAS))], "setting int, beta double, weight double, gamma double")
    m = sweep.metrics(swept(Graph(spark, sf)), ["split", "setting"]).join(F.broadcast(settings), "setting")
    return m.select("split", "beta", "weight", "gamma", "n", R("mrr").alias("mrr"), R("hits_10").alias("hits_10"), R("dominance").alias("dominance"))


@query("topk08_balanced_choice", f"""WITH {SWEEP}, rw AS (SELECT split, avg(CASE WHEN g <= 20 THEN 1.0 / g ELSE 0 END) AS raw FROM (SELECT split, row_index, coalesce(min(pos) FILTER (cand = gold_id), 21) AS g FROM cand GROUP BY ALL) GROUP BY split),
bal AS (SELECT *, t.top1 AS limit_, dominance <= t.top1 AND mrr >= raw * t.ratio AS balanced FROM sm JOIN sd USING (setting, split) JOIN rw USING (split), (VALUES ({TOP1}::DOUBLE, {RATIO}::DOUBLE), (0.0::DOUBLE, {RATIO}::DOUBLE)) t(top1, ratio))
SELECT limit_ AS top1_limit, split, beta, weight, gamma, round(mrr, 6) AS mrr, round(dominance, 6) AS dominance, balanced FROM bal JOIN st USING (setting) QUALIFY row_number() OVER (PARTITION BY limit_, split ORDER BY balanced DESC, round(mrr, 9) DESC, round(hits_10, 9) DESC, round(dominance, 9), setting) = 1""")
def _(spark, sf):
    """The setting chosen under both constraints; and under a limit that none can meet, where the best of all is taken."""
    kg = Graph(spark, sf)
    settings = F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(sweep.grid(BETAS, WEIGHTS, GAMMAS))], "setting int, beta double, weight double, gamma double"))
    m, raw = store.written(sweep.metrics(swept(kg), ["split", "setting"]), "sweep-metrics"), sweep.metrics(raw_ranks(kg), ["split"])
    out = [sweep.choose(m, raw, limit, RATIO, ["split"]).withColumn("top1_limit", F.lit(float(limit))) for limit in (TOP1, 0.0)]
    return out[0].unionByName(out[1]).join(settings, "setting").select("top1_limit", "split", "beta", "weight", "gamma", R("mrr").alias("mrr"), R("dominance").alias("dominance"), "balanced")


@query("gr05_support_features_wide", f"WITH {features_sql('E')} SELECT split, row_index, cand, shared, bridges, cand_genes, query_genes, round(evidence, 6) AS evidence, round(penalty, 6) AS penalty, round(support, 6) AS support FROM soft")
def _(spark, sf):
    """Support features by the constants of setting E: fewer query genes, more bridges, another norm."""
    kg = Graph(spark, sf)
    return support_of(kg, kg.candidates(), SETTINGS["E"]).select(*KEY, "cand", "shared", "bridges", "cand_genes", "query_genes", R("evidence").alias("evidence"), R("penalty").alias("penalty"), R("support").alias("support"))


#: What the seed of a row's noise has from its split.
OFFSETS = {"train": 0, "valid": 100_000, "test": 200_000}


@query("sens01_seeded_noise")
def _(spark, sf):
    """Support with the noise of a generator of its own for every row, seeded by seed, split and row; drawn in the order of the candidates. Equal to the standard generator's numbers, which tests hold against a loop."""
    rows = soft_ranked(Graph(spark, sf)).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "cand", "support"))).alias("c"))

    def noise(split: pd.Series, row: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for s, r, m in zip(split, row, n, strict=True):
            draw = random.Random(2026 + OFFSETS.get(s, 0) + int(r))
            out.append([draw.gauss(0.0, 0.05) for _ in range(m)])
        return pd.Series(out)

    drawn = F.pandas_udf(noise, "array<double>")("split", "row_index", F.size("c"))
    each = rows.withColumn("e", drawn).select(*KEY, F.explode(F.zip_with("c", "e", lambda c, e: F.struct(c["pos"].alias("pos"), c["cand"].alias("cand"), e.alias("noise"), (c["support"] + e).alias("noisy")))).alias("x")).select(*KEY, "x.*")
    return k.rank_by(each, F.desc("noisy"), "pos").select(*KEY, "cand", "noise", "noisy", "rank")


#: Entities of another source: some diseases under one of three names, some under a name that others share.
ENTITIES = """en AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Disease::UMLS:C' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 1 THEN 'Disease::C' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 2 THEN 'C' || lpad(c_custkey::VARCHAR, 7, '0') END AS entity FROM customer WHERE c_custkey % 4 < 3
UNION ALL SELECT 'Disease::C' || lpad(c_custkey::VARCHAR, 7, '0') FROM customer WHERE c_custkey % 20 = 0)"""


def probed(kg: Graph):
    """(names, entities): diseases by identifier, and the entities of the other source."""
    cui = F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    c = kg.table("customer")
    form = F.col("c_custkey") % 4
    entity = F.when(form == 0, F.concat(F.lit("Disease::UMLS:"), cui)).when(form == 1, F.concat(F.lit("Disease::"), cui)).when(form == 2, cui)
    entities = c.where("c_custkey % 4 < 3").select(entity.alias("entity")).unionByName(c.where("c_custkey % 20 = 0").select(F.concat(F.lit("Disease::"), cui).alias("entity")))
    return c.select(F.concat(F.lit("Disease::UMLS:"), cui).alias("name")), entities


def alias_forms(c: str) -> list:
    """The full name, the name without its source, and the bare identifier."""
    bare = F.element_at(F.split(F.col(c), "Disease::UMLS:"), -1)
    return [("full", F.concat(F.lit("Disease::UMLS:"), bare)), ("short", F.concat(F.lit("Disease::"), bare)), ("bare", bare)]


@query("jn18_alias_resolution", f"""WITH {ENTITIES}, nm AS (SELECT 'Disease::UMLS:C' || lpad(c_custkey::VARCHAR, 7, '0') AS name, 'C' || lpad(c_custkey::VARCHAR, 7, '0') AS b FROM customer),
hit AS (SELECT name, 0 AS place, 'full' AS form, entity FROM nm JOIN en ON entity = 'Disease::UMLS:' || b UNION ALL SELECT name, 1, 'short', entity FROM nm JOIN en ON entity = 'Disease::' || b UNION ALL SELECT name, 2, 'bare', entity FROM nm JOIN en ON entity = b)
SELECT nm.name, arg_min(entity, place) AS entity, arg_min(form, place) AS form, count(entity) AS hits, false AS ambiguous, coalesce(count(DISTINCT entity) > 1, false) AS disagree FROM nm LEFT JOIN hit USING (name) GROUP BY nm.name""")
def _(spark, sf):
    """Diseases found among the entities of another source by three forms of their identifier; the first form that hits decides."""
    names, entities = probed(Graph(spark, sf))
    return aliases.resolve(names, alias_forms("name"), aliases.index(entities, [("whole", F.col("entity"))]))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS tab, col, count(*) AS n_rows, count(*) FILTER (coalesce(trim(v), '') = '') AS blanks, count(*) FILTER (regexp_matches(trim(v), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')) AS numbers FROM (SELECT COLUMNS(*)::VARCHAR FROM {t}) UNPIVOT INCLUDE NULLS (v FOR col IN (COLUMNS(*))) GROUP BY col" for t in TABLES)


def profiled(kg: Graph):
    """Profiles of the tables of a folder, whatever they are; a table is a Parquet file or folder."""
    def build():
        out = None
        for name in files.tables_in(kg.spark, kg.sf_dir):
            one = inventory.profiles(kg.table(name), name)
            out = one if out is None else out.unionByName(one)
        return out

    return store.once(kg.spark, kg.sf_dir, "profiles", build)


@query("src15_column_profiles", f"SELECT tab, col, n_rows, blanks, numbers FROM ({_PROFILE})")
def _(spark, sf):
    """Rows, blank values and numbers of every column of the tables in the folder, each read once."""
    return profiled(Graph(spark, sf)).select("tab", "col", "n_rows", "blanks", "numbers")


@query("agg25_table_inventory", f"""WITH p AS ({_PROFILE}), ro(part, role, points) AS (VALUES ('status', 'status', 10), ('phase', 'phase', 2), ('drugbank', 'drugbank_id', 8), ('drugcentral', 'drugcentral_id', 4), ('drug', 'drug_name', 4), ('compound', 'drug_name', 4), ('umls', 'umls', 8), ('disease', 'disease_name', 4), ('indication', 'indication', 4), ('nct', 'nct', 0)),
r AS (SELECT DISTINCT tab, role, CASE WHEN role IN ('disease_name', 'indication') THEN 'x' ELSE role END AS g, points FROM p JOIN ro ON contains(lower(col), part)), s AS (SELECT tab, sum(points) AS points, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT tab, role, CASE WHEN row_number() OVER (PARTITION BY tab, g) = 1 THEN points ELSE 0 END AS points FROM r) GROUP BY tab),
t AS (SELECT tab, max(n_rows) AS n_rows, count(*) AS n_cols FROM p GROUP BY tab), u AS (SELECT t.*, coalesce(roles, '') AS roles, least(n_rows / 1000.0, 20.0) + least(n_cols / 10.0, 5.0) + coalesce(points, 0) AS score FROM t LEFT JOIN s USING (tab))
SELECT tab, n_rows, n_cols, roles, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, tab) = 1 AS best FROM u""")
def _(spark, sf):
    """The folder's tables with the roles that their columns' names show, their score, and which one is best."""
    return inventory.tables(profiled(Graph(spark, sf))).select("tab", "n_rows", F.col("n_cols").cast("long").alias("n_cols"), F.array_join("roles", ",").alias("roles"), R("score").alias("score"), "best")
