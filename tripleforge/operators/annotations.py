"""Flags from annotation lists, brought to candidates and to the triples that touch them, and back to candidates as a bonus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import KEY, band_weight

#: Texts that count as true.
TRUE = ("1", "true", "yes", "y")


def truth(flag: Column, kind: str) -> Column:
    """Whether a flag of a type (string, boolean or a number) is set: a text that counts as true, any number but 0; false for null."""
    return F.coalesce(F.lower(F.trim(flag)).isin(*TRUE) if kind == "string" else flag.cast("boolean"), F.lit(False))


def aligned(cands: DataFrame, notes: DataFrame, mode: str = "name", fallback: Column | None = None) -> DataFrame:
    """cands (KEY, pos, name, ..) with contra, from notes (KEY, pos, name, flag) in an order of their own.

    name: the last note of the candidate's name; false without one. position: the note at the candidate's place, in rows with as many notes as candidates; in others
    `fallback`, a column of cands (false).
    """
    kind = notes.schema["flag"].dataType.simpleString()
    if mode == "name":
        by = notes.groupBy(*KEY, "name").agg(F.max_by("flag", "pos").alias("flag"))
        return cands.join(by, [*KEY, "name"], "left").withColumn("contra", truth(F.col("flag"), kind)).drop("flag")
    if mode != "position":
        raise ValueError(f"mode must be name or position, not {mode}")
    sizes = cands.groupBy(*KEY).agg(F.count("*").alias("n")).join(notes.groupBy(*KEY).agg(F.count("*").alias("m")), KEY, "left").select(*KEY, F.coalesce(F.col("n") == F.col("m"), F.lit(False)).alias("fits"))
    out = cands.join(sizes, KEY).join(notes.select(*KEY, "pos", "flag"), [*KEY, "pos"], "left")
    return out.withColumn("contra", F.when(F.col("fits"), truth(F.col("flag"), kind)).otherwise(F.lit(False) if fallback is None else fallback)).drop("fits", "flag")


def annotate(triples: DataFrame, cands: DataFrame, rules: DataFrame, query_kind: str, cand_kind: str, twice: bool = False) -> DataFrame:
    """triples (KEY, query_id, idx, h, r, t) with what they touch: positions (of the candidates at head and tail; a self-loop's one only once, or `twice`), best_rank, touches_query, touches_candidate, top_band,
    direct, contra, ontology, frequency, density.

    cands: KEY, cand, pos, rank (by support), contra. rules: r, domain, range. ontology is null where the relation has no full rule or an end is neither the query nor a candidate, as then its kind is not known. frequency counts equal
    triples, density how often the ends are ends of any of the row's triples.
    """
    side = lambda c: cands.select(*KEY, F.col("cand").alias(c), F.col("pos").alias(f"pos_{c}"), F.col("rank").alias(f"rank_{c}"), F.col("contra").alias(f"contra_{c}"))
    degree = triples.select(*KEY, F.explode(F.array("h", "t")).alias("node")).groupBy(*KEY, "node").agg(F.count("*").alias("n"))
    ends = lambda c: degree.select(*KEY, F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    out = triples.join(side("h"), [*KEY, "h"], "left").join(side("t"), [*KEY, "t"], "left").join(ends("h"), [*KEY, "h"]).join(ends("t"), [*KEY, "t"]).join(F.broadcast(rules.select("r", "domain", "range")), "r", "left")
    at = F.array_compact(F.array("pos_h", "pos_t"))
    if not twice:
        at = F.when(F.col("h") == F.col("t"), F.slice(at, 1, 1)).otherwise(at)
    kind = lambda c: F.when(F.col(c) == F.col("query_id"), F.lit(query_kind)).when(F.col(f"pos_{c}").isNotNull(), F.lit(cand_kind))
    query = (F.col("h") == F.col("query_id")) | (F.col("t") == F.col("query_id"))
    touches = F.col("pos_h").isNotNull() | F.col("pos_t").isNotNull()
    best = F.least("rank_h", "rank_t")
    same = F.count("*").over(Window.partitionBy(*KEY, "h", "r", "t"))
    known = kind("h").isNotNull() & kind("t").isNotNull() & F.col("domain").isNotNull() & F.col("range").isNotNull()
    contra = F.coalesce("contra_h", F.lit(False)) | F.coalesce("contra_t", F.lit(False))
    return out.select(
        *KEY, "query_id", "idx", "h", "r", "t", at.alias("positions"), best.alias("best_rank"), query.alias("touches_query"), touches.alias("touches_candidate"),
        F.coalesce(best <= 5, F.lit(False)).alias("top_band"), (query & touches).alias("direct"), contra.alias("contra"), F.when(known, (kind("h") == F.col("domain")) & (kind("t") == F.col("range"))).alias("ontology"),
        same.alias("frequency"), (F.col("n_h") + F.col("n_t")).alias("density"),
    )


def score(weights: dict | None = None) -> Column:
    """Band of the best candidate touched, touch, query, density, less direct and contra; to 6 places, before any rank."""
    w = {"touch": 0.35, "query": 0.05, "direct": -0.8, "contra": -0.1, "density": 0.05} | (weights or {})
    one = lambda c: F.col(c).cast("int")
    band = F.when(F.col("touches_candidate"), band_weight(F.col("best_rank"))).otherwise(0.0)
    return F.bround(band + w["touch"] * one("touches_candidate") + w["query"] * one("touches_query") + w["direct"] * one("direct") + w["contra"] * one("contra") + w["density"] * F.least(F.col("density"), F.lit(10)) / 10.0, 6)


def touched(annotated: DataFrame) -> DataFrame:
    """(KEY, pos, bonus, direct) of candidates that triples (with score) touch: the best score as a share of the row's best, 0 at least, and whether one of them is direct."""
    top = F.max("score").over(Window.partitionBy(*KEY))
    share = F.col("score") / F.when(top > 0, top).otherwise(1.0)
    each = annotated.withColumn("share", share).select(*KEY, "share", "direct", F.explode("positions").alias("pos"))
    return each.groupBy(*KEY, "pos").agg(F.greatest(F.max("share"), F.lit(0.0)).alias("bonus"), F.max("direct").alias("direct"))


def rescored(cands: DataFrame, bonus: DataFrame, weights: dict | None = None) -> DataFrame:
    """cands (KEY, pos, contra, ..) with final: place in the list, best triple, less direct and contra."""
    w = {"prior": 0.7, "bonus": 0.3, "direct": -0.15, "contra": -0.05} | (weights or {})
    n = F.count("*").over(Window.partitionBy(*KEY))
    out = cands.withColumn("_n", n).join(bonus, [*KEY, "pos"], "left")
    prior = F.when(F.col("_n") > 1, 1 - (F.col("pos") - 1) / (F.col("_n") - 1)).otherwise(1.0)
    one = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    final = w["prior"] * prior + w["bonus"] * F.coalesce("bonus", F.lit(0.0)) + w["direct"] * one("direct") + w["contra"] * one("contra")
    return out.withColumn("final", F.round(final, 9)).drop("_n")
