"""An inventory of tables: profiles of all columns in one pass, roles from names, and a score that picks the best table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import snake

#: Parts of normalised column names that make a role, and whole names.
ROLES = {
    "status": (("status",), ()),
    "phase": (("phase",), ()),
    "drugbank_id": (("drugbank",), ("drug_bank_id",)),
    "drugcentral_id": (("drugcentral", "drug_central"), ()),
    "drug_name": (("drug", "compound"), ()),
    "disease_name": (("disease",), ()),
    "indication": (("indication",), ()),
    "umls": (("umls",), ("cui", "cuis")),
    "nct": (("nct", "clinicaltrial", "clinical_trial"), ()),
}
#: What a table's score has from having a column of any of the roles.
POINTS = [(("status",), 10), (("drugbank_id",), 8), (("drugcentral_id",), 4), (("drug_name",), 4), (("umls",), 8), (("disease_name", "indication"), 4), (("phase",), 2)]
#: Patterns that values are counted by.
PATTERNS = {"numbers": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "drug_ids": r"^DB\d{5}$", "concept_ids": r"^C\d{7}$"}


def profiles(table: DataFrame, name: str) -> DataFrame:
    """(tab, col, place, n_rows, blanks, longest, numbers, drug_ids, concept_ids, approved, failed, distinct) of every column, read once.

    Tasks send one row of counts and sketches for all columns, which add up in any order; distinct is a sketch's estimate (HyperLogLog, about 1.6 % off for many values). Values count as text, trimmed; arrays and structs by their JSON.
    """
    def text(c: str, kind: str) -> Column:
        return F.trim(F.col(f"`{c}`").cast("string") if not kind.startswith(("array", "struct", "map")) else F.to_json(f"`{c}`"))

    def one(i: int, c: str, kind: str) -> Column:
        v = text(c, kind)
        low = F.lower(v)
        of = {n: F.count_if(v.rlike(p)) for n, p in PATTERNS.items()}
        of |= {"approved": F.count_if(low.contains("approved")), "failed": F.count_if(low.rlike("terminated|withdrawn|suspended|failed"))}
        sketch = F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v != "", v), F.lit(12)))
        return F.struct(F.lit(c).alias("col"), F.lit(i).alias("place"), F.count("*").alias("n_rows"), F.count_if(F.coalesce(v, F.lit("")) == "").alias("blanks"), F.coalesce(F.max(F.length(v)), F.lit(0)).alias("longest"), *[x.alias(n) for n, x in of.items()], F.coalesce(sketch, F.lit(0)).alias("distinct"))

    columns = F.array(*[one(i, c, kind) for i, (c, kind) in enumerate(table.dtypes)])
    return table.agg(columns.alias("c")).select(F.lit(name).alias("tab"), F.explode("c").alias("x")).select("tab", "x.*")


def roles(profiled: DataFrame) -> DataFrame:
    """profiled with the roles of each column, by its normalised name."""
    n = snake(F.col("col"))
    has = {role: reduce(Column.__or__, [n.contains(p) for p in parts] + [n == w for w in whole]) for role, (parts, whole) in ROLES.items()}
    return profiled.withColumn("roles", F.array_compact(F.array(*[F.when(c, F.lit(role)) for role, c in has.items()])))


def tables(profiled: DataFrame) -> DataFrame:
    """(tab, n_rows, n_cols, roles, score, best): the score of each table from its size and the roles of its columns; best for the first of the highest."""
    t = roles(profiled).groupBy("tab").agg(F.max("n_rows").alias("n_rows"), F.count("*").cast("int").alias("n_cols"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"))
    points = [F.when(reduce(Column.__or__, [F.array_contains("roles", r) for r in some]), n).otherwise(0) for some, n in POINTS]
    score = F.least(F.col("n_rows") / 1000.0, F.lit(20.0)) + F.least(F.col("n_cols") / 10.0, F.lit(5.0)) + reduce(Column.__add__, points)
    # One row for each table: few, whatever the tables hold.
    first = F.row_number().over(Window.orderBy(F.desc("score"), "tab"))
    return t.withColumn("score", score).withColumn("best", first == 1)
