"""Names resolved through several normalised forms: an index of forms with a precedence, the first form that hits decides, and conflicts are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forms_of(df: DataFrame, forms: list[tuple[str, Column]], *keep: str) -> DataFrame:
    """(keep.., place, form, key): every form of each row in the order of precedence; null and empty ones are left out."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("form"), c.alias("key")) for i, (name, c) in enumerate(forms)])
    return df.select(*keep, F.explode(each).alias("f")).select(*keep, "f.*").where("key is not null and key <> ''")


def index(entities: DataFrame, forms: list[tuple[str, Column]]) -> DataFrame:
    """(key, entity, entities): for each key the least entity that has it as a form, and how many different ones do."""
    return forms_of(entities, forms, "entity").groupBy("key").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("entities"))


def resolve(names: DataFrame, forms: list[tuple[str, Column]], known: DataFrame) -> DataFrame:
    """(name, entity, form, hits, ambiguous, disagree): for each distinct name the entity that its first form to hit finds (the least, where several have that key: ambiguous), how many forms hit, and
    whether a later one finds another entity. No entity, and 0 hits, for names that none finds."""
    met = forms_of(names.select("name").distinct(), forms, "name").join(known, "key")
    best = Window.partitionBy("name").orderBy("place")
    met = met.withColumn("n", F.row_number().over(best)).withColumn("first", F.first("entity").over(best))
    got = met.groupBy("name").agg(F.max(F.when(F.col("n") == 1, F.col("entity"))).alias("entity"), F.max(F.when(F.col("n") == 1, F.col("form"))).alias("form"), F.count("*").alias("hits"), F.max(F.when(F.col("n") == 1, F.col("entities") > 1)).alias("ambiguous"), F.max(F.col("entity") != F.col("first")).alias("disagree"))
    out = names.select("name").distinct().join(got, "name", "left")
    return out.select("name", "entity", "form", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("disagree", F.lit(False)).alias("disagree"))
