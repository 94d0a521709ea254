"""Rows of candidate lists as they are stored: fields with fallbacks, lookups by name, alignment of row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import KEY


def known(df: DataFrame, paths) -> Column:
    """The first of these fields (dotted paths) that df has and that is not null."""
    def has(path: str) -> bool:
        kind = df.schema
        for part in path.split("."):
            if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    return F.coalesce(*[F.col(p) for p in paths if has(p)], F.lit(None))


def checked(value: Column, wrong: Column, message: str) -> Column:
    """value, where nothing is wrong (nor unknown); the query fails otherwise."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit(message))).otherwise(value)


def raw_rows(df: DataFrame, names: str, ids: str, rank=("gold_rank_in_full_universe", "rank"), flag: str = "gold_in_topk_raw") -> DataFrame:
    """Candidate lists with full_rank (the first known rank) and in_topk (false where unknown). Lists that are missing or differ in length are an error."""
    ids_ok = checked(F.col(ids), F.size(names) != F.size(ids), "candidate names and ids are no lists of one length")
    return df.withColumn(ids, ids_ok).withColumn("full_rank", known(df, rank)).withColumn("in_topk", F.coalesce(F.col(flag), F.lit(False)))


def extract_ids(df: DataFrame) -> DataFrame:
    """gold, query and candidates (numbers only) from the first field that holds them: ids of their own, then places 0 and 2 of triple_id, then row_metrics; candidates also from a nested row."""
    number = lambda c: c.try_cast("long")
    gold = F.coalesce(number(known(df, ["gold_entity_id", "gold_id", "tail_id"])), number(F.get("triple_id", F.lit(0))), number(F.col("row_metrics.gold_entity_id")))
    query = F.coalesce(number(known(df, ["query_entity_id", "query_id", "head_id"])), number(F.get("triple_id", F.lit(2))))
    ids = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), number), lambda x: x.isNotNull())
    own, nested = ids(F.col("ids")), ids(F.col("row.ids"))
    return df.withColumn("gold", gold).withColumn("query", query).withColumn("candidates", F.when(F.size(own) > 0, own).otherwise(nested))


def any_positive(*flags: Column) -> Column:
    """Is one of the alternative fields (numbers or booleans) set? Missing ones are not."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f.cast("double") > 0, F.lit(False))
    return out


def tri_state(edges: DataFrame, kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """edges with consistent: do the kinds of both ends meet the relation's rule? Null where the rule, one of its ends or a kind is unknown. kinds (id, kind), rules (r, domain, range): a row for each relation."""
    h, t = kinds.select(F.col("id").alias("h"), F.col("kind").alias("_hk")), kinds.select(F.col("id").alias("t"), F.col("kind").alias("_tk"))
    j = edges.join(rules.select("r", F.col("domain").alias("_d"), F.col("range").alias("_r")), "r", "left").join(h, "h", "left").join(t, "t", "left")
    every = F.col("_d").isNotNull() & F.col("_r").isNotNull() & F.col("_hk").isNotNull() & F.col("_tk").isNotNull()
    return j.withColumn("consistent", F.when(every, (F.col("_hk") == F.col("_d")) & (F.col("_tk") == F.col("_r")))).drop("_d", "_r", "_hk", "_tk")


def zip_lookup(df: DataFrame, key, names: str, values: str) -> DataFrame:
    """(key.., name, value) of two lists zipped up to the shorter one; of equal names the last counts."""
    n = F.least(F.size(names), F.size(values))
    zipped = F.arrays_zip(F.slice(names, 1, n).alias("name"), F.slice(values, 1, n).alias("value"))
    rows = df.where((F.size(names) > 0) & (F.size(values) > 0)).select(*key, F.posexplode(zipped).alias("at", "x")).select(*key, "at", F.col("x.name").alias("name"), F.col("x.value").alias("value"))
    return rows.groupBy(*key, "name").agg(F.max_by("value", "at").alias("value"))


def mock_flags(topk: Column, contra: Column) -> Column:
    """1 for each name of a list that stands in the set of contraindicated ones, trimmed both."""
    bad = F.transform(contra, lambda x: F.trim(x))
    return F.transform(topk, lambda x: F.array_contains(bad, F.trim(x)).cast("int"))


def mismatches(a: DataFrame, b: DataFrame, keys, values) -> DataFrame:
    """Rows of either side whose partner by keys is missing or differs in values."""
    j = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b")), keys, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    return j.where(F.col("_a").isNull() | F.col("_b").isNull() | ~same).drop("_a", "_b")


def matched(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """a joined to b by keys; a row of a without a partner is an error."""
    j = a.join(b.withColumn("_there", F.lit(True)), keys, "left")
    first = keys[0]
    return j.withColumn(first, checked(F.col(first), F.col("_there").isNull(), "a row has no partner")).drop("_there")


def reordered(lists: DataFrame, order: DataFrame, columns) -> DataFrame:
    """lists (KEY, pos, ..) in a new order (KEY, pos, new_pos): every aligned column moves with its place."""
    return lists.join(order, [*KEY, "pos"]).select(*KEY, F.col("new_pos").alias("pos"), *columns)


#: Values of one part of a run; a matrix of more is not meant.
PARTS = 10_000


def run_matrix(*parts: DataFrame) -> DataFrame:
    """All combinations of the distinct values of one-column tables: lists of names, which must be short."""
    out = None
    for p in parts:
        names = p.distinct()
        if names.limit(PARTS + 1).count() > PARTS:
            raise ValueError(f"a part of a run has {PARTS} values at most")
        out = names if out is None else out.crossJoin(F.broadcast(names))
    return out
