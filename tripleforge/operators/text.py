"""Text columns: answers, identifiers, prompts, and how a prediction matches its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What generation leaves at the end of an answer.
END_MARKS = ("</s>", "<|end_of_text|>", "<|eot_id|>")


def clean(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", ""), r"(?U)\s+", " ")


def loose(c: Column) -> Column:
    """What follows the last 'Answer:', its first line, without the quotes and then the punctuation at its ends, lower-cased. Quotes within stay; each kind is taken off in turn."""
    last = F.element_at(F.split(c, "Answer:"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"(?U)^\s+", ""), r"(?s)[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029].*$", "")
    bare = F.regexp_replace(bare, r"(?U)\s+$", "")
    for quote in ("'", '"', "`"):
        bare = F.btrim(bare, F.lit(quote))
    return F.lower(F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" .,:;")))


def strict(c: Column) -> Column:
    """Without end marks, outer quotes and end punctuation; lower-cased."""
    for mark in END_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return F.lower(F.btrim(c, F.lit(" \n\t\"'`.,:;")))


def alnum(c: Column) -> Column:
    """' words ' with everything but letters and digits as spaces, so that whole words are found by contains()."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def drug_id(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), r"\bDB\d{5}\b", 0)


def concept_id(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), r"\bC\d{7}\b", 0)


def entity_type(c: Column) -> Column:
    return F.when(c.contains("::"), F.substring_index(c, "::", 1)).when(c.contains(":"), F.substring_index(c, ":", 1)).otherwise("UNKNOWN")


def snake(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")


def status(main: Column, *others: Column) -> Column:
    """approved, failed_like or other, over lower-cased fields."""
    text = F.lower(F.concat_ws(" ", main, *others))
    return F.when(text.contains("approved"), "approved").when(text.rlike("terminated|withdrawn|suspended|failed"), "failed_like").otherwise("other")


def prompt(names: Column, question: Column) -> Column:
    """The candidates as a quoted tuple with one reference each, then the question."""
    options = F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    refs = F.array_join(F.transform(names, lambda n: F.lit("[ENTITY]")), ", ")
    return F.concat(F.lit("Options: ("), options, F.lit(") References: ([QUERY], "), refs, F.lit(") Question: "), question, F.lit(" Answer:"))


def question_block(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)Question: (.*?) Answer:", 1)


def fragment(pred: Column, hits: Column, marker: bool = True) -> Column:
    """Does a prediction look like a piece of the candidate list?"""
    out = (F.length(pred) > 120) | (F.regexp_count(pred, F.lit(",")) >= 2) | (F.regexp_count(pred, F.lit("'")) >= 4) | (hits >= 3)
    return out | pred.contains("####") if marker else out


def category(pred: Column, exact: Column, top1: Column, other: Column, piece: Column) -> Column:
    return F.when(F.trim(pred) == "", "empty").when(exact, "exact").when(top1, "top1_copy").when(other, "other_candidate").when(piece, "list_fragment").otherwise("invalid")


def adjusted_rank(pred_pos: Column, gold_rank: Column, exact: Column, rule: str = "at", absent: int = 21) -> Column:
    """Rank of the gold once an answer is given: `absent` where the gold is no candidate, 1 for the gold itself; an answer that is no candidate costs a place, and so does one at or behind the gold's place (rule `at`) or behind it (rule `after`)."""
    lost = pred_pos.isNull() | (pred_pos >= gold_rank if rule == "at" else pred_pos > gold_rank)
    return F.when(gold_rank >= absent, absent).when(exact, 1).when(lost, F.least(gold_rank + 1, F.lit(absent))).otherwise(gold_rank)


def strict_rank(pred_pos: Column, gold_rank: Column, exact: Column, k: int = 20) -> Column:
    """Second rule set: 1 for an exact answer to a present gold; an answer that is no candidate or stands before the gold costs a place; k + 1 where the gold is absent."""
    lost = F.least(F.lit(k + 1), gold_rank + 1)
    return F.when(exact & (gold_rank <= k), 1).when(gold_rank > k, k + 1).when(pred_pos.isNull() | (pred_pos < gold_rank), lost).otherwise(gold_rank)


def inference_rank(right: Column, place: Column, rank: Column) -> Column:
    """1 for the target itself, else its rank, one more where the answer is no candidate or its place from 0 is not below the rank."""
    return F.when(right, 1).when(place.isNull() | (place - 1 >= rank), rank + 1).otherwise(rank)


#: What stands before an answer.
ANSWER_MARKS = ("Answer:", "answer:", "ANSWER:")


def answer(c: Column) -> Column:
    """What follows the last marker of an answer, whatever its case: the first line, without quotes, brackets and end punctuation."""
    last = c
    for mark in ANSWER_MARKS:
        last = F.element_at(F.split(last, mark), -1)
    line = F.substring_index(F.regexp_replace(last, r"^\s+", ""), "\n", 1)
    return F.btrim(F.regexp_replace(line, r"\s+$", ""), F.lit("'\"`.,;:()[]{} "))


def tiered_match(answers: DataFrame, cands: DataFrame, key) -> DataFrame:
    """(key.., tier, pos) of the candidate that an answer (key.., raw) names: 1 by its name, 2 by its canonical id, 3 and 4 by one that stands in the answer; of equal tiers the first. No tier and place 21 without any."""
    j = answers.withColumn("ans", F.lower(answer(F.col("raw")))).join(cands.select(*key, "pos", "name", "canonical"), key)
    named = lambda c: F.col("ans") == F.lower(c)
    inside = lambda c: F.contains(alnum(F.col("raw")), alnum(F.col(c)))
    tier = F.when(named("name"), 1).when(named("canonical"), 2).when(inside("name"), 3).when(inside("canonical"), 4).otherwise(9)
    best = j.groupBy(*key).agg(F.min(F.struct(tier.alias("tier"), "pos")).alias("m"))
    return best.select(*key, F.when(F.col("m.tier") < 9, F.col("m.tier")).alias("tier"), F.when(F.col("m.tier") < 9, F.col("m.pos")).otherwise(21).alias("pos"))


def canonical(kind: str, ident: Column) -> Column:
    """kind::id; empty without an id."""
    return F.when(ident == "", F.lit("")).otherwise(F.concat(F.lit(f"{kind}::"), ident))


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor empty; empty without any."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def normalised_rows(raw: DataFrame) -> DataFrame:
    """Rows of a drug table (drug_id, drug_name, Drug, status, TrialStatus) with fallbacks: the id from either of two columns, the name from Drug without its id where drug_name is empty."""
    ident = first_text(drug_id(F.col("drug_id")), drug_id(F.col("Drug")))
    rest = clean(F.regexp_replace("Drug", r"\(DBID:\s*DB\d{5}\)", ""))
    return raw.select("i", first_text(clean(F.col("drug_name")), rest).alias("drug_name"), ident.alias("drug_id"), canonical("Compound", ident).alias("compound"), status(F.col("status"), F.col("TrialStatus")).alias("status"), (ident != "").alias("valid"))


#: Families of the relation codes.
CODES = {"compound_gene": ("CbG", "CdG", "CuG"), "disease_gene": ("DaG", "DdG", "DuG"), "gene_gene": ("GiG", "Gr>G", "GcG"), "target": ("CtD",), "pair": ("CpD",)}


def family_by_code(r: Column) -> Column:
    return F.coalesce(*[F.when(r.isin(*codes), F.lit(name)) for name, codes in CODES.items()], F.lit("other"))


def family_by_name(name: Column, target: Column) -> Column:
    """By the kinds that a relation's name holds, as in X::r::Compound:Gene; the target apart."""
    either = lambda a, b: name.contains(f"{a}:{b}") | name.contains(f"{b}:{a}")
    return F.when(target, "target").when(either("Compound", "Disease"), "pair").when(either("Compound", "Gene"), "compound_gene").when(either("Disease", "Gene"), "disease_gene").when(name.contains("Gene:Gene"), "gene_gene").otherwise("other")


def family_by_kinds(h: Column, t: Column) -> Column:
    """By the kinds of both ends: 0 compound, 1 gene, 2 disease, either way round."""
    pair = F.least(h, t) * 3 + F.greatest(h, t)
    return F.when(pair == 1, "compound_gene").when(pair == 2, "pair").when(pair == 4, "gene_gene").when(pair == 5, "disease_gene").otherwise("other")


def column_roles(names: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """(tab, role, col) of columns (tab, col) whose normalised name contains one of a role's parts."""
    n = snake(F.col("col"))
    found = F.array(*[F.when(F.greatest(*[n.contains(p) for p in parts], F.lit(False)), F.lit(role)) for role, parts in roles.items()])
    return names.select("tab", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("role"), "col")


def questions(triples: DataFrame, lexicon: DataFrame, name: str) -> DataFrame:
    """triples (r, side) with the lexicon's question about `name`, or the general one."""
    template = F.coalesce("template", F.lit("What is related to {}?"))
    return triples.join(lexicon, ["r", "side"], "left").withColumn("question", F.replace(template, F.lit("{}"), F.col(name))).drop("template")


def display_name(shown: Column, raw: Column, entity: Column) -> Column:
    return F.coalesce(F.nullif(shown, F.lit("")), F.nullif(raw, F.lit("")), entity)


#: Names under which stored edges hold their parts.
EDGE_FIELDS = {"h": ("h", "head", "src", "source"), "r": ("r", "relation", "rel"), "t": ("t", "tail", "dst", "target")}


def edge_key(text: Column) -> Column:
    """struct<h, r, t> of an edge written as a list or as an object; nulls for anything else."""
    parts = []
    for i, (name, fields) in enumerate(EDGE_FIELDS.items()):
        parts.append(F.coalesce(*[F.get_json_object(text, f"$.{f}") for f in fields], F.get_json_object(text, f"$[{i}]")).try_cast("long").alias(name))
    return F.struct(*parts)


def placeholders(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def suspicious(pred: Column, hits: Column) -> Column:
    """The strict rule: empty answers, two candidates in it, or any sign of a list or a prompt."""
    low = F.lower(pred)
    signs = [low.contains(s) for s in (",", ";", "['", "']", "answer must be", "question:", "candidate", "entity")]
    return (F.trim(pred) == "") | (hits >= 2) | F.greatest(*signs)


def relation_hints(rel: Column) -> list[Column]:
    """What the text of a relation says about its meaning, and its source before '::'."""
    low = F.lower(rel)
    has = lambda *parts: F.greatest(*[low.contains(p) for p in parts], F.lit(False))
    source = F.when(rel.contains("::"), F.substring_index(rel, "::", 1)).otherwise("UNKNOWN")
    return [source.alias("source"), has("treat").alias("treat"), has("palliat").alias("palliate"), has("associat").alias("association"), has("contra").alias("contra"), has("side", "effect").alias("side_effect")]


def auxiliary_role(rel: Column, n: Column, own: str, large: int) -> list[Column]:
    """The role of a relation beside the target, and cautions: from the source whose data are used already, or very large."""
    role = F.when(F.lower(rel).contains("contra"), "possible_contradiction_or_safety").otherwise("direct_cd_auxiliary")
    source = F.when(rel.contains("::"), F.substring_index(rel, "::", 1)).otherwise("UNKNOWN")
    caution = F.concat_ws(",", F.when(source == own, F.lit("overlaps_with_other_source")), F.when(n > large, F.lit("very_large_relation")))
    return [role.alias("role"), caution.alias("caution")]
