"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and telephone numbers (the patterns below, leftmost and
non-overlapping for each kind; matches that fail a kind's check are dropped). A term (a run of min_letters letters or more, lower-cased,
that touches no entity) is the context of every entity of its text. Over the whole corpus, N documents, with df of an entity, of a term
anywhere, and of both in one document:

    information(e) = log2(N / df(e));  disclosure(t, e) = log2(p(e | t) N / df(e)) / information(e)
    p(e | t) = (df(t, e) + prior df(e) / N) / (df(t) + prior)

All pairs count, those of one document too: the prior, of so many documents at e's own rate, smooths them. A term with
disclosure >= general is generalised wherever it stands in a text with e; from `remove` on it is removed.

Null and empty texts have no spans. A very long text is matched in time that grows with its length; cutting takes its length times its cuts. Spans count code points, ends exclusive. Repeated rows and equal texts under one id
get equal spans; each counts as a document. An empty table gives an empty result. Extra columns stay out of spans() and stay
in sanitised(). U+E000 in a text stands for an ordinary symbol: it separates matches while they are cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, small_enough

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns give, written so that no input makes them backtrack: runs are possessive, and begin where no run of the same kind goes on.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK, PLAIN = "\ue000", "\u25a1"
MIN_LETTERS, PRIOR, GENERAL, REMOVE, BROADCAST_ROWS, BROADCAST_CUTS = 4, 1.0, 0.75, 0.9, 500_000, 50_000
#: Parts of a text that are placed in one go; even, so that each block begins between terms.
BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(text: Column, pattern: str, name: str) -> Column:
    """array<struct<name, start, end>> of the leftmost non-overlapping matches; text is free of MARK.

    Matches are set between marks, the text is split there, and the lengths of the parts are summed, by blocks of parts, so that time grows with the text.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    spans = F.array().cast(f"array<struct<{name}:string,start:int,end:int>>")

    def place(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        hit = F.array(F.struct(part.alias(name), acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def begin(acc: Column, block: Column) -> Column:
        end = acc["at"] + F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, at: F.aggregate(x, F.struct(at.alias("at"), F.lit(False).alias("hit"), spans.alias("out")), place, lambda acc: acc["out"])))

    blocks = _let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda i: F.slice(p, i, F.lit(BLOCK))))
    return _let(blocks, placed)


def matches(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<value, start, end>> of the leftmost non-overlapping matches that keep() holds for; text is free of MARK."""
    found = _placed(text, pattern, "value")
    return F.filter(found, lambda s: keep(s["value"])) if keep else found


def _few_digits(m: Column, low: int, high: int) -> Column:
    return F.length(F.translate(m, " ().+-", "")).between(low, high)


def _octets(m: Column) -> Column:
    def fits(p: Column) -> Column:
        short = F.ltrim(p, F.lit("0"))
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), fits)


#: What a match of each kind must pass, and what a text must hold for the pattern to be tried.
CHECKS = {"email": None, "ip": _octets, "card": lambda m: _few_digits(m, 16, 19) & F.call_function("luhn_check", F.translate(m, " -", "")), "phone": lambda m: _few_digits(m, 8, 15)}
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.contains("+")}


def _of_kind(k: int):
    return lambda s: F.struct(F.lit(k).alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def _base(text: Column) -> Column:
    """array<struct<kind number, value, start, end>> of all protected entities, by kind, then start."""
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    each = []
    for k, kind in enumerate(KINDS):
        found = F.when(HINTS[kind](text), matches(text, PATTERNS[kind], CHECKS[kind])).otherwise(none)
        each.append(F.transform(found, _of_kind(k)))
    return F.concat(*each)


def _lower(text: Column) -> Column:
    """text in lower case, as long as before (of all letters only U+0130 would grow)."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _terms(text: Column, base: Column, letters: int) -> Column:
    """array<struct<term, start, end>> of the terms of a text that lie outside all entities."""
    placed = _placed(_lower(text), rf"\p{{L}}{{{letters},}}+", "term")
    return F.filter(placed, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))


def _named(base: Column) -> Column:
    """The entities of a text, each once, as kind:value."""
    return F.array_distinct(F.transform(base, lambda b: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), b["kind"] + 1), b["value"])))


def found(docs: DataFrame, letters: int = MIN_LETTERS, prior: float = PRIOR, general: float = GENERAL, remove: float = REMOVE) -> DataFrame:
    """doc_id, digest (of the text), base: the protected entities, terms: array<struct<start, end, removed>> of the terms that disclose one."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, PLAIN)
    first = docs.select("doc_id", F.xxhash64("text").alias("digest"), text.alias("t")).withColumn("base", _base(F.col("t")))
    placed = F.when(F.size("base") > 0, _terms(F.col("t"), F.col("base"), letters)).otherwise(F.array().cast("array<struct<term:string,start:int,end:int>>"))
    scan = Kept(first.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "base", placed.alias("placed")), "entities")

    some = scan.df.where(F.size("base") > 0)
    named = some.select("row", F.explode(_named(F.col("base"))).alias("entity"), F.array_distinct("placed.term").alias("terms"))
    met = named.select("row", "entity", F.explode("terms").alias("term"))
    pairs = Kept(met.groupBy("entity", "term").agg(F.count("*").alias("both")), "pairs").df
    entities = named.groupBy("entity").agg(F.count("*").alias("with_entity"))
    wanted = Kept(pairs.select("term").distinct(), "terms").df
    wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted
    everywhere = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(_lower(text), F.lit(rf"\p{{L}}{{{letters},}}+"), F.lit(0)))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    rate = F.col("with_entity") / F.lit(float(scan.df.count()))
    shown = F.log2((F.col("both") + prior * rate) / (F.col("with_term") + prior) / rate) / -F.log2(rate)
    telling = Kept(pairs.join(entities, "entity").join(everywhere, "term").where(rate < 1).withColumn("disclosure", shown).where(F.col("disclosure") >= general).select("entity", "term", "disclosure"), "telling").df
    telling = F.broadcast(telling) if small_enough(telling, BROADCAST_ROWS) else telling
    cut = met.join(telling, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("d"))
    terms = some.select("row", F.explode("placed").alias("x")).select("row", "x.*").join(cut, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", (F.col("d") >= remove).alias("removed")))).alias("terms"))
    both = scan.df.select("row", "doc_id", "digest", "base").join(terms, "row", "left")
    return both.select("doc_id", "digest", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("terms"))


def spans(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: counts by kind, digest of the base spans, and all spans with the terms' after them."""
    got = found(docs, **options)
    base = F.transform("base", lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with each entity replaced by its kind in brackets, disclosing terms by [TERM] or by nothing."""
    got = found(docs, **options).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "digest"])
    tags = F.lit([f"[{k.upper()}]" for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(tags, s["kind"] + 1).alias("tag")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise("[TERM]").alias("tag")))
    cuts = got.select("doc_id", "digest", F.array_sort(F.concat(base, terms)).alias("cuts"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        kept = F.substring("row.text", acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, s["tag"])).alias("out"))

    text = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("row.text", acc["at"] + 1, F.lit(2**31 - 1))))
    # Only texts with something to cut are listed; few of them go to every executor, so that the texts stay where they are.
    cuts = Kept(cuts, "cuts").df
    cuts = F.broadcast(cuts) if small_enough(cuts, BROADCAST_CUTS) else cuts
    # The documents go along whole, as one column, so that none of their columns can clash with these.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"))
    both = whole.join(cuts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")), "left")
    new = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(text)
    return both.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
