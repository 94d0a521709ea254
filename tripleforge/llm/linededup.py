"""Repeated lines or paragraphs: digests of normalised units are grouped over the whole corpus, the earliest occurrence stays.

A unit is a line, or a paragraph (between blank lines). It is normalised by lower-casing A-Z and reading runs of white space as one space. Units with equal
digests are occurrences of one text; they rank by doc_id (null last), text and place. The first one stays and the others go, with their offsets in code points.

Passages within longer lines are found by an option, piece_words: long units are cut into pieces that end after words whose hash is less than those
of the piece_words - 1 words on either side, so where they end depends on the words nearby only, and a passage within longer lines, or on
either side of an edit, is cut alike wherever it stands. As common phrases repeat everywhere, another option, min_words, has a unit count only within a run of repeated units that follow
one another in a document and have so many words together (a unit that comes again within the run adds none).

shared_passages() finds passages wherever their lines or pieces end: its units are runs of `run` words, from the words on whose run's hash is the least of some `least_words - run + 1` in a row (winnowing). Equal
passages of least_words words have such a word in common, so all of them are found, whatever stands around; nothing is reported that has no `run` words in a row in common with another place.

Null and empty texts have no units. Rows that agree in doc_id and text count as one document, and both keep or lose its units; other
texts of one doc_id, null too, are documents of their own, known by 128 bits of their digest. An empty table gives an empty result. Very long texts are cut on their own, one at a time. Extra columns stay out of the result of
repeats() and stay in without_repeats().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, lean
from .shingles import chunks, mix, word_places

#: For passages: words of a run, and the least of a piece (but for the last one of a line).
MIN_WORDS, PIECE_WORDS = 40, 5
#: For shared passages: words of a passage that is found for sure, and of the runs that are compared.
LEAST_WORDS, RUN = 50, 39
BROADCAST_ROWS, HOT = 200_000, 10_000
#: Ranks are doc_id times PLACES, plus the place: a number from the text's digest times STARTS, plus the offset. Units of two texts of one id that agree in rank both stay.
PLACES, STARTS, TEXTS = 10**19, 10**10, 9 * 10**8
LAST = 2**63 - 1
_STEP = 0x9FB21C651E98DF25


def digest_of(text: bytes) -> tuple[int, int]:
    """What a text is known by among those of its doc_id."""
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pieces(h: np.ndarray, segment: np.ndarray, piece_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word) of each unit of words with hashes h, in lines numbered by segment; whole lines without piece_words."""
    low = np.full(len(h), piece_words is not None)
    for k in range(1, min(piece_words or 0, len(h))):
        apart = segment[k:] != segment[:-k]
        low[k:] &= apart | (h[k:] < h[:-k])
        low[:-k] &= apart | (h[:-k] <= h[k:])
    if len(h):
        low[-1] = True
        low[:-1] |= segment[1:] != segment[:-1]
    last = np.flatnonzero(low)
    return np.concatenate(([0], last[:-1] + 1)).astype(np.int64) if len(last) else last, last


def units_of(texts: list[bytes], piece_words: int | None = None, unit: str = "line") -> dict[str, np.ndarray]:
    """text (its number in the list), no (of the unit in its text), start, end (code points), words and the digest (hi, lo) of each unit."""
    doc, h, start, stop, data = word_places(texts, b"\n")
    line = data == 10
    if unit == "paragraph":  # a blank line: only white space since the last line end
        dark = np.cumsum(~np.isin(data, (9, 10, 11, 12, 13, 32)))
        ends = np.flatnonzero(line)
        line = np.zeros(len(data), bool)
        line[ends[1:][dark[ends[1:]] == dark[ends[:-1]]]] = True
    # Lines of two texts are never one: texts are part of the segment's number.
    segment = np.cumsum(line)[start] + doc
    first, last = pieces(h, segment, piece_words)
    powers = np.full(len(h) + 1, np.uint64(_STEP))
    inverse = np.full(len(h) + 1, np.uint64(pow(_STEP, -1, 2**64)))
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    n, digests = last - first + 1, []
    for salt in (3, 5):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt * 0x9E3779B9)) * powers[: len(h)])))
        digests.append(mix((sums[last + 1] - sums[first]) * inverse[first] + n.astype(np.uint64)).view(np.int64))
    of = doc[first]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = points[np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]] if texts else points[:0]
    count = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    no = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return {"text": of, "no": no, "start": points[start[first]] - begin[of], "end": points[stop[last]] - begin[of], "words": n, "hi": digests[0], "lo": digests[1]}


def runs_of(texts: list[bytes], run: int = RUN, least_words: int = LEAST_WORDS) -> dict[str, np.ndarray]:
    """What units_of() has, for runs of words: no is the number of the run's first word in its text. Of equal runs that overlap (a word that comes again and again) the first one counts."""
    doc, h, start, stop, data = word_places(texts, b"\n")
    n, w = len(h) - run + 1, least_words - run + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = points[np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]] if texts else points[:0]
    if n < 1:
        return {c: np.zeros(0, np.int64) for c in ("text", "no", "start", "end", "words", "hi", "lo")}
    powers = np.cumprod(np.full(len(h), np.uint64(_STEP)))
    inverse = np.cumprod(np.full(len(h), np.uint64(pow(_STEP, -1, 2**64))))
    digests = []
    for salt in (3, 5):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt * 0x9E3779B9)) * powers)))
        digests.append(mix((sums[run:] - sums[:n]) * inverse[:n]))
    # A run over the end of a text is none: it is the greatest, and left out.
    whole = doc[run - 1 :] == doc[:n]
    key = np.where(whole, digests[0], np.uint64(2**64 - 1))
    # The least of w in a row, those of one text, is chosen; equal ones all.
    padded = np.concatenate((np.full(w - 1, np.uint64(2**64 - 1)), key, np.full(w - 1, np.uint64(2**64 - 1))))
    least = padded[: n + w - 1].copy()
    for k in range(1, w):
        np.minimum(least, padded[k : k + n + w - 1], out=least)
    chosen = np.zeros(n, bool)
    for k in range(w):
        chosen |= key == least[k : k + n]
    at = np.flatnonzero(chosen & whole)
    order = np.lexsort((at, key[at]))
    o = at[order]
    again = np.zeros(len(at), bool)
    again[order[1:]] = (key[o[1:]] == key[o[:-1]]) & (o[1:] - o[:-1] < run) & (doc[o[1:]] == doc[o[:-1]])
    at = at[~again]
    of = doc[at]
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    return {"text": of, "no": at - first_word[of], "start": points[start[at]] - begin[of], "end": points[stop[at + run - 1]] - begin[of], "words": np.full(len(at), run), "hi": digests[0][at].view(np.int64), "lo": digests[1][at].view(np.int64)}


#: Two whole numbers of 31 bits stand in one column, the first in its upper half.
_upper = lambda c: F.shiftright(c, 32).cast("int")
_lower = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")


def units(docs: DataFrame, piece_words: int | None = None, unit: str = "line", find=None) -> DataFrame:
    """A row for each unit that find(texts) gives, units_of() if there is none: id, the text's digest (thi, tlo), span (start and end in one number), nth (the number of the unit and its words in one number), and the unit's digest (hi, lo)."""
    def split(batches):
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(np.int64), [_bytes(t) for t in pdf["text"]]
            for a, b in chunks(texts):
                with np.errstate(over="ignore"):
                    u = find(texts[a:b]) if find else units_of(texts[a:b], piece_words, unit)
                known = np.array([digest_of(t) for t in texts[a:b]], np.int64).reshape(-1, 2)[u["text"]]
                yield pd.DataFrame({"id": ids[a:b][u["text"]], "thi": known[:, 0], "tlo": known[:, 1], "span": u["start"].astype(np.int64) << 32 | u["end"], "nth": u["no"].astype(np.int64) << 32 | u["words"], "hi": u["hi"], "lo": u["lo"]})

    return docs.where("text is not null").select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), "text").mapInPandas(split, "id long, thi long, tlo long, span long, nth long, hi long, lo long")


def _met(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows with what groups (a row for each key, with copies) has for them. However many rows a key has, no task gets all of them."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on)
    # The keys with most copies are few: no more than all rows divided by the bound. They go to every executor; the others meet by a shuffle.
    bound = max(HOT, rows.count() // BROADCAST_ROWS)
    hot = F.broadcast(groups.where(F.col("copies") > bound))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col("copies") <= bound), on))


DOC = ["id", "thi", "tlo"]


def _occurrences(docs: DataFrame, piece_words: int | None, unit: str, find=None) -> DataFrame:
    """All units that occur more than once: id, thi, tlo, no, start, end, words, hi, lo, copies, kept (0 or 1), kept_id, kept_place."""
    lean(docs.sparkSession)
    u = Kept(units(docs, piece_words, unit, find), "units")
    place = F.pmod("thi", F.lit(TEXTS)) * STARTS + _upper("span")
    rank = (F.col("id").cast("decimal(19,0)") * F.lit(str(PLACES)).cast("decimal(20,0)") + place.cast("decimal(19,0)")).cast("decimal(38,0)")
    groups = u.df.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min(rank).alias("first")).where("copies > 1")
    # A whole number of PLACES is left to divide, so nothing is rounded.
    kept_place = F.expr(f"pmod(first, cast({PLACES} as decimal(20,0)))").cast("decimal(38,0)")
    groups = groups.withColumn("kept_place", kept_place).select("hi", "lo", "copies", F.expr(f"(first - kept_place) div cast({PLACES} as decimal(20,0))").alias("kept_id"), F.col("kept_place").cast("long").alias("kept_place"))
    met = _met(u.df, Kept(groups, "repeated").df, ["hi", "lo"])
    kept = (F.col("id") == F.col("kept_id")) & (place == F.col("kept_place"))
    # Repeated rows of a document give the same units: one of each is enough, and they are no copies of each other.
    values = ["span", "hi", "lo", "copies", "kept", "kept_id", "kept_place"]
    met = met.select(*DOC, "nth", *[c for c in values if c != "kept"], kept.cast("int").alias("kept")).groupBy(*DOC, "nth").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in values]).where(F.col("copies") > F.col("rows"))
    return met.select(*DOC, _upper("nth").alias("no"), _upper("span").alias("start"), _lower("span").alias("end"), _lower("nth").alias("words"), *values[1:])


def _passages(docs: DataFrame, min_words: int, piece_words: int | None, unit: str) -> DataFrame:
    """The parts of runs of repeated units that stay or go: id, thi, tlo, start, end, words, units, copies, kept, kept_id, kept_start."""
    at = Window.partitionBy(*DOC).orderBy("no")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    runs = _occurrences(docs, piece_words, unit).withColumn("new", (F.coalesce(F.col("no") - F.lag("no").over(at), F.lit(0)) != 1).cast("int")).withColumn("turn", F.coalesce(F.col("kept") != F.lag("kept").over(at), F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(upto)).withColumn("part", F.sum(F.greatest("new", "turn")).over(upto))
    again = F.row_number().over(Window.partitionBy(*DOC, "run", "hi", "lo").orderBy("no")) > 1
    runs = runs.withColumn("own", F.when(again, 0).otherwise(F.col("words")))
    runs = runs.withColumn("total", F.sum("own").over(Window.partitionBy(*DOC, "run"))).where(F.col("total") >= min_words)
    first = F.min_by(F.struct("kept_id", "kept_place"), "no")
    parts = runs.groupBy(*DOC, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("units"), F.max("copies").alias("copies"), (F.max("kept") == 1).alias("kept"), first.alias("first"))
    return parts.select(*DOC, "start", "end", "words", "units", "copies", "kept", F.col("first.kept_id").alias("kept_id"), (F.col("first.kept_place") % STARTS).cast("int").alias("kept_start"))


def _real(c: str):
    return F.when(F.col(c) == LAST, None).otherwise(F.col(c))


def occurrences(docs: DataFrame, piece_words: int | None = None, unit: str = "line") -> DataFrame:
    """Each occurrence of a repeated unit on its own: doc_id, start, end, words, copies, kept, and where the first one stays: kept_doc_id, kept_start."""
    return _occurrences(docs, piece_words, unit).select(_real("id").alias("doc_id"), "start", "end", "words", "copies", (F.col("kept") == 1).alias("kept"), _real("kept_id").alias("kept_doc_id"), (F.col("kept_place") % STARTS).cast("int").alias("kept_start"))


def occurrences_sql() -> str:
    """The same rows for lines in DuckDB's SQL, for tables with unique, not null ids."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM texts),
    placed AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS place FROM numbered),
    units AS (SELECT doc_id, CAST(place + length(line) - length(ltrim(line, {blank})) AS INTEGER) AS start, CAST(place + length(rtrim(line, {blank})) AS INTEGER) AS "end",
        string_split(regexp_replace(translate(trim(line, {blank}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+', ' ', 'g'), ' ') AS unit FROM placed WHERE trim(line, {blank}) <> ''),
    met AS (SELECT *, count(*) OVER (PARTITION BY unit) AS copies, min((doc_id, start)) OVER (PARTITION BY unit) AS first FROM units)
    SELECT doc_id, start, "end", CAST(len(unit) AS INTEGER) AS words, copies, doc_id = first[1] AND start = first[2] AS kept, first[1] AS kept_doc_id, first[2] AS kept_start FROM met WHERE copies > 1"""


def repeats(docs: DataFrame, min_words: int = 1, piece_words: int | None = None, unit: str = "line") -> DataFrame:
    """All runs of repeated units, in parts that stay (kept) or go: doc_id, start, end, words, units, copies, kept, and where the first unit of the part stays: kept_doc_id, kept_start."""
    return _passages(docs, min_words, piece_words, unit).select(_real("id").alias("doc_id"), "start", "end", "words", "units", "copies", "kept", _real("kept_id").alias("kept_doc_id"), "kept_start")


def shared_passages(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages that stand in two places or more, in parts whose runs stay (kept) or go; columns as in repeats(), units are the runs compared.

    Every passage of least_words words is found, but for less than that at either end; those of `run` words or more may be. A part ends where the next one begins.
    """
    if not 0 < run <= least_words:
        raise ValueError("run must be from 1 to least_words")
    at = Window.partitionBy(*DOC).orderBy("no")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    find = lambda texts: runs_of(texts, run, least_words)
    before = F.lag("no").over(at)
    apart = F.coalesce(F.col("no") > before + run, F.lit(True))
    turn = F.coalesce(F.col("kept") != F.lag("kept").over(at), F.lit(True))
    runs = _occurrences(docs, None, "line", find).withColumn("new", (apart | turn).cast("int"))
    runs = runs.withColumn("part", F.sum("new").over(upto))
    first = F.min_by(F.struct("kept_id", "kept_place"), "no")
    parts = runs.groupBy(*DOC, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("no").alias("no"), (F.max("no") + run).alias("upto"), F.count("*").alias("units"), F.max("copies").alias("copies"), (F.max("kept") == 1).alias("kept"), first.alias("first"))
    following = Window.partitionBy(*DOC).orderBy("part")
    parts = parts.withColumn("end", F.least("end", F.lead("start").over(following))).withColumn("upto", F.least("upto", F.lead("no").over(following)))
    kept_start = (F.col("first.kept_place") % STARTS).cast("int")
    return parts.select(_real("id").alias("doc_id"), "start", "end", (F.col("upto") - F.col("no")).cast("long").alias("words"), "units", "copies", "kept", _real("first.kept_id").alias("kept_doc_id"), kept_start.alias("kept_start"))


def without_repeats(docs: DataFrame, min_words: int = 1, piece_words: int | None = None, unit: str = "line", removed: str = "removed") -> DataFrame:
    """docs with every part of a run that goes cut out of text (with the line end after it, or else the space), and a column named by `removed`: the spans cut, by offsets in the original.

    All columns of docs stay; where one has the name `removed` already, another name must be given.
    """
    if removed in docs.columns:
        raise ValueError(f"docs has a column {removed} already")
    spans = _passages(docs, min_words, piece_words, unit).where("not kept").groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def known(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([digest_of(_bytes(t)) for t in text], columns=["thi", "tlo"], dtype="int64")

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is not None and ss is not None and len(ss):
                parts, at = [], 0
                for s in ss:
                    parts.append(t[at : s["start"]])
                    # The end of a line stays with what is left of the line before the span.
                    rest = t[s["end"] : s["end"] + 1] == "\n" and "".join(parts)[-1:] not in ("", "\n")
                    at = s["end"] if rest else min(len(t), s["end"] + 1)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    # The documents go along whole, as one column, so that none of their columns can clash with these.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), F.pandas_udf(known, "thi long, tlo long")("text").alias("known"))
    both = whole.select("row", "id", "known.*").join(spans, DOC, "left")
    text = F.pandas_udf(cut, "string")("row.text", "spans")
    both = both.select("row", text.alias("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.col("spans").alias(removed))
