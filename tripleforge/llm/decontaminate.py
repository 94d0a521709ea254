"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are what stands between white space, lower-cased, without ASCII punctuation. First every n-gram of the benchmark is
counted over all texts. An item's seeds are its n-grams in no more than one in `rare` documents, and in any case the rarer
half of those that any text has, so that a much copied item keeps its seeds. Where a text has a seed of an item, the stretch of the text that the item could
cover is aligned with the item (match +2, mismatch -1, gap -1); the best score by twice the item's length is the likeness, 1 for a
whole copy. From `threshold` on the text is contaminated.

The benchmark goes to the executors in parts of part_words words (or one item of more), each of which reads the texts; so no size of it is
broadcast whole. Null and empty texts match nothing, nor do items of fewer than n words. Of a very long text the numbers of its words are held, and one stretch at a time is aligned. Repeated rows are judged each on
their own. Empty tables give empty results. Extra columns stay out of leaks() and stay in clean().
"""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, word_count

N, RARE, THRESHOLD, PART_WORDS = 3, 1000, 0.5, 500_000
MATCH, MISMATCH, GAP = 2, 1, 1
_PUNCTUATION = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


class Part:
    """Some items of the benchmark: their words as numbers, and where each n-gram stands. Keys of n-grams are numbers of n digits, which must fit 63 bits."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.vocab, self.items, self.names = n, {}, [], []
        grams: dict = {}
        for name, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text or "")], np.int64)
            if len(ids) >= n:
                self.items.append(ids), self.names.append(name)
        if n * np.log2(len(self.vocab) + 1) >= 62:
            raise ValueError(f"{n}-grams of {len(self.vocab)} words have no keys of 63 bits; take smaller parts (part_words) or n")
        for k, ids in enumerate(self.items):
            for p, g in enumerate(self.grams(ids).tolist()):
                grams.setdefault(g, []).append((k, p))
        self.places = grams
        self.keys = np.array(sorted(grams), np.int64)

    @classmethod
    def of(cls, held: dict) -> "Part":
        """The part that was broadcast as plain data."""
        p = cls.__new__(cls)
        p.__dict__.update(held)
        return p

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the n-grams at each place; -1 where a word is not in the benchmark."""
        size = len(ids) - self.n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        key, ok = np.zeros(size, np.int64), np.ones(size, bool)
        for j in range(self.n):
            key = key * (len(self.vocab) + 1) + ids[j : j + size]
            ok &= ids[j : j + size] >= 0
        return np.where(ok, key, -1)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, keys) of n-grams that are in self.keys."""
        g = self.grams(ids)
        at = np.flatnonzero(g >= 0)
        if not len(at) or not len(self.keys):
            return at[:0], g[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        at = at[self.keys[k] == g[at]]
        return at, g[at]

    def keep_rare(self, counts: dict, docs: int, rare: int) -> None:
        """Leaves the seeds only."""
        keep = set()
        for ids in self.items:
            c = sorted((counts[g], g) for g in set(self.grams(ids).tolist()) if counts.get(g))
            keep |= {g for n, g in c if n <= c[(len(c) - 1) // 2][0] or n * rare <= docs}
        self.places = {g: p for g, p in self.places.items() if g in keep}
        self.keys = np.array(sorted(keep), np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the place in the text after its last word. Gaps along the text are a running maximum, so a row is a few array operations."""
    n = len(text)
    up, slope = np.zeros(n + 1, np.int64), np.arange(n + 1) * GAP
    best, end = 0, 0
    for w in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(up[:-1] + np.where(text == w, MATCH, -MISMATCH), up[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        up = row
    return best, end


def passages(part: Part, text: str, threshold: float) -> list[tuple]:
    """(item number, likeness, first word, word after the last, seeds) of each item whose best alignment reaches the threshold."""
    ids = part.numbers(text)
    at, keys = part.hits(ids)
    if not len(at):
        return []
    near: dict = {}
    for p, g in zip(at.tolist(), keys.tolist(), strict=True):
        for k, q in part.places[g]:
            near.setdefault(k, []).append(p - q)
    out = []
    for k, starts in near.items():
        item, stretches = part.items[k], []
        pad = len(item) // 4 + 5
        for s in sorted(set(starts)):
            lo, hi = max(0, s - pad), min(len(ids), s + len(item) + pad)
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
        best = max(((*align(item, ids[lo:hi]), lo) for lo, hi in stretches), key=lambda x: (x[0], -x[2]))
        likeness = best[0] / (MATCH * len(item))
        if likeness >= threshold:
            end = best[2] + best[1]
            lo = max(0, end - 2 * len(item) - pad)
            out.append((k, likeness, end - align(item[::-1], ids[lo:end][::-1])[1], end, len(starts)))
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Start and end in code points of each word of words_of(text)."""
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if m.group().lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)]


def _dealt(items: DataFrame, of: int, part_words: int):
    """Lists of (item, text) of part_words words at most, or of one item: items dealt by hash into `of` lots, each of which is cut further where it has drawn more."""
    for k in range(of):
        held, words = [], 0
        for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(of)) == k).toLocalIterator():
            if held and words + r["n"] > part_words:
                yield held
                held, words = [], 0
            held.append((r["item"], r["text"]))
            words += r["n"]
        if held:
            yield held


def parts(docs: DataFrame, bench: DataFrame, n: int = N, rare: int = RARE, part_words: int = PART_WORDS):
    """Broadcast parts of the benchmark with their seeds, one after another."""
    lean(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = bench.select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("text"), word_count(F.col("text")).alias("n")).distinct()
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    texts = docs.where("text is not null").select("text")
    number = texts.count() if total else 0
    for held in _dealt(items, -(-total // part_words), part_words):
        part = Part(sorted(held, key=lambda x: (x[0] is None, x[0], x[1])), n)
        if not len(part.keys):
            continue
        sent = sc.broadcast(vars(part))

        def count(batches, sent=sent):
            p = Part.of(sent.value)
            for pdf in batches:
                found = [np.unique(p.hits(p.numbers(t))[1]) for t in pdf["text"]]
                key, c = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pd.DataFrame({"key": key, "c": c})

        got = texts.mapInPandas(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).collect()
        sent.unpersist()
        part.keep_rare({r["key"]: r["c"] for r in got}, number, rare)
        yield sc.broadcast(vars(part))


def leaks(docs: DataFrame, bench: DataFrame, n: int = N, rare: int = RARE, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, item_id, likeness, seeds, start, end (code points) of each benchmark item found in a text."""
    kinds = [docs.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, likeness double, seeds int, start int, end int"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in parts(docs, bench, n, rare, part_words):

        def find(batches, sent=sent):
            p = Part.of(sent.value)
            for pdf in batches:
                rows = []
                for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if found := passages(p, t, threshold):
                        at = places(t)
                        rows += [(i, p.names[k], like, seeds, at[a][0], at[b - 1][1]) for k, like, a, b, seeds in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "likeness", "seeds", "start", "end"])

        out = out.unionByName(docs.where("text is not null").select("doc_id", "text").mapInPandas(find, schema))
    return out


def clean(docs: DataFrame, bench: DataFrame, n: int = N, rare: int = RARE, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the contaminated ones."""
    def dirty(sent):
        def judge(texts: pd.Series) -> pd.Series:
            p = Part.of(sent.value)
            return pd.Series([t is not None and bool(passages(p, t, threshold)) for t in texts], dtype=bool)

        return F.pandas_udf(judge, "boolean")

    for sent in parts(docs, bench, n, rare, part_words):
        docs = docs.where(~dirty(sent)("text"))
    return docs
