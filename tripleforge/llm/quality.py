"""Line quality by a linear-chain conditional random field, and document quality from its marginals.

Each line is good or bad. Its features are shares of character classes, sizes, repetition within the text, and the same
features of the lines before and after it. Forward-backward gives each line's probability of being good; their mean,
weighted by line length, is the document's quality, and a logistic curve in its log odds, fitted on the training documents, is the score.

Only documents carry labels. Training therefore takes a document's label for each of its lines, fits the field, and
then keeps as bad in bad documents those lines that the field itself holds for likely bad (at least the likeliest), and fits
again. Fitting runs on the driver over a bounded sample of whole texts: of the sample_docs labelled documents of least hash, in that order, each
that still fits into sample_chars characters. Scoring reads every line of every text.

Null and empty texts are one empty line and get a score like any other. A very long text is scored alone, in arrays of some 40 bytes a character. Without both labels in the training rows every score is the share of good
ones (0.5 without any). Repeated rows are scored each on their own; labels of one id count once, the least of them. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean
from .shingles import mix

SAMPLE_DOCS, SAMPLE_CHARS, STEPS, RATE, PENALTY = 4000, 16_000_000, 250, 0.05, 1e-4
CLASSES = 9
OWN = 17
THRESHOLD = 0.7


def _class_table() -> np.ndarray:
    """0 letters without upper case, 1 upper case, 2 digits, 3 white space, 4 line ends, 5 common punctuation, 6 bars, 7 exclamation marks, 8 other."""
    t = np.zeros(0x3001, np.uint8)
    for i in range(0x3000):
        kind = unicodedata.category(chr(i))
        t[i] = 1 if kind == "Lu" else 0 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if kind[0] == "Z" or i in (9, 11, 12, 13) else 8
    t[10] = 4
    t[[ord(c) for c in ".,;:?'\"()-"]] = 5
    t[ord("|")], t[ord("!")] = 6, 7
    return t


_CACHE: dict = {}


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of lines of each text, length of each line, features of each line with those of its neighbours)."""
    if "table" not in _CACHE:
        _CACHE["table"] = _class_table()
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _CACHE["table"][np.minimum(cp, 0x3000)]
    ends = np.flatnonzero(cls == 4)
    total = len(ends)
    line = np.repeat(np.arange(total), np.diff(ends, prepend=-1))
    counts = np.bincount(line * CLASSES + cls, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    size = np.diff(ends, prepend=-1) - 1
    black = (cls != 3) & (cls != 4)
    edge = np.diff(black.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.append(stop, len(cp)) if len(stop) < len(begin) else stop
    word_line, word_len = line[begin], stop - begin
    n_words = np.bincount(word_line, minlength=total).astype(np.float64)
    short = np.bincount(word_line, weights=word_len <= 3, minlength=total)
    capital = np.bincount(word_line, weights=(cls[begin] == 1) & (word_len > 1), minlength=total)
    symbol_end = np.bincount(word_line, weights=(cls[stop - 1] >= 7), minlength=total)
    # Words equal to the one before, by sums of mixed code points.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)))))
    key = sums[stop] - sums[begin]
    echo = np.bincount(word_line[1:], weights=(key[1:] == key[:-1]) & (word_line[1:] == word_line[:-1]), minlength=total) if len(key) > 1 else np.zeros(total)
    # Lines that come again in their text.
    again = np.zeros(total)
    pieces, at = joined.split("\n"), 0
    for n in n_lines:
        seen: dict = {}
        for i in range(at, at + n):
            p = pieces[i]
            if len(p) > 12:
                if p in seen:
                    again[i] = again[seen[p]] = 1
                else:
                    seen[p] = i
        at += n
    x = np.zeros((total, OWN), np.float32)
    n, w = np.maximum(size, 1), np.maximum(n_words, 1)
    x[:, 0] = 1
    x[:, 1] = np.log1p(size) / 5
    x[:, 2] = np.log1p(n_words) / 4
    x[:, 3] = np.minimum(size / w / 10, 3)
    x[:, 4] = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    x[:, 5] = counts[:, 8] / n * 4
    x[:, 6] = counts[:, 2] / n * 2
    x[:, 7] = counts[:, 6] / n * 10
    x[:, 8] = counts[:, 7] / n * 10
    x[:, 9] = counts[:, 5] / n * 4
    x[:, 10] = short / w
    x[:, 11] = capital / w
    x[:, 12] = symbol_end / w
    x[:, 13] = again
    x[:, 14] = size == 0
    x[:, 15] = n_words == 1
    x[:, 16] = echo / w
    first = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[first + n_lines - 1] = 0
    return n_lines, size, np.concatenate((x, before, after), axis=1)


def _padded(n_lines: np.ndarray, cells: int = 200_000):
    """Numbers of texts by falling number of lines, in groups whose padded size is bounded, with the place of their first lines."""
    order, first = np.argsort(-n_lines, kind="stable"), np.concatenate(([0], np.cumsum(n_lines)))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, cells // int(n_lines[order[at]]))]
        yield group, n_lines[group], first[group]
        at += len(group)


def marginals(n_lines: np.ndarray, odds: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and expected counts of the four pairs of neighbours for all texts.

    odds: score of good against bad of each line; pair: scores of (state, next state), 0 bad, 1 good.
    """
    good, step, pairs = np.empty(len(odds)), np.exp(pair - pair.max()), np.zeros((2, 2))
    for group, lens, first in _padded(n_lines):
        t_max = int(lens[0])
        emit = np.empty((t_max, len(group), 2))
        active = np.searchsorted(-lens, -np.arange(t_max), side="left")
        alphas, scales = [], []
        for t in range(t_max):
            m = active[t]
            o = np.clip(odds[first[:m] + t], -50, 50)
            emit[t, :m, 1], emit[t, :m, 0] = 1 / (1 + np.exp(-o)), 1 / (1 + np.exp(o))
            a = emit[t, :m] * (alphas[-1][:m] @ step if t else 1)
            c = a.sum(axis=1, keepdims=True)
            alphas.append(a / c), scales.append(c)
        beta = np.ones((active[-1], 2))
        for t in range(t_max - 1, -1, -1):
            m = active[t]
            if t + 1 < t_max:
                k = active[t + 1]
                back = emit[t + 1, :k] * beta / scales[t + 1]
                pairs += (alphas[t][:k].T @ back) * step
                beta = np.ones((m, 2))
                beta[:k] = back @ step.T
            g = alphas[t] * beta
            good[first[:m] + t] = g[:, 1] / g.sum(axis=1)
    return good, pairs


def _fit_field(n_lines, x, y, weight, steps=STEPS):
    """Weights of features and pairs by gradient ascent (Adam) of the lines' conditional likelihood."""
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    first = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
    inner = np.ones(len(y), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    m = v = np.zeros(len(w) + 4)
    for t in range(1, steps + 1):
        good, pairs = marginals(n_lines, x @ w.astype(np.float32), pair)
        grad = np.concatenate((x.T @ ((y - good) * weight).astype(np.float32) / weight.sum() - PENALTY * w, (seen - pairs).reshape(-1) / max(1, len(i)) - PENALTY * pair.reshape(-1)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
    return w, pair


def _document(n_lines, size, good):
    """Mean of the lines' marginals by length, as log odds."""
    first = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
    weight = size + 1.0
    q = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _fit_curve(z, y):
    """Slope (not below 0) and place of a logistic curve, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * z).sum() - 0.5 * (a - 1), (y - p).sum() - 0.01 * b])
        h = np.array([[(r * z * z).sum() + 0.5, (r * z).sum()], [(r * z).sum(), r.sum() + 0.01]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.0, a + d[0]), b + d[1]
        if abs(d).max() < 1e-7:
            break
    return a, b


def _runs(texts: list[str], size: int = 1_000_000):
    """Runs of texts of about so many characters, or of one text."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) < size:
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def fit(texts: list[str], labels: np.ndarray) -> tuple | None:
    """(feature weights, pair weights, slope, place) from whole texts and their labels; None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    n_lines, size, x = (np.concatenate(part) for part in zip(*[line_features(texts[a:b]) for a, b in _runs(texts)], strict=True))
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    y = labels[doc].astype(np.float64)
    first = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
    # Documents of either label count alike in sum, and lines by length, as in the mean that is wanted.
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    total = np.add.reduceat(size + 1.0, first)
    weight = (size + 1.0) / total[doc] * share[doc]
    w, pair = _fit_field(n_lines, x, y, weight, STEPS // 2)
    good, _ = marginals(n_lines, x @ w, pair)
    worst = np.minimum.reduceat(good, first)[doc]
    y = np.where((labels[doc] == 0) & ((good < 0.5) | (good <= worst)), 0.0, 1.0)
    w, pair = _fit_field(n_lines, x, y, weight)
    good, _ = marginals(n_lines, x @ w, pair)
    a, b = _fit_curve(_document(n_lines, size, good), labels)
    return w, pair, a, b


def score_texts(texts: list[str], model: tuple) -> np.ndarray:
    w, pair, a, b = model
    n_lines, size, x = line_features(texts)
    good, _ = marginals(n_lines, x @ w, pair)
    return 1 / (1 + np.exp(-np.clip(a * _document(n_lines, size, good) + b, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, where: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple:
    """The model, from labelled documents for which `where` holds; and the share of good ones among them."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    rows = docs.where(where).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = rows.select("doc_id", F.char_length("text").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).join(known, "doc_id")
    first = sized.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    chosen, left = [], sample_chars
    for r in first:
        if r["n"] <= left:
            chosen.append((r["doc_id"], r["quality"]))
            left -= r["n"]
    chosen = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("quality", T.LongType())]))
    # The ids are at most sample_docs and their texts, with repeated rows, at most sample_chars; they come from a second reading, so that no text is sorted or shuffled.
    got = rows.join(F.broadcast(chosen), "doc_id").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["quality"] for r in got])
    return fit([r["text"] for r in got], y) if len(got) else None, float(y.mean()) if len(got) else 0.5


def score(docs: DataFrame, model: tuple | None, share: float, name: str = "score") -> DataFrame:
    """docs with a column of that name."""
    lean(docs.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        texts = [t if t is not None else "" for t in texts]
        return pd.Series(np.concatenate([np.zeros(0), *(score_texts(texts[a:b], model) for a, b in _runs(texts))]))

    return docs.withColumn(name, F.lit(share) if model is None else F.pandas_udf(run, "double")("text"))


def classify(docs: DataFrame, labels: DataFrame, train_where: Column, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs' doc_id with score and predicted, learning from the rows where train_where holds."""
    model, share = train(docs, labels, train_where, sample_docs)
    held = ~F.coalesce(train_where, F.lit(False))
    out = score(docs.select("doc_id", "text", held.alias("held_out")), model, share)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
