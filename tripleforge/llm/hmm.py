"""A hidden Markov language model over words.

Tokens are words between white space, A-Z lower-cased, then one end of text. Training counts every token of the training
texts, and the most frequent words of no more than head_chars characters, at most `head` (a fixed model size), are symbols of their own; all other words, seen or not,
are emitted by way of one of `classes` symbols (a hash of the last three characters). A state emits a symbol; a class
symbol then emits its word with probability (c + 0.1) / (n + 0.1 (v + 1)), c the word's count, n and v the counts of tokens and of words
in the class; all unseen words of a class are one type. So each state's words sum to 1, as in the unigram base.

Baum-Welch: the start is fitted on a bounded sample of training texts (those of the first warm_docs by hash that fit into warm_tokens) on the driver; then `rounds` rounds run
over all training texts: each partition sums expected counts by forward-backward over blocks of `block` tokens, Spark adds
the partitions' counts by symbol, and the driver re-estimates the fixed-size parameters. Scoring runs the scaled forward recursion over
each whole text.

Null and empty texts are one end token. A very long text is one sequence, held as two bytes a token, and cut into blocks for training only. Repeated rows count and are scored each on their own. A null doc_id is held out
(its text form is taken as empty). With no training text all counts are 0 and every symbol is equally likely. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, lean, lower_ascii, meet, regrouped, words

ADD = 0.1
#: Levels of counts for each unit of their logarithm: counts below this are levels of their own.
LEVELS = 2000


@dataclass(frozen=True)
class Config:
    states: int = 8
    head: int = 64_000
    classes: int = 1024
    rounds: int = 3
    head_chars: int = 64
    warm_docs: int = 1500
    warm_tokens: int = 2_000_000
    warm_rounds: int = 25
    block: int = 1024
    seed: int = 11
    smooth: float = 10.0


def word_class(word: str, classes: int) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % classes


def _batches(seqs: list[np.ndarray], tokens: int = 400_000):
    """Sequences sorted by length, longest first, in groups of about so many tokens: (their numbers, padded by time)."""
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, tokens // len(seqs[order[at]])))
        group = order[at : at + n]
        ids = np.zeros((len(seqs[group[0]]), n), np.int32)
        lens = np.array([len(seqs[i]) for i in group])
        for j, i in enumerate(group):
            ids[: lens[j], j] = seqs[i]
        yield group, ids, lens
        at += n


def forward(ids: np.ndarray, lens: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray, keep: bool = False):
    """Scaled forward recursion of sequences sorted by length: natural log likelihoods, and if kept the scaled forward values and the scales."""
    t_max, n = ids.shape
    active = np.searchsorted(-lens, -np.arange(t_max), side="left")
    total = np.zeros(n)
    a, alphas, scales = np.broadcast_to(start, (n, len(start))), [], []
    for t in range(t_max):
        m = active[t]
        a = (a[:m] if t == 0 else a[:m] @ step) * emit[ids[t, :m]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        total[:m] += np.log(c.astype(np.float64))
        if keep:
            alphas.append(a), scales.append(c)
    return total, alphas, scales, active


def expected(seqs: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray):
    """Expected counts of starts, steps and emissions, and the log likelihood."""
    k = len(start)
    starts, steps, emits, ll = np.zeros(k), np.zeros((k, k)), np.zeros((emit.shape[0], k)), 0.0
    for _, ids, lens in _batches(seqs):
        total, alphas, scales, active = forward(ids, lens, start, step, emit, keep=True)
        ll += total.sum()
        gammas: list = [None] * len(alphas)
        beta = np.ones((active[-1], k), emit.dtype)
        gammas[-1] = alphas[-1] * beta
        for t in range(len(alphas) - 2, -1, -1):
            m = active[t + 1]
            back = emit[ids[t + 1, :m]] * beta / scales[t + 1][:, None]
            steps += alphas[t][:m].T @ back
            beta = np.ones((active[t], k), emit.dtype)
            beta[:m] = back @ step.T
            gammas[t] = alphas[t] * beta
        starts += gammas[0].sum(axis=0)
        flat = np.concatenate([ids[t, : active[t]] for t in range(len(alphas))])
        g = np.concatenate(gammas)
        for j in range(k):
            emits[:, j] += np.bincount(flat, weights=g[:, j], minlength=emit.shape[0])
    return starts, steps * step, emits, ll


def maximised(starts, steps, emits, unigram, smooth):
    start = (starts + 1) / (starts + 1).sum()
    step = (steps + 1) / (steps + 1).sum(axis=1, keepdims=True)
    emit = (emits + smooth * unigram[:, None]) / (emits.sum(axis=0) + smooth)
    return start, step, emit


def _first(seqs, unigram, cfg: Config):
    """A start for Baum-Welch: states that stay, each with the symbols of some of the sample's texts; then rounds over the sample."""
    k, rng = cfg.states, np.random.default_rng(cfg.seed)
    start, step = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    emit = np.repeat(unigram[:, None], k, axis=1)
    if not seqs:
        return start, np.full((k, k), 1 / k), emit
    share = rng.dirichlet(np.full(k, 0.3), len(seqs))
    counts = np.zeros((len(unigram), k))
    for s, w in zip(seqs, share, strict=True):
        np.add.at(counts, s, w)
    emit = maximised(np.ones(k), np.ones((k, k)), counts, unigram, 1000.0)[2]
    for _ in range(cfg.warm_rounds):
        starts, steps, emits, _ = expected(seqs, *(x.astype(np.float32) for x in (start, step, emit)))
        start, step, emit = maximised(starts, steps, emits, unigram, cfg.smooth)
    return start, step, emit


def _blocks(raw, size: int) -> list[np.ndarray]:
    out = []
    for b in raw:
        x = np.frombuffer(b, np.uint16)
        out += [x[i : i + size] for i in range(0, len(x), size)]
    return out


def fit_and_score(docs: DataFrame, train: F.Column, cfg: Config = Config()) -> DataFrame:
    """docs' doc_id with held_out (not train), n_tokens, n_known, train_tokens, base_score and score, learning from the rows where train holds."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    lean(spark)
    assert cfg.head + cfg.classes + 1 <= 1 << 16
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = Kept(src.where("train").select(F.explode(words(lower_ascii(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("c")), "counts")
    n_docs = src.where("train").count()
    # The commonest words, by levels of their counts: whole levels from the top while they fit. A histogram of levels decides, so no task sends the driver a list of its own.
    level = F.when(F.char_length("word") <= cfg.head_chars, F.floor(F.ln("c") * LEVELS)).otherwise(-1)
    room, floor_ = cfg.head, None
    for r in sorted(counts.df.where(level >= 0).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if r["n"] > room:
            break
        room, floor_ = room - r["n"], r["level"]
    head = sorted(counts.df.where(level >= floor_).collect(), key=lambda r: (-r["c"], r["word"])) if floor_ is not None else []
    seen = counts.df.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all, n_head, end, symbols = seen["n"] + n_docs, seen["v"] + (n_docs > 0), len(head), len(head), len(head) + 1 + cfg.classes
    index = sc.broadcast([r["word"] for r in head])
    # The classes hold what is not in the head: a row for each class.
    cls = F.pmod(F.crc32(F.substring("word", -3, 3).cast("binary")), F.lit(cfg.classes))
    tail = counts.df.where(level < floor_) if floor_ is not None else counts.df
    in_class = np.zeros((cfg.classes, 2))
    for r in tail.groupBy(cls.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        in_class[r["k"]] = r["n"], r["v"]

    n_classes, head_n = cfg.classes, n_head

    def encode(batches):
        at = {w: i for i, w in enumerate(index.value)}
        rest: dict = {}
        lower, row = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), TaskContext.get().partitionId() << 40
        for pdf in batches:
            raw, tails = [], []
            for text in pdf["text"]:
                ws = text.encode("utf-8", "surrogatepass").translate(lower).decode("utf-8", "surrogatepass").split(" ") if not any(c in text for c in "\t\n\x0b\x0c\r") else [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").translate(lower).split()]
                ids, out = [], []
                for w in ws:
                    if not w:
                        continue
                    i = at.get(w)
                    if i is None:
                        i = rest.get(w)
                        if i is None:
                            if len(rest) > 300_000:
                                rest.clear()
                            i = rest[w] = head_n + 1 + zlib.crc32(w[-3:].encode("utf-8", "surrogatepass")) % n_classes
                        out.append(w)
                    ids.append(i)
                ids.append(head_n)
                raw.append(np.array(ids, np.uint16).tobytes())
                tails.append(" ".join(out))
            n = len(raw)
            yield pd.DataFrame({"row": np.arange(row, row + n), "doc_id": pdf["doc_id"], "train": pdf["train"], "ids": raw, "tails": tails})
            row += n

    coded = Kept(src.mapInPandas(encode, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, train boolean, ids binary, tails string"), "coded")
    head_counts = np.array([r["c"] for r in head] + [n_docs], np.float64)
    symbol_counts = np.concatenate((head_counts, in_class[:, 0]))
    unigram = (symbol_counts + ADD) / (symbol_counts.sum() + ADD * symbols)

    # Row numbers are chosen first; the tokens of the chosen rows only then come to the driver.
    hashed = F.xxhash64("doc_id", F.lit(cfg.seed))
    first = coded.df.where("train").select("row", hashed.alias("hash"), (F.octet_length("ids") / 2).cast("long").alias("n")).orderBy("hash", "row").limit(cfg.warm_docs).collect()
    chosen, left = [], cfg.warm_tokens
    for r in first:
        if r["n"] <= left:
            chosen.append((r["row"], r["hash"]))
            left -= r["n"]
    chosen = spark.createDataFrame(chosen, "row long, hash long")
    sample = sorted(coded.df.select("row", "doc_id", "ids").join(F.broadcast(chosen), "row").select("hash", "row", "ids").collect())
    model = _first(_blocks([r["ids"] for r in sample], cfg.block), unigram, cfg)
    k, block = cfg.states, cfg.block
    for _ in range(cfg.rounds):
        now = sc.broadcast([x.astype(np.float32) for x in model])

        def gather(batches, now=now):
            sums = None
            for pdf in regrouped(batches, lambda p: sum(map(len, p["ids"])), 4_000_000):
                got = expected(_blocks(pdf["ids"], block), *now.value)[:3]
                sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
            if sums is not None:
                # Rows of one sum for each state: symbols, then (below 0) the starts and the steps.
                used = np.flatnonzero(sums[2].any(axis=1))
                at = np.concatenate((used, [-1], -2 - np.arange(k)))
                rows = np.concatenate((sums[2][used], sums[0][None], sums[1]))
                yield pd.DataFrame({"at": at} | {f"s{j}": rows[:, j] for j in range(k)})

        parts = coded.df.where("train").select("ids").mapInPandas(gather, "at long, " + ", ".join(f"s{j} double" for j in range(k)))
        got = parts.groupBy("at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
        at, rows = got["at"].to_numpy(np.int64), got[[f"s{j}" for j in range(k)]].to_numpy(np.float64)
        starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
        emits[at[at >= 0]] = rows[at >= 0]
        starts[:] = rows[at == -1].sum(axis=0)
        steps[-2 - at[at < -1]] = rows[at < -1]
        model = maximised(starts, steps, emits, unigram, cfg.smooth)
    final = sc.broadcast([x.astype(np.float32) for x in model])

    # Words outside the head: their counts by a join on the word, summed again for each text. A word may be as common as any (one longer than head_chars), so its rows are dealt by salts; words that training has not seen find no count.
    spread = coded.df.where("tails <> ''").select("row", F.explode(F.split("tails", " ")).alias("word"))
    rest = meet(spread, tail, ["word"], "c", F.col("row")).groupBy("row").agg(F.sum(F.log10(F.col("c") + ADD)).alias("rest"), F.count("*").alias("known"))
    log_head = np.log10(head_counts + ADD)
    log_class = np.log10(in_class[:, 0] + ADD * (in_class[:, 1] + 1))
    known_head = (head_counts > 0).astype(np.int64)
    sizes = sc.broadcast((log_head, log_class, known_head))

    def score(batches):
        log_h, log_c, known = sizes.value
        own = np.concatenate((log_h, np.zeros(len(log_c))))
        own_known = np.concatenate((known, np.zeros(len(log_c), np.int64)))
        in_tail = np.concatenate((np.zeros(len(log_h), np.int64), np.ones(len(log_c), np.int64)))
        by_class = np.concatenate((np.zeros(len(log_h)), log_c))
        for pdf in regrouped(batches, lambda p: sum(map(len, p["ids"])), 4_000_000):
            seqs = [np.frombuffer(b, np.uint16) for b in pdf["ids"]]
            ll = np.zeros(len(seqs))
            for group, ids, lens in _batches(seqs):
                ll[group] = forward(ids, lens, *final.value)[0]
            end_ = np.cumsum([len(s) for s in seqs])
            flat = np.concatenate(seqs)
            cut = lambda x: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x[flat])))[np.concatenate(([0], end_))])
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "train": pdf["train"], "n_tokens": np.diff(end_, prepend=0), "known_head": cut(own_known), "n_tail": cut(in_tail), "base_head": cut(own), "hmm": ll / np.log(10) - cut(by_class)})

    scored = coded.df.select("row", "doc_id", "train", "ids").mapInPandas(score, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, known_head long, n_tail long, base_head double, hmm double")
    both = scored.join(rest, "row", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    both = both.withColumn("rest", F.coalesce("rest", F.lit(0.0)) + (F.col("n_tail") - F.col("known")) * float(np.log10(ADD)))
    return both.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known_head") + F.col("known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.col("rest") - F.col("n_tokens") * float(np.log10(n_all + ADD * (v_all + 1)))).alias("base_score"),
        (F.col("hmm") + F.col("rest")).alias("score"),
    )
