"""Ranked lexical search: postings are traversed in windows of documents, scores added up in a small array, the best harvested into a heap.

Terms are the runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. index() reads the texts once and puts at most `window`
documents that stand together into one row: their ids and lengths, the terms, and each term's postings (place in the window, occurrences). A window is
closed early at window_postings postings, so long texts make small windows and no row grows with the corpus. Documents keep the places that they were read at, so neither an id
that many rows share nor ids with gaps make a window large or empty.

search() takes the items by parts of at most part_terms terms (or one item), counts the terms' documents over all windows, and sends terms and weights to the executors. There, for each
window and item, the contributions of the item's terms are added to an array with a place for each document of the window (16 KB), an occupancy bitset of 64-bit words
collects which places were met, and the places met whose score reaches the least of the item's heap go into the heap of k. A task returns its heaps, which are
ranked over all tasks in two steps. No postings are shuffled and every document that holds a term is scored.

score = sum of w * ((1000000000*tf) div (1000*tf + 8*m)) over the item's distinct terms, w = floor(1000*ln((2N+2)/(2df+1))), m = 100-90 + (90*n*N) div L, with N documents
that have terms, L terms in all, n of the document, df documents that hold the term and tf its occurrences in the document.

Null and empty texts have no terms and are never found; they don't count in N. Equal scores rank by ascending doc_id, null ids last. Repeated rows and rows of one id are documents
of their own. Items that agree in item_id and text are one; other texts of one item_id are items of their own. A very long text is one window with its neighbours so far. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, lean

TOP, WINDOW, WINDOW_POSTINGS, PART_TERMS = 10, 2048, 2_000_000, 200_000
#: Bytes of a text: A-Z lower-cased, what separates terms made a space, bytes of characters beyond ASCII as they are.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SEGMENT = "docs long, terms_in_all long, ids array<long>, lengths binary, terms binary, starts binary, places binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def index(docs: DataFrame, window: int = WINDOW, window_postings: int = WINDOW_POSTINGS) -> DataFrame:
    """A row for each window of documents, as the docstring above has it."""
    if window > 65536:
        raise ValueError("places in a window are 16-bit numbers")
    schema = pa.schema([("docs", pa.int64()), ("terms_in_all", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "terms", "starts", "places", "tfs")]])

    def windows(batches):
        ids, lengths, vocab, of, tfs, distinct = [], array("q"), {}, array("i"), array("i"), array("i")

        def row():
            term = np.frombuffer(of, np.int32)
            order = np.argsort(term, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(vocab)))))
            place = np.repeat(np.arange(len(ids)), np.frombuffer(distinct, np.int32))
            held = [len(ids), sum(lengths), ids, lengths.tobytes(), b"\n".join(vocab), starts.astype("<i4").tobytes(), place[order].astype("<u2").tobytes(), np.frombuffer(tfs, np.int32)[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                ids.append(i)
                lengths.append(len(found))
                distinct.append(len(counts))
                of.extend([vocab.setdefault(t, len(vocab)) for t in counts])
                tfs.extend(counts.values())
                if len(ids) >= window or len(of) >= window_postings:
                    yield row()
                    ids, lengths, vocab, of, tfs, distinct = [], array("q"), {}, array("i"), array("i"), array("i")
        if ids:
            yield row()

    lean(docs.sparkSession)
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(windows, _SEGMENT)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _items(items: DataFrame, part_terms: int):
    """Lists of (item number, item_id, distinct terms), of about part_terms terms together or one item."""
    named = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    of, number = size // (4 * part_terms) + 1, 0
    for k in range(of):
        held, n = [], 0
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(of)) == k) if of > 1 else named
        for r in rows.toLocalIterator():
            own = sorted(set(terms_of(r["text"])))
            if held and n + len(own) > part_terms:
                yield held
                held, n = [], 0
            held.append((number, r["item_id"], own))
            number, n = number + 1, n + len(own)
        if held:
            yield held


def _found(segments: DataFrame, terms) -> DataFrame:
    """(term, df): documents of each of the broadcast terms."""
    def count(batches):
        wanted, df = terms.value, Counter()
        for batch in batches:
            for names, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                n = np.diff(np.frombuffer(starts, "<i4"))
                for at, t in enumerate(names.split(b"\n")):
                    if t in wanted:
                        df[t] += int(n[at])
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(df), pa.binary()), "df": pa.array(list(df.values()), pa.int64())})

    return segments.select("terms", "starts").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Heaps:
    """The k best documents of each item so far, over the windows of one task."""

    def __init__(self, items: list, weights: dict, n: int, total: int, k: int, window: int):
        self.items, self.weights, self.n, self.total, self.k = items, weights, n, total, k
        self.best: list[list[tuple]] = [[] for _ in items]
        self.scores, self.occupied = np.zeros(window, np.int64), np.zeros(-(-window // 64), np.uint64)

    def traverse(self, ids: list, lengths: np.ndarray, terms: bytes, starts: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> None:
        """Scores one window for all items."""
        m = np.array([10 + 90 * int(x) * self.n // self.total for x in lengths], np.int64)
        known = {}
        for at, t in enumerate(terms.split(b"\n")):
            if t in self.weights:
                own, tf = places[starts[at] : starts[at + 1]].astype(np.int64), tfs[starts[at] : starts[at + 1]].astype(np.int64)
                bits = np.zeros(len(self.occupied) * 64, np.uint8)
                bits[own] = 1
                known[t] = own, self.weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[own])), np.packbits(bits, bitorder="little").view(np.uint64)
        null = np.array([i is None for i in ids])
        number = np.array([0 if i is None else i for i in ids], np.int64)
        for (_, _, own), heap in zip(self.items, self.best, strict=True):
            met = [known[t] for t in own if t in known]
            if not met:
                continue
            for at, adds, bits in met:
                self.scores[at] += adds
                self.occupied |= bits
            at = np.flatnonzero(np.unpackbits(self.occupied.view(np.uint8), bitorder="little"))
            self._harvest(heap, at, self.scores[at], number, null)
            self.scores[at] = 0
            self.occupied[:] = 0

    def _harvest(self, heap: list, at: np.ndarray, scores: np.ndarray, number: np.ndarray, null: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.k else 1
        at, scores = at[scores >= least], scores[scores >= least]
        if len(at) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            at, scores = at[scores >= least], scores[scores >= least]
        for j in np.lexsort((number[at], null[at], -scores))[: self.k].tolist():
            i = int(at[j])
            x = (int(scores[j]), not null[i], -int(number[i]))
            if len(heap) < self.k:
                heapq.heappush(heap, x)
            elif heap[0] < x:
                heapq.heapreplace(heap, x)
            else:
                break


def search(docs: DataFrame, items: DataFrame, k: int = TOP, window: int = WINDOW, window_postings: int = WINDOW_POSTINGS, part_terms: int = PART_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    segments = Kept(index(docs, window, window_postings), "segments").df
    all_ = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms_in_all"), F.lit(0)).alias("total")).first()
    n, total = all_["n"], all_["total"]
    out = None
    for held in _items(items, part_terms) if n else ():
        terms = spark.sparkContext.broadcast({t for _, _, own in held for t in own})
        df = {bytes(r["term"]): r["df"] for r in _found(segments, terms).collect()}  # no more than part_terms rows, or one item's
        terms.unpersist()
        sent = spark.sparkContext.broadcast((held, {t: weight(n, c) for t, c in df.items()}))

        def score(batches, sent=sent):
            heaps = Heaps(*sent.value, n, total, k, window)
            for batch in batches:
                for r in range(batch.num_rows):
                    cell = {c: batch.column(c)[r].as_py() for c in ("ids", "lengths", "terms", "starts", "places", "tfs")}
                    heaps.traverse(cell["ids"], np.frombuffer(cell["lengths"], np.int64), cell["terms"], np.frombuffer(cell["starts"], "<i4"), np.frombuffer(cell["places"], "<u2"), np.frombuffer(cell["tfs"], "<i4"))
            found = [(no, -x[2] if x[1] else None, x[0]) for (no, _, _), heap in zip(heaps.items, heaps.best, strict=True) for x in heap]
            task = TaskContext.get().partitionId() % 1024
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([task] * len(found), pa.int32())], names=["item", "doc_id", "score", "task"])

        got = segments.select("ids", "lengths", "terms", "starts", "places", "tfs").mapInArrow(score, "item long, doc_id long, score long, task int")
        names = spark.createDataFrame([(no, i) for no, i, _ in held], f"item long, item_id {kind}")
        got = got.join(F.broadcast(names), "item")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_sql(k: int = TOP) -> str:
    """The same rows in DuckDB's SQL, from all pairs of an item's term and a document's."""
    terms = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
    words AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, {terms} AS term FROM docs) GROUP BY row, term),
    lengths AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM words GROUP BY row),
    totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM words GROUP BY term), totals),
    asked AS (SELECT DISTINCT item_id, text, term FROM (SELECT item_id, text, {terms} AS term FROM benchmark)),
    scored AS (SELECT a.item_id, a.text, d.doc_id, d.row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
        FROM asked a JOIN words USING (term) JOIN weights USING (term) JOIN lengths USING (row) JOIN docs d USING (row), totals GROUP BY a.item_id, a.text, d.doc_id, d.row)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {k}"""
