"""Vector code compression: parts of integer vectors, deduplicated, Lloyd's rounds over the distinct parts, codes joined back.

Each component x of a vector becomes floor(scale * x), and the vector is cut into equal consecutive parts. Equal parts at one position become one
row with a weight, so that a part that a third of all vectors share costs as much as any other. Each position has a codebook of `entries` entries, at first the parts
of the vectors of least id. A round deals every distinct part to the nearest entry (squared distance, ties to the lower index) and replaces an entry by the
floor of its parts' weighted mean; entries that got none stay. Tasks add their rows up, so a round sends one row per component of the codebooks and task, and
the driver holds the codebooks only. After the last round the parts are dealt once more, and codes and errors are joined back to the vectors by (position, part),
the joins of parts of many vectors being salted by their weight. All arithmetic is on integers and exact.

Rows whose vector is null or has null or non-finite components are dropped. Null ids come last. Repeated rows, and vectors of one id, are rows of their own; of the
vectors of one id the lesser ones come first. With fewer vectors than entries the codebooks are shorter. Vectors of different lengths, of a length that the number of
parts does not divide, or so large that a squared distance could pass 63 bits are refused with an error. An empty table gives an empty result; extra columns stay out of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, meet

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Differences of one step of the assignment.
_STEP = 1 << 20


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integer components v of the rows that are kept."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    kept = vectors.where(F.col("embedding").isNotNull() & F.forall(F.col("embedding").cast("array<double>"), finite))
    return kept.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale)).alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each row of x."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, _STEP // max(1, book.size))
    for a in range(0, len(x), step):
        d = ((x[a : a + step, None, :] - book[None]) ** 2).sum(axis=2)
        at[a : a + step] = d.argmin(axis=1)
        far[a : a + step] = d.min(axis=1)
    return at, far


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and parts of a batch of distinct parts."""
    x = batch.column("part").flatten().to_numpy(zero_copy_only=False)
    return batch.column("pos").to_numpy(zero_copy_only=False), x.reshape(batch.num_rows, width)


def _round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts."""
    positions, entries, width = books.shape

    def add(batches):
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            pos, x = _read(batch, width)
            w = batch.column("weight").to_numpy(zero_copy_only=False)
            for p in np.unique(pos):
                own = pos == p
                at = nearest(x[own], books[p])[0]
                np.add.at(total[p], at, x[own] * w[own, None])
                np.add.at(n[p], at, w[own])
        used = np.argwhere(n > 0)
        at = np.repeat(used, width, axis=0)
        yield pa.RecordBatch.from_pydict({"pos": at[:, 0].astype(np.int32), "entry": at[:, 1].astype(np.int32), "j": np.tile(np.arange(width, dtype=np.int32), len(used)), "total": total[used[:, 0], used[:, 1]].reshape(-1), "n": n[at[:, 0], at[:, 1]]})

    sums = distinct.mapInArrow(add, "pos int, entry int, j int, total long, n long").groupBy("pos", "entry", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # positions x entries x width rows at most
        out[r["pos"], r["entry"], r["j"]] = r["total"] // r["n"]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by position, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows (row, vec_id, label, pos, part) of all vectors, the distinct parts (pos, part, weight), and the codebooks (positions, entries, width)."""
    rows = Kept(integers(vectors, scale).select("*", F.monotonically_increasing_id().alias("row")), "vectors").df
    shape = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", F.abs))).alias("far"), F.count("*").alias("n")).first()
    size = shape["size"] or 0
    if shape["n"] and (shape["least"] != size or size % parts):
        raise ValueError(f"vectors of {shape['least']} to {size} components can't be cut into {parts} equal parts")
    far = shape["far"] or 0
    if (2 * far) ** 2 * size >= 2**63 or far * shape["n"] >= 2**63:
        raise ValueError("components are too large for exact distances of 63 bits")
    width = size // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v", F.asc_nulls_last("label")).limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", i * width + 1, width))
    cuts = rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = Kept(cuts.groupBy("pos", "part").agg(F.count("*").alias("weight")), "parts").df
    for _ in range(rounds if first else 0):
        books = _round(distinct, books)
    return cuts, distinct, books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error, label_error (of all vectors of the label), codebooks_sha256."""
    cuts, distinct, books = codebooks(vectors, parts, entries, rounds, scale)
    width = books.shape[2]

    def deal(batches):
        for batch in batches:
            pos, x = _read(batch, width)
            at, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                at[pos == p], far[pos == p] = nearest(x[pos == p], books[p])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("weight"), pa.array(at.astype(np.int32)), pa.array(far)], names=["pos", "part", "weight", "at", "far"])

    dealt = Kept(distinct.mapInArrow(deal, "pos int, part array<long>, weight long, at int, far long"), "dealt").df
    met = meet(cuts, dealt, ["pos", "part"], "weight", F.col("row"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at"))), lambda x: F.lpad(F.lower(F.hex(x["at"])), 2, "0")), "")
    coded = Kept(met.groupBy("row", "vec_id", "label").agg(code.alias("code"), F.sum("far").alias("error")), "codes").df
    labels = Kept(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("vectors")), "label-errors").df
    return meet(coded, labels, ["label"], "vectors", F.col("row")).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def encode_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in DuckDB's SQL, with every part of every vector on its own; for tables with unique, not null ids."""
    near = "SELECT vec_id, pos, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT c.vec_id, c.pos, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN {book} b USING (pos, j) GROUP BY c.vec_id, c.pos, b.entry) GROUP BY vec_id, pos"
    steps = []
    for k in range(1, rounds + 1):
        old = f"book{k - 1}"
        steps += [f"near{k} AS MATERIALIZED ({near.format(book=old)})"]
        steps += [f"mean{k} AS (SELECT n.pos, n.entry, c.j, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM near{k} n JOIN comp c USING (vec_id, pos) GROUP BY n.pos, n.entry, c.j)"]
        steps += [f"book{k} AS MATERIALIZED (SELECT b.pos, b.entry, b.j, coalesce(m.x, b.x) AS x FROM {old} b LEFT JOIN mean{k} m USING (pos, entry, j))"]
    return f"""WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    flat AS (SELECT vec_id, width, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
    comp AS MATERIALIZED (SELECT vec_id, CAST(i // width AS INTEGER) AS pos, CAST(i % width AS INTEGER) AS j, CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT) AS x FROM flat),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
    book0 AS MATERIALIZED (SELECT c.pos, f.entry, c.j, c.x FROM first f JOIN comp c USING (vec_id)),
    {', '.join(steps)},
    last AS MATERIALIZED ({near.format(book=f'book{rounds}')}),
    coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', l.entry), '' ORDER BY l.pos) AS code, CAST(sum(l.d) AS BIGINT) AS error FROM kept k JOIN last l USING (vec_id) GROUP BY k.vec_id, k.label)
    SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, j)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""
