"""Vector code compression: product codes of whole-number vectors, found by partial-distance search.

Vectors are cut into equal parts. The codebook of a part starts as that part of the vectors of the least ids;
each round assigns every part to its nearest entry (squared distance, ties to the lower index) and puts the
floored mean of its parts in an entry's place; entries without parts stay.

The search goes through the dimensions in descending variance of the codebook. What an entry has come to is
compared after every dimension with the best whole distance known for that vector (at first that of the
entry nearest in the first dimension), and entries strictly over it are dropped by masks. Entries go by blocks, so
that what one block finds bounds the next one.

Spark deals out the vectors, sums parts and counts by entry within each task and then by shuffle; what the
driver sees of a round is one row for each entry and dimension, whatever the number of vectors. A lost
executor's tasks are repeated from the input.

Results: null vectors and those with null, NaN or infinite components have no row, nor have empty ones or those
whose length isn't a multiple of ``parts`` or differs from that of the least id's. A null id is one like
others, after all of them. Repeated rows all count and all have their row; ids that tie are ordered by their
vectors. With fewer vectors than entries the codebooks are shorter. Long vectors are taken whole. An empty table has no rows. Other
columns than those named go, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .vectors import comparable, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors and entries that are compared at once.
ROWS, BLOCK = 2048, 16
#: A label with more than one in so many rows is summed apart: there are fewer than that many.
HOT_SHARE = 1000


@dataclass
class Codebooks:
    """An array of entries (index, dimension) for each part, and what their vectors are scaled by."""

    books: list[np.ndarray]
    scale: int

    def digest(self) -> str:
        numbers = (str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, ties to the lower index."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order].T), np.ascontiguousarray(book[:, order].T)
    by_first = np.argsort(book[0], kind="stable")
    firsts = book[0][by_first]
    after = np.minimum(np.searchsorted(firsts, x[0]), len(firsts) - 1)
    before = np.maximum(after - 1, 0)
    index = by_first[np.where(np.abs(firsts[after] - x[0]) <= np.abs(firsts[before] - x[0]), after, before)]
    best = ((x - book[:, index]) ** 2).sum(axis=0)
    for low in range(0, book.shape[1], BLOCK):
        part = book[:, low : low + BLOCK]
        begun = (x[0][:, None] - part[0][None, :]) ** 2
        row, entry = np.nonzero(begun <= best[:, None])
        total = begun[row, entry]
        for j in range(1, len(x)):
            total += (x[j][row] - part[j][entry]) ** 2
            alive = total <= best[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        if not len(row):
            continue
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(total, first)
        tied = total == np.repeat(least, np.diff(np.append(first, len(row))))
        lowest = low + np.minimum.reduceat(np.where(tied, entry, BLOCK), first)
        at = row[first]
        better = (least < best[at]) | (lowest < index[at])  # none is over the best one
        index[at[better]], best[at[better]] = lowest[better], least[better]
    return index, best


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (row, part) and summed distances of some vectors."""
    width = books[0].shape[1]
    found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], axis=1), np.sum([d for _, d in found], axis=0)


def blocks(batch: pa.RecordBatch, column: int, length: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        yield at, matrix(batch.column(column).slice(at, ROWS), length, scale)


def moved(rows: DataFrame, length: int, now: Codebooks) -> Codebooks:
    """The codebooks after one round over all rows (column v)."""
    parts, entries, width = len(now.books), len(now.books[0]), now.books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x in blocks(batch, 0, length, now.scale):
                index, _ = assigned(x, now.books)
                for p in range(parts):
                    count[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(total[p], index[:, p], x[:, p * width : (p + 1) * width])
        p, e, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)) for a in (p, e, j)] + [pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], names=["p", "e", "j", "total", "n"]
        )

    sums = rows.select("v").mapInArrow(run, "p int, e int, j int, total long, n long")
    sums = sums.groupBy("p", "e", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    books = [book.copy() for book in now.books]
    for r in sums.collect():  # a row for each entry and dimension at most
        books[r.p][r.e, r.j] = r.total // r.n
    return Codebooks(books, now.scale)


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks from all vectors; None without any."""
    rows, length = comparable(vectors, id_col, vector_col, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    if not first.num_rows:
        return None
    x = matrix(first.column("v").combine_chunks(), length, scale)
    books = Codebooks([x[:, p : p + length // parts].copy() for p in range(0, length, length // parts)], scale)
    for _ in range(rounds):
        books = moved(rows, length, books)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, ``keep``, code (a byte for each part) and error (summed squared distances) of every vector."""
    if books is not None and len(books.books[0]) > 256:
        raise ValueError("a code has one byte for each part, so there are 256 entries at most")
    parts = len(books.books) if books else 1
    rows, length = comparable(vectors, id_col, vector_col, parts, keep)
    if books is None or length != parts * books.books[0].shape[1]:
        rows = rows.where("false")
    kept = [c for c in keep if c in rows.columns]
    rows = rows.select("id", *kept, "v")
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch, batch.num_columns - 1, length, books.scale):
                index, error = assigned(x, books.books)
                codes = [row.tobytes() for row in index.astype(np.uint8)]
                same = [c.slice(at, len(x)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(codes, pa.binary()), pa.array(error)], names=["id", *kept, "code", "error"])

    return rows.mapInArrow(run, f"id long, {kinds}code binary, error long").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Adds approximate, the whole-number vector that a code stands for."""
    entries = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book.tolist())) for book in books.books))
    numbers = [F.conv(F.hex(F.substring(code_col, p + 1, 1)), 16, 10).cast("int") for p in range(len(books.books))]
    return coded.withColumn("approximate", F.flatten(F.array(*(entries[p][n] for p, n in enumerate(numbers)))))


def with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds the sum of a column over equal values of another, nulls together.

    Sums are made before rows meet. Those of groups with over one in ``HOT_SHARE`` rows, of which there are fewer
    than that, are broadcast; the other groups are small and meet their rows by a shuffle.
    """
    sums = written(rows.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias(name), F.count("*").alias("_n")), "group-sums")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).collect()[0].n
    hot, cold = sums.where(F.col("_n") * HOT_SHARE > total).drop("_n"), sums.where(F.col("_n") * HOT_SHARE <= total).drop("_n")
    same = F.col(group).eqNullSafe(F.col("_g"))
    often = rows.join(F.broadcast(hot), same).drop("_g")
    seldom = rows.join(F.broadcast(hot.select("_g")), same, "left_anti").join(cold, same).drop("_g")
    return often.unionByName(seldom)


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    coded = encode(vectors, books, keep=("label",))
    coded = written(coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    done = with_group_sum(coded, "label", "error", "label_error")
    return done.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: assignments a{k} to codebooks c{k} and the next codebooks."""
    return f"""a{k} as (select rn, p, min(list_sum(list_transform(list_zip(pieces.x, c{k}.x), lambda y: (y[1] - y[2]) ** 2))::bigint * 64 + e) best from pieces join c{k} using (p) group by 1, 2),
m{k} as (select p, best % 64 e, j, sum(x[j])::bigint s, count(*) n from a{k} join pieces using (rn, p), unnest(range(1, len(x) + 1)) t(j) group by 1, 2, 3),
n{k} as (select p, e, list((s - ((s % n) + n) % n) // n order by j) x from m{k} group by 1, 2),
c{k + 1} as materialized (select p, e, coalesce(n{k}.x, c{k}.x) x from c{k} left join n{k} using (p, e))"""


OP11_SQL = f"""with kept as materialized (select row_number() over (order by vec_id, embedding) - 1 rn, vec_id, label, len(embedding) // 16 w, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
  from embeddings where len(embedding) > 0 and len(embedding) % 16 = 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pieces as materialized (select rn, p, v[p * w + 1 : p * w + w] x from kept, unnest(range(16)) t(p)),
c0 as (select p, rn e, x from pieces where rn < 64),
{_round(0)},
{_round(1)},
a2 as materialized (select rn, p, min(list_sum(list_transform(list_zip(pieces.x, c2.x), lambda y: (y[1] - y[2]) ** 2))::bigint * 64 + e) best from pieces join c2 using (p) group by 1, 2),
coded as (select rn, string_agg(printf('%02x', (best % 64)::int), '' order by p) code, sum(best // 64)::bigint error from a2 group by 1),
books as (select sha256(string_agg(x[j]::varchar, ',' order by p, e, j)) h from c2, unnest(range(1, len(x) + 1)) t(j))
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, h codebooks_sha256 from coded join kept using (rn), books"""
