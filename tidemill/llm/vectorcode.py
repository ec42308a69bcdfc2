"""Operator 12: product codes of vectors, exact to the integer.

Vectors become integers and are cut into parts; each part has a codebook that rounds of assignment
and averaging improve. The nearest entry is found by screening: one float32 matrix product gives every
distance with a bound on its rounding error, and only entries whose interval overlaps the best one's
are computed again in int64. So codes, sums and errors are those of exact arithmetic, in any order of rows.

A round is one pass over the table. Tasks send a sum and a count for each entry, Spark adds them up,
and the driver holds the codebooks alone: their size depends on the vectors' length, not on their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Unit roundoff of float32, and of float64.
U32, U64 = 2.0**-24, 2.0**-53
#: Rows that are screened at a time.
BLOCK = 4096
#: Beyond this size of a component, or length of a part, distances may leave int64 and are computed with Python's integers.
SAFE, SAFE_WIDTH = 1 << 24, 4096
#: Components must be below this, as int64 has to hold them and their differences.
MOST = 1 << 61


def integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(1024 x) of the vectors that can be kept: which rows they are, and a matrix.

    Kept are vectors of ``length`` components that are neither null nor non-finite, nor so large that int64 could not hold them.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(x * SCALE)
        good = (np.abs(scaled) < MOST).all(1)
    return rows[good], scaled[good].astype(np.int64)


def cut(x: np.ndarray) -> np.ndarray:
    """Rows x parts x components of a part; zeros fill the last part up where the length is no multiple of the number of parts."""
    short = -x.shape[1] % PARTS
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), PARTS, (x.shape[1] + short) // PARTS)


class Codebook:
    """The entries of one part and what screening needs of them."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.large = int(np.abs(self.entries).max(initial=0)) > SAFE or entries.shape[1] > SAFE_WIDTH
        if not self.large:
            self.single = np.ascontiguousarray(self.entries.astype(np.float32).T)
            self.squares = (self.entries * self.entries).sum(1).astype(np.float64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, for each row; ties go to the lower index."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.large or int(np.abs(x).max(initial=0)) > SAFE:
            return self.by_whole_numbers(x)
        index, distance = [], []
        for at in range(0, len(x), BLOCK):
            for out, part in zip((index, distance), self.screened(x[at : at + BLOCK]), strict=True):
                out.append(part)
        return np.concatenate(index), np.concatenate(distance)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A bound on the error of |c|^2 - 2 x.c for any entry c, for each row x.

        Components up to 2^24 are exact in float32. A product of ``w`` terms, added in any order, is off by at most
        g |x|.|c| with g = w u / (1 - w u) <= 2 w u; by Cauchy |x|.|c| is at most the product of the norms. What follows is
        float64: |c|^2 is exact there up to 2^53 and off by one part in 2^53 beyond, and so is the difference. The bound is taken twice as large
        for its own rounding.
        """
        width = x.shape[1]
        most = np.sqrt(self.squares.max(initial=0.0))
        reach = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * most
        return 2 * (4 * width * U32 * reach + 4 * U64 * (most * most + 2 * reach))

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and entry of every pair whose interval overlaps that of the row's best, by row, then entry."""
        product = x.astype(np.float32) @ self.single
        score = self.squares[None, :] - 2 * product.astype(np.float64)
        return np.nonzero(score <= (score.min(1) + 2 * self.radius(x))[:, None])

    def screened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, entry = self.candidates(x)
        gap = x[row] - self.entries[entry]
        exact = np.einsum("ij,ij->i", gap, gap)
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, first)
        equal = np.flatnonzero(exact == best[row])  # the first of a row has the lowest index
        return entry[equal[np.searchsorted(row[equal], np.arange(len(x)))]], best

    def by_whole_numbers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by Python's integers, for components of any size; a distance beyond int64 is given as its greatest value."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        entries = self.entries.astype(object)
        for i, row in enumerate(x.astype(object)):
            gaps = ((entries - row) ** 2).sum(1) if x.shape[1] else np.zeros(len(entries), object)
            index[i] = int(np.argmin(gaps))
            distance[i] = min(int(gaps[index[i]]), (1 << 63) - 1)
        return index, distance


def first_rows(vectors: DataFrame, id_col: str, vector_col: str, length: int) -> np.ndarray:
    """Integers of the rows with the smallest ids; of equal ids those with smaller components. Null ids come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), length)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    kept = arrow_batches(vectors.select(id_col, vector_col)).mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, x array<bigint>")
    top = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    return np.array([r.x for r in top], np.int64).reshape(len(top), length)


def sums_of_entries(vectors: DataFrame, vector_col: str, length: int, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry in use: how many parts are nearest to it and their sum. At most PARTS x ENTRIES rows reach the driver."""
    entries, width = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        count, high, low = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            x = cut(integers(batch.column(0), length)[1])
            for k, book in enumerate(own if len(x) else []):
                index, _ = book.nearest(x[:, k])
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                count[k][used] += n
                high[k][used] += np.add.reduceat(x[order, k] >> 24, first, 0)  # in halves, so that int64 holds the sums of large components too
                low[k][used] += np.add.reduceat(x[order, k] & 0xFFFFFF, first, 0)
        part, entry = np.nonzero(count)
        sums = [[str((h << 24) + v) for h, v in zip(high[k, e].tolist(), low[k, e].tolist(), strict=True)] for k, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(sums, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    each = arrow_batches(vectors.select(vector_col)).mapInArrow(run, "part int, entry int, n bigint, sums array<string>")
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    return {(r.part, r.entry): (r.n, [int(v) for v in r.sums]) for r in added.collect()}


def improved(books: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> list[np.ndarray]:
    """Codebooks with each entry in use replaced by floor(sum / count)."""
    new = [b.copy() for b in books]
    for (part, entry), (n, total) in sums.items():
        new[part][entry] = [v // n for v in total]
    return new


def vector_length(vectors: DataFrame, id_col: str, vector_col: str) -> int | None:
    """The length of the vector with the smallest id that can be kept; None if there is none."""
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float(MOST)))
    row = vectors.where(F.coalesce(finite, F.lit(False))).agg(F.min(F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.size(v).alias("size"))).alias("first")).first()
    return row.first.size if row.first else None


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The vectors' length and the codebook of each part after ``rounds`` passes over all rows."""
    length = vector_length(vectors, id_col, vector_col)
    if length is None:
        return 0, [np.zeros((0, 0), np.int64)] * PARTS
    start = cut(first_rows(vectors, id_col, vector_col, length))
    books = [np.ascontiguousarray(start[:, k]) for k in range(PARTS)]
    for _ in range(rounds):
        books = improved(books, sums_of_entries(vectors, vector_col, length, books))
    return length, books


def encode(vectors: DataFrame, length: int, books: list[np.ndarray], vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """Adds ``code`` (two hex digits for each part) and ``error`` (squared distances of all parts) to the columns of ``keep``, for each vector that is kept."""
    fields = [vectors.schema[name] for name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            rows, x = integers(batch.column(0), length)
            if not len(rows):
                continue
            found = [book.nearest(part) for book, part in zip(own, np.moveaxis(cut(x), 1, 0), strict=True)]
            codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
            distances = [d for _, d in found]
            error = sum(distances) if max(int(d.max()) for d in distances) < 1 << 60 else np.array([min(sum(map(int, d)), (1 << 63) - 1) for d in zip(*distances, strict=True)], np.int64)
            kept = [batch.column(1 + i).take(pa.array(rows)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], [*keep, "code", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "code string", "error bigint"])
    return arrow_batches(vectors.select(F.col(vector_col), *keep)).mapInArrow(run, schema)


def books_sha256(books: list[np.ndarray]) -> str:
    """The digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Returns ``id_col``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` for each vector that is kept.

    Dropped are vectors that are null, hold null or non-finite components, are longer or shorter than that of the smallest
    kept id (of equal ids the shortest), or have components of 2^51 and more. Fewer than 256 rows give as many entries. Repeated ids and rows count and are returned each; the first
    codebooks take equal ids in the order of their components; a null id comes last. A length that is no multiple of four is filled up with zeros, empty vectors have
    errors of 0. Errors beyond a long are its greatest value. Null labels are one label. Further columns are left out; a table without a vector to keep gives none.
    """
    length, books = fit(vectors, id_col, vector_col, rounds)
    rows = written(encode(vectors.select(F.col(id_col), F.col(vector_col), F.col(label_col).alias("__label")), length, books, vector_col, (id_col, "__label")), "vector-codes")
    # a label with a third of all rows is summed in each task first; the join sends its sum to the parts that Spark cuts a large key into
    sums = rows.groupBy(F.col("__label").alias("__of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return rows.join(sums, F.col("__label").eqNullSafe(F.col("__of"))).select(id_col, "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))

