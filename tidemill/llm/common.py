"""What the training-data operators share: tables, written intermediates, hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.batches import PIECE_BYTES, arrow_batches, map_rows, pieces
from tidemill.sources.tables import fresh_path, parquet
from tidemill.sources.tables import kept as written

__all__ = ["PIECE_BYTES", "arrow_batches", "fresh_path", "map_rows", "pieces", "table", "written"]

#: One of the input tables.
table = parquet


def squeezed(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as take least room; those that are larger follow with their places."""
    sizes = {k: k * len(values) + 16 * int((values >= (1 << 8 * k) - 1).sum()) for k in (1, 2, 4)}
    width = min(sizes, key=sizes.get)
    most = (1 << 8 * width) - 1
    large = np.flatnonzero(values >= most)
    return bytes([width]) + np.minimum(values, most).astype(f"<u{width}").tobytes() + large.astype("<i8").tobytes() + values[large].astype("<i8").tobytes()


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    """``n`` counts that ``squeezed`` has packed."""
    width = data[0]
    values = np.frombuffer(data, f"<u{width}", n, 1).astype(np.int64)
    places, counts = np.frombuffer(data[1 + width * n :], "<i8").reshape(2, -1)
    values[places] = counts
    return values


def sum_arrays(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], None]], size: int, blocks: int = 16) -> np.ndarray:
    """Adds one int64 array of fixed ``size`` up over all tasks.

    Every task fills an array of its own and sends it in ``blocks`` pieces; Spark adds
    equal pieces, and the driver gets the sum, whose size does not depend on the input. The sum
    is packed on its way too: the driver's JVM holds what it collects several times over.
    """
    step = -(-size // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, add = np.zeros(size, np.int64), make()
        for batch in pieces(batches):
            add(batch, total)
        yield pa.RecordBatch.from_pydict({"block": list(range(blocks)), "data": [squeezed(total[i * step : (i + 1) * step]) for i in range(blocks)]}, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))

    def add_up(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in pieces:
            for block, data in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), strict=True):
                part = unsqueezed(data, min(step, size - block * step))
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_pydict({"block": list(sums), "data": [squeezed(x) for x in sums.values()]}, schema=pa.schema([("block", pa.int32()), ("data", pa.binary())]))

    parts = arrow_batches(df).mapInArrow(run, "block int, data binary").repartition(blocks, "block").mapInArrow(add_up, "block int, data binary")
    total = np.zeros(size, np.int64)
    for row in parts.collect():
        part = total[row.block * step : (row.block + 1) * step]
        part += unsqueezed(row.data, len(part))
    return total


def held_out(id_col: str, parts: int, remainder: int):
    """Whether crc32(id as text) mod ``parts`` is ``remainder``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == remainder, F.lit(False))


def drawn_by_hash(id_col, part):
    """Whether an id is in a sample of this part of all; the hash tells as many ids apart as any table has."""
    wide = 1 << 52
    return F.pmod(F.xxhash64(id_col), F.lit(wide)) < part * float(wide)


# --- hashing of words in a buffer of UTF-8 ---------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the next call."""
    key = "inv" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        step = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, np.uint64)
        step[0] = 1
        _powers[key] = np.multiply.accumulate(step)
    return _powers[key][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(len(data), True)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _ODD)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_bytes(text: str | None) -> np.ndarray:
    """The UTF-8 of a text with A-Z lower-cased."""
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased UTF-8."""
    return span_hashes(data, *runs(~_SPACE[data]))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; fewer words count as one run; none give none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total = total * _BASE + words[k : k + n]
    return np.unique(mix(total + np.uint64(min(width, len(words)))))


def either(parts: list):
    """The disjunction of Columns."""
    return reduce(lambda a, b: a | b, parts)
