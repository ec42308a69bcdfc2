"""Operator 13: runs of periodic words by probing harmonic grids.

A run of period p holds at least two neighbouring points of the grid 0, p, 2p, ... at which the word
equals the next one on the grid. All grids of a text have about n log n points; they are compared as
arrays. What survives is extended both ways by comparing chunks of the text with the text p words on.
Points of a grid within a run that was found, whose period divides p, are skipped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows

#: A run has this many words at least, and its period this many times.
LEAST_LENGTH, LEAST_TIMES = 24, 3
#: Grid points that are compared at a time, about; words of the first chunk of an extension.
POINTS, CHUNK = 1 << 20, 32

Run = tuple[int, int, int]


def ahead(words: np.ndarray, at: int, period: int) -> int:
    """How many words from ``at`` on equal the ones ``period`` on."""
    i, size, n = at, CHUNK, len(words) - period
    while i < n:
        stop = min(n, i + size)
        differ = words[i:stop] != words[i + period : stop + period]
        k = int(differ.argmax())
        if differ[k]:
            return i + k - at
        i, size = stop, size * 2
    return n - at


def back(words: np.ndarray, at: int, period: int) -> int:
    """How many words before ``at`` equal the ones ``period`` on, without a gap."""
    i, size = at, CHUNK
    while i > 0:
        start = max(0, i - size)
        differ = (words[start:i] != words[start + period : i + period])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - i + k
        i, size = start, size * 2
    return at


def grid_points(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All points jp with (j + 1)p < n of the grids first..last, and their p."""
    periods = np.arange(first, last + 1)
    counts = (n - 1) // periods
    period = np.repeat(periods, counts)
    j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
    return j * period, period


def next_last(n: int, first: int, top: int) -> int:
    """The last of the grids from ``first`` on that are probed together."""
    last, points = min(top, max(8, 8 * first)), 0
    if (n - 1) // first * (last - first + 1) <= POINTS:
        return last
    for p in range(first, last + 1):
        points += (n - 1) // p
        if points > POINTS:
            return max(first, p - 1)
    return last


def find_runs(words: np.ndarray) -> list[Run]:
    """Start, length and period of every run, by start, then period.

    A run is a stretch that keeps its smallest period, that no neighbouring word extends, of 24 words at
    least and three times its period at least.
    """
    n = len(words)
    top = n // LEAST_TIMES
    if n < LEAST_LENGTH:
        return []
    found: dict[tuple[int, int], int] = {}
    # of the run found last over each word: its period and where it ends
    over, until = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = 1
    while first <= top:
        last = next_last(n, first, top)
        at, period = grid_points(n, first, last)
        equal = words[at] == words[at + period]
        # a stretch of equal words as long as two periods holds two neighbouring points
        equal[:-1] &= equal[1:] & (period[:-1] == period[1:])
        equal[-1:] = False
        at, period = at[equal], period[equal]
        for offset in (1, 2, 3):  # most of what agrees by chance goes here
            step = np.minimum(offset, period)
            keep = words[at + step] == words[at + step + period]
            at, period = at[keep], period[keep]
        own = over[at]
        known = (own > 0) & (at + period < until[at]) & (period % np.maximum(own, 1) == 0)
        at, period = at[~known].tolist(), period[~known].tolist()
        seen, p = 0, 0
        for i, q in zip(at, period, strict=True):
            if q != p:
                seen, p = 0, q
            if i < seen or (over[i] and q % over[i] == 0 and i + q < until[i]):
                continue
            right = i + ahead(words, i, q)
            seen = right
            left = i - back(words, i, q)
            length = right - left + q
            if length >= max(LEAST_LENGTH, LEAST_TIMES * q) and (left, right + q) not in found:
                found[left, right + q] = q
                over[left : right + q], until[left : right + q] = q, right + q
        first = last + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def best_run(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones that which starts first, then the smaller period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def repeated(words: list[bytes], key: int) -> list[bytes]:
    """The words of a text, or of one in ten keys with a stretch repeated up to the end."""
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Returns ``id_col``, ``runs`` (array of start, length, period in words, by start, then period), ``best`` (one of them or null) and ``collapsed`` for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``collapsed`` has the words that no run contains after its first period, joined by
    one space. A null or empty text has no words, no run and an empty ``collapsed``. ``plant`` repeats a stretch in a tenth of
    all texts, chosen by the id, before it looks; a null id is never chosen. Repeated rows give one row each, further columns are left
    out, an empty table gives an empty one. Rows are not shuffled.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_runs, bests, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if plant and key is not None:
                    words = repeated(words, key)
                found = find_runs(numbered(words)) if len(words) >= LEAST_LENGTH else []
                if found:
                    kept = kept_words(len(words), found)
                    words = [words[i] for i in np.flatnonzero(kept)]
                rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]
                best = best_run(found)
                all_runs.append(rows)
                bests.append(rows[found.index(best)] if best else None)
                texts.append(b" ".join(words).decode())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_runs, pa.list_(run)), pa.array(bests, run), pa.array(texts, pa.string())], [id_col, "runs", "best", "collapsed"])

        return each

    field = "struct<start:bigint,length:bigint,period:bigint>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, runs array<{field}>, best {field}, collapsed string")

