"""Operator 11: secrets by patterns and by the entropy of sliding windows.

Patterns find assignments, access keys and long hexadecimal numbers. Beside them, every window of
a class of characters inside a candidate string is weighed by its Shannon entropy. Counts are kept
from window to window: one character enters and one leaves, and the sum of c log c over the counts
changes by theirs alone. Windows over the class's entropy are joined to spans; an allow-list takes
out what is known to be harmless.

Sums of c log c are integers (multiples of 2^-20), so no rounding depends on where a window stands.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, runs

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Characters that group 2 of an assignment, an access key and a hexadecimal number have at least.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")

DIGITS, LOWER, UPPER = "0-9", "a-z", "A-Z"
#: A sum of c log2 c is counted in these parts.
UNIT = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """Windows of ``window`` characters of ``members`` with one of each of ``needs`` and ``bits`` of entropy are secrets."""

    kind: str
    members: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def limit(self) -> int:
        """The greatest sum of c log2 c that a window of enough entropy has."""
        return int(self.window * (np.log2(self.window) - self.bits) * UNIT)


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0, (DIGITS, "A-Fa-f")),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.9, (DIGITS, LOWER, UPPER)),
)
#: Where windows are looked for.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Spans that hold one of these are harmless: stand-ins, alphabets in order, digests of nothing.
ALLOWED = (
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Dd][Uu][Mm][Mm][Yy]|[Yy][Oo][Uu][Rr][_-]",
    r"0123456789|abcdefgh|ABCDEFGH|12345678901234567890",
    r"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
#: Characters of candidates that are weighed at a time.
CHUNK = 1 << 20

# the letters of an assignment's words and values may stand in either case, ASCII only
_ASSIGN, _ACCESS, _HEX, _CANDIDATE = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX[:-1] + f"{{{LEAST_HEX},}}"), re.compile(CANDIDATE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's number and end of each match of a base pattern; starts and ends in code points.

    A failing assignment still takes up its characters. A shorter access key or number cannot hide
    a longer one, so those are asked for their length at once.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def member_table(members: str) -> np.ndarray:
    """Which bytes a class of characters has."""
    return np.array([bool(re.fullmatch(f"[{members}]", chr(b), re.A)) for b in range(256)])


def scaled_logs(window: int) -> np.ndarray:
    """c log2 c in units for counts up to ``window``."""
    c = np.arange(window + 1)
    return np.rint(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)


def window_sums(codes: np.ndarray, run: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """For each position the sum of c log2 c over the counts of the ``window`` characters that end there.

    ``run`` numbers the stretches that windows stay in, ``place`` the positions in each. Sums before a stretch's first whole window mean nothing.
    """
    logs, n = scaled_logs(window), len(codes)
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(1, min(window, n)):
        same = (codes[d:] == codes[:-d]) & (run[d:] == run[:-d])
        before[d:] += same
        behind[:-d] += same
    change = logs[before + 1] - logs[before]  # the character that enters
    last = np.flatnonzero(place >= window)
    count = behind[last - window] + 1  # of the one that leaves, in the window before
    change[last] -= logs[count] - logs[count - 1]
    total = np.concatenate(([0], np.cumsum(change)))
    return total[1:] - total[np.arange(n) - place]


def window_ends(codes: np.ndarray, kind: CharClass) -> np.ndarray:
    """Positions at which a window of enough entropy ends."""
    inside = member_table(kind.members)[codes]
    starts, ends = runs(inside)
    long = ends - starts >= kind.window
    if not long.any():
        return np.zeros(0, np.int64)
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts[long], ends[long], strict=True)])
    run = np.repeat(np.flatnonzero(long), (ends - starts)[long])
    place = at - starts[run]
    own = codes[at]
    good = (place >= kind.window - 1) & (window_sums(own, run, place, kind.window) <= kind.limit)
    for members in kind.needs:
        count = np.concatenate(([0], np.cumsum(member_table(members)[own])))
        good &= count[1:] > count[np.maximum(np.arange(len(own)) - kind.window + 1, 0)]
    return at[good]


def entropy_spans(codes: np.ndarray, kind: CharClass) -> list[tuple[int, int]]:
    """Stretches that windows of enough entropy cover without a gap; starts and ends."""
    ends = [window_ends(codes[max(0, a - kind.window + 1) : a + CHUNK], kind) + max(0, a - kind.window + 1) for a in range(0, len(codes), CHUNK)]
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    if not len(ends):
        return []
    cut = np.flatnonzero(np.diff(ends) > kind.window)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ends) - 1]))
    return list(zip((ends[first] - kind.window + 1).tolist(), (ends[last] + 1).tolist(), strict=True))


def uncovered(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that no single base span covers."""
    base = sorted(base)
    furthest = list(accumulate((end for _, _, end in base), max))
    return [s for s in spans if not (k := bisect_right(base, s[0], key=lambda b: b[0])) or furthest[k - 1] < s[2]]


def find_spans(texts: list[str], allowed: re.Pattern | None, classes: tuple[CharClass, ...] = CLASSES) -> list[list[tuple[int, int, int]]]:
    """Start, kind's number and end of all spans of each text, in order. Candidates of all texts are weighed together."""
    found = [base_spans(text) for text in texts]
    owner, start, pieces = [], [], []
    for i, text in enumerate(texts):
        for m in _CANDIDATE.finditer(text):
            owner.append(i)
            start.append(m.start())
            pieces.append(m[0])
    codes = np.frombuffer("\n".join(pieces).encode(), np.uint8)
    offset = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces]))).astype(np.int64)
    more: dict[int, list[tuple[int, int, int]]] = {}
    for k, kind in enumerate(classes, len(BASE_KINDS)):
        for a, b in entropy_spans(codes, kind):
            c = int(np.searchsorted(offset, a, "right")) - 1
            if allowed and allowed.search(pieces[c], a - int(offset[c]), b - int(offset[c])):
                continue
            shift = start[c] - int(offset[c])
            more.setdefault(owner[c], []).append((a + shift, k, b + shift))
    return [sorted(spans + uncovered(more[i], spans)) if i in more else sorted(spans) for i, spans in enumerate(found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """Returns ``id_col`` and ``spans``, an array of (kind, start, end), for every row; starts and ends count code points, ends are exclusive.

    Spans are in order of their start, then of their kind: assign, access, hex, then the classes. A base span is the
    whole match of its pattern and always stays. A span of the method is left out if the allow-list knows it or a base
    span covers it. A null or empty text has no span; repeated rows give one row each, further columns are left out, an
    empty table gives an empty one. Texts of any length are scanned whole; rows are not shuffled.
    """
    names = [*BASE_KINDS, *(c.kind for c in classes)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        known = re.compile("|".join(allowed)) if allowed else None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": names[k], "start": a, "end": b} for a, k, b in found] for found in find_spans(texts, known, classes)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

        return each

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(kinds: tuple[str, ...]) -> Column:
    """The spans of some kinds."""
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))
