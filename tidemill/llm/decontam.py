"""Operator 9: benchmark decontamination by templates.

A text becomes two streams of tokens: its words in lower case, and a template in which numbers,
names and units are typed placeholders. A capital that opens a sentence may be that of a name or
not, so there is a template for each reading. Windows of ``WINDOW`` tokens of either stream are hashed;
windows of documents meet those of benchmark items in a hash join. What a document has at the
placeholders must then stand for what the item has there, the same for the same over the whole
passage. An item counts as leaked into a document if enough of its windows meet, not counting those
with few plain words, or if its whole template stands there. Items shorter than a window are found inside
longer texts too: all of them with ``common``, as the query and the pipeline do, else those that few documents
hold, for a benchmark with turns of phrase among its items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, mix, pieces, runs, span_hashes, sum_arrays, written

WINDOW = 8
#: A template window with fewer words counts only where the whole template of its item stands.
LEAST_WORDS = 5
#: Without ``common``, an item shorter than a window is found inside longer texts if so many documents hold it at most, or this part of all; else only where it is the whole text.
RARE, RARE_SHARE = 20, 0.001
#: An item has leaked if half of its windows meet, or this many of a long item: six windows are 13 words.
LEAST_SHARE, ENOUGH = 0.5, 6
#: Slots of the filter that keeps windows of no item from the shuffle; its size is fixed.
FILTER = 1 << 21
#: Bytes of texts that are handled together, about.
TOGETHER = 1 << 19

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Units that count as such behind a number.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons cup cups s sec ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent degrees celsius fahrenheit dollar dollars cent cents euro euros usd eur mph kmh".split()

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[0, 10, 13, 33, 46, 58, 59, 63]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(span_hashes(data, *runs(data != 32)))


_UNITS = _unit_hashes()
_PLACEHOLDERS = mix(np.arange(901, 905, dtype=np.uint64))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


class Template:
    """One reading of the words of some texts: tokens with their kinds, values and texts; a run of names is one name."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, kind: np.ndarray, opens: np.ndarray, texts: int) -> None:
        head = np.ones(len(words), bool)
        head[1:] = ~((kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:])
        at = np.flatnonzero(head)
        self.kind, self.doc, self.value = kind[at], doc[at], words[at]
        if len(at) < len(words):
            place = np.arange(len(words)) - at[np.cumsum(head) - 1]
            self.value = np.add.reduceat(words * (2 * place.astype(np.uint64) + np.uint64(1)), at)
        self.tokens = np.where(self.kind == WORD, self.value, _PLACEHOLDERS[self.kind])
        self.sizes = np.bincount(self.doc, minlength=texts)


class Streams:
    """Tokens of some texts that are joined by NUL bytes: word hashes, and templates in which a capital that opens a sentence is a word, or a name."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\0".join(t.replace("\0", " ") for t in texts)
        data, lower = as_bytes(joined), as_bytes(joined.lower())
        if len(lower) != len(data):  # rare letters change their length
            lower = as_bytes("".join(c if len(as_bytes(c)) != len(as_bytes(c.lower())) else c.lower() for c in joined))
        inside = _IS_WORD[data]
        if len(data) > 2:  # a point or comma between digits belongs to the number
            mark = (data[1:-1] == 44) | (data[1:-1] == 46)
            inside[1:-1] |= mark & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        starts, ends = runs(inside)
        self.words = span_hashes(lower, starts, ends)
        self.doc = np.cumsum(data == 0)[starts] if len(starts) else starts
        first = data[starts]
        number = _DIGIT[first]
        second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else first
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        opens = np.ones(len(starts), bool)
        opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & ~opens[1:] & np.isin(self.words[1:], _UNITS)
        kind = np.where(number, NUMBER, np.where(unit, UNIT, WORD))
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.templates = [Template(self.words, self.doc, np.where((kind == WORD) & names, NAME, kind), opens, len(texts)) for names in (capital & ~opens, capital)]

    def windows(self, short: Sequence[int], inside: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each family: family (0 words, 1 and 2 the templates), the text, the place, the first token, the width, the hash, the words, whether these are enough, and whether it is its whole text, of each window.

        A window has ``WINDOW`` tokens, or one of the ``short`` widths if that is the whole text, or if it has a word and ``inside`` lets its hash through.
        """
        families = [(0, self.words, self.doc, self.sizes), *((f, t.tokens, t.doc, t.sizes) for f, t in enumerate(self.templates, 1))]
        for family, tokens, docs, sizes in families:
            filled = np.zeros(len(tokens) + 1, np.int64)
            if family:
                np.cumsum(self.templates[family - 1].kind != WORD, out=filled[1:])
            found = []
            for size in (*short, WINDOW):
                at, hashes = rolled(tokens, docs, size, min(family, 1))  # both templates meet each other
                plain = size - (filled[at + size] - filled[at])
                whole = sizes[docs[at]] == size
                if size < WINDOW:
                    keep = whole if inside is None else whole | ((plain > 0) & inside(hashes))
                    at, hashes, plain, whole = at[keep], hashes[keep], plain[keep], whole[keep]
                found.append((at, np.full(len(at), size), hashes, plain, whole))
            first, width, hashes, words, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            begins = np.concatenate(([0], np.cumsum(sizes)))
            yield family, docs[first], first - begins[docs[first]], first, width, hashes, words, words >= np.minimum(LEAST_WORDS, width), whole


def rolled(tokens: np.ndarray, docs: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of so many tokens that lies in one text."""
    n = max(0, len(tokens) - width + 1)
    total = np.full(n, 2 * width + salt, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + tokens[k : k + n]
    first = np.flatnonzero(docs[:n] == docs[width - 1 : width - 1 + n])
    return first, mix(total[first])


def slots_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of the filter for each hash."""
    return (hashes & np.uint64(FILTER - 1)).astype(np.int64), (hashes >> np.uint64(40) & np.uint64(FILTER - 1)).astype(np.int64)


def among(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter knows."""
    a, b = slots_of(hashes)
    return (table[a >> 3] >> (7 - (a & 7)) & table[b >> 3] >> (7 - (b & 7)) & 1).astype(bool)


def told_once(doc: np.ndarray, hashes: np.ndarray, fills: list[list[int]], within: np.ndarray) -> np.ndarray:
    """Windows without those ``within`` that repeat one of their text: the same hash, and equal values at the same placeholders, which is all that decides whether they fit an item of one window."""
    seen, keep = set(), ~within
    for k in np.flatnonzero(within).tolist():
        key = (doc[k], hashes[k], *(fills[k].index(x) for x in fills[k]))
        keep[k] = key not in seen
        seen.add(key)
    return np.flatnonzero(keep)


def together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of bounded size."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size < TOGETHER):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


FIELDS = "family int, hash bigint, place int, windows int, plain_windows int, width int, words int, plain boolean, whole boolean, fills array<bigint>"
_SCHEMA = [("family", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()), ("windows", pa.int32()), ("plain_windows", pa.int32()), ("width", pa.int32()), ("words", pa.int32()), ("plain", pa.bool_()), ("whole", pa.bool_()), ("fills", pa.list_(pa.int64()))]


def window_table(texts: DataFrame, id_col: str, text_col: str, marks=None, rare=None, short: Sequence[int] = range(1, WINDOW)) -> DataFrame:
    """A row for each window: ``id_col``, family, hash, place, windows and plain_windows (of this text and family), width, words, plain (words enough), whole (the whole text) and fills (what stands at the placeholders).

    With ``marks``, a broadcast filter, only windows that may belong to an item; ``short`` are the widths under ``WINDOW`` that items have, which
    are looked for inside texts where the filter ``rare`` knows them, and told once for a text: an item so short is one window, so its place says nothing.
    """
    id_field = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, few = (None if x is None else x.value for x in (marks, rare))
        inside = None if few is None else lambda hashes: among(few, hashes)
        for batch in pieces(batches):
            whole = batch.column(1).to_pylist()
            for at, stop in together(whole):
                if (out := one(whole[at:stop], batch.column(0).slice(at, stop - at), table, inside)) is not None:
                    yield out

    def one(some: list[str], ids: pa.Array, table: np.ndarray | None, inside: Callable[[np.ndarray], np.ndarray] | None) -> pa.RecordBatch | None:
        streams = Streams(some)
        out: list[list] = [[] for _ in range(11)]
        for family, doc, place, first, width, hashes, words, plain, whole in streams.windows(short, inside):
            counts, plain_counts = np.bincount(doc, minlength=len(some)), np.bincount(doc[plain], minlength=len(some))
            if table is not None:
                keep = np.flatnonzero(among(table, hashes))
                doc, place, first, width, hashes, words, plain, whole = (x[keep] for x in (doc, place, first, width, hashes, words, plain, whole))
            if not len(doc):
                continue
            fills: list[list[int]] = [[]] * len(first)
            if family:
                template = streams.templates[family - 1]
                values = template.value.astype(np.int64)
                fills = [values[f:e][template.kind[f:e] != WORD].tolist() for f, e in zip(first, first + width, strict=True)]
            if (within := (width < WINDOW) & ~whole).any():
                keep = told_once(doc, hashes, fills, within)
                fills = [fills[k] for k in keep.tolist()]
                doc, place, width, hashes, words, plain, whole = (x[keep] for x in (doc, place, width, hashes, words, plain, whole))
            for k, values in enumerate((doc, np.full(len(doc), family), hashes.astype(np.int64), place, counts[doc], plain_counts[doc], width, words, plain, whole)):
                out[k].append(values)
            out[10] += fills
        if not out[0]:
            return None
        columns = [ids.take(pa.array(np.concatenate(out[0]))), *(pa.array(np.concatenate(x), kind) for x, (_, kind) in zip(out[1:10], _SCHEMA, strict=False)), pa.array(out[10], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [id_col, *(name for name, _ in _SCHEMA)])

    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    return arrow_batches(rows).mapInArrow(run, f"`{id_col}` {id_field}, {FIELDS}")


def rare_windows(docs: DataFrame, text_col: str, known: DataFrame, short: Sequence[int]) -> DataFrame:
    """Hashes of those ``known`` windows of short items that few documents hold, the document's whole text or not.

    Each task counts a window once for each text and sends one number for it, so a turn of phrase that all texts have is as cheap as others.
    """
    marks = window_filter(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in pieces(batches):
            texts = batch.column(0).to_pylist()
            for at, stop in together(texts):
                held = [np.zeros((0, 2), np.uint64)]
                for _, doc, _, _, width, hashes, *_ in Streams(texts[at:stop]).windows(short, lambda h: among(table, h)):
                    own = width < WINDOW
                    held.append(np.stack((hashes[own], doc[own].astype(np.uint64)), 1))
                hashes, counts = np.unique(np.unique(np.concatenate(held), axis=0)[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])

    counted = arrow_batches(docs.where(F.col(text_col).isNotNull()).select(text_col)).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    most = max(RARE, int(RARE_SHARE * docs.count()))
    return known.select("hash").distinct().join(counted, "hash").where(F.col("n") <= most).select("hash")


def window_filter(windows: DataFrame):
    """A broadcast bitmap of fixed size with the windows of all items."""

    def make():
        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for slots in slots_of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)):
                total[slots] = 1

        return add

    return windows.sparkSession.sparkContext.broadcast(np.packbits(sum_arrays(windows.select("hash"), make, FILTER, 8) > 0))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", common: bool = False) -> DataFrame:
    """Returns ``id_col``, ``item_col``, ``kind``, ``matched`` and ``windows`` for each leaked item of each document.

    ``matched`` of the item's ``windows`` stand in the document; ``kind`` is ``exact`` if its words do,
    ``template`` if only the template does, with other numbers, names or units, the same for the same. An item
    has leaked if half of its windows with enough words match, or ``ENOUGH`` of them, or if all of its
    windows match in one passage and not all of them are placeholders only. Null texts, texts without words
    and rows without an id meet nothing. Rows with one id count as one document (item). An item
    shorter than a window is one window; with ``common`` it is found anywhere in any text that holds it, else only if few documents
    do (``RARE`` or ``RARE_SHARE`` of all, in any reading), or where it is the whole text. Empty tables give an empty one; further columns
    are left out.
    """
    items = items.select(F.col(item_col).alias("__item"), F.col(item_text).alias("__text"))
    known = written(window_table(items, "__item", "__text"), "item-windows")
    short = sorted(r.width for r in known.where(F.col("width") < WINDOW).select("width").distinct().collect())
    rare = written(rare_windows(docs, text_col, known.where(F.col("width") < WINDOW), short), "rare-windows") if short and not common else None
    marks = window_filter(known)
    within = None if not short else marks if common else window_filter(rare)
    own = written(window_table(docs.select(id_col, text_col), id_col, text_col, marks, within, short), "met-windows")
    if rare is not None:  # the filter lets a few others through
        within = ~F.col("whole") & (F.col("width") < WINDOW)
        own = own.where(~within).unionByName(own.where(within).join(rare, "hash", "left_semi").select(*own.columns))
    theirs = known.select(F.col("family").alias("f"), F.col("hash").alias("h"), "__item", F.col("place").alias("item_place"), F.col("plain_windows").alias("item_windows"), F.col("fills").alias("item_fills"), "plain")
    met = own.where("plain").drop("plain").join(theirs.where("plain"), (F.col("hash") == F.col("h")) & ((F.col("family") > 0) == (F.col("f") > 0)))
    pairs = F.arrays_zip(F.col("fills").alias("d"), F.col("item_fills").alias("b"))
    met = met.select(id_col, "__item", "family", "f", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "item_windows", pairs.alias("pairs"))
    fitting = passages(met, id_col)
    places = fitting.select(id_col, "__item", "f", "windows", F.explode("places").alias("place"))
    counts = places.groupBy(id_col, "__item", "f").agg(F.countDistinct("place").alias("matched"), F.max("windows").alias("windows"))
    hits = counts.where((F.col("matched") >= LEAST_SHARE * F.col("windows")) | (F.col("matched") >= ENOUGH)).withColumn("whole", F.lit(False))
    hits = hits.unionByName(whole_templates(own, known, id_col).withColumn("whole", F.lit(True)))
    best = hits.groupBy(id_col, "__item").agg(F.min(F.struct("f", "whole", "matched", "windows")).alias("best"))
    kind = F.when(F.col("best.f") == 0, F.lit("exact")).otherwise(F.lit("template"))
    return best.select(id_col, F.col("__item").alias(item_col), kind.alias("kind"), F.col("best.matched").alias("matched"), F.col("best.windows").cast("long").alias("windows"))


def passages(met: DataFrame, id_col: str) -> DataFrame:
    """Passages (windows of one reading of an item at one distance in one reading of a text) in which no value of the item has two replacements.

    An item's length bounds the sets of each.
    """
    found = met.groupBy(id_col, "__item", "family", "f", "shift").agg(F.max("item_windows").alias("windows"), F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    return found.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))))


def whole_templates(own: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Where the whole templates stand of items that have windows with few words: ``id_col``, __item, f, matched, windows.

    The window with the most words gives the places where an item may stand, and so the place of each
    other window: those of placeholders only, which long rows of numbers repeat, are never paired.
    """
    sparse = known.where("family > 0").groupBy("__item", F.col("family").alias("f")).agg(F.min_by(F.struct("hash", "place"), F.struct(-F.col("words"), "place")).alias("anchor"), F.max("words").alias("most"), F.bool_or(~F.col("plain")).alias("few"), F.max("windows").alias("item_windows"))
    anchors = sparse.where("few and most > 0").select("__item", "f", F.col("anchor.hash").alias("hash"), F.col("anchor.place").alias("anchor_place"), "item_windows")
    template = own.where("family > 0").select(id_col, "family", "hash", "place", "fills")
    found = template.join(anchors, "hash").select(id_col, "family", "__item", "f", "item_windows", (F.col("place") - F.col("anchor_place")).alias("shift")).distinct()
    parts = known.where("family > 0").select("__item", F.col("family").alias("f"), "hash", F.col("place").alias("item_place"), F.col("fills").alias("item_fills"))
    wanted = found.join(parts, ["__item", "f"]).withColumn("place", F.col("shift") + F.col("item_place"))
    met = wanted.join(template, [id_col, "family", "hash", "place"]).withColumn("pairs", F.arrays_zip(F.col("fills").alias("d"), F.col("item_fills").alias("b")))
    return passages(met, id_col).where(F.size("places") == F.col("windows")).select(id_col, "__item", "f", F.size("places").cast("long").alias("matched"), "windows").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: bool = False) -> DataFrame:
    """The documents, with all their columns, into which no item has leaked; rows without an id stay."""
    return docs.join(leaks(docs, items, id_col, text_col, common=common).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
