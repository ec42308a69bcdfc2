"""Operator 7: n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets are put in one order, rare shingles
first; frequencies come from a counting sketch of fixed size, so the order is the same in every
task and any error in it costs time only. Two sets with Jaccard similarity t share at least l
shingles among the first ``n - ceil(t n) + l`` of each. Each document takes the l, and so the
prefix, with the least estimated cost of candidates; a pair is verified only if it shares as
many prefix shingles as the smaller l of the two.

Only the classes that links form are wanted, so pairs inside a class need not all be verified.
First every set meets the hub of its posting lists, the set in which the shingle stands
earliest; what these links leave apart is then joined completely. Verification is exact.

A hub h that a set x does not link with still speaks for others: x and y share at most
``|x & h|`` shingles and those of x outside h. If that is too few without the latter, x and y must
share one of them, so a shingle that stands behind all of these need not be paired: in a large
group of texts that are near each other, but not near enough, hardly any pair is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, lower_bytes, map_rows, mix, pieces, shingle_hashes, sum_arrays, word_hashes, written

SKETCH = 1 << 21
FILTER = 1 << 20
MAX_L = 4
#: Hubs that a set meets before the complete join.
HUBS = 1
#: Cost of verifying a candidate and of a further posting, in units of one row of the join.
VERIFY, POSTING = 10.0, 1.0
#: Rows of one posting list, or pairs of one hub, that a task should get at most, about.
SHARE = 20_000
MAX_SALT_BITS = 10


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    return shingle_hashes(word_hashes(lower_bytes(text)), width)


def signature(hashes: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(np.append(mix(hashes), mix(np.array([len(hashes)], np.uint64))).sum(dtype=np.uint64).astype(np.int64))


def packed(hashes: np.ndarray) -> bytes:
    """A sorted set with the upper seven bytes of each hash, for the way to another task."""
    return (hashes >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked(data: pa.Buffer) -> np.ndarray:
    """What ``packed`` has made, as sorted hashes with a last byte of 0."""
    out = np.zeros((data.size // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def least_shared(n: int, num: int, den: int) -> int:
    """ceil(num * n / den)."""
    return -(-num * n // den)


def prefix_sizes(n: int, num: int, den: int) -> list[int]:
    """Prefix lengths for l = 1, 2, ... as far as they make sense."""
    least = least_shared(n, num, den)
    return [n - least + k for k in range(1, min(MAX_L, least) + 1)]


def chosen_l(df: np.ndarray, sizes: list[int]) -> int:
    """The l with the least estimated cost; ``df`` has estimated frequencies in prefix order."""
    sums = np.cumsum(df[: sizes[-1]])
    costs = [POSTING * k + sums[size - 1] * (1 + VERIFY / k) for k, size in enumerate(sizes, 1)]
    return int(np.argmin(costs)) + 1


def slot_of(hashes: np.ndarray) -> np.ndarray:
    """The slot of the sketch of each hash."""
    return (hashes >> np.uint64(8) & np.uint64(SKETCH - 1)).astype(np.int64)


def prefix_order(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the hashes in the order of all sets: rare slots first, then smaller hashes. The last byte plays no part."""
    return np.lexsort((hashes >> np.uint64(8), counts[slot_of(hashes)]))


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle of each slot, over all documents."""

    def make():
        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for text in batch.column(0).to_pylist():
                hashes = shingles(text, width)
                np.add.at(total, slot_of(hashes), 1)

        return add

    return sum_arrays(docs.select("text"), make, SKETCH)


def base_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set) and sig (null for an empty set) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "sig"])

        return each

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {id_type}, n bigint, sig bigint")


def postings(docs: DataFrame, shared, width: int, num: int, den: int) -> DataFrame:
    """A row for each prefix shingle of each distinct set a task meets: token, sig and info (salts, n, pos, l in one number).

    ``shared`` is the sketch as a broadcast.
    """
    mean = shared.value.mean()

    def make():
        table, seen = shared.value, set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            tokens, sigs, infos = [], [], []
            for text in batch.column(0).to_pylist():
                hashes = shingles(text, width)
                n = len(hashes)
                if not n or (sig := signature(hashes)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                sizes = prefix_sizes(n, num, den)
                order = prefix_order(hashes, table)[: sizes[-1]]
                df = np.maximum(table[slot_of(hashes[order])].astype(np.float64) - mean, 0) + 0.1
                k = chosen_l(df, sizes)
                order, df = order[: sizes[k - 1]], df[: sizes[k - 1]]
                salt_bits = np.minimum(np.log2(1 + df // SHARE), MAX_SALT_BITS).astype(np.int64)
                tokens.append(hashes[order].astype(np.int64))
                sigs.append(np.full(len(order), sig, np.int64))
                infos.append(salt_bits << 60 | n << 30 | np.arange(len(order)) << 2 | k - 1)
            if not tokens:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sigs, infos)], ["token", "sig", "info"])

        return each

    return map_rows(docs.select("text"), make, "token bigint, sig bigint, info bigint")


# info: 4 bits for the logarithm of the salts, 30 for n, 28 for pos and 2 for l; no text that a row can hold has more shingles


def salts_of(info):
    return F.pow(F.lit(2), F.shiftrightunsigned(info, 60)).cast("bigint")


def size_of(info):
    return F.shiftrightunsigned(info, 30).bitwiseAND(F.lit((1 << 30) - 1))


def pos_of(info):
    return F.shiftrightunsigned(info, 2).bitwiseAND(F.lit((1 << 28) - 1))


def l_of(info):
    return info.bitwiseAND(F.lit(3)) + 1


def sizes_fit(a, b, num: int, den: int):
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(size_of(a), size_of(b)) * den >= F.greatest(size_of(a), size_of(b)) * num


def rest_fits(a, b, num: int, den: int, before=0):
    """Whether enough can be shared if ``before`` common shingles come before this one.

    Of every pair it holds for the first common shingle with 0, for the k-th with k - 1.
    """
    most = F.least(size_of(a) - pos_of(a), size_of(b) - pos_of(b)) + before
    return most * (num + den) >= num * (size_of(a) + size_of(b))


def shared_at_least(a, b, num: int, den: int):
    """How many shingles of both prefixes similar sets share: what one has beyond its prefix is all that a pair may share elsewhere."""
    up = lambda x, by: F.floor((x + (by - 1)) / by)
    beyond = lambda info: up(num * size_of(info), den) - l_of(info)
    return up(num * (size_of(a) + size_of(b)), num + den) - F.greatest(beyond(a), beyond(b))


def early_enough(a, b, num: int, den: int):
    """Whether this may be among the first common shingles, as many as the pair must share in its prefixes."""
    return rest_fits(a, b, num, den, F.least(l_of(a), l_of(b)) - 1)


def with_hubs(rows: DataFrame) -> DataFrame:
    """Posting lists of two sets or more, with the hub of each list (of each part of a long list)."""
    w = Window.partitionBy("token", F.pmod("sig", salts_of(F.col("info")))).orderBy(pos_of(F.col("info")), "sig")
    marked = rows.select("*", F.first(F.struct("sig", "info")).over(w).alias("hub"), F.lag("sig").over(w).alias("before"), F.lead("sig").over(w).alias("after"))
    once = marked.where(F.col("before").isNull() | (F.col("before") != F.col("sig")))
    shared = once.where((F.col("hub.sig") != F.col("sig")) | F.col("after").isNotNull() | (salts_of(F.col("info")) > 1))
    return shared.select("token", "sig", "info", F.col("hub.sig").alias("hub"), F.col("hub.info").alias("hub_info"))


def hub_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """For each set the ``HUBS`` hubs that share most of its prefix, as pairs (a, b)."""
    heads = lists.where((F.col("hub") == F.col("sig")) & (salts_of(F.col("info")) > 1))  # hubs of the parts of long lists
    w = Window.partitionBy("token").orderBy(pos_of(F.col("info")), "sig")
    upper = heads.select("token", "sig", "info", F.first(F.struct("sig", "info")).over(w).alias("top")).select("sig", "info", F.col("top.sig").alias("hub"), F.col("top.info").alias("hub_info"))
    met = lists.select("sig", "info", "hub", "hub_info").unionByName(upper).where("hub <> sig")
    met = met.where(sizes_fit(F.col("info"), F.col("hub_info"), num, den) & early_enough(F.col("info"), F.col("hub_info"), num, den))
    info, hub = F.col("info"), F.col("hub_info")
    pairs = met.groupBy(F.col("hub").alias("a"), F.col("sig").alias("b")).agg(F.count("*").alias("shared"), F.max(rest_fits(info, hub, num, den)).alias("fits"), F.max(shared_at_least(info, hub, num, den)).alias("least"))
    # a set has no more to share than its rows in the lists
    rows = lists.groupBy("sig").agg(F.count("*").alias("of"))
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("sig").alias(side), F.col("of").alias(f"of_{side}")), side)
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    return pairs.where("fits and least(of_a, of_b) >= least").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= HUBS).select("a", "b")


def cross_pairs(lists: DataFrame, classes: DataFrame, missed: DataFrame, num: int, den: int) -> DataFrame:
    """All candidates (a, b) that are not yet in one class and share enough of their prefixes.

    ``missed`` (sig, cut, common) has a hub for some sets that they do not link with: how many shingles
    they share, and the place behind the last that they do not. The first shingle that two sets share is
    never left out, so it decides alone where others may be.
    """
    known = classes.join(missed, "sig", "full")
    # shingles of one set only are not in the lists: what is left of a set bounds what it can share
    own = Window.partitionBy("sig")
    rows = lists.select("token", "sig", "info").withColumns({"nth": F.row_number().over(own.orderBy(pos_of(F.col("info")))), "of": F.count("*").over(own)})
    rows = rows.join(known, "sig", "left").select("token", "sig", "info", "nth", "of", F.coalesce("label", "sig").alias("label"), "cut", "common")
    w = Window.partitionBy("token")
    rows = rows.withColumns({"lo": F.min("label").over(w), "hi": F.max("label").over(w)}).where("lo <> hi").drop("lo", "hi")
    x, y = rows.alias("x"), rows.alias("y")
    a, b = F.col("x.info"), F.col("y.info")
    both = (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.sig") < F.col("y.sig"))

    def spoken(side: str):
        """Whether the hub shows that sets of these sizes share too little but for what stands before the cut, and this lies in the prefix."""
        own = F.col(f"{side}.info")
        inside = num * size_of(own) <= den * (size_of(own) - F.col(f"{side}.cut") + l_of(own) - 1)
        return F.coalesce(inside & (F.col(f"{side}.common") * (num + den) < num * (size_of(a) + size_of(b))), F.lit(False))

    nth, after = F.least("x.nth", "y.nth"), F.least(F.col("x.of") - F.col("x.nth"), F.col("y.of") - F.col("y.nth"))
    left_out = (spoken("x") & (pos_of(a) >= F.col("x.cut"))) | (spoken("y") & (pos_of(b) >= F.col("y.cut")))
    least = F.when(spoken("x") | spoken("y"), F.lit(1)).otherwise(F.least(l_of(a), l_of(b)))
    may = rest_fits(a, b, num, den, F.least(l_of(a), l_of(b), nth) - 1) & (nth + after >= shared_at_least(a, b, num, den))
    met = x.join(y, both & sizes_fit(a, b, num, den) & may & ~left_out)
    pairs = met.groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).agg(F.count("*").alias("shared"), F.max(least).alias("needed"), F.max(rest_fits(a, b, num, den)).alias("fits"))
    return pairs.where("fits and shared >= needed").select("a", "b")


def verified(docs: DataFrame, owners: DataFrame, pairs: DataFrame, shared, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with whether their sets ``link``, by exact intersection; for those that do not, what they have in ``common`` and the ``cut``.

    ``cut`` is the place in the order of b behind its last shingle that a has not. ``owners`` names one
    document for each signature. Sets are made anew from the texts of the
    documents in question; a filter of fixed size leaves most others out before the shuffle. Each
    set goes to the tasks of its hubs; a hub with many pairs is sent to several.
    """
    loads = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / SHARE)).cast("int").alias("salts"))
    sides = pairs.join(loads, "a").select(F.col("b").alias("sig"), "a", F.pmod("b", "salts").cast("int").alias("salt"))
    hubs = loads.select(F.col("a").alias("sig"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted = written(sides.unionByName(hubs).join(owners, "sig"), "wanted")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def slots(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.astype(np.int64)) & np.uint64(FILTER - 1)).astype(np.int64)

    def make_filter():
        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            total[slots(batch.column(0).to_numpy(zero_copy_only=False))] = 1

        return add

    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(sum_arrays(wanted.select(F.col("doc_id").cast("long")).distinct().coalesce(8), make_filter, FILTER, 4) > 0))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at = slots(batch.column(2).to_numpy(zero_copy_only=False))
            rows = np.flatnonzero(marks.value[at >> 3] >> (7 - (at & 7)) & 1)
            if not len(rows):
                return None
            sets = [shingles(t, width) for t in batch.column(1).take(pa.array(rows)).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([signature(s) for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.binary())], ["doc_id", "sig", "hashes"])

        return each

    sets = map_rows(docs.where("doc_id is not null").select("doc_id", "text", F.col("doc_id").cast("long").alias("__key")), make, f"doc_id {kind}, sig bigint, hashes binary")
    # an id may stand for several texts, so it is the set that must be the wanted one
    sent = sets.join(wanted, ["doc_id", "sig"]).select("a", "salt", (F.col("sig") != F.col("a")).alias("other"), "sig", "hashes")
    grouped = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "other")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_()), ("common", pa.int64()), ("cut", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in pieces(batches):
            found = []
            for a, other, sig, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                hashes = unpacked(data.as_buffer())
                if not other:
                    hub, own = a, hashes
                elif a == hub:
                    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                    both = own[at] == hashes
                    common = int(both.sum())
                    if den * common >= num * (len(hashes) + len(own) - common):
                        found.append((a, sig, True, common, 0))
                    else:
                        order = prefix_order(hashes, shared.value)
                        found.append((a, sig, False, common, int(np.flatnonzero(~both[order])[-1]) + 1 if common < len(hashes) else 0))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return arrow_batches(grouped).mapInArrow(compare, "a bigint, b bigint, link boolean, common bigint, cut bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (sig, label), the label being the smallest node, for every node of an edge.

    Alternating large and small stars: each step ties neighbours to the smallest node next to
    them, until nothing changes. Nothing but two sums goes to the driver.
    """
    current, last = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = written(small, "edges")
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            return current.select(F.col("u").alias("sig"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("sig"), F.col("v").alias("label")).distinct())
        last = state


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Returns doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text, ...).

    Two documents link when ``den * intersection >= num * union`` of their shingle sets. Words are
    ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; with fewer words than ``width`` the whole
    sequence is one shingle. A null text or one without words has an empty set and links with
    nothing. ``component_id`` is the smallest doc_id reachable by links. Repeated rows and ids give
    one row each; a null id stays null where it stands alone. An empty table gives an empty one.
    Equal sets are joined once, however many documents have them.
    """
    base = written(base_table(docs, width), "sets")
    owners = written(base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "owners")
    counts = sketch(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.min_scalar_type(int(counts.max()))))
    lists = written(with_hubs(postings(docs, shared, width, num, den)), "postings")
    met = written(verified(docs, owners, hub_pairs(lists, num, den), shared, width, num, den), "links")
    first = met.where("link").select("a", "b")
    missed = met.where("not link").groupBy(F.col("b").alias("sig")).agg(F.min(F.struct("cut", "common")).alias("m")).select("sig", "m.cut", "m.common")
    second = written(verified(docs, owners, written(cross_pairs(lists, components(first), missed, num, den), "pairs"), shared, width, num, den).where("link").select("a", "b"), "links")
    classes = components(first.unionByName(second)).join(owners, "sig")
    labels = classes.select("sig", "label").join(classes.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("sig", "component_id")
    own = owners.select("sig", F.col("doc_id").alias("own_id")).join(labels, "sig", "left").select("sig", F.coalesce("component_id", "own_id").alias("component_id"))
    named = base.join(own, "sig", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
