"""Findings of reviews: each test failed before its finding was settled."""

import datetime
import random

from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import neighbours, tokenfile
from tidemill.llm.common import sum_arrays
from tidemill.operators import links
from tidemill.plans import registry
from tidemill.streaming import stateful


def test_a_number_that_opens_a_paragraph_stays(spark, tmp_path):
    html = "<html><body><article><h1>T</h1><p>28.68.191.238 is an address.</p><p>Q. Is this one asked?</p><p>A. This one is said.</p></article></body></html>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in registry.QUERIES["faq_extract"](spark, str(tmp_path)).collect()] == con.sql(registry.ORACLES["faq_extract"]).fetchall()


def test_lines_of_one_number_have_one_order(spark, tmp_path):
    shipped = lambda quantity: datetime.datetime(1998, 1, 30) - datetime.timedelta(days=quantity // 2)
    rows = [(k, 1, float(q), shipped(q)) for k in range(20) for q in ((28, 10) if k % 2 else (10, 28))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["restock_due"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.l_orderkey, r.lasts_days) for r in got] == [(k, days) for k in range(20) for days in (5, 14)]


def recall_of(spark, v):
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 100 == 0).toPandas()
    shares = []
    for q in range(0, len(v), 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(v)), d))[:10]
        shares.append(np.isin(true, got.vec_id[got.query_id == q]).mean())
    return np.mean(shares)


def test_queries_unlike_other_rows_find_their_neighbours(spark):
    """Rows lie in narrow groups, queries between them: what the rows need says nothing of the queries."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (150, 16))[rng.integers(0, 150, 6000)] + rng.normal(0, 0.01, (6000, 16))
    v[::100] = rng.normal(0, 0.5, (60, 16))
    assert recall_of(spark, v) >= 0.9


def test_vectors_far_from_zero_find_their_neighbours(spark):
    rng = np.random.default_rng(6)
    assert recall_of(spark, rng.normal(0, 1, (3000, 8)) + 1e8) >= 0.9


def test_blocks_of_posts_give_the_links_of_all_pairs(spark, sf_dir, monkeypatch):
    """Many copies of one post and one very frequent word: blocks of about a hundred posts, and a task sends k links of a post at most."""
    monkeypatch.setattr(links, "BLOCK_ROWS", 100)
    rows = [(i, i, ["the", *([f"w{i % 7}", f"v{i % 11}"] if i % 3 else [])], "en" if i % 5 else "", "org", "k" if i % 13 == 0 else "") for i in range(600)]
    posts = spark.createDataFrame(rows, "id long, ord int, toks array<string>, cat string, region string, cluster string")
    got = links.top_links(posts)
    want = {}
    for a in rows:
        score = lambda b, a=a: round(len(set(a[2]) & set(b[2])) / (len(a[2]) * len(b[2])) ** 0.5 + sum(w for w, c in ((0.15, 3), (0.10, 4), (0.25, 5)) if a[c] and a[c] == b[c]), 9)
        want[a[0]] = sorted((-score(b), b[0]) for b in rows if b[0] != a[0])[:4]
    assert {(r.src, r["rank"]): (-r.score, r.dst) for r in got.collect()} == {(src, n): pair for src, best in want.items() for n, pair in enumerate(best, 1)}


def test_a_slot_keeps_as_many_posts_as_there_are_slots(spark, monkeypatch):
    """All posts fit all slots alike; few slots and many give the same."""
    slots = spark.createDataFrame([(k, k, "", "one two") for k in range(3)], "slot long, ord long, cat string, kw string")
    posts = spark.createDataFrame([(k, k, "", "one two three") for k in range(50)], "post long, ord long, cat string, text string")
    for few in (5000, 1):
        monkeypatch.setattr(links, "FEW_SLOTS", few)
        assert sorted((r.slot, r.post, r["rank"]) for r in links.candidates(slots, posts).collect()) == [(k, 50 - n, n) for k in range(3) for n in (3, 2, 1)]
        assert sorted((r.slot, r.post) for r in links.assign_greedily(slots, posts).collect()) == [(0, 49), (1, 48), (2, 47)]


class Calls:
    """State and timers of one key in memory, and how often they are called."""

    def __init__(self):
        self.n, self.value, self.months, self.timers = 0, None, {}, set()

    def counted(self, result=None):
        self.n += 1
        return result

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.counted(self.value is not None), get=lambda: self.counted(self.value), update=lambda v: self.counted(setattr(self, "value", v)), clear=lambda: self.counted(setattr(self, "value", None)))

    def getMapState(self, *_):  # noqa: N802
        items = self.months
        return SimpleNamespace(containsKey=lambda k: self.counted(k in items), getValue=lambda k: self.counted(items[k]), updateValue=lambda k, v: self.counted(items.update({k: v})), iterator=lambda: iter(items.items()))

    def registerTimer(self, at):  # noqa: N802
        self.counted(self.timers.add(at))

    def deleteTimer(self, at):  # noqa: N802
        self.counted(self.timers.discard(at))

    def listTimers(self):  # noqa: N802
        return self.counted(sorted(self.timers))


def fired(processor, calls, rows, now_ms):
    out = list(processor.handleInputRows((7,), iter(rows), None))
    while calls.timers and (at := min(calls.timers)) < now_ms:
        out += processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now_ms), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        calls.timers.discard(at)
    return out


def test_streams_call_their_state_for_blocks_and_lanes_not_for_rows():
    hour, calls = 3600 * 10**6, Calls()
    lane = stateful.Publisher(hour, 3)
    lane.init(calls)
    out = fired(lane, calls, [SimpleNamespace(slot=k * hour // 4) for k in range(400)], 10**9)
    assert [r.slot for r in out] == [k * hour // 4 for k in range(400)] and calls.n < 20
    calls = Calls()
    block = stateful.Alarms(1)
    block.init(calls)
    out = fired(block, calls, [SimpleNamespace(id=k, active=True, next_fire=k * hour, seen=0) for k in range(400)], 3600 * 1000 * 200)
    assert sorted(r.id for r in out) == list(range(200)) and calls.n < 20


def test_sums_reach_the_driver_packed(spark, monkeypatch):
    size, sent = 1 << 16, []

    def make():
        def add(batch, total):
            for k in batch.column(0).to_pylist():
                total += 300
                total[k] += 1 << 40

        return add

    rows = spark.range(3).repartition(3)
    kind = type(rows)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: [sent.append(len(r.data)) or r for r in collect(df)])
    got = sum_arrays(rows, make, size, 4)
    assert (got[3:] == 900).all() and (got[:3] == 900 + (1 << 40)).all() and len(got) == size
    assert len(sent) == 4 and sum(sent) < 3 * size


def test_new_words_go_to_the_library_together():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, sent, draw = tokenfile.WordIds(path, 2), [], random.Random(3)
    encode = words.encode
    words.encode = lambda texts, **k: sent.append(len(texts)) or encode(texts, **k)
    parts = ["a", "Bc", "'s", "é", "\u0301", "Σ", "İ", "\u3000", "中", "7", ".", "$$", "<|endoftext|>", "</w>"]
    word = lambda parts: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 9)))
    plain = ["", *(" \n".join(word(parts) for _ in range(100)) for _ in range(40))]
    marked = [" ".join(word([*parts, "\0"]) for _ in range(100)) for _ in range(10)]
    whole = lambda texts: [np.array(e.ids, "<u2").tobytes() for e in encode(texts, add_special_tokens=False)]
    assert words.batch(plain) == whole(plain) and sum(sent) < 50
    assert words.batch(marked) == whole(marked)


def test_pre_tokens_that_words_share_are_encoded_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, sent = tokenfile.WordIds(path, 2), []
    whole = lambda texts: [np.array(e.ids, "<u2").tobytes() for e in words.encode(texts, add_special_tokens=False)]
    of_tokens = words.of_tokens
    monkeypatch.setattr(words, "of_tokens", lambda tokens: sent.extend(tokens) or of_tokens(tokens))
    monkeypatch.setattr(words, "of_words", None)
    texts = ["Word word\tWORD, (word)", " \v", "Señor's señor. WORD'S 7word"]
    assert words.batch(texts) == whole(texts) and sorted(sent) == ["'s", "(", ")", ",", ".", "7", "señor", "word"]
    assert words.batch(texts[::-1]) == whole(texts[::-1]) and len(sent) == 8


def test_plain_words_are_those_of_the_library(monkeypatch):
    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    words = tokenfile.WordIds(path, 2)
    whole = lambda texts: [np.array(e.ids, "<u2").tobytes() for e in words.encode(texts, add_special_tokens=False)]
    # letters that compose only when lower-cased, or with the next; cases beyond Latin-1; control characters; added tokens
    odd = ["H\u0331 h\u0331 J\u030c A\u030a \u00c5\u0331", "\u212a \u0130 \u0178\u00ff \u03a3 \u017f \u0149", "a\0b \x1cc\x1f \x7f \x85d\u00a0e \u2028f", "<|endoftext|> a<|endoftext|>'s <|ENDOFTEXT|> x<|StartOfText|>y <| |>", "", "a" * 5000, "\u00aa \u00ba \u00b2 \u00d7\u00f7"]
    texts = odd + [" ".join("".join(draw.choices(tokenfile.PLAIN + "'sdtl" * 3, k=draw.randrange(1, 12))) for _ in range(400)) for _ in range(40)]
    want = whole(texts)
    assert words.batch(texts) == want
    assert words.batch(pa.array(["x", *texts]).slice(1)) == want and words.batch([]) == []
    pattern, bare, ends = words.plain
    for plain in (None, (pattern, bare, ends & False)):  # another vocabulary; pre-tokens that cannot be told apart
        monkeypatch.setattr(tokenfile, "plain_words", lambda path, plain=plain: plain)
        assert tokenfile.WordIds(path, 2).batch(texts) == want
    monkeypatch.setattr(tokenfile, "CACHE_WORDS", 100)
    assert [x for t in texts for x in words.batch([t])] == want


def test_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    draw = random.Random(5)
    posts = [(k if k < 58 else None if k == 58 else 7, [draw.choice("abcdefghijk") for _ in range(draw.randrange(4))] + ["z", None] * (k % 3 == 0)) for k in range(60)]
    sets = [(k, set(t) - {None}) for k, t in posts]
    plain = sorted((a, b, len(x & y)) for a, x in sets for b, y in sets if a is not None and b is not None and a != b and x & y)
    for rows, pairs in ((1 << 12, 1 << 17), (7, 5)):
        monkeypatch.setattr(links, "PAIR_ROWS", rows)
        monkeypatch.setattr(links, "PAIRS", pairs)
        found = links.overlap_pairs(spark.createDataFrame(posts, "id long, toks array<string>"))
        assert sorted(tuple(r) for r in found.collect()) == plain
        assert "Join" not in found._jdf.queryExecution().toString()
    assert links.overlap_pairs(spark.createDataFrame([], "id long, toks array<string>")).count() == 0


def test_blocks_meet_without_being_dealt_and_their_size_is_bounded(spark, monkeypatch):
    """Each post is in one block of about the tokens allowed, however many blocks it meets; products and index count the same."""
    rng, tables, keep = random.Random(3), {}, links.kept
    monkeypatch.setattr(links, "kept", lambda df, label: tables.setdefault(label, keep(df, label)))
    for name, value in (("BLOCK_TOKENS", 1000), ("FREQUENT", 4), ("DENSE", 0.05), ("TOGETHER", 7), ("INDEXED", 60)):
        monkeypatch.setattr(links, name, value)
    rows = [(i, 400 - i, sorted({f"t{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 40))}), "en" if i % 3 else "", f"r{i % 2}", "k" if i % 5 == 0 else "") for i in range(400)]
    posts = spark.createDataFrame(rows, "id long, ord int, toks array<string>, cat string, region string, cluster string")
    want = {}
    for a in rows:
        score = lambda b, a=a: (len(set(a[2]) & set(b[2])) / (len(a[2]) * len(b[2])) ** 0.5 if a[2] and b[2] else 0) + sum(w for w, c in ((0.15, 3), (0.10, 4), (0.25, 5)) if a[c] and a[c] == b[c])
        want[a[0]] = [p for p in sorted((-round(score(b), 9), b[1], b[0]) for b in rows if b[0] != a[0])[:4] if p[0] <= -0.12]
    got = links.top_links(posts).collect()
    assert {(r.src, r["rank"]): (-r.score, r.dst) for r in got} == {(src, n): (p[0], p[2]) for src, best in want.items() for n, p in enumerate(best, 1)}
    blocks = tables["post-blocks"].collect()
    total = sum(len(r[2]) for r in rows)
    assert sorted(i for b in blocks for i in b.id) == list(range(400)) and len(blocks) >= total // 1000
    assert max(len(b.codes) // 4 for b in blocks) < 2000
    found = {}
    for row in links.met_blocks(tables["post-blocks"], len(blocks)).toArrow().to_batches(max_chunksize=1):
        sources = links.Block(row, "src")
        ids, best = found.setdefault(sources.number, (sources.ids, links.Best(len(sources.n), 4)))
        links.meet(sources, links.Block(row, "dst"), 4, 0.12, best)
    pairs = [(p["src"], p["dst"]) for ids, best in found.values() for p in best.pairs(ids).to_pylist() if p["digits"] >= 12e7]
    assert sorted(pairs) == sorted((r.src, r.dst) for r in got)


def test_posts_of_pairs_are_not_dealt_to_each_block(spark, monkeypatch):
    """What is written and shuffled is each post once: many blocks hold no more rows than one."""
    tables, keep = {}, links.kept
    monkeypatch.setattr(links, "kept", lambda df, label: tables.setdefault(label, keep(df, label)))
    monkeypatch.setattr(links, "PAIR_ROWS", 10)
    posts = spark.createDataFrame([(f"p{i}", [f"t{i % 9}", "all"]) for i in range(200)], "id string, toks array<string>")
    found = links.overlap_pairs(posts)
    blocks = [pa.ipc.open_stream(r.posts).read_all() for r in tables["pair-blocks"].collect()]
    assert sorted(i for b in blocks for i in b["id"].to_pylist()) == sorted(f"p{i}" for i in range(200)) and len(blocks) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "explode" not in plan
    common = {(r.src, r.dst): r.common for r in found.collect()}
    assert common == {(f"p{a}", f"p{b}"): 1 + (a % 9 == b % 9) for a in range(200) for b in range(200) if a != b}
