"""Secrets, vector codes and periodic runs against brute force, and on odd inputs."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, langid, periodic, quality, queries, secretscan, urlrules, vectorcode
from tidemill.llm.common import PIECE_BYTES, pieces

ODD = [None, "", " \n", "a", "É" * 3, "x " * 20000, "one two three four five", "one two three four five"]
MIXED = "kJ8fQ2zLw9XbR4tYc7VmN1pH"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "k", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, spans string, runs string, best int")


def plain_windows(text, kind):
    """Ends of the windows whose entropy, by counting each anew, is enough."""
    w = kind.window
    for i in range(len(text) - w + 1):
        part = text[i : i + w]
        if re.fullmatch(f"[{kind.members}]+", part, re.A) and all(re.search(f"[{n}]", part) for n in kind.needs):
            if -sum(c / w * math.log2(c / w) for c in Counter(part).values()) >= kind.bits - 1e-9:
                yield i


def plain_spans(text, allowed=secretscan.ALLOWED):
    """All spans with plain loops."""
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), "assign", m.end())] if len(m[2]) >= 8 else []
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    base = list(spans)
    for kind in secretscan.CLASSES:
        stretches = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            for i in plain_windows(m[0], kind):
                a, b = m.start() + i, m.start() + i + kind.window
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = b
                else:
                    stretches.append([a, b])
        spans += [(a, kind.kind, b) for a, b in stretches if not any(re.search(x, text[a:b]) for x in allowed) and not any(x <= a and b <= y for x, _, y in base)]
    order = [*secretscan.BASE_KINDS, *(k.kind for k in secretscan.CLASSES)]
    return sorted(spans, key=lambda s: (s[0], order.index(s[1])))


def secret_texts():
    rng = random.Random(8)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab1", "xyz", "A1b"]
    texts = ["".join(rng.choice(["é ", " ", ".", '"', "token=", "API_KEY : '", "ſecret=", "AKIA", "a", MIXED, *["".join(rng.choice(x) for _ in range(rng.choice([5, 19, 20, 23, 24, 31, 33, 60]))) for x in alphabets]]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    fixed = ['token="secret:abcdefgh12', "password = short", "PassWord:'long-enough'", "AKIA" + "Z" * 11, "xAKIA" + "Z" * 12, "0" * 31, "0" * 32, "𝒳 é " + MIXED, "example" + MIXED, MIXED + "/your-key/" + MIXED, "abcdefgh" + MIXED, "token=" + MIXED, "é" * 30, "d41d8cd98f00b204e9800998ecf8427e"]
    return texts + fixed


def test_secrets_are_those_of_plain_loops(spark):
    texts = secret_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secretscan.scan(table).collect()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in found}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert Counter(k for spans in got.values() for _, k, _ in spans).keys() == {"assign", "access", "hex", "entropy_hex", "entropy_base64"}


def test_windows_across_chunks(monkeypatch):
    monkeypatch.setattr(secretscan, "CHUNK", 7)
    for text in secret_texts():
        found = secretscan.find_spans([text], re.compile("|".join(secretscan.ALLOWED)))[0]
        assert [(a, [*secretscan.BASE_KINDS, *(c.kind for c in secretscan.CLASSES)][k], b) for a, k, b in found] == plain_spans(text)


def test_allow_list(spark):
    table = spark.createDataFrame([(1, "see build-" + MIXED), (2, "see token=" + MIXED)], "doc_id long, text string")
    spans = lambda **more: {r.doc_id: [s.kind for s in r.spans] for r in secretscan.scan(table, **more).collect()}
    assert spans() == {1: ["entropy_base64"], 2: ["assign"]}
    assert spans(allowed=(MIXED[:12],)) == {1: [], 2: ["assign"]}


def test_secrets_of_odd_texts(spark, odd):
    got = secretscan.scan(odd)
    assert got.columns == ["doc_id", "spans"] and [r.spans for r in got.collect()] == [[]] * (len(ODD) + 1)
    assert secretscan.scan(odd.where("false")).count() == 0
    long = secretscan.scan(spark.createDataFrame([(1, MIXED * 200_000)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in long.spans] == [("entropy_base64", 0, 24 * 200_000)]


def test_secret_digests(spark, tmp_path):
    text = "é token = 'abcdefgh' and AKIA" + "B2" * 8 + " " + MIXED
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op11_secrets(spark, str(tmp_path)).collect()}
    spans = [f"{k}:{a}:{b}" for a, k, b in plain_spans(text)]
    assert rows[1].spans == ",".join(spans) and len(spans) == 3
    assert rows[1].base_sha256 == hashlib.sha256(",".join(spans[:2]).encode()).hexdigest()
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex) == (1, 1, 0)
    assert (rows[2].n_assign, rows[2].spans, rows[2].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# --- vector codes ----------------------------------------------------------------------------


def plain_codes(rows, rounds=4):
    """Codes by Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = -(-len(kept[0][1]) // 4)
    parts = lambda v: [(v + [0] * (4 * w - len(v)))[k * w : (k + 1) * w] for k in range(4)]
    cuts = [parts(v) for _, v, _ in kept]
    books = [[list(c[k]) for c in cuts[:256]] for k in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            members = {}
            for c in cuts:
                members.setdefault(nearest(c[k], books[k])[1], []).append(c[k])
            for j, some in members.items():
                books[k][j] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    found = [[nearest(c[k], books[k]) for k in range(4)] for c in cuts]
    error = [sum(d for d, _ in f) for f in found]
    label = Counter()
    for (_, _, name), e in zip(kept, error, strict=True):
        label[name] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((i, "".join(f"{j:02x}" for _, j in f), e, label[name], digest) for (i, _, name), f, e in zip(kept, found, error, strict=True))


def coded(spark, rows, kind="array<double>"):
    table = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding {kind}, label int, code string")
    return Counter(tuple(r) for r in vectorcode.compress(table).collect())


def test_codes_are_those_of_whole_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 10) / 1024).tolist(), [None, 1, 2][i % 3]) for i in range(700)]  # small numbers: many ties
    rows += [(5, rows[5][1], 7), rows[9], rows[9], (None, rows[3][1], None)]
    assert coded(spark, rows) == plain_codes(rows)
    near = [(i, (0.3 + rng.normal(0, 1e-3, 16)).tolist(), i % 2) for i in range(400)]  # far from 0, close to each other
    assert coded(spark, near) == plain_codes(near)
    odd_size = [(i, rng.normal(0, 0.2, 7).tolist(), 0) for i in range(30)]  # fewer rows than entries, no multiple of four
    assert coded(spark, odd_size) == plain_codes(odd_size)


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 1, 8) * 10.0 ** rng.integers(-3, 7)).tolist(), 0) for i in range(300)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, -0.5, 1.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [None, 0.0, 0.0, 0.0], 1), (5, [inf, 0.0, 0.0, 0.0], None), (6, [1.0], 1), (7, [0.0, 0.0, 0.0, 1.0], None), (7, [0.0, 0.0, 0.0, 1.0], None), (0, [], None)]
    got = coded(spark, rows[:-1])
    assert got == plain_codes(rows[:-1]) and sum(got.values()) == 3
    assert {(i, code, error) for i, code, error, _, _ in coded(spark, rows)} == {(0, "00000000", 0)}
    assert coded(spark, rows[1:3]) == Counter()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorcode.compress(empty).count() == 0


def test_screening_keeps_what_may_be_nearest():
    """For entries close to each other, every nearest one is among the candidates, and most others are not."""
    rng = np.random.default_rng(1)
    for spread in (3, 300, 1 << 23):
        centre = rng.integers(-(1 << 20), 1 << 20, 16)
        book, x = centre + rng.integers(-spread, spread, (256, 16)), centre + rng.integers(-spread, spread, (500, 16))
        exact = ((x[:, None] - book[None]) ** 2).sum(2)
        row, entry = vectorcode.Codebook(book).candidates(x)
        found = set(zip(row.tolist(), entry.tolist(), strict=True))
        assert all((i, j) in found for i, j in zip(*np.nonzero(exact == exact.min(1)[:, None]), strict=True))
        index, distance = vectorcode.Codebook(book).nearest(x)
        assert np.array_equal(index, exact.argmin(1)) and np.array_equal(distance, exact.min(1))
    assert len(found) < 5000


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(w):
    """Stretches of equal words at every distance, smallest first."""
    found, ends = [], set()
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            start = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            length = k - start + q
            if k > start and length >= max(24, 3 * q) and (start, length) not in ends:
                ends.add((start, length))
                found.append((start, length, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.randint(0, 180), rng.choice([1, 2, 3, 5, 1000])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, q, length = rng.randrange(n + 1), rng.randint(1, 14), rng.randint(1, 90)
        for i in range(a + q, min(n, a + length)):
            w[i] = w[i - q]
    return w


def test_runs_are_those_of_plain_loops(monkeypatch):
    rng = random.Random(3)
    for i in range(600):
        if i == 300:
            monkeypatch.setattr(periodic, "POINTS", 40)
            monkeypatch.setattr(periodic, "CHUNK", 2)
        w = periodic_words(rng)
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_long_periodic_texts():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.arange(300_000) % 70_000) == [(0, 300_000, 70_000)]
    assert periodic.find_runs(np.arange(300_000) % 100_001) == []


def plain_report(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *row, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w[i] for i in range(n) if i not in gone)))


def test_periodic_query_is_that_of_plain_loops(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    more = [(10_000 + i, "\x0b\t".join(f"w{k}é" for k in periodic_words(rng))) for i in range(300)]
    more += [(20_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(plain_report(r.doc_id, r.text) for r in rows)
    assert sum(n for r, n in got.items() if r[1]) > 100


def test_periodic_odd_texts(spark, odd):
    got = periodic.collapse(odd)
    assert got.columns == ["doc_id", "runs", "best", "collapsed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[5].collapsed == "x" and rows[5].best == rows[5].runs[0] == (0, 20000, 1) and rows[0].collapsed == "" and rows[6].runs == []
    assert got.count() == len(ODD) + 1 and periodic.collapse(odd.where("false"), plant=True).count() == 0
    assert periodic.collapse(odd.select(F.lit(None).cast("long").alias("doc_id"), "text"), plant=True).count() == len(ODD) + 1


# --- earlier operators against plain loops ------------------------------------------------------


def test_chunks_are_those_of_a_plain_loop():
    """Scoring cuts a text as training does, at every length around a piece's end."""
    net = quality.ByteNet.fresh(3)
    rng = np.random.default_rng(3)
    piece = 64 * quality.HOP
    for n in (0, 1, 5, 130, quality.CHUNK + 4, piece, piece + 4, piece + 5, piece + 10, piece + quality.HOP + 4, piece + quality.HOP + 5, 2 * piece + 77):
        data = rng.integers(32, 127, n).astype(np.uint8)
        answers = net.answers(quality.padded(data))
        starts = range(0, max(1, len(answers) - quality.CHUNK + quality.HOP), quality.HOP)
        want = np.maximum(np.array([answers[s : s + quality.CHUNK].max(0) for s in starts]) + net.bias, 0)
        assert np.allclose(net.chunk_peaks(data), want)


def test_languages_are_bounded(spark):
    rows = [(i, "some words of text here", f"l{i % 7 % 5}") for i in range(70)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), most=2)
    assert model.languages == ["l0", "l1"]


def plain_chat(messages, tools):
    """(conv, turn, part, kind, id, level, status) of calls and results."""
    calls, results = [], []
    for conv, turn, role, text in messages:
        v = json.loads(text)
        if role == "assistant" and "tool_calls" in v:
            calls += [(conv, turn, part, c) for part, c in enumerate(v["tool_calls"])]
        elif role == "tool":
            results.append((conv, turn, v["tool_call_id"]))
    first, uses = {}, {}
    for conv, turn, part, c in calls:
        key = (conv, c.get("id"))
        if key[1] is not None:
            first[key] = min(first.get(key, (turn, part)), (turn, part))
            uses.setdefault(key, set()).update((conv, a[1:]) for a in c["arguments"].values() if isinstance(a, str) and a.startswith("$"))
    uses = {k: {u for u in us if u in first} for k, us in uses.items()}
    level = {k: 0 for k, us in uses.items() if not us}
    while new := {k: 1 + max(level[u] for u in us) for k, us in uses.items() if k not in level and all(u in level for u in us)}:
        level |= new
    kinds = {"string": str, "integer": int}
    out = []
    for conv, turn, part, c in calls:
        key, params = (conv, c.get("id")), {p: (kind, need) for t, p, kind, need in tools if t == c["name"]}
        wrong = sorted([f"missing:{p}" for p, (_, need) in params.items() if need and p not in c["arguments"]] + [f"unknown:{a}" for a in c["arguments"] if a not in params] + [f"type:{a}" for a, x in c["arguments"].items() if a in params and type(x) is not kinds[params[a][0]]])
        answers = [t for cv, t, i in results if (cv, i) == key]
        status = "invalid no id" if key[1] is None else "repeated" if first[key] != (turn, part) else "invalid unknown tool" if not params else "invalid " + ",".join(wrong) if wrong else "ok" if any(t > turn for t in answers) else "unanswered"
        out.append((conv, turn, part, "call", key[1], 0 if key[1] is None else level.get(key, -1), status))
    for conv, turn, i in results:
        at = first.get((conv, i))
        earliest = min(t for cv, t, k in results if (cv, k) == (conv, i))
        status = "orphan" if at is None else "early" if turn <= at[0] else "repeated" if turn > earliest else "ok"
        out.append((conv, turn, at[1] if at else -1, "result", i, level.get((conv, i), -1) if at else 0, status))
    return Counter(out)


def test_generated_calls_are_linked_as_by_plain_loops(spark):
    rng = random.Random(21)
    messages = []
    for conv in range(40):
        ids = [f"c{k}" for k in range(rng.randint(1, 6))]
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.5:
                calls = []
                for _ in range(rng.randint(1, 3)):
                    args = {p: rng.choice(["x", 3, f"${rng.choice(ids)}", "$none"]) for p in rng.sample(["query", "limit", "expression", "extra"], rng.randint(0, 3))}
                    calls.append({"name": rng.choice(["search", "calculator", "nope"]), "arguments": args} | ({"id": rng.choice(ids)} if rng.random() < 0.9 else {}))
                messages.append((conv, turn, "assistant", json.dumps({"content": "c", "tool_calls": calls})))
            else:
                messages.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "q"]), "content": turn})))
    messages += [(99, 0, "tool", json.dumps({"tool_call_id": "big", "content": "word " * 50_000}))] * 2
    out = chat.format_chat(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"), chat.tool_parameters(spark)).where("kind <> 'message'")
    got = Counter((r.conv_id, r.turn, r.part, r.kind, r.call_id, r.level, r.status) for r in out.collect())
    assert got == plain_chat(messages, chat.TOOLS) and len({s for *_, s in got}) > 12


def test_url_rules_of_odd_pages(spark):
    rules = urlrules.rule_table(spark, urlrules.RULES)
    rows = [(1, "http://a.example.org/en/1" + "x" * 200_000), (2, "http://x.org"), (2, "http://x.org"), (None, "http://example.org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect())
    assert got == Counter([(1, "example.org/en/1", "block"), (2, None, "allow"), (2, None, "allow"), (None, "example.org/es/", "block")])
    assert urlrules.judge(pages.where("false"), rules).count() == 0
    longer = [("block", f"host{i}.net/") for i in range(300)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(urlrules, "RULES_SENT", 100)
        many = spark.createDataFrame([(i, f"http://w.host{i}.net/a") for i in range(0, 600, 7)], "page_id long, url string")
        assert {r.page_id: r.verdict for r in urlrules.judge(many, urlrules.rule_table(spark, longer)).collect()} == {i: "block" if i < 300 else "allow" for i in range(0, 600, 7)}


def test_pieces_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (PIECE_BYTES // 3)] * 10 + ["y" * 2 * PIECE_BYTES, "z"]})
    parts = list(pieces(iter([batch, batch.slice(0, 0)])))
    assert [t for p in parts for t in p["t"].to_pylist()] == batch["t"].to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= PIECE_BYTES for p in parts)
