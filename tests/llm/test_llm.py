"""The training-data operators against brute force, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import bpe, chat, decontam, html, jaccard, langid, neighbours, quality, queries, tokenfile, urlrules
from tidemill.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, key string"
ODD = [None, "", " \n", "a", "É" * 3, "x " * 20000, "one two three four five", "one two three four five"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, short, long and repeated texts, a repeated row, and extra columns with clashing names."""
    rows = [(i, t, None, None, None, "s", "l", "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_language_of_held_out_documents(spark, sf_dir, texts):
    got = queries.op1_language_id(spark, sf_dir).join(texts.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_odd_texts(texts, odd, none):
    model = langid.train(texts, ~held_out("doc_id", 4, 2))
    got = langid.identify(odd, model).toPandas()
    assert len(got) == len(ODD) + 1
    assert set(got.set_index("doc_id").lang_pred.loc[[0, 1, 2]]) == {"und"}
    assert langid.identify(none, model).count() == 0
    assert langid.identify(odd, langid.train(none, ~held_out("doc_id", 4, 2))).where("lang_pred <> 'und'").count() == 0


def test_proportions_are_those_of_plain_expectation_maximisation(spark):
    """Sets of languages of every size, largest first, each fitted on its own in plain loops."""
    rng = np.random.default_rng(5)
    model = langid.LanguageModel(["a", "b", "c"], np.log(rng.dirichlet(np.full(60, 0.15), 3).T + 1e-9))
    docs = []
    for mix in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0, 0.8], [0.34, 0.33, 0.33], [0.03, 0.97, 0]):
        slots, counts = np.unique(rng.choice(60, 900, p=np.exp(model.log_p) @ np.array(mix) / (np.exp(model.log_p) @ np.array(mix)).sum()), return_counts=True)
        docs.append((slots, counts.astype(float)))

    def fit(slots, counts, some):
        share = [1 / len(some)] * len(some)
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(some)
            for slot, n in zip(slots, counts, strict=True):
                parts = [w * np.exp(model.log_p[slot, k]) for w, k in zip(share, some, strict=True)]
                for i, part in enumerate(parts):
                    new[i] += n * part / sum(parts)
            share = [x / counts.sum() for x in new]
        return share, sum(n * np.log(sum(w * np.exp(model.log_p[slot, k]) for w, k in zip(share, some, strict=True))) for slot, n in zip(slots, counts, strict=True))

    for (slots, counts), got in zip(docs, model.infer(docs), strict=True):
        order = np.argsort([-x for x in fit(slots, counts, [0, 1, 2])[0]], kind="stable")
        alone = [(counts * model.log_p[slots, k]).sum() for k in range(3)]
        want, score = np.eye(3)[int(np.argmax(alone))], max(alone)
        for size in (2, 3):
            some = [int(k) for k in order[:size]]
            share, value = fit(slots, counts, some)
            value -= (size - 1) * (langid.PENALTY + langid.PENALTY_PER_GRAM * counts.sum())
            if value <= score:
                break
            want, score = np.zeros(3), value
            want[some] = share
        assert np.allclose(got, want, atol=1e-6)


def test_mixtures_are_seen(spark, texts):
    model = langid.train(texts, F.lit(True))
    some = {r.lang: r.text for r in texts.where("lang in ('de', 'fr') and length(text) > 800").collect()}
    mixed = spark.createDataFrame([(1, some["de"][:800] + " " + some["fr"][:800])], "doc_id long, text string")
    shares = langid.identify(mixed, model).first().proportions
    assert shares["de"] > 0.25 and shares["fr"] > 0.25


def test_bpe_is_that_of_the_library(spark, odd, none):
    t = library("byte_bpe_50k.json")
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab é\n\t0'’<>|💡中ß") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    extra = ["<|endoftext|>x<|endoftext|>", "don't  stop\n\n now", "aaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01", *noise]
    rows = spark.createDataFrame([(100 + i, x) for i, x in enumerate(extra)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(rows)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in both.collect()}
    got = bpe.encode_documents(both, queries.vocabulary("byte_bpe_50k.json")).collect()
    for r in got:
        ids = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def conversation(spark):
    calls = {"content": "c", "tool_calls": [{"id": "b", "name": "search", "arguments": {"query": "$a", "limit": 2}}, {"id": "a", "name": "weather", "arguments": {"place": "P", "days": "x"}}]}
    circle = {"tool_calls": [{"id": "x", "name": "calculator", "arguments": {"expression": "$y"}}, {"id": "y", "name": "calculator", "arguments": {"expression": "$x", "k": 1}}, {"name": "nope", "arguments": 3}]}
    rows = [
        (1, 0, "user", 'hi "x"\n'), (1, 1, "assistant", json.dumps(calls)), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": [1.5, None]}})), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "t"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "q", "content": "t"})), (1, 5, "assistant", "{not json"), (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": 2})), (2, 0, None, None), (None, 1, "user", ""), (3, 0, "assistant", json.dumps(circle)),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))


def test_chat_links_orders_and_validates(spark):
    out = chat.format_chat(conversation(spark), chat.tool_parameters(spark))
    assert tuple(out.columns) == chat.COLUMNS
    rows = out.collect()
    assert all(r.line == json.dumps(json.loads(r.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows)
    call = {(r.conv_id, r.call_id): (r.level, r.status) for r in rows if r.kind == "call"}
    assert call == {(1, "a"): (0, "invalid type:days"), (1, "b"): (1, "ok"), (3, "x"): (-1, "unanswered"), (3, "y"): (-1, "invalid unknown:k"), (3, None): (0, "invalid no id")}
    assert sorted((r.call_id, r.turn, r.anchor_turn, r.status) for r in rows if r.kind == "result") == [("a", 2, 1, "ok"), ("a", 6, 1, "repeated"), ("b", 3, 1, "ok"), ("q", 4, 4, "orphan")]
    assert sum(r.kind == "message" for r in rows) == 6


def test_repeated_calls_and_keys_that_look_like_uses(spark):
    """Calls given many times stay one call; ``$`` opens a use in values only; chains of any order get their levels."""
    call = lambda i, args: '{"tool_calls":[{"id":"%s","name":"search","arguments":%s}]}' % (i, args)
    rows = [(1, 0, "assistant", call("a", '{"query":"x","$b":"y"}'))] * 300 + [(1, 1, "assistant", call("b", '{"query":"$a"}'))] * 300
    rows += [(2, k, "assistant", call(f"c{k}", '{"query":"$c%d"}' % (k - 1))) for k in range(1, 6)] + [(2, 9, "assistant", call("c0", '{"query":"x"}'))]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chat.tool_parameters(spark)).where("kind = 'call'").collect()
    assert {(r.call_id, r.level) for r in out} == {("a", 0), ("b", 1), *((f"c{k}", k) for k in range(6))} and len(out) == 606


def test_chat_of_nothing(spark):
    assert chat.format_chat(conversation(spark).where("false"), chat.tool_parameters(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    plain = lambda df: sorted(str([None if pd.isna(v) else str(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(want.columns) == sorted(got.columns) and plain(want) == plain(got)


def test_quality_orders_held_out_documents(spark, sf_dir, odd, none):
    got = queries.op4_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("quality is not null").toPandas()
    ranks = got.score.rank()
    good = got.quality == 1
    assert (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.75
    scored = quality.score(odd, quality.ByteNet.fresh(1)).toPandas()
    assert len(scored) == len(ODD) + 1 and scored.score.between(0, 1).all()
    assert quality.score(none, quality.ByteNet.fresh(1)).count() == 0


def test_quality_learns_from_whole_texts_at_every_byte(spark):
    docs = spark.createDataFrame([(i, "plain words " * 800 + ("#~#~# " * 60 if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))
    net = quality.ByteNet.fresh(1)
    assert np.array_equal(net.answers(quality.as_bytes("xabcdefgh"))[1:], net.answers(quality.as_bytes("abcdefgh")))


def test_url_rules(spark):
    rows = [(1, None), (2, "nonsense"), (3, "http://EXAMPLE.org/es/x?y"), (4, "http://a.example.org/en/12"), (5, "https://x.com/de"), (6, "https://x.com/de/#a"), (7, "https://notexample.org"), (8, "a://b://org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, urlrules.rule_table(spark, urlrules.RULES)).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == (None, "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == (None, "allow") and got[8][0] == "b:"


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie'>ok?</div><article><h1>A &amp; B</h1><p>one<br>two<p>three <b>bold</b></article><div id=comments>c</div><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), (3, "http://h/2", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in html.extract(pages).orderBy("page_id", "n_chars").collect()]
    text = "A & B\none two\nthree bold"
    assert got == [(1, "http://h/1", text, len(text)), (2, None, "", 0), (3, "http://h/2", "", 0), (3, "http://h/2", "x", 1)]
    assert html.extract(pages.where("false")).count() == 0


def test_repeated_branches_of_a_host_go(spark):
    pages = spark.createDataFrame([(i, "http://h/x", f"<div class=intro><p>Same words on every page.</p></div><div class=words><p>Own words of page {i * 7919}.</p></div>") for i in range(12)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {f"Own words of page {i * 7919}." for i in range(12)}


def main_texts(spark, pages):
    table = spark.createDataFrame([(i, "http://h/x", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(table).orderBy("page_id").collect()]


def test_repeated_branches_inside_article_go(spark):
    own = [f"Own words of page {i * 7919}." for i in range(12)]
    pages = [f"<article><div class=zz><p>Read this on every page.</p></div><p>{t}</p></article>" for t in own]
    assert main_texts(spark, pages) == own
    # copies of one page add nothing to what repeats
    assert main_texts(spark, pages + pages[:1] * 40) == own + own[:1] * 40


def test_importance_is_that_of_the_entropies(spark):
    """Nodes of a small site weighed in plain Python, and a page far longer than others."""
    pages = [f"<div class=intro><p>Same words.</p></div><div class=w{'' if i % 3 else 'x'}><p>Own {i * 7919}.</p><p>Half {i % 2}</p></div>" for i in range(8)] + ["<p>" + "very long " * 200_000 + "</p>"]
    table = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    contents, layouts = {}, {}
    for page in pages:
        for kind, (node, parent), value in {(f["kind"], (f["path"], f["parent"]), f["feature"]) for f in html.page_features(page)[1]}:
            if kind == 0:
                contents.setdefault((node, parent), []).append(value)
            elif kind == 1:
                layouts.setdefault(node, []).append(value)
    log = lambda values: [math.log(values.count(v)) for v in set(values)]
    m = math.log(len(pages))
    want = {}
    for (node, parent), values in contents.items():
        content = 1 - sum(log(values)) / len(set(values)) / m
        own = layouts.get(parent, [])
        layout = -sum(own.count(v) / len(own) * math.log(own.count(v) / len(own)) for v in set(own)) / m if own else 0
        want[node] = 1 - (1 - 1 / len(pages)) * (1 - (1 - html.GAMMA) * layout - html.GAMMA * content)
    got = {r.path: r.importance for r in html.style_nodes(table)[0].collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    texts = html.extract(table).orderBy("page_id").collect()
    assert texts[8].n_chars == 2_000_000 - 1 and texts[0].text == "Own 0.\nHalf 0"


def only(page):
    return html.main_text(page).split("\n") if html.main_text(page) else []


def test_names_of_wrappers_do_not_empty_a_page():
    assert only('<div class="layout has-sidebar"><article><p>one</p></article><div class="sidebar">x</div></div>') == ["one"]
    assert only('<div class="post no-comments"><p>one</p></div>') == ["one"]
    assert only('<article class="post no-comments"><p>one</p><div class="post-comments">c</div></article>') == ["one"]
    assert only('<form id=aspnet><div class=promo-page><p>' + "own words " * 9 + "</p></div><div class=login>in</div></form>") == [("own words " * 9).strip()]
    assert only('<div class=sidebar-layout><main><p>one</p></main><aside><article>teaser, and far more text than the page itself has</article></aside></div>') == ["one"]
    assert only("<main><p>one</p></main><section class=comments><article class=comment-body>c</article></section>") == ["one"]
    assert only("<article><p>one <span class=ad>buy</span> two</p><p class=side-effects>three</p></article>") == ["one two", "three"]


def test_attributes_end_where_html_ends_them():
    assert only("<p class=it's>one two</p><p>that is it's end</p><p>three</p>") == ["one two", "that is it's end", "three"]
    assert only('<p title="x>hello') == ["hello"]
    assert only('<p title="a>b" class=\'c>d\'>one</p><p data-x=a/b/>two</p>a < b <p') == ["one", "two", "a < b"]
    assert only('<p "odd" =x class = "y">one</p><svg/><p>two</p>') == ["one", "two"]
    long = "<p class='a'>" + "word " * 300_000 + "</p>"
    assert len(only(long)[0]) == 5 * 300_000 - 1 and only("<div>" * 50_000 + "deep") == ["deep"] and only("<" * 100_000 + "<p title='") == ["<" * 100_000]


def test_branches_of_little_importance_go_whole(spark):
    """What differs inside a branch that repeats goes with it; a branch that holds the page's text stays."""
    box = "<div class=zz><p>Read all of this on every page of this site.</p><p>And this too, on every page of the site, with all that it says.</p><i class=q>Here {}.</i><h4>Now {}</h4></div>"
    pages = [f"<div class=all>{box.format(i, i * 31)}<div class=words><p>Own words of page {i * 7919}, and far more of them than any box that all pages share has room for: what is said here is said once, on this page and on no other, at some length and with care.</p></div></div>" for i in range(12)]
    assert main_texts(spark, pages) == [f"Own words of page {i * 7919}, and far more of them than any box that all pages share has room for: what is said here is said once, on this page and on no other, at some length and with care." for i in range(12)]


def test_copies_keep_their_text(spark):
    pages = [f"<div class=intro><p>First words of {k}.</p></div><div class=words><p>Own words of {k}.</p></div>" for k in "ab"]
    want = [f"First words of {k}.\nOwn words of {k}." for k in "ab"]
    assert main_texts(spark, pages[:1] * 20) == want[:1] * 20
    assert main_texts(spark, pages * 20) == want * 20


def test_seven_pages_show_what_repeats(spark):
    pages = [f"<div class=intro><p>Same words on every page.</p></div><div class=words><p>Own words of page {i * 7919}.</p></div>" for i in range(7)]
    assert main_texts(spark, pages) == [f"Own words of page {i * 7919}." for i in range(7)]


def test_deep_nodes_are_told_apart(spark):
    pages = ["<div>" * 14 + f"<div class=zz><p>Same words on every page.</p></div><div class=words><p>Own words of page {i * 7919}.</p><p>Also {i}.</p></div>" for i in range(12)]
    assert main_texts(spark, pages) == [f"Own words of page {i * 7919}.\nAlso {i}." for i in range(12)]


def test_a_small_article_leaves_the_text_around_it(spark):
    pages = [f"<div class=words><p>Own words of page {i * 7919}.</p></div><article><p>Teaser {i}</p></article>" for i in range(12)]
    assert main_texts(spark, pages) == [f"Own words of page {i * 7919}.\nTeaser {i}" for i in range(12)]


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    links = []
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_are_those_of_brute_force(spark, odd, none):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = "new" + str(rng.randint(0, 9))
        rows.append((100 + i, " ".join(words)))
    want = brute_components(rows, 4, 85, 100)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    plain = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd, 4, 85, 100).collect()}
    assert plain == brute_components(list(enumerate(ODD)), 4, 85, 100)
    assert jaccard.near_duplicates(none).count() == 0


def test_a_large_group_of_texts_near_but_not_alike(spark):
    """400 texts with one to six changed words: a hub links some, others link further on, many with nothing."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(140, rng.integers(1, 7), replace=False):
            words[at] = f"e{rng.integers(0, 60)}"
        rows.append((i, " ".join(words[: 140 - rng.integers(0, 4)])))
    rows += [(5, "another text under an id that is taken"), (400, "another text under an id that is taken"), (401, rows[7][1])]
    want = {}
    for name, width, num in (("four", 4, 85), ("five", 5, 80)):
        want[name] = brute_components(rows[:400] + rows[401:], width, num, 100)
    for name, width, num in (("four", 4, 85), ("five", 5, 80)):
        got = jaccard.near_duplicates(spark.createDataFrame(rows[:400] + rows[401:], "doc_id long, text string"), width, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want[name]
        assert 1 < len({c for _, c in want[name].values()}) < 390
    twice = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).where("doc_id = 400").collect()
    assert [(r.n_shingles, r.component_id) for r in twice] == [(5, 5)]  # id 5 has this text too


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 700):
        values = np.sort(rng.integers(0, 10**6, n))
        seq, _ = tokenfile.EliasFano.from_bytes(memoryview(tokenfile.EliasFano.of(values).to_bytes()))
        assert list(seq.all()) == list(values) and [seq.select(i) for i in range(n)] == list(values)
        for start, stop in ((0, 0), (0, n), (n // 3, n), (n // 2, n - n // 4), (n - 1, n)):
            assert list(seq.run(max(start, 0), stop)) == list(values[max(start, 0) : stop])


def test_token_files(spark, odd, none, tmp_path):
    t = library("word_bpe_49k.json")
    rows = odd.dropDuplicates(["doc_id"])
    path = str(tmp_path / "files")
    files = tokenfile.write_token_files(rows, path, queries.vocabulary("word_bpe_49k.json")).collect()
    listed = spark.createDataFrame(files)
    got = {r.doc_id: r for r in tokenfile.with_starts(tokenfile.read_token_files(spark, path), listed).collect()}
    start = 0
    for i, text in enumerate(ODD):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.write_token_files(none, str(tmp_path / "empty"), queries.vocabulary("word_bpe_49k.json")).count() == 0
    assert tokenfile.read_token_files(spark, str(tmp_path / "empty")).count() == 0


def test_word_ids_are_those_of_the_library(texts):
    """Words cut into pieces: contractions in any case, marks, letters that change class or length, added tokens; then whole documents."""
    t, path = library("word_bpe_49k.json"), queries.vocabulary("word_bpe_49k.json")
    odd = ["DON'T 'Show they'LL x's'S 12a3 a_b-- ...'d", "W\u030a e\u0301 \u0130stanbul \u00c5\u00df\u01c4 \u212b \u03a3\u03a3 na\u00efve stra\u00dfe", "a\u00a0b \u2003c\u200bd \u0085x", "日本語 가나다 \U0001f600x", *[f"a{x}b {x}" for x in json.load(open(path))["added_tokens"] and [a["content"] for a in json.load(open(path))["added_tokens"]]]]
    some = odd + [r.text or "" for r in texts.collect()]
    words = tokenfile.WordIds(path, 4)
    for text, got in zip(some, words.batch(some), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_files_of_odd_ids(spark, odd, none, tmp_path, monkeypatch):
    """Null ids have no place, repeated ids follow one another, in files of bounded size; an empty table gives nothing."""
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 16)
    rows = spark.createDataFrame([(3, "a b c"), (None, "x"), (3, "d e f g h i j"), (1, "k"), (3, None), (2, "l m " * 30)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "t/documents.parquet"))
    got = queries.op8_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    t = library("word_bpe_49k.json")
    sizes = {text: len(t.encode(text, add_special_tokens=False).ids) + 1 for text in ("k", "l m " * 30, "a b c", "d e f g h i j", "")}
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 3] and [r.start for r in got][:3] == [0, sizes["k"], sizes["k"] + sizes["l m " * 30]]
    assert sorted(r.n_tokens for r in got) == sorted(sizes.values())
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert queries.op8_token_files(spark, str(tmp_path / "none")).count() == 0


def test_leaks(spark, none):
    items = spark.createDataFrame([(1, "Every morning Alice Smith walks 12 km to the market and buys 3 apples for 40 cents each before Bob comes home."), (2, "short one here"), (3, None), (4, "If a train leaves at 7 and another at 7 from the town of Leeds how far apart are they after 2 hours?")], "item_id long, text string")
    docs = [
        (1, "x y. Every morning Carol walks 15 miles to the market and buys 7 apples for 99 dollars each before Dan comes home. z"),
        (2, "EVERY MORNING ALICE SMITH WALKS 12 KM TO THE MARKET AND BUYS 3 APPLES FOR 40 CENTS EACH BEFORE BOB COMES HOME"),
        (3, "a short one here b"), (4, "short one here"), (5, "If a train leaves at 5 and another at 6 from the town of York how far apart are they after 3 hours?"),
        (6, "If a train leaves at 5 and another at 5 from the town of York how far apart are they after 3 hours?"), (None, "short one here"), (7, None), (8, ""), (9, "Every morning people like to walk to the market and buy apples"), (6, "repeated id"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    assert sorted((r.doc_id, r.item_id, r.kind) for r in decontam.leaks(table, items).collect()) == [(1, 1, "template"), (2, 1, "exact"), (3, 2, "exact"), (4, 2, "exact"), (6, 4, "template")]
    assert sorted(r.doc_id for r in decontam.without_leaks(table, items).where("doc_id is not null").collect()) == [5, 7, 8, 9]
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(table, items.where("false")).count() == 0


def leaked(spark, items, docs):
    texts = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    return sorted((r.doc_id, r.item_id, r.kind) for r in decontam.leaks(texts(docs, "doc_id"), texts(items, "item_id")).collect())


def test_names_that_open_sentences_are_replaced(spark):
    items = ["Tom has 5 big red apples. Tom buys some more green apples today. Tom Reed eats 2 of them at home."]
    docs = [
        "Anna has 7 big red apples. Anna buys some more green apples today. Anna Lee Hill eats 3 of them at home.",
        "We saw that Anna has 7 big red apples. Anna buys some more green apples today. Anna Lee Hill eats 3 of them at home.",
        "Anna has 7 big red apples. Carl buys some more green apples today. Dora eats 3 of them at home.",
        "Anna likes to be here. Anna wants more of these things soon. Anna sees 3 of us at home.",
    ]
    assert leaked(spark, items, docs) == [(0, 0, "template"), (1, 0, "template")]


def test_items_of_many_numbers_are_found_whole(spark):
    items = ["Tom has 5 apples. Tom buys 3 more.", "What is 12 times 7 minus 3", "Tom has 5 apples", "Add 1 2 3 4 5 6 7 8 9 10 and then 11 12 13 14", "12 7"]
    rows = " ".join(str(n) for n in range(3000))
    docs = [
        "Anna has 7 apples. Anna buys 2 more.", "So it goes: Anna has 7 apples. Anna buys 2 more. That is it.", "Anna has 7 apples. Carl buys 2 more.", "What is 8 times 8 minus 8", "Anna has 7 apples", "Anna has 7 pears",
        f"{rows} Add 3 4 5 6 7 8 9 1 2 33 and then 4 4 4 4 and {rows}", f"{rows} Add 3 4 5 6 7 8 9 1 2 33 and 4 4 4 4 and {rows}", "5 6",
    ]
    assert leaked(spark, items, docs) == [(0, 0, "template"), (0, 2, "template"), (1, 0, "template"), (1, 2, "template"), (2, 2, "template"), (3, 1, "template"), (4, 2, "template"), (6, 3, "template")]


def test_short_items_inside_long_texts(spark):
    """A short item that few documents hold is found anywhere, with other numbers too."""
    items = spark.createDataFrame([(1, "What is 12 times 7 minus 3"), (2, "who wrote the red book"), (3, "Tom has 5 apples")], "item_id long, text string")
    docs = [(1, "so then what is 40 times 9 minus 5 he said and left the room"), (2, "they asked who wrote the red book and why"), (3, "we know that Ann has 7 apples and more"), (4, "Ann has 7 apples"), (5, "what is a minus sign " * 9)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got) == [(1, 1, "template"), (2, 2, "exact"), (3, 3, "template"), (4, 3, "template")]


def test_short_items_with_few_words_inside_texts(spark):
    items = ["What is 12 times 7?", "Tom has 5 apples."]
    docs = ["A page says: What is 31 times 4? Answer below and more of it", "once more Anna has 9 apples. and so on it goes", "what is 5 plus 6? anna has 9 pears", "7 8 9 10"]
    assert leaked(spark, items, docs) == [(0, 0, "template"), (1, 1, "template")]


def test_turns_of_phrase_are_no_leaks(spark):
    """What many documents say is found only where it is the whole text."""
    items = ["in the end", "who wrote the red book"]
    docs = [f"this is text {i} and in the end it stops there" for i in range(60)] + ["in the end", "he asked who wrote the red book once"]
    assert leaked(spark, items, docs) == [(60, 0, "exact"), (61, 1, "exact")]


def test_short_items_that_many_documents_hold(spark, tmp_path):
    """The query and the pipeline find a short item in every document that holds it, however many do and however often."""
    items = [(0, "who wrote the red book"), (1, "What is 12 times 12?"), (2, "in the end")]
    docs = [(i, f"text {i} asks who wrote the red book and says more") for i in range(60)]
    docs += [(100 + i, f"he asked: What is {i} times {i}? and then: what is 3 times 4? " * 5) for i in range(60)] + [(200, "what is 3 times 4? and so on"), (201, "in the end " * 400)]
    for name, rows, kind in (("benchmark", items, "item_id long, text string"), ("documents", docs, "doc_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    want = [(i, 0, "exact") for i in range(60)] + [(100 + i, 1, "exact" if i == 12 else "template") for i in range(60)] + [(201, 2, "exact")]
    got = queries.op9_decontaminate(spark, str(tmp_path))
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got.collect()) == want
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, table, str(tmp_path)).collect()] == [200]


def test_a_short_item_is_told_once_for_a_text(spark):
    """A text that says an item a thousand times gives a window for each way in which its values are the same."""
    rows = spark.createDataFrame([(1, "the 5 and 5 or the 6 and 7 or " * 500)], "doc_id long, text string")
    known = decontam.window_table(spark.createDataFrame([(1, "the 1 and 2")], "item long, text string"), "item", "text")
    marks = decontam.window_filter(known)
    got = decontam.window_table(rows, "doc_id", "text", marks, marks, [4]).where("width = 4 and family = 1").collect()
    assert len(got) == 2 and sorted(len(set(r.fills)) for r in got) == [1, 2]


def plain_template_leaks(items, docs):
    """Items of lower-case words, numbers and names inside a sentence, laid over every place of every text."""
    kind = lambda w: "number" if w[0].isdigit() else "name" if w[0].isupper() else w
    found = set()
    for d, text in enumerate(docs):
        t = text.split()
        for i, item in enumerate(items):
            w = item.split()
            for at in range(len(t) - len(w) + 1):
                part = t[at : at + len(w)]
                pairs = {(a, b) for a, b in zip(w, part, strict=True) if kind(a) in ("number", "name")}
                if list(map(kind, part)) == list(map(kind, w)) and len({a for a, _ in pairs}) == len(pairs) and any(kind(a) == a for a in w):
                    found.add((d, i))
    return found


def test_templates_are_those_of_plain_loops(spark):
    rng = random.Random(12)
    word, number, name = (lambda: rng.choice("red green house tree walks sees buys little old new".split())), (lambda: str(rng.randint(2, 99))), (lambda: rng.choice(["Ann", "Bo", "Cy", "Di"]))

    def phrase(n):
        out = [word()]
        while len(out) < n:
            out.append(rng.choice([word, word, number, name])())
            if kinds(out[-2:]) == ["name", "name"]:
                out.pop()
        return out

    kinds = lambda ws: ["number" if w[0].isdigit() else "name" if w[0].isupper() else "word" for w in ws]

    def changed(ws):
        other = {}
        for w, k in zip(ws, kinds(ws), strict=True):
            other.setdefault(w, {"number": number, "name": name}.get(k, lambda w=w: w)())
        if rng.random() < 0.3:  # one slot gets a value of its own
            return [({"number": number, "name": name}.get(k, lambda w=w: w)() if rng.random() < 0.3 else other[w]) for w, k in zip(ws, kinds(ws), strict=True)]
        return [other[w] for w in ws]

    items = [phrase(rng.choice([3, 4, 5, 6, 7])) for _ in range(40)]
    docs = []
    for _ in range(150):
        inner = changed(rng.choice(items))
        docs.append(["so"] + [word() for _ in range(rng.randint(0, 6))] + inner + ["then"] + [word() for _ in range(rng.randint(0, 6))])
    items, docs = [" ".join(x) for x in items], [" ".join(x) for x in docs]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontam, "RARE", 1000)
        got = {(d, i) for d, i, _ in leaked(spark, items, docs)}
    assert got == plain_template_leaks(items, docs) and len(got) > 100


def test_leaks_are_those_of_brute_force(spark, sf_dir, texts):
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in texts.collect() for i, t in items if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 0.1 * max(10, len(want))


def test_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    v, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    got = queries.op10_neighbours(spark, sf_dir).toPandas()
    hits = total = 0
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.sort(d)[:10]
        mine = mine.sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose([d[ids == x][0] for x in mine.vec_id], mine.score)
        hits, total = hits + (mine.score <= best[-1] + 1e-9).sum(), total + 10
    assert got.query_id.nunique() == (ids % 100 == 0).sum() and hits / total >= 0.9


def test_neighbours_of_many_queries(spark, monkeypatch):
    """250 queries in clustered data, with groups so small that leaves and queries are dealt."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (25, 12))[rng.integers(0, 25, 2500)] + rng.normal(0, 0.4, (2500, 12))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 10 == 0).toPandas()
    recall = []
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(mine) == 10 and np.allclose(d[mine.vec_id], mine.score)
        recall.append((mine.score <= np.sort(d)[9] + 1e-9).mean())
    assert len(recall) == 250 and np.mean(recall) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (100, [1.5, 0.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = neighbours.search(table, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0.0), (0, 100, 0.5), (0, 2, 1.0), (100, 0, 0.5), (100, 1, 0.5), (100, 2, 0.5)]
    assert neighbours.search(table.where("false"), F.lit(True)).count() == 0


def test_odd_rows_in_every_stage(spark, sf_dir, odd, none):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass every stage; so does an empty table."""
    lost = spark.createDataFrame([(None, "no id but words of its own here"), (None, "no id but words of its own here")], "doc_id long, text string")
    rows = odd.unionByName(lost, allowMissingColumns=True)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        counts[name] = [r.doc_id for r in out.select("doc_id").collect()]
        assert out.columns == corpus_pipeline.COLUMNS or name == "token_ids"
        assert stage(spark, none, sf_dir).count() == 0
    assert sorted(x for x in counts["near_duplicates"] if x is not None) == [0, 1, 2, 3, 4, 5, 6] and counts["near_duplicates"].count(None) == 1
    assert len(counts["decontaminated"]) == len(counts["token_ids"]) == len(ODD) + 3
    assert not {0, 1, 2} & set(counts["language"])


def test_pipeline(spark, sf_dir, texts):
    docs = texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == corpus_pipeline.COLUMNS
        assert 0 < kept.count() <= docs.count(), name
        docs = kept
    leaked = {r.doc_id for r in queries.op9_decontaminate(spark, sf_dir).collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids & leaked and len(ids) > 0.7 * texts.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids
