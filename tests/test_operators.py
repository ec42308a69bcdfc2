"""Operators on small rows of their own."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, scoring, text
from tidemill.operators import content, keywords, landed, links, recommend, traffic, upserts
from tidemill.sources import tables
from tidemill.streaming import counters


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_rounding_is_towards_plus_infinity(spark):
    assert one(spark, scoring.round_half_up(F.col("v"), 2), v=-0.125) == -0.12


def test_fnv1a(spark):
    assert one(spark, text.fnv1a(F.col("v")), v="ab") == 1294271946


def test_text_functions(spark):
    assert one(spark, text.tokens(F.col("v"), stop=["the"]), v="The big, BIG a fox-1") == ["big", "fox"]
    assert one(spark, text.slug(F.col("v"), 7), v=" Big  Fox! ") == "big-fox"
    assert one(spark, text.strip_tags(F.col("v")), v="<p>a &lt; b</p>") == "a < b"
    assert one(spark, text.percent_encode(F.col("v")), v="a b") == "a%20b"
    assert one(spark, text.first_int(F.col("v")), v=" 12px") == 12
    assert one(spark, text.volume(F.col("v")), v="< 10") == 5
    assert one(spark, text.initial_consonant(F.col("v")), v="한") == "ㅎ"
    assert one(spark, text.substitute(F.col("v"), [("Best", "good")]), v="the BEST") == "the good"


def test_open_now_and_slots(spark):
    assert one(spark, dates.open_now(F.col("o"), F.col("c"), F.lit(False), F.lit(60)), o="22:00", c="02:00") is False
    assert one(spark, dates.hhmm(F.lit(1500))) == "01:00"


def test_iso_week_belongs_to_the_year_of_its_thursday(spark):
    assert one(spark, dates.iso_week_key(F.col("d")), d=dt.date(2024, 12, 30)) == "2025-W01"


def test_channels(spark):
    df = spark.createDataFrame([(None,), ("https://www.google.com/x",), ("https://m.naver.com",), ("nonsense",), ("https://my.site/a",), ("https://else.org",)], "r string")
    assert [r.c for r in df.select(traffic.channel(F.col("r"), "my.site").alias("c")).collect()] == ["direct", "google", "naver", "direct", "direct", "other"]


def posts(spark, rows):
    return spark.createDataFrame(rows, "id string, ord int, toks array<string>, cat string, region string, cluster string")


def test_links_top_k_is_that_of_all_pairs(spark):

    rng = random.Random(5)
    rows = [(f"p{i:02d}", i, rng.sample("abcdefghij", rng.randint(0, 3)), rng.choice(["x", "y", ""]), rng.choice(["n", "s", None]), rng.choice(["", "k"])) for i in range(40)]
    got = {(r.src, r["rank"]): (r.dst, round(r.score, 6)) for r in links.top_links(posts(spark, rows), k=3).collect()}
    want = {}
    for a in rows:
        scored = []
        for b in rows:
            if a[0] != b[0]:
                s = len(set(a[2]) & set(b[2])) / math.sqrt(len(a[2]) * len(b[2])) if a[2] and b[2] else 0
                s += sum(w for w, i in ((0.15, 3), (0.10, 4), (0.25, 5)) if a[i] and a[i] == b[i])
                if round(s, 9) >= 0.12:
                    scored.append((-round(s, 9), b[1], b[0]))
        for rank, (s, _, dst) in enumerate(itertools.islice(sorted(scored), 3), 1):
            want[a[0], rank] = (dst, round(-s, 6))
    assert got == want


def test_anchors_differ_while_they_can(spark):
    found = spark.createDataFrame([("a", "b", 1, 0.5), ("a", "c", 2, 0.4), ("a", "d", 3, 0.3)], "src string, dst string, rank int, score double")
    names = spark.createDataFrame([("b", ["T"]), ("c", ["t", "u"]), ("d", ["T "])], "dst string, anchors array<string>")
    assert {r.dst: r.anchor for r in links.with_anchors(found, names).collect()} == {"b": "T", "c": "u", "d": "T "}


def test_greedy_assignment_uses_each_post_once_and_prefers_later_ties(spark):
    slots = spark.createDataFrame([("s1", 1, "x", "red fox"), ("s2", 2, "x", "red fox"), ("s3", 3, "y", "red fox")], "slot string, ord int, cat string, kw string")
    items = spark.createDataFrame([("p1", 1, "x", "red fox"), ("p2", 2, "x", "red fox"), ("p3", 3, "x", "blue")], "post string, ord int, cat string, text string")
    assert {(r.slot, r.post) for r in links.assign_greedily(slots, items).collect()} == {("s1", "p2"), ("s2", "p1")}


def test_greedy_assignment_is_that_of_taking_turns(spark):
    """Slots one after the other, each with its best free post of the same category, where both have one."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    some = lambda n: [(i, rng.choice(["x", " X", "y", "", None]), " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(n)]
    slots, items = some(30), some(25)
    norm = lambda c: (c or "").strip().lower()
    want, used = {}, set()
    for slot, cat, kw in slots:
        best, top = None, 0.34
        for post, c, text in items:
            if post in used or (norm(c) and norm(cat) and norm(c) != norm(cat)):
                continue
            a, b = set(kw.split()), set(text.split())
            score = round(len(a & b) / math.sqrt(len(a) * len(b)), 9)
            if score >= top and a & b:
                best, top = post, score
        if best is not None:
            want[slot] = best
            used.add(best)
    s = spark.createDataFrame([(i, i, c, k) for i, c, k in slots], "slot int, ord int, cat string, kw string")
    p = spark.createDataFrame([(i, i, c, k) for i, c, k in items], "post int, ord int, cat string, text string")
    assert {r.slot: r.post for r in links.assign_greedily(s, p).collect()} == want
    assert links.assign_greedily(s.where("false"), p).count() == 0


def test_published_and_indexable(spark):
    rows = [("draft", None, False, False), ("Draft live", None, True, False), ("hidden", None, False, False), ("under review", None, True, False), ("검수", None, True, False), ("done", False, False, False), (None, None, True, True), ("", True, True, True)]
    df = spark.createDataFrame([(s, p) for s, p, _, _ in rows], "s string, p boolean")
    got = df.select(links.is_published(F.col("s"), F.col("p")).alias("a"), links.is_indexable(F.col("s"), F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, _, a, b in rows]


def test_related_rows_are_others_of_the_category(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(20)] + [(99, "c")], "id int, cat string")
    cats = {r.id: r.cat for r in rows.collect()}
    got = {}
    for r in landed.related_rows(rows, "id", "cat", 1).collect():
        got.setdefault(r.id, []).append(r.other)
    assert 99 not in got and all(len(set(o)) == 3 and k not in o and {cats[x] for x in o} == {cats[k]} for k, o in got.items()) and len(got) == 20


def test_ranks_over_many_partitions(spark):
    rows = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(40)).alias("v"), "id")
    got = [(r.v, r.id) for r in upserts.ranked(rows, [F.desc("v"), "id"]).orderBy("rank").collect()]
    assert got == sorted(((r.v, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))


def test_random_numbers_and_hashes_of_code_units(spark):
    assert one(spark, text.mulberry32(F.col("v").cast("bigint"), F.lit(1)), v="1") == pytest.approx(0.6270739405881613)
    assert one(spark, text.fnv1a(F.col("v")), v="ab") == 1294271946
    pair = "😀"  # two code units
    units = [0xD83D, 0xDE00]
    h = 5381
    for u in units:
        h = (h * 33 + u) % 2**32
    assert one(spark, text.djb2(F.col("v")), v=pair) == h


def test_robots(spark):
    allows = lambda robots, agent: one(spark, content.robots_allows(F.col("v"), agent), v=robots)
    assert allows(None, "Yeti") and allows("Disallow: /", "Yeti")  # a rule before any group is none
    both = "User-agent: a\nUser-agent: Yeti\nDisallow: /\n\nUser-agent: *\nDisallow: /\nAllow: /"
    assert not allows(both, "Yeti") and allows(both, "other")


def test_cleaning_is_that_of_plain_patterns(spark):
    """The rules over a page, once more with the patterns of another engine."""
    html = "<<<HTML>>><p><em> </em></p>\n\n\n\n<script src='x'>1</script><script type='application/ld+json'>{}</script>a��b  c Tel: 02-123-4567 / 1588-1234 전화: <b>x</b> <a href='tel now'>in</a> <a class='k' href=\"https://else.example\">우리 <b>카톡</b></a>"
    want = re.sub(r"(?i)<{2,3}\s*(?:TITLE|SEO|META|KEYWORDS|HTML|END)\s*>{2,3}", "", html)
    want = re.sub(r"(?is)<script\b(?![^>]*application/ld\+json)[^>]*>.*?</script>", "", want).replace("�", "")
    for _ in range(3):
        want = re.sub(r"(?i)<(p|h1|h2|h3|h4|li|strong|em|span)>\s*</\1>", "", want)
    want = want.replace("Tel: 02-123-4567", "카카오 상담").replace("1588-1234", "").replace("전화: <b>", "<b>").replace("<a href='tel now'>in</a>", "in")
    want = re.sub(r"<a class='k'[^>]*>(.*)</a>", rf'<a href="{content.CONTACT_URL}" target="_blank" rel="noopener">\1</a>', want)
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", want)).strip()
    assert one(spark, content.clean(F.col("v")), v=html) == want


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, upserts.upsert(base, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in upserts.delete(base, new, ["id"]).collect()] == [(1, "a")]


def test_streak_may_end_yesterday(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in (1, 3, 4, 5)] + [(2, dt.date(2024, 1, 2))], "u int, d date")
    assert dict(map(tuple, upserts.streaks(days, "u", "d", "2024-01-06").collect())) == {1: 3, 2: 0}


def test_clean_and_errors(spark):
    html = '<<<TITLE>>><p> </p><a href="none">x</a> <script>bad()</script><p>a�b 010-1234-5678</p>'
    assert one(spark, content.clean(F.col("v")), v=html) == "x <p>ab </p>"
    assert one(spark, content.content_errors(F.col("v")), v="<h2>x") == ["too-short", "truncated", "broken-html:h2"]


def test_headings_and_faq(spark):
    html = "<h2>FAQ</h2><h3>Why so?</h3><p>Because it is so.</p><h3>How long?</h3><p>Until it is done.</p><h2>Next</h2>"
    assert [h.level for h in one(spark, content.headings(F.col("v")), v=html)] == [2, 3, 3, 2]
    assert [x.q for x in one(spark, content.faq_pairs(F.col("v")), v=html)] == ["Why so?", "How long?"]
    assert one(spark, content.faq(F.col("v")), v="<h2>FAQ</h2><h3>Only one?</h3><p>It is not enough.</p>") is None


def test_recommendation_by_hand(spark):
    users = spark.createDataFrame([("u", ["c1", "c2"], ["d"])], "user string, concerns array<string>, drugs array<string>")
    items = spark.createDataFrame([("a", 1, 3), ("b", 2, 2), ("c", 3, 3)], "item string, ord int, evidence int")
    concerns = spark.createDataFrame([("c1", ["a", "b", "c"]), ("c2", ["b"])], "concern string, items array<string>")
    rules = spark.createDataFrame([(1, "d", "exclude", "no", ["c"])], "ord int, drug string, action string, message string, items array<string>")
    pairs = spark.createDataFrame([("a", "b", "synergy", "")], "a string, b string, kind string, mode string")
    got = recommend.recommend(users, items, concerns, rules, pairs)
    assert [(r.item, r.score) for r in got.orderBy("rank").collect()] == [("a", 1.1), ("b", 0.5)]
    clash = spark.createDataFrame([("a", "b", "antagonism", "split")], "a string, b string, kind string, mode string")
    assert tuple(recommend.schedule(got, clash).select("morning", "evening").first()) == (["a"], ["b"])


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"posts": [{"id": "x"}, {"id": "y"}]}')
    assert [r.id for r in tables.json_rows(spark, str(tmp_path / "a.json"), "id string").collect()] == ["x", "y"]
    assert tables.json_file(spark, str(tmp_path / "none.json"), "id string").count() == 0
    with pytest.raises(ValueError):
        tables.matching(spark.range(1), {"id": ""})


def test_streamed_counts_are_those_of_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = counters.run_available(counters.daily_counts(stream, key=F.col("event_type")), "counts", str(tmp_path / "cp"))
    want = events.groupBy(dates.local_day(F.col("ts")).alias("day"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_publishing_reads_the_partitions_of_a_batch_and_keeps_to_what_is_due(spark, tmp_path):
    spark.createDataFrame([("d1", "09:00"), ("d1", "23:00"), ("d2", "10:00")], "day string, slot string").write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema("day string, slot string").parquet(str(tmp_path / "in"))
        counters.publish_due(stream, str(tmp_path / "out"), str(tmp_path / f"cp{n}"), ("day", "slot"), part="day", now="12:00").awaitTermination()
    assert sorted((str(r.day), r.slot) for r in spark.read.schema("slot string, day string").parquet(str(tmp_path / "out")).collect()) == [("d1", "09:00"), ("d2", "10:00")]


def test_publishing_twice_adds_nothing(spark, tmp_path):
    spark.createDataFrame([("s1",), ("s2",)], "slot string").write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema("slot string").parquet(str(tmp_path / "in"))
        counters.publish_due(stream, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_white_space_of_every_kind_is_trimmed(spark):
    assert one(spark, text.norm(F.lit("\n Ab\t "))) == "ab" and one(spark, text.norm(F.lit("　﻿A b "))) == "a b" and one(spark, text.norm(F.lit(None).cast("string"))) == ""
    assert one(spark, text.collapse_spaces(F.lit(" a  \n b　"))) == "a b"
    short = "x" * 700 + "\n" * 200
    assert "too-short" in one(spark, content.content_errors(F.lit(f"<p>{short}</p>"))) and "too-short" not in one(spark, content.content_errors(F.lit("<p>" + "x" * 800 + "\n</p>")))


def test_only_the_label_makes_a_contact_link(spark):
    def link(href, label):
        return f'<a class="c" href="{href}">{label}</a>'

    fixed = lambda html: one(spark, content.sanitise_links(F.lit(html), "https://pf.kakao.com/x"))
    contact = lambda label: f'<a href="https://pf.kakao.com/x" target="_blank" rel="noopener">{label}</a>'
    same = link("https://bad.example/x", '<img alt="카카오">더보기')
    assert fixed(same) == same
    assert fixed(link("https://bad.example/x", "<b>카</b>카오 1 < 2")) == contact("<b>카</b>카오 1 < 2")
    assert fixed(link("https://pf.kakao.com/y", "카톡")) == link("https://pf.kakao.com/y", "카톡")
    assert fixed(link("카카오 상담", "카톡") + link("nowhere", "<i>x</i>") + link("/here", "y")) == contact("카톡") + "<i>x</i>" + link("/here", "y")


def test_region_and_keyword_are_no_find(spark):
    words = spark.createDataFrame([("g", w, w.lower(), i) for i, w in enumerate(["Seoul clinic", "clinic", "best clinic", "clinic seoul"])], "g string, word string, key string, ord int")
    found = lambda **more: [r.word for r in keywords.research(words, "g", F.lit("Clinic"), **more).orderBy("rank").collect()]
    assert found(region=F.lit(" SEOUL\t")) == ["best clinic", "clinic seoul"] and found() == found(region=F.lit("")) == ["Seoul clinic", "best clinic", "clinic seoul"]


def test_links_that_exist_make_no_post_less_of_an_orphan(spark):
    posts = spark.createDataFrame([(101, "a-b", "<a href='/C%20d'>"), (102, "c d", "no"), (103, "e", "101")], "id long, slug string, html string")
    new = spark.createDataFrame([(101, 102), (102, 103), (103, 101)], "src long, dst long")
    there = links.existing_links(new, posts)
    assert sorted(tuple(r) for r in there.collect()) == [(101, 102), (103, 101)]
    assert tuple(links.link_stats(posts, new, there).first()) == (3, 3, 1.0, 2, 0.667) and tuple(links.link_stats(posts, new).first())[3] == 0


def test_merge_keeps_opens_and_fills_as_taking_turns_does(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(8)]
    said = lambda: " ".join(rng.sample(words, rng.randint(1, 4)))
    items = [(i, rng.choice(["x", "y", ""]), said()) for i in range(25)]
    slots = [(100 + i, rng.choice([" X", "y", ""]), said(), rng.choice([None, None, i % 25, 900 + i])) for i in range(30)]
    want, there = {}, {i for i, _, _ in items}
    used = {post for *_, post in slots if post in there}
    for slot, cat, kw, post in slots:
        if post in there:
            want[slot] = (post, "kept")
            continue
        best, top = None, 0.34
        for i, c, t in items:
            a, b = set(kw.split()), set(t.split())
            score = round(len(a & b) / math.sqrt(len(a) * len(b)), 9)
            if i not in used and not (c and cat.strip() and c != cat.strip().lower()) and score >= top and a & b:
                best, top = i, score
        want[slot] = (best, "open" if best is None else "filled")
        used.add(best)
    s = spark.createDataFrame([(i, i, c, k, p, i % 3) for i, c, k, p in slots], "slot long, ord long, cat string, kw string, post long, cluster long")
    p = spark.createDataFrame([(i, i, c, t) for i, c, t in items], "post long, ord long, cat string, text string")
    merged = links.merge_clusters(s, p)
    rows = merged.collect()
    assert {r.slot: (r.post, r.status) for r in rows} == want and len(rows) == 30
    again = s.drop("post").join(merged.select("slot", "post"), "slot")
    assert {r.slot: (r.post, r.status) for r in links.merge_clusters(again, p).collect()} == {i: (post, "open" if post is None else "kept") for i, (post, _) in want.items()}
    total = [r for r in links.cluster_summary(merged, s, "cluster").collect() if r.cluster is None]
    assert [(r.slots, r.filled) for r in total] == [(30, sum(post is not None for post, _ in want.values()))]
    assert {r.status for r in links.merge_clusters(s, p.where("false")).collect()} == {"open"}


def test_audit_looks_into_the_body(spark):
    long = "<p>" + "words " * 100 + "</p>"
    pages = [
        ("root", f"<head><title>A title long enough</title></head><body>{long}<div class=x id=\"root\"><!-- c --></div></body>", None),
        ("spaced", f"<head><title>A title long enough</title></head><body>{long}<div id='app'> </div></body>", False),
        ("reactroot", f"<head><title>A title long enough</title></head><body>{long}<main data-reactroot=\"\"></main></body>", None),
        ("other", f"<head><title>A title long enough</title></head><body>{long}<div id=roots></div></body>", False),
        ("head", f"<head><style>{'p{} ' * 200}</style></head><body><title>x</title>short</body>", None),
        ("two", f"<head><title>A title long enough</title></head><body>{long}<svg><title>x</title></svg></body>", False),
    ]
    rows = spark.createDataFrame([(k, h, "https://x.example/a") for k, h, _ in pages], "id string, html string, url string")
    got = {r.id: r for r in content.page_checks(rows).collect()}
    assert {k: got[k].h1 for k, *_ in pages} == {k: h1 for k, _, h1 in pages}
    assert got["two"].title is True
    urls = [("https://x.example/%ED%95%9C%EA%B8%80", True), ("https://x.example/%31%32%33%34%35%36", False), ("https://x.example/%zz1", True), ("https://x.example/ab+c", True), ("https://x.example/a%2Bb", False)]
    table = spark.createDataFrame(urls, "url string, ok boolean")
    assert all(r.ok == r.found for r in table.select("ok", content.url_ok(F.col("url")).alias("found")).collect())


@pytest.mark.parametrize("stretch", [2, 7, 4096])
def test_rings_cut_into_stretches_are_whole_rings(spark, monkeypatch, stretch):
    monkeypatch.setattr(landed, "STRETCH", stretch)
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(60)] + [(100, "single"), (101, "pair"), (102, "pair")]
    want = {}
    for category in {c for _, c in rows if c}:
        ring = sorted((hashlib.md5(f"{i}|5".encode()).hexdigest(), i) for i, c in rows if c == category)
        for at, (_, i) in enumerate(ring):
            for rank in range(1, min(3, len(ring) - 1) + 1):
                want[i, rank] = ring[(at + rank) % len(ring)][1]
    table = spark.createDataFrame(rows, "id long, category string")
    assert {(r.id, r["rank"]): r.other for r in landed.related_rows(table, "id", "category", seed=5).collect()} == want


def test_broken_files_fall_back_one_by_one(spark):
    bodies = ['[{"a":1},{"a":2}]', '{"posts":[{"a":3}]}', ' {"items":[]}', '[{"a":1},{"a"', "{broken", "", None, '{"other":[{"a":4}]}', "17"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "file long, body string")
    rows = tables.json_rows_or(texts, "body", "a bigint", F.array(F.struct(F.lit(-1).alias("a")))).collect()
    assert sorted((r.file, r.a, r.fell_back) for r in rows) == [(0, 1, False), (0, 2, False), (1, 3, False), *((i, -1, True) for i in (3, 4, 5, 6, 7, 8))]


def test_search_needs_a_filter_that_counts(spark):
    rows = spark.createDataFrame([("Red Ring", "b1", 7), ("big red bolt", "b2", 7), ("blue", "b1", 7)], "name string, brand string, size int")
    found = lambda wanted, **more: sorted(r.name for r in tables.matching(rows, wanted, **more).collect())
    assert found({"name": " RED ", "brand": "", "size": None}, within=("name",)) == ["Red Ring", "big red bolt"]
    assert found({"name": "red", "brand": "b1"}, within=("name",)) == ["Red Ring"] and found({"name": "red"}) == []
    with pytest.raises(ValueError):
        tables.matching(rows, {"name": "  ", "size": 7}, counted=("name", "brand"))


def test_boards_hold_valid_domains_only(spark):
    rows = spark.createDataFrame([("\thttps://WWW.a.example/x\n", 50.7), ("a.example:80", 120.0), ("localhost", 90.0), (None, 90.0), ("b" * 80 + ".com", 9.0), ("c.org", 0.4)], "url string, score double").withColumn("ts", F.lit("2024-01-31 16:00:00").cast("timestamp_ntz"))
    got = {(r.period, r.member, r.score) for r in traffic.domain_leaderboard(rows, "ts", "url", F.col("score")).collect()}
    assert got == {(p, "a.example", 100) for p in ("all", "2024-02", "2024-W05")}
