"""Long phrase lists, the paged source and the streams with state, against plain loops and through restarts."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators import phrases, routine
from tidemill.sources import paged
from tidemill.streaming import stateful


def plain_longest(text, words):
    out, at = [], 0
    while at < len(text):
        fits = [w for w in words if text[at : at + len(w)].lower() == w.lower()]
        if fits:
            best = max(fits, key=len)
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


def test_thousands_of_phrases_in_one_pass(spark):
    rng = random.Random(2)
    words = list(dict.fromkeys("".join(rng.choice("abcé ") for _ in range(rng.randint(1, 7))) for _ in range(5000)))
    texts = [None, "", *["".join(rng.choice("abcéABC d") for _ in range(rng.randint(0, 200))) for _ in range(30)]]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in phrases.find_phrases(table, "text", words, ["id"]).collect():
        text = texts[r.id] or ""
        assert r.found == [w for w in words if w in text.lower()]
        assert [tuple(s) for s in r.spans] == plain_longest(text, words)
    assert [r.found for r in phrases.find_phrases(table, "text", [], ["id"]).collect()] == [[]] * len(texts)


def test_rules_longest_first_are_a_pass_each(spark):
    rng = random.Random(3)
    rules = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "".join(rng.choice("abcX") for _ in range(rng.randint(0, 3)))) for _ in range(60)]
    rules = list({a: (a, b) for a, b in rules}.values())
    texts = [None, "", "x", *["".join(rng.choice("abcAx ") for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in phrases.replace_phrases(table, "text", rules, ["id"]).collect():
        want, n = texts[r.id], 0
        for a, b in sorted(rules, key=lambda x: -len(x[0])):
            if want:
                want, k = re.subn(re.escape(a), lambda _, b=b: b, want, flags=re.I)
                n += k
        assert (r.replaced, r.replacements) == (want, n)


def test_a_list_of_phrases_is_bounded(monkeypatch):
    monkeypatch.setattr(phrases, "MOST_CHARS", 10)
    with pytest.raises(ValueError):
        phrases.Phrases(["abcdef", "ghijkl"])


@pytest.fixture()
def pages(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.floor(F.col("id") / 100) + 1).cast("int").alias("page"))
    paged.land(rows.where("page <> 8"), str(tmp_path / "p"))
    return tmp_path / "p"


SCHEMA = "id bigint, name string, page int"


def poison(folder, *numbers):
    """Pages that cannot be read: whoever opens one fails."""
    for k in numbers:
        (folder / f"page={k}").mkdir(exist_ok=True)
        (folder / f"page={k}" / "part-bad.json").write_text("{broken")


def test_pages_end_at_the_first_empty_one(spark, pages):
    poison(pages, 9, 10)
    assert sorted(r.id for r in paged.paged(spark, str(pages), SCHEMA).collect()) == list(range(700))
    (pages / "page=8").mkdir()
    (pages / "page=8" / "part-0.json").write_text("")
    assert paged.paged(spark, str(pages), SCHEMA).count() == 700
    assert paged.paged(spark, str(pages), SCHEMA, pages=2).count() == 200


def test_filters_and_limits_keep_pages_closed(spark, pages):
    poison(pages, 1, 4, 5, 6, 7)
    rows = paged.paged(spark, str(pages), SCHEMA).where("page >= 2 and page < 4 and id in (150, 250, 251, 950) and name <> 'n251'")
    assert sorted(r.id for r in rows.collect()) == [150, 250] and rows.rdd.getNumPartitions() == 2
    assert paged.paged(spark, str(pages), SCHEMA).where("page > 90").count() == 0
    with pytest.raises(ValueError):
        paged.paged(spark, str(pages), SCHEMA, limit=5)


def test_limits_count_in_page_order(spark, pages):
    poison(pages, 4)
    rows = paged.paged(spark, str(pages), SCHEMA, limit=250, page_rows=100)
    assert rows.count() == 250 and rows.where("page = 3").count() == 50
    assert paged.paged(spark, str(pages), SCHEMA, limit=250, page_rows=100).where("id % 2 = 0 and id >= 100").count() > 0


def streamed(spark, tmp_path, build, parts, mode="append"):
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        out = stateful.drained(build(spark.readStream.schema(parts[0].schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode)
    return out


ALARM = "id bigint, active boolean, next_fire_at string, seen_at string"


def alarm_rows(spark, rows):
    return spark.createDataFrame(rows, ALARM).select("id", "active", F.col("next_fire_at").cast("timestamp"), F.col("seen_at").cast("timestamp"))


def test_alarms_fire_once_and_move_on(spark, tmp_path):
    clock = lambda t: (-1, False, None, t)
    runs = [
        [(1, True, "2024-01-02 08:00:00", "2024-01-01 00:00:00"), (2, False, "2024-01-02 08:00:00", "2024-01-01 00:00:00"), (3, True, "2024-01-09 08:00:00", "2024-01-01 00:00:00"), clock("2024-01-04 09:00:00")],
        [(3, True, "2024-01-05 07:00:00", "2024-01-04 10:00:00"), (4, True, None, "2024-01-04 10:00:00"), clock("2024-01-05 07:30:00")],
        [clock("2024-01-05 09:00:00")],
    ]
    got = streamed(spark, tmp_path, stateful.alarms, [alarm_rows(spark, r) for r in runs])
    assert sorted((r.id, str(r.fired_at), str(r.next_fire_at)) for r in got.collect()) == [
        (1, "2024-01-02 08:00:00", "2024-01-05 08:00:00"), (1, "2024-01-05 08:00:00", "2024-01-06 08:00:00"), (3, "2024-01-05 07:00:00", "2024-01-06 07:00:00"),
    ]


def test_alarm_stream_is_the_batch_tick(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (F.col("event_id") % 3 != 0).alias("active"), F.col("ts").cast("timestamp").alias("next_fire_at"))
    seen = lambda df, t: df.withColumn("seen_at", F.lit(t).cast("timestamp"))
    parts = [seen(rows.where("id % 2 = 0"), "2023-12-01 00:00:00"), seen(rows.where("id % 2 = 1"), "2023-12-01 00:00:01").unionByName(alarm_rows(spark, [(-1, False, None, "2024-01-20 12:00:00.001")]))]
    got = Counter((r.id, r.next_fire_at) for r in streamed(spark, tmp_path, stateful.alarms, parts).collect())
    due, moved = routine.due_alarms(rows, F.lit("2024-01-20 12:00:00").cast("timestamp"))
    assert got == Counter((r.id, r.next_fire_at) for r in moved.join(due.select("id"), "id").collect()) and got


def test_publisher_publishes_each_slot_once_and_few_a_poll(spark, tmp_path):
    rows = lambda slots, seen: spark.createDataFrame([(lane, slot, seen) for lane, slot in slots], "lane bigint, slot string, seen_at string").select("lane", F.col("slot").cast("timestamp"), F.col("seen_at").cast("timestamp"))
    slots = [(1, f"2024-01-01 08:{m:02d}:00") for m in (5, 10, 15, 20, 25)] + [(1, "2024-01-01 09:00:00"), (2, "2024-01-01 08:00:00")]
    parts = [rows(slots, "2024-01-01 00:00:00").unionByName(rows([(-1, None)], "2024-01-01 09:10:00")), rows([*slots[:3], (1, "2024-01-01 10:30:00")], "2024-01-01 09:20:00"), rows([(-1, None)], "2024-01-02 00:00:00")]
    got = streamed(spark, tmp_path, stateful.publisher, parts)
    assert sorted((r.lane, str(r.slot)[11:16], str(r.published_at)[11:16]) for r in got.collect()) == [
        (1, "08:05", "09:00"), (1, "08:10", "09:00"), (1, "08:15", "09:00"), (1, "08:20", "10:00"), (1, "08:25", "10:00"), (1, "09:00", "10:00"), (1, "10:30", "11:00"), (2, "08:00", "08:00"),
    ]


def test_old_keys_leave_the_state(spark, tmp_path):
    """Two seconds stand for the days: a key that comes again before is counted on, one that comes later starts anew."""
    rows = lambda *keys: spark.createDataFrame([(k, float(v)) for k, v in keys], "key string, value double")
    short, long = 3 / 86_400, 1.0
    for best, days, want in ((False, long, 3.0), (False, short, 1.0), (True, long, 9.0), (True, short, 2.0)):
        place = tmp_path / f"{best}-{days}"
        build = lambda s, best=best, days=days: stateful.expiring(s, F.col("key"), F.col("value") if best else F.lit(1), best, days)
        streamed(spark, place, build, [rows(("a", 9), ("a", 4))], "update")
        time.sleep(4 if days == short else 0)
        out = streamed(spark, place, build, [rows(("a", 2))], "update")
        assert [r.value for r in out.orderBy("batch").collect()] == [9.0 if best else 2.0, want]
