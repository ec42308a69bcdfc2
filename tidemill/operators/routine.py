"""Routines: items in slots, checks, progress, schedules and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a day in their order.
SLOTS = ("morning", "evening")


def add_items(state: DataFrame, new: DataFrame, user: str = "user") -> DataFrame:
    """(user, id, name, slots): new items join those that are there; slots are united, a new name wins, none means morning."""
    slots = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c).otherwise(F.array(F.lit(SLOTS[0])))
    old = state.select(user, "id", F.col("name").alias("old_name"), F.col("slots").alias("old_slots"))
    added = new.select(user, "id", F.col("name").alias("new_name"), slots(F.col("slots")).alias("new_slots"))
    met = old.join(added, [user, "id"], "full")
    none = F.array().cast("array<string>")
    return met.select(user, "id", F.coalesce(F.nullif(F.col("new_name"), F.lit("")), "old_name").alias("name"), F.array_union(F.coalesce("old_slots", none), F.coalesce("new_slots", none)).alias("slots"))


def toggled(checks: Column, key: Column) -> Column:
    """A map of checks with a key taken out if it is there, else added."""
    return F.when(F.map_contains_key(checks, key), F.map_filter(checks, lambda k, _: k != key)).otherwise(F.map_concat(checks, F.create_map(key, F.lit(True))))


def toggled_value(values: Column, key: Column, value: Column) -> Column:
    """A map with a value set, or taken out if it was set to the same."""
    rest = F.map_filter(values, lambda k, _: k != key)
    return F.when(F.coalesce(F.try_element_at(values, key) == value, F.lit(False)), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def chosen(picked: Column, option: Column, none: str = "none") -> Column:
    """A multiple choice after one click: ``none`` excludes all others, an option clicked twice goes."""
    without = F.array_remove(picked, none)
    other = F.when(F.array_contains(without, option), F.array_remove(without, option)).otherwise(F.array_append(without, option))
    return F.when(option == none, F.when(F.array_contains(picked, none), F.array().cast("array<string>")).otherwise(F.array(F.lit(none)))).otherwise(other)


def slots_of(items: DataFrame, checks: DataFrame, user: str = "user") -> DataFrame:
    """(user, id, slot, checked) of every item and slot. ``checks``: user, id, slot."""
    each = items.select(user, "id", F.explode("slots").alias("slot"))
    done = checks.select(user, "id", "slot").distinct().withColumn("checked", F.lit(True))
    return each.join(done, [user, "id", "slot"], "left").select(user, "id", "slot", F.coalesce("checked", F.lit(False)).alias("checked"))


def progress(slots: DataFrame, user: str = "user") -> DataFrame:
    """(user, done, total, complete)."""
    return slots.groupBy(user).agg(F.count_if("checked").alias("done"), F.count("*").alias("total"), F.bool_and("checked").alias("complete"))


def by_slot(slots: DataFrame, user: str = "user") -> DataFrame:
    """(user, slot, items): ids of each slot in order; slots without items are left out."""
    return slots.groupBy(user, "slot").agg(F.array_sort(F.collect_list("id")).alias("items"))


def schedule_on(schedules: DataFrame, days: DataFrame, first: str = "from", last: str = "to") -> DataFrame:
    """The first schedule of each day that lies in its range; null where none does. ``schedules``: id, ord, from, to; ``days``: day.

    Ranges are unfolded to days, which makes it an equi-join.
    """
    unfolded = schedules.where(F.col(first) <= F.col(last)).select("id", "ord", F.explode(F.sequence(first, last)).alias("day"))
    first_one = unfolded.groupBy("day").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    return days.join(first_one, "day", "left").select("day", "id")


def due_alarms(alarms: DataFrame, now: Column, every_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """Active alarms whose time has come, and all alarms with the due ones moved on past ``now``. ``alarms``: id, active, next_fire_at."""
    due = F.coalesce(F.col("active") & (F.col("next_fire_at") <= now), F.lit(False))
    steps = F.floor(F.datediff(now, F.col("next_fire_at")) / every_days).cast("int") * every_days
    ahead = lambda n: F.col("next_fire_at") + F.make_dt_interval(n)
    moved = F.when(ahead(steps) > now, ahead(steps)).otherwise(ahead(steps + F.lit(every_days)))
    return alarms.where(due), alarms.withColumn("next_fire_at", F.when(due, moved).otherwise(F.col("next_fire_at")))


def to_publish(due: Column, count: Column, published: Column, most: int = 3) -> Column:
    """How many slots a run may publish now."""
    return F.greatest(F.lit(0), F.least(F.least(count, due) - published, F.lit(most)))


def not_yet_measured(targets: DataFrame, done: DataFrame, keys: list[str], forced: bool = False, most: int | None = None) -> DataFrame:
    """Targets without a measurement of the day, in order, ``most`` of them at most."""
    left = targets if forced else targets.join(done.select(*keys), keys, "left_anti")
    return left if most is None else left.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).where(F.col("rank") <= most).drop("rank")
