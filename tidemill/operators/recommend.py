"""Rule-based recommendation for many users at once: candidates, exclusions, scores, pair bonuses, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import small

#: Fixed values of the scoring policy.
RANK_WEIGHTS = (1.0, 0.85, 0.7, 0.55)
EVIDENCE_WEIGHT = {3: 1.0, 2: 0.7, 1: 0.4}
WARNED, OVERLAP_PENALTY, PAIR_BONUS = 0.5, 0.3, 0.1


def candidates(users: DataFrame, concerns: DataFrame) -> DataFrame:
    """(user, item, fit, matches): the best rank weight over the user's concerns. users: user, concerns; concerns: concern, items (best first)."""
    ranked = concerns.select("concern", F.posexplode("items").alias("pos", "item"))
    w = F.element_at(F.array(*map(F.lit, RANK_WEIGHTS)), F.least(F.col("pos") + 1, F.lit(len(RANK_WEIGHTS))))
    asked = users.select("user", F.explode(F.array_distinct("concerns")).alias("concern"))
    return asked.join(small(ranked.withColumn("w", w)), "concern").groupBy("user", "item").agg(F.max("w").alias("fit"), F.count("*").alias("matches"))


def drug_actions(users: DataFrame, rules: DataFrame) -> DataFrame:
    """(user, item, excluded, warnings, warned): rules hold where the user takes the drug. rules: ord, drug, items, action, message.

    The last exclusion wins. Warnings keep rule order; those behind an exclusion are not given.
    """
    taken = users.select("user", F.explode(F.array_distinct("drugs")).alias("drug"))
    hits = taken.join(small(rules.select("ord", "drug", "action", "message", F.explode(F.array_distinct("items")).alias("item"))), "drug")
    told = F.array_sort(F.collect_list(F.when(F.col("action") == "warn", F.struct("ord", "message"))))
    folded = hits.groupBy("user", "item").agg(F.max_by("message", F.when(F.col("action") == "exclude", F.col("ord"))).alias("excluded"), F.min(F.when(F.col("action") == "exclude", F.col("ord"))).alias("since"), told.alias("told"))
    warnings = F.transform(F.filter("told", lambda x: F.col("since").isNull() | (x["ord"] < F.col("since"))), lambda x: x["message"])
    return folded.select("user", "item", "excluded", warnings.alias("warnings"), (F.size(warnings) > 0).alias("warned"))


def allergic(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """(item, allergy) where the cautions of an item name a keyword of an allergy. items: item, cautions; keywords: allergy, words."""
    words = keywords.select("allergy", F.explode("words").alias("word"))
    return items.select("item", F.array_join("cautions", " ").alias("text")).join(small(words), F.contains("text", F.col("word"))).select("item", "allergy").distinct()


def not_recommended(users: DataFrame, concerns: DataFrame, rules: DataFrame, allergies: DataFrame | None = None) -> DataFrame:
    """(user, item, reason) of candidates that a rule excludes, or that hold what the user is allergic to. users: user, concerns, drugs, allergies."""
    asked = candidates(users, concerns).select("user", "item")
    out = asked.join(drug_actions(users, rules).where(F.col("excluded").isNotNull()), ["user", "item"]).select("user", "item", F.col("excluded").alias("reason"))
    if allergies is not None:
        has = users.select("user", F.explode("allergies").alias("allergy")).join(small(allergies), "allergy").select("user", "item").distinct()
        found = asked.join(has, ["user", "item"]).join(out.select("user", "item"), ["user", "item"], "left_anti")
        out = out.unionByName(found.select("user", "item", F.lit("allergy").alias("reason")))
    return out


def pair_hits(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, a, b, kind, mode) of rule pairs of which a user has both. pairs: a, b, kind, mode; each unordered pair once, synergies first."""
    left, right = rows.select("user", F.col("item").alias("a")), rows.select("user", F.col("item").alias("b"))
    return left.join(small(pairs), "a").join(right, ["user", "b"])


def combinations(users: DataFrame, items: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, kind, what) for a stack of items: drug conflicts, separate, monitor and synergy pairs, upper limits, categories taken twice.

    users: user, stack, drugs; items: item, category, upper (a limit or null).
    """
    taken = users.select("user", F.explode(F.array_distinct("stack")).alias("item"))
    known = taken.join(small(items.select("item", "category", "upper")), "item")
    acts = taken.join(drug_actions(users, rules), ["user", "item"])
    what = lambda df, kind, text: df.select("user", F.lit(kind).alias("kind"), text.alias("what"))
    hits = pair_hits(taken, pairs)
    kind = F.when(F.col("kind") == "synergy", "synergy").when(F.col("mode") == "monitor", "monitor").otherwise("separate")
    twice = known.groupBy("user", "category").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    return (
        what(acts.where(F.col("excluded").isNotNull()), "exclude", F.concat_ws(": ", "item", "excluded"))
        .unionByName(acts.select("user", F.lit("warn").alias("kind"), F.explode(F.transform("warnings", lambda w: F.concat_ws(": ", F.col("item"), w))).alias("what")))
        .unionByName(hits.select("user", kind.alias("kind"), F.concat_ws("+", "a", "b").alias("what")))
        .unionByName(what(known.where(F.col("upper").isNotNull()), "limit", F.concat_ws(": ", "item", F.col("upper").cast("string"))))
        .unionByName(what(twice, "twice", F.concat_ws(": ", "category", F.array_join("items", ","))))
    )


def recommend(users: DataFrame, items: DataFrame, concerns: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, item, score, rank, warnings) of items that no rule excludes.

    Score: evidence weight times fit times safety, less a penalty for each concern beyond the first, plus a bonus for each synergy in the
    result; rounded half up to two digits. Ties keep the order of items. items: item, ord, evidence.
    """
    evidence = F.create_map(*[F.lit(x) for pair in EVIDENCE_WEIGHT.items() for x in pair])
    rows = candidates(users, concerns).join(small(items), "item").join(drug_actions(users, rules), ["user", "item"], "left").where(F.col("excluded").isNull())
    weight = F.coalesce(F.try_element_at(evidence, F.col("evidence")), F.lit(0.4))
    safety = F.when(F.coalesce("warned", F.lit(False)), F.lit(WARNED)).otherwise(F.lit(1.0))
    rows = rows.withColumn("base", weight * F.col("fit") * safety - OVERLAP_PENALTY * F.greatest(F.col("matches") - 1, F.lit(0)))
    synergies = pair_hits(rows, pairs.where("kind = 'synergy'"))
    bonus = synergies.select("user", F.explode(F.array("a", "b")).alias("item")).groupBy("user", "item").agg((F.count("*") * PAIR_BONUS).alias("bonus"))
    scored = rows.join(bonus, ["user", "item"], "left").withColumn("score", F.floor((F.col("base") + F.coalesce("bonus", F.lit(0.0))) * 100 + 0.5) / 100)
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "ord"))
    return scored.select("user", "item", "score", rank.alias("rank"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def schedule(recommended: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, morning, evening): in rank order an item goes to the evening if an item of the morning conflicts with it.

    A user's list is small, so it is folded as an array.
    """
    conflicts = pair_hits(recommended, pairs.where("kind = 'antagonism' and mode <> 'monitor'"))
    against = conflicts.select("user", F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("other")), F.struct(F.col("b").alias("item"), F.col("a").alias("other")))).alias("c")).select("user", "c.*").groupBy("user", "item").agg(F.collect_set("other").alias("others"))
    rows = recommended.join(against, ["user", "item"], "left").select("user", F.struct("rank", "item", F.coalesce("others", F.array().cast("array<string>")).alias("others")).alias("r"))
    lists = rows.groupBy("user").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    none = F.array().cast("array<string>")

    def place(acc: Column, r: Column) -> Column:
        clash = F.arrays_overlap(acc["morning"], r["others"])
        return F.struct(F.when(clash, acc["morning"]).otherwise(F.array_append(acc["morning"], r["item"])).alias("morning"), F.when(clash, F.array_append(acc["evening"], r["item"])).otherwise(acc["evening"]).alias("evening"))

    return lists.select("user", F.aggregate("rs", F.struct(none.alias("morning"), none.alias("evening")), place).alias("s")).select("user", "s.*")


def notes(recommended: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, note) for each rule pair in a result."""
    text = F.when(F.col("kind") == "synergy", F.concat_ws(" ", "a", F.lit("goes with"), "b")).when(F.col("mode") == "monitor", F.concat_ws(" ", F.lit("watch"), "a", F.lit("and"), "b")).otherwise(F.concat_ws(" ", F.lit("separate"), "a", F.lit("and"), "b"))
    return pair_hits(recommended, pairs).select("user", text.alias("note"))


def nearest(place: list[Column], palette: list[tuple]) -> Column:
    """The name of the palette entry (name, coordinates...) with the least squared distance; of equal ones the first. The palette is a literal."""
    far = [F.struct(sum(((c - x) * (c - x) for c, x in zip(place, at, strict=True)), F.lit(0)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, *at) in enumerate(palette)]
    return F.array_min(F.array(*far))["name"]


def with_catalogue(rows: DataFrame, types: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows with the name and URL of the catalogue that their type leads to; without one the type is the label. types: type, source; catalogue: source, name, url."""
    known = rows.join(small(types), "type", "left").join(small(catalogue), "source", "left")
    return known.withColumn("label", F.coalesce("name", "type"))


#: Ranks of the strength of evidence, and what stands for no dose.
STRENGTH = {"established": 3, "moderate": 2, "limited": 1, "insufficient": 0}
UNSET = "출처 미확인"


def top_benefit(benefits: Column) -> Column:
    """The benefit (name, strength) with the strongest evidence; of equal ones the first."""
    ranks = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    rank = lambda b: F.coalesce(F.try_element_at(ranks, b["strength"]), F.lit(0))
    placed = F.transform(benefits, lambda b, i: F.struct((-rank(b)).alias("rank"), i.alias("i"), b.alias("b")))
    return F.array_min(placed)["b"]


def lifestyle_notes(habits: Column, notes: dict[str, str]) -> Column:
    """Notes on those habits that are set and not ``none``."""
    has = lambda h: ~F.coalesce(F.try_element_at(habits, F.lit(h)), F.lit("")).isin("", "none")
    return F.array_compact(F.array(*[F.when(has(h), F.lit(note)) for h, note in notes.items()]))


def dose_line(daily: Column, most: Column) -> Column:
    """Daily amount and upper limit, those that are set; ``unset`` if neither is."""
    real = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", UNSET), c)
    line = F.concat_ws(" · ", F.concat(F.lit("daily "), real(daily)), F.concat(F.lit("most "), real(most)))
    return F.when(line == "", F.lit("unset")).otherwise(line)


def conflicts_with(item: Column, taken: Column, conflicts: dict[str, list[str]]) -> Column:
    """What of the taken items a fixed list says an item must not meet."""
    known = F.create_map(*[x for k, v in conflicts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_intersect(taken, F.coalesce(F.try_element_at(known, item), F.array().cast("array<string>")))
