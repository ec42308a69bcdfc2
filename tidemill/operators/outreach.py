"""Contacts: validation, normal form, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import contact_id, trimmed

#: States and kinds of a contact, and states that end or secure it.
STATUSES = ("lead", "contacted", "replied", "published", "maintained", "declined", "archived")
TYPES = ("guestpost", "pr", "partnership", "interview", "resource", "directory")
TERMINAL, ACQUIRED = ("declined", "archived"), ("published", "maintained")


def is_http_url(c: Column) -> Column:
    """Nothing, or an absolute URL of http or https with a host."""
    return (F.coalesce(c, F.lit("")) == "") | F.coalesce(c, F.lit("")).rlike(r"(?i)^\s*https?:/*[^/?#\s]")


def contact_errors(name: Column, kind: Column, status: Column, site: Column, next_at: Column) -> Column:
    """Names of all fields that are wrong, in order: name is needed, the others may be empty."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(
        F.array(
            F.when(trimmed(F.coalesce(name, F.lit(""))) == "", F.lit("name")),
            F.when(given(kind) & ~kind.isin(*TYPES), F.lit("type")),
            F.when(given(status) & ~status.isin(*STATUSES), F.lit("status")),
            F.when(~is_http_url(site), F.lit("site")),
            F.when(given(next_at) & ~next_at.rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit("nextAt")),
        )
    )


def normal_contacts(contacts: DataFrame, at: str) -> DataFrame:
    """Valid contacts with defaults: id, name, type, status, site, next_at. ``contacts``: id, name, type, status, site, next_at."""
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    valid = contacts.where(F.size(contact_errors(*[F.col(c) for c in ("name", "type", "status", "site", "next_at")])) == 0)
    name = trimmed("name")
    return valid.select(F.coalesce(F.nullif(F.col("id"), F.lit("")), contact_id(name, F.lit(at))).alias("id"), name.alias("name"), filled("type", "guestpost").alias("type"), filled("status", "lead").alias("status"), filled("site", "").alias("site"), F.left(filled("next_at", ""), F.lit(10)).alias("next_at"))


def summary(contacts: DataFrame) -> DataFrame:
    """One row: total, active (not ended), acquired, and a count for each state and kind; other values count in the total only."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    ended = F.count_if(F.col("status").isin(*TERMINAL))
    return contacts.agg(F.count("*").alias("total"), (F.count("*") - ended).alias("active"), F.count_if(F.col("status").isin(*ACQUIRED)).alias("acquired"), *[n("status", s).alias(s) for s in STATUSES], *[n("type", t).alias(t) for t in TYPES])
