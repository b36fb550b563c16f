"""URL filters by dated lists.

A list entry says that from a day on a host, a domain with all below it, or a path and all below it is on a list, or no
longer is. Entries become validity intervals: sorted by day, an entry holds until the next one on the same list and key.
A capture is evaluated against the entries active on the day it was fetched: an as-of join on its candidate keys, which
are its host, the domains above it, and its path with all paths above. A list of exceptions outweighs the others.

Nothing grows with the captures of a key: host and domain keys are joined once for each host and day, paths once for
each path and day, and only on hosts that have path entries at all. A key has one interval for each day at most, since
entries of a day are folded first; removal outweighs addition on the same day.

Edge cases: a NULL or malformed URL has no host and is on no list, and neither is a capture without a day; entries
without list, key, action or day are ignored; repeated captures each get their verdict; without entries nothing is on a
list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.common import fresh

KINDS = ("host", "domain", "path")
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def path_of(url: Column) -> Column:
    """The path without query, fragment and final slashes."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, valid_from and valid_to (exclusive, NULL if open) of what ``entries`` put on lists.

    ``entries`` has list, kind, key, action ('add' or 'remove') and day.
    """
    whole = entries.where(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull()).where(
        F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")
    )
    folded = whole.groupBy("list", "kind", F.lower("key").alias("key"), F.col("day").cast("date").alias("valid_from")).agg(
        F.min(F.col("action") == "add").alias("on")
    )
    by_key = Window.partitionBy("list", "kind", "key").orderBy("valid_from")
    return folded.withColumn("valid_to", F.lead("valid_from").over(by_key)).where("on").drop("on")


def as_of(keys: DataFrame, valid: DataFrame, group: list[str]) -> DataFrame:
    """The lists that any key of ``group`` is on at its day, as a sorted array; groups on no list are left out."""
    v = valid.select(*(F.col(c).alias(f"_{c}") for c in ("list", "kind", "key", "valid_from", "valid_to")))
    open_ended = F.coalesce(F.col("_valid_to"), F.lit("9999-12-31").cast("date"))
    active = (F.col("_valid_from") <= F.col("_day")) & (F.col("_day") < open_ended)
    met = keys.join(v, (F.col("_at_kind") == F.col("_kind")) & (F.col("_at_key") == F.col("_key")) & active)
    return met.groupBy(*group).agg(F.sort_array(F.collect_set("_list")).alias("_lists"))


def on_lists(
    captures: DataFrame, entries: DataFrame, url: str, day: str, exceptions: tuple[str, ...] = ("allow",)
) -> DataFrame:
    """``captures`` with ``host``, ``lists`` (the sorted names of the lists it was on that day) and ``blocked``."""
    valid = intervals(entries)
    whole = F.struct(*(captures[c] for c in captures.columns)).alias("_row")  # apart from names used here
    work = captures.select(
        whole,
        host_of(captures[url]).alias("_host"),
        F.lower(path_of(captures[url])).alias("_path"),
        captures[day].cast("date").alias("_day"),
    )
    known = work.where("_host <> '' and _day is not null").select("_host", "_path", "_day")

    labels = F.split("_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    candidates = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("key"))),
        F.transform(above, lambda name: F.struct(F.lit("domain").alias("kind"), name.alias("key"))),
    )
    hosts = known.select("_host", "_day").distinct().withColumn("_at", F.explode(candidates))
    hosts = hosts.select("_host", "_day", F.col("_at.kind").alias("_at_kind"), F.col("_at.key").alias("_at_key"))
    by_host = as_of(hosts, valid.where("kind <> 'path'"), ["_host", "_day"])

    paths = valid.where("kind = 'path'")
    with_paths = paths.select(F.substring_index("key", "/", 1).alias("_host")).distinct()
    steps = F.split("_path", "/")
    up_to = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat("_host", F.concat_ws("/", F.slice(steps, 1, i)))
    )
    # A host may hold a third of all captures: its captures are dealt over several salts, its name stands under each.
    salt = F.pmod(F.xxhash64("_path", "_day"), F.lit(SALTS).cast("bigint"))
    salted = with_paths.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    on_path_hosts = known.withColumn("_salt", salt).join(salted, ["_host", "_salt"], "left_semi").drop("_salt")
    places = on_path_hosts.distinct().withColumn("_at_key", F.explode(up_to))
    by_path = as_of(places.withColumn("_at_kind", F.lit("path")), paths, ["_host", "_path", "_day"])

    found = work.join(by_host.withColumnRenamed("_lists", "_by_host"), ["_host", "_day"], "left")
    found = found.join(by_path.withColumnRenamed("_lists", "_by_path"), ["_host", "_path", "_day"], "left")
    empty = F.array().cast("array<string>")
    lists = F.sort_array(F.array_union(F.coalesce("_by_host", empty), F.coalesce("_by_path", empty)))
    excepted = F.arrays_overlap(lists, F.array(*map(F.lit, exceptions)).cast("array<string>"))
    names = {new: fresh(new, captures) for new in ("host", "lists", "blocked")}
    return found.select(
        "_row.*",
        F.col("_host").alias(names["host"]),
        lists.alias(names["lists"]),
        ((F.size(lists) > 0) & ~excepted).alias(names["blocked"]),
    )


def keep_allowed(
    captures: DataFrame, entries: DataFrame, url: str, day: str, exceptions: tuple[str, ...] = ("allow",)
) -> DataFrame:
    """The rows of ``captures`` that were on no list, or excepted, on their day."""
    judged = on_lists(captures, entries, url, day, exceptions)
    return judged.where(~F.col(judged.columns[-1])).select(*captures.columns)
