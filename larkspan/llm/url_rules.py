"""URL filters as a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels reversed, each with a dot after it, so a rule for a host covers exactly the keys
from its own key up to that key with the last dot raised by one: an interval, and intervals of rules nest or are
disjoint.  Rule starts and the distinct hosts of the pages are sorted together and swept: the stack of nested rules that
is active at a rule's start is known from its own host's prefixes, so the last rule start at or before a host gives the
host's stack once entries that have ended are taken off.  The sweep runs in key ranges, each taking over the last rule
start of the ranges before it.  Pages then meet their host's stack, and the longest rule whose path fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Verdict where no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host the rules of it and of the hosts above it."""
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select("host", "path", "verdict").distinct()
    listed = listed.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
    end = F.concat(F.expr("substring(key, 1, char_length(key) - 1)"), F.lit("/"))
    listed = listed.withColumn("entry", F.struct(end.alias("end"), F.concat("host", "path").alias("rule"), "path", "verdict"))
    labels = F.split(F.expr("substring(key, 1, char_length(key) - 1)"), "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    below = listed.select("key").distinct().select("key", F.explode(above).alias("at"))
    return below.join(listed.select(F.col("key").alias("at"), "entry"), "at").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack) of the distinct ``hosts`` under at least one rule."""
    starts = _rule_stacks(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"))
    points = materialise(starts.union(points).repartitionByRange("key").withColumn("range", F.spark_partition_id()), "url-points")
    ends = points.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("last"))
    ends = points.groupBy("range").agg(F.count(F.lit(1)).alias("n")).join(ends, "range", "left")
    before = F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("range", before.alias("carried"))
    inside = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = points.withColumn("inside", inside).where("kind = 1").join(carried, "range")
    active = F.filter(F.coalesce("inside", "carried"), lambda e: F.col("key") < e["end"])
    return swept.select("host", active.alias("stack")).where("size(stack) > 0")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of every page row.

    ``rules`` has host, path (from the slash on; empty fits every path) and verdict; rules with a null are ignored.  Of
    rules that fit, the one with the longest host and path wins, ties by verdict, so ``block`` before ``allow`` never
    depends on order.  A null url, or one without ``://``, has an empty host and path and gets the default verdict.
    Repeated pages give repeated rows; extra columns are ignored; empty tables give empty or default results.
    """
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    stacks = materialise(host_stacks(parts.select("host").distinct(), rules), "url-stacks")
    fits = F.filter("stack", lambda e: F.startswith(F.col("path"), e["path"]))
    order = F.transform(fits, lambda e: F.struct(F.char_length(e["rule"]).alias("n"), e["verdict"].alias("verdict"), e["rule"].alias("rule")))
    best = F.array_max(order)
    joined = parts.join(stacks, "host", "left").withColumn("best", best)
    return joined.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
