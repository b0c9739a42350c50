"""URL filters: a sort-merge range join of urls with host and path rules.

A host is turned round (``blog.example.net`` becomes ``net.example.blog.``), so
that the subdomains of a rule's host are exactly the keys in the interval from
the rule's key to that key with its last dot raised. Intervals are nested or
disjoint. A sweep over intervals and urls in the order of the keys keeps the
stack of rule hosts whose interval is open; the boundaries of the intervals
carry the stack that holds from there on, at most one host a label, and each url
takes the one of the boundary before it. The paths of one rule host are
intervals too (from the path to the path and a byte that no text has), so a
second sweep, over (rule host, path), finds for a url and each of its open hosts
the innermost path rule, which is the longest. Of these the longest wins (host
and path together, then the longer host, then block).

A sweep is one range-partitioned sort of urls and boundaries together. What is
open at the end of a partition is handed on to the next ones: one row for each
partition. So a boundary exists once, no domain is a key, and equal urls
spread over partitions. Only page_id, host and path are sorted; the pages' text
is not read.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
fits no rule and gets the default verdict; hosts are compared in lower case,
paths exactly; urls of any length are read whole; equal urls get equal
verdicts, and rows with null or repeated page_ids are each judged; without rules
all get the default; rules with a null or empty host are left out, a null path
fits every path, and of rules that differ in the verdict only block wins; extra
columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import materialize

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty if it has no scheme."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ordered_rules(rules: DataFrame) -> DataFrame:
    """(lo, path, rule): the reversed host, the path, and a struct in whose order rules win."""
    r = rules.where("host is not null and host <> ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), F.concat("host", "path").alias("rule"), "verdict")
    return r.select(reversed_key(F.col("host")).alias("lo"), "path", rule.alias("rule")).groupBy("lo", "path").agg(F.max("rule").alias("rule"))


def host_boundaries(hosts: DataFrame) -> DataFrame:
    """(key, stack) of rule hosts (lo): from ``key`` on, the hosts of ``stack`` are open, until the next boundary."""
    labels = F.split(F.col("lo"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))
    nested = hosts.select("lo", F.explode(prefixes).alias("outer")).join(hosts.select(F.col("lo").alias("outer")), "outer")
    open_ = nested.groupBy("lo").agg(F.collect_list("outer").alias("stack"))
    ends = open_.select(F.expr("concat(substring(lo, 1, length(lo) - 1), '/')").alias("key"), F.filter("stack", lambda h: h != F.col("lo")).alias("stack"))
    return open_.select(F.col("lo").alias("key"), "stack").unionByName(ends)


def path_boundaries(rules: DataFrame) -> DataFrame:
    """(lo, at, held) of rules (lo, path, rule): from ``at`` on, the rule in ``held`` is the innermost one, until the next boundary (null: none is open)."""
    shorter = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda k: F.substring("path", F.lit(1), k))
    around = rules.where("path <> ''").select("lo", "path", F.explode(shorter).alias("outer")).join(rules.select("lo", F.col("path").alias("outer"), F.col("rule").alias("outer_rule")), ["lo", "outer"])
    parent = around.groupBy("lo", "path").agg(F.max_by("outer_rule", F.length("outer")).alias("parent"))
    start = F.col("path").cast("binary")
    starts = rules.select("lo", start.alias("at"), F.struct("rule").alias("held"))
    ends = rules.join(parent, ["lo", "path"], "left").select("lo", F.concat(start, F.unhex(F.lit("FF"))).alias("at"), F.struct(F.col("parent").alias("rule")).alias("held"))
    return starts.unionByName(ends)


def sweep(events: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``events`` with ``out``: the last ``value`` that is not null, in the row itself or before it in the order."""
    placed = materialize(events.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = placed.groupBy("_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_m"))).alias("_end"))
    # one row a partition
    handed = ends.select("_p", F.last("_end", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_handed"))
    return placed.withColumn("_here", here).join(F.broadcast(handed), "_p").withColumn(out, F.coalesce("_here", "_handed")).drop("_p", "_m", "_here", "_handed")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host and path of the deciding rule, else null), verdict."""
    host, path = host_and_path(F.col(url))
    ordered = materialize(_ordered_rules(rules))
    urls = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")).withColumn("key", reversed_key(F.col("host")))
    stops = host_boundaries(ordered.select("lo").distinct()).withColumn("event", F.lit(0))
    events = urls.withColumn("event", F.lit(1)).unionByName(stops, allowMissingColumns=True)
    open_ = materialize(sweep(events, ["key", "event", "row"], "stack", "open").where("event = 1").select("page_id", "host", "path", "row", "open"))

    asked = open_.select("page_id", "host", "path", "row", F.explode("open").alias("lo")).withColumn("at", F.col("path").cast("binary"))
    stops = path_boundaries(ordered).withColumn("event", F.lit(0))
    events = asked.withColumn("event", F.lit(1)).unionByName(stops, allowMissingColumns=True)
    found = sweep(events, ["lo", "at", "event", "row"], "held", "inner").where("event = 1")
    best = found.groupBy("page_id", "host", "path", "row").agg(F.max("inner.rule").alias("won"))
    free = open_.where(F.coalesce(F.size("open"), F.lit(0)) <= 0).select("page_id", "host", "path", "row", F.lit(None).cast(best.schema["won"].dataType).alias("won"))
    return best.unionByName(free).select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)
