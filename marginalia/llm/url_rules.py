"""Longest-match URL rules by a sort-merge sweep over nested key intervals, in DataFrame operations only.

A host's labels are reversed ("m.example.net" -> "net.example.m."), so a rule's host and all its subdomains are one
interval of keys, and a path prefix is an interval of paths. Rules open and close intervals; points (hosts, then paths)
lie between. One sort puts openings, points and closings in order; a running sum gives the number of open rules and a
running "last opened at depth k" for each k is the stack. Nested intervals close in the reverse order of opening, so
the first ``depth`` slots are the rules that hold at a point.

Two sweeps: distinct hosts against rule hosts, then (rule host, path) against that host's path prefixes. Hosts are
counted before anything moves, so a hot host is one row in the first sweep. Points of a hot group are dealt over as
many salts as they need, and only that group's rules are copied to each salt; rows are dealt out by group and salt, as
otherwise a join on the group before would have left all salts of a group in one task. What grows with the pages is
merge-joined, also where its compressed files look small; only what the rules bound may be broadcast.

Defined results: a url that is null or has no "://" has an empty host and path and gets the default verdict; so does
a host that no rule covers. Rules that are null in host, path or verdict are ignored; of rules with the same host and
path, "block" wins. "Longest" is the length of host plus path; of equal lengths, the longer host. Every input row gives one row,
repeated rows too; an empty table gives an empty one. Extra columns are kept if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free, settle

#: A group's points are split so that one task sorts about this many of them.
POINTS_A_GROUP = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no "://"."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


def _sweep(points: DataFrame, rules: DataFrame, keep: list[str], per_group: int) -> DataFrame:
    """points (group, key, *keep) and rules (group, key, rule), key as bytes -> *keep and stack, an array of the rules that hold, outermost first. Points without any are left out."""
    groups = rules.select("group").distinct()
    near = points.join(groups, "group", "left_semi")
    ways = near.groupBy("group").agg(F.ceil(F.count("*") / F.lit(per_group)).cast("int").alias("ways"))
    opened = rules.join(ways, "group").select("group", F.explode(F.expr("sequence(0, ways - 1)")).alias("salt"), "key", "rule")
    spaced = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep]
    blank = F.lit(None).cast(rules.schema["rule"].dataType).alias("rule")
    closing = F.concat("key", F.lit(b"\xff")).alias("key")
    kind, step = "kind", "step"
    starts = opened.select("group", "salt", "key", F.lit(0).alias(kind), F.lit(1).alias(step), "rule", *spaced)
    ends = opened.select("group", "salt", closing, F.lit(2).alias(kind), F.lit(-1).alias(step), blank, *spaced)
    salt = F.pmod(F.xxhash64(*keep), F.col("ways")).cast("int").alias("salt")
    dealt = near.join(ways, "group").select("group", salt, "key", F.lit(1).alias(kind), F.lit(0).alias(step), blank, *keep)

    alone = rules.select("group", "key", F.lit(0).alias(kind), F.lit(1).alias(step))
    alone = alone.unionByName(rules.select("group", closing, F.lit(2).alias(kind), F.lit(-1).alias(step)))
    nested = Window.partitionBy("group").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deepest = alone.withColumn("depth", F.sum("step").over(nested)).agg(F.max("depth")).first()[0] or 1

    running = Window.partitionBy("group", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = starts.unionByName(ends).unionByName(dealt).repartition("group", "salt").withColumn("depth", F.sum("step").over(running))
    opening = lambda k: F.when((F.col("kind") == 0) & (F.col("depth") == k), F.col("rule"))
    slots = [F.last(opening(k), ignorenulls=True).over(running) for k in range(1, deepest + 1)]
    at = at.withColumn("stack", F.array(*slots)).where("kind = 1 AND depth > 0")
    return at.select(*keep, F.expr("slice(stack, 1, int(depth))").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", per_group: int = POINTS_A_GROUP) -> DataFrame:
    """*keep, host, path, rule (host and path of the longest that fits, or null), verdict. ``rules``: host, path, verdict."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("host_key", host_key(F.col("host")))
    host, path = split_url(F.col(url_col))
    rows = pages.select(*[F.col(c).alias(f"k_{c}") for c in keep], host.alias("host"), path.alias("path"))
    urls = settle(rows.where("host != ''").groupBy("host", "path").agg(F.count("*").alias("n")), "urls")

    def of(key: Column) -> Column:
        """The first two labels of a reversed host; rules for a single label are swept with all hosts under it."""
        return F.substring_index(key.cast("string"), ".", 2)

    wide = F.length(F.regexp_replace(F.col("host"), r"[^.]", "")) == 0
    rule_hosts = rules.select("host", F.col("host_key").alias("key")).distinct()
    rule_hosts = rule_hosts.select(F.when(wide, F.concat(F.substring_index(F.col("key").cast("string"), ".", 1), F.lit("."))).otherwise(of(F.col("key"))).alias("group"), "key", F.col("host").alias("rule"))
    hosts = urls.groupBy("host").agg(F.count("*").alias("paths")).withColumn("key", host_key(F.col("host")))
    first = F.concat(F.substring_index(F.col("key").cast("string"), ".", 1), F.lit("."))
    hosts = settle(hosts.select("host", "key", F.explode(F.array(first, of(F.col("key")))).alias("group")).distinct(), "hosts")
    held = settle(_sweep(hosts, rule_hosts, ["host"], per_group).select("host", F.explode("stack").alias("group")), "held")
    probes = settle(urls.join(held.hint("merge"), "host").select("group", F.col("path").cast("binary").alias("key"), "host", "path"), "probes")
    size = F.length(F.concat("host", "path")).alias("size")
    rule = F.struct(size, F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("rule")
    prefixes = rules.select(F.col("host").alias("group"), F.col("path").cast("binary").alias("key"), rule)
    won = _sweep(probes, prefixes, ["host", "path"], per_group).groupBy("host", "path").agg(F.max(F.element_at("stack", -1)).alias("won"))
    won = settle(won, "won")
    free(urls, hosts, held, probes)
    out = rows.join(won.hint("merge"), ["host", "path"], "left")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
