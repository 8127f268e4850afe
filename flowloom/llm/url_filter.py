"""URL filters: a path-template tree per host, judged by smoothed purity of labelled urls.

Each host's paths form a tree of segments, which is collapsed from the top, level by level: below each node variable
segments become wildcards and branches whose labels differ no more than chance are merged, so that what lies below a
wildcard is pooled before the next level is looked at. A template is rejected if the share of blocked urls among its
labelled ones, smoothed by its parent's up to the host's and that of all, is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import drop, written

#: Rules (host, path, verdict); the longest that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
WILD = "*"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one string) and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segment_class(segment: Column) -> Column:
    """A segment, or the class of a variable one: digits are n, with an ending kept; hex strings are x; long ones are w."""
    return (
        F.when(segment.rlike(r"^[0-9]++$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]++\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{x}"))
        .when((F.length(segment) > 32) | segment.rlike("[0-9]{3}"), F.lit("{w}"))
        .otherwise(segment)
    )


def g_test(blocked: Column, marked: Column, blocked_2: Column, marked_2: Column) -> Column:
    """The G statistic of two shares of blocked among labelled urls; 0 where one has no labels."""
    total, share = marked + marked_2, (blocked + blocked_2) / F.greatest(F.lit(1), marked + marked_2)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    parts = [term(b, m * share) + term(m - b, m * (1 - share)) for b, m in ((blocked, marked), (blocked_2, marked_2))]
    return F.when((marked > 0) & (marked_2 > 0) & (total > 0), 2 * (parts[0] + parts[1])).otherwise(0.0)


def templates(leaves: DataFrame, variety: float, least: int, cut: float, prior: float, levels: int) -> DataFrame:
    """(host, path, template, purity) of distinct urls (host, path, n, marked, blocked); see ``judge``.

    Joins keep the rows of their left side, so that only their right one, of hosts, nodes or names, may be broadcast.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "marked", "blocked")]
    every = leaves.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("marked", "blocked")]).first()  # one row
    base = (every["blocked"] + 0.5) / (every["marked"] + 1)
    smoothed = lambda above: (F.col("all_blocked") + prior * above) / (F.col("all_marked") + prior)
    segments = F.transform(F.split(F.regexp_replace("path", "^/+", ""), "/"), segment_class)
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("all_n"), F.sum("marked").alias("all_marked"), F.sum("blocked").alias("all_blocked"))
    rows = leaves.join(written(hosts, "hosts"), "host", "left").select("host", "path", "n", "marked", "blocked", segments.alias("left"), F.lit("").alias("template"), smoothed(F.lit(base)).alias("purity"), F.col("all_n").alias("pages"))
    live, done = written(rows, "tree"), []
    for level in range(levels + 1):
        # of nodes with few pages, and from the last level on, the rest of the path is named by its classes
        ended = (F.size("left") == 0) | (F.col("pages") < least) | F.lit(level == levels)
        rest = F.when(F.size("left") > 0, F.concat(F.lit("/"), F.array_join("left", "/"))).otherwise("")
        done.append(live.where(ended).select("host", "path", F.concat("template", rest).alias("template"), "purity"))
        going = live.where(~ended)
        if going.isEmpty():
            break
        node = ["host", "template"]
        child = going.withColumn("segment", F.col("left")[0]).groupBy(*node, "segment").agg(*sums)
        about = child.groupBy(*node).agg(F.count_if(~F.col("segment").startswith("{")).alias("children"), F.sum(F.when(~F.col("segment").startswith("{"), F.col("n"))).alias("own"), F.sum("marked").alias("node_marked"), F.sum("blocked").alias("node_blocked"))
        many = (F.col("children") >= least) & (F.col("children") > variety * F.col("own"))
        alike = g_test(F.col("blocked"), F.col("marked"), F.col("node_blocked") - F.col("blocked"), F.col("node_marked") - F.col("marked")) < cut
        merged = (F.col("children") > 1) & alike & ((F.col("n") < least) | (F.col("marked") > 0))
        name = F.when(F.col("segment").startswith("{"), F.col("segment")).when(many | merged, WILD).otherwise(F.col("segment"))
        named = child.join(about, node, "left").select(*node, "segment", name.alias("name"), "n", "marked", "blocked")
        after = named.groupBy(*node, "name").agg(F.sum("n").alias("all_n"), F.sum("marked").alias("all_marked"), F.sum("blocked").alias("all_blocked"))
        names = named.select(*node, "segment", "name").join(after, [*node, "name"], "left")
        moved = going.withColumn("segment", F.col("left")[0]).join(names, [*node, "segment"], "left")
        below = moved.select("host", "path", "n", "marked", "blocked", F.slice("left", F.lit(2), F.greatest(F.lit(1), F.size("left") - 1)).alias("left"), F.concat("template", F.lit("/"), "name").alias("template"), smoothed(F.col("purity")).alias("purity"), F.col("all_n").alias("pages"))
        before, live = live, written(below, "tree")
        done[-1] = written(done[-1], "templates")
        drop(before)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, rules=RULES, variety: float = 0.5, least: int = 8, cut: float = 3.84, prior: float = 4.0, reject: float = 0.5, levels: int = 32, salts: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (smoothed share of blocked) of every page.

    Urls that a rule fits are the labels. Below a node, a segment of a variable class becomes that class. Other segments
    become one wildcard if the node has at least ``least`` of them, more than ``variety`` a page; else those become it
    whose share of blocked labels differs from their siblings' by no more than chance (a G statistic below ``cut``) and
    that are rare (under ``least`` pages) or labelled. Below nodes of under ``least`` pages, and ``levels`` segments deep,
    segments only become their classes; no segment is left out. A node's share is smoothed with ``prior`` urls of its
    parent's share, a host's with that of all labels, which starts from one half of one label; urls whose template's share
    is above ``reject`` are blocked. Without any label all shares are one half, and urls are allowed.
    Null urls and urls without :// have empty host and path, no rule, and are judged as the host "" is. Repeated rows
    give repeated rows; an empty table gives an empty one; other columns are left out.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = written(urls.withColumns({"rule": rule, "said": verdict}), "urls")
    leaves = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("said").alias("marked"), F.count_if(F.col("said") == "block").alias("blocked"))
    of_path = templates(written(leaves, "paths"), variety, least, cut, prior, levels)
    # a very common url is spread over its salts; the table of urls is never broadcast, however small its files are
    of_path = of_path.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    out = urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(of_path.hint("merge"), ["host", "path", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") > reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")
