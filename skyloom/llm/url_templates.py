"""URL filters by path templates, in DataFrame expressions only.

A host's paths make a tree of segments, which is worked down level by level.  Segments that look like numbers become
wildcards at once; where a node has many children and none prevails, its children do.  Then branches of the node whose
labelled rates do not differ significantly from the node's are merged into one wildcard branch, and what was below them
is one subtree.  A template is what is left of a path; it is rejected if its labelled examples are bad almost purely.

A template's purity is smoothed twice: a host's own examples towards the vote of all hosts that have labelled examples
of the same template, one vote a host, and that vote towards a prior.  So a template of a host without labels is judged
by what the template is elsewhere, and no host, however large, outvotes the others.

All statistics are kept on distinct (host, path shape) rows with counts, not on pages; look-ups from pages are salted,
since one host may hold a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path: a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
NUMBER = "^[0-9]+([.][A-Za-z]+)?$"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or where no :// stands."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, nulls if none does; ties: the first by text."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Left join on keys of which one may hold most rows: the table is repeated under each salt."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "salt"], "left").drop("salt")


def path_templates(shapes: DataFrame, *, many: int = 8, prevail: float = 0.5, z: float = 1.96, least: int = 5) -> DataFrame:
    """shapes: host, cells (segments), n, good, bad.  Adds t, the template's segments.

    A node with more than ``many`` children, none of them holding more than ``prevail`` of its pages, makes its children
    '*'.  Then a child with ``least`` labels or more whose bad rate is within z standard errors of its node's becomes
    '*' as well.  Level by level, as deep as the paths go; shapes that have a node of their own are done, as nothing can
    vary or merge there.
    """
    node, child, salt = ["host", "node"], F.col("child"), F.col("cells")
    rate = F.try_divide(F.col("all_bad"), F.col("all_bad") + F.col("all_good"))
    own = F.col("good") + F.col("bad")
    near = F.abs(F.try_divide(F.col("bad"), own) - rate) <= z * F.sqrt(F.try_divide(rate * (1 - rate), own))
    # The end of a path is an empty child, and stays one.
    starred = F.when(F.col("star") & (child != ""), "*").otherwise(child)
    at, done, level = shapes.withColumn("t", F.col("cells")), [], 0
    while True:
        at = at.withColumns({"node": F.slice("t", 1, level), "child": F.coalesce(F.get("t", F.lit(level)), F.lit(""))})
        varied = (
            at.where(child != "")
            .groupBy(*node, "child")
            .agg(F.sum("n").alias("n"))
            .groupBy(*node)
            .agg(F.count("*").alias("kinds"), F.max("n").alias("top"), F.sum("n").alias("all"))
            .where((F.col("kinds") > many) & (F.col("top") <= prevail * F.col("all")))
            .select(*node, F.lit(True).alias("star"))
        )
        at = salted_join(at, varied, node, salt).withColumn("child", starred).drop("star")
        of = at.groupBy(*node, "child").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        whole = of.groupBy(*node).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("kinds"))
        alike = (
            salted_join(of.where((own >= least) & (child != "")), whole.where("kinds > 1 AND all_good + all_bad > 0"), node, child)
            .where(near)
            .select(*node, "child", F.lit(True).alias("star"))
        )
        at = salted_join(at, alike, [*node, "child"], salt).withColumn("child", starred)
        ahead = F.concat("node", F.array("child"))
        after = F.slice("t", level + 2, F.greatest(F.size("t") - level - 1, F.lit(0)))
        at = at.withColumn("t", F.when(F.size("t") > level, F.concat(ahead, after)).otherwise(F.col("t"))).select("host", "cells", "n", "good", "bad", "t")
        level += 1
        shared = at.where(F.size("t") >= level).groupBy("host", F.slice("t", 1, level).alias("node")).agg(F.count("*").alias("shapes")).where("shapes > 1")
        next_node = F.when(F.size("t") >= level, F.slice("t", 1, level))
        at = salted_join(at.withColumn("node", next_node), shared, node, salt).withColumn("open", F.col("shapes").isNotNull()).drop("shapes", "node")
        at = materialise(at, "tree")
        done.append(at.where("NOT open").drop("open"))
        at = at.where("open").drop("open")
        if at.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    *,
    prior_bad: float = 0.25,
    weight: float = 4.0,
    votes: float = 2.0,
    reject: float = 0.8,
    **shape: float,
) -> DataFrame:
    """Judge every url by the longest rule that fits, else by its path's template.

    The urls that rules fit are the labelled examples of their templates.  A template's vote over the hosts is (sum of
    the bad rates of the hosts with examples of it + ``votes`` * prior_bad) / (such hosts + ``votes``); its bad rate on
    a host is (bad + weight * vote) / (labelled + weight).  Over ``reject``, its urls without a rule are blocked.

    Returns page_id, host, path, rule, verdict, template, bad_rate.  Null urls and urls without :// have an empty host
    and path and are judged like any other; urls are taken whole, however long.  The tree is as deep as paths have
    segments in common; slashes at a path's end make no segments.  Of rules of equal length that fit, the first by text decides.  Null ids and repeated
    rows stay row by row; an empty table gives an empty result.  Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(pages["url"].cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    body = F.rtrim(F.substring("path", 2, 1_000_000_000), F.lit("/"))
    cells = F.when(body != "", F.split(body, "/", -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"rule": rule, "said": said, "cells": F.transform(cells, lambda s: F.when(s.rlike(NUMBER), "*").otherwise(s))})
    shapes = materialise(rows.groupBy("host", "cells").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")
    ), "shapes")
    tree = materialise(path_templates(shapes, **shape), "templates")
    purity = tree.groupBy("host", "t").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    own = F.col("good") + F.col("bad")
    elsewhere = purity.where(own > 0).groupBy("t").agg(
        ((F.sum(F.try_divide(F.col("bad"), own)) + votes * prior_bad) / (F.count("*") + votes)).alias("vote")
    )
    vote = F.coalesce("vote", F.lit(prior_bad))
    rated = salted_join(purity, elsewhere, ["t"], F.col("host")).select("host", "t", ((F.col("bad") + weight * vote) / (own + weight)).alias("bad_rate"))
    judged = salted_join(tree.select("host", "cells", "t"), rated, ["host", "t"], F.col("cells")).select(
        "host", "cells", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "bad_rate"
    )
    out = salted_join(rows, materialise(judged, "judged"), ["host", "cells"], F.col("page_id"))
    verdict = F.coalesce("said", F.when(F.col("bad_rate") > reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_rate")
