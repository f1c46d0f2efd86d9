"""Operator 3: URL filter by a tree of path templates for each host.

A url's host and path are cut by position. Segments of a path that vary by
their form (numbers, numbers with a suffix, hexadecimal ids, long slugs) are
generalised where they stand, which leaves fewer different paths; these are
counted once with their labels. Then the tree grows from the root, one branching
at a time: what all paths below a node have in common is passed over, and the
children at the first segment that differs are tested against each other.

Each child's rate of bad labels is compared with that of all its siblings in its
group (at first all of them), by the difference of two shares with a pooled
error. Children that differ by more than Z errors leave the group, for one of
better or one of worse branches, and the test is repeated within each new group
until no child differs. Children with fewer than LEAST_LABELS labels, or too few
beside them, can't be told apart and stay. Then children of one group with
enough labels are similar, and merge into one branch: ``*``, with a + or - for
each time the group was found worse or better than its siblings. A child alone
in its group keeps its name. Children with too few labels keep theirs, too,
unless their level varies: if it has fewer than VARIES pages a child, they go
into its ``*``, as what differs from page to page. Below a merged branch, the
subtrees of its children are one.

A template is rejected if its share of bad labels, smoothed by the share over
all labels with a weight of PRIOR labels, reaches REJECT.

Rules (block or allow, for a host with its subdomains and a beginning of the
path) come before the tree; the longest rule that fits wins.

Null urls and urls without ``://`` have an empty host and path and are judged
like any other. Null ids and repeated rows are judged each by itself; labels that
repeat an id are averaged. Without labels nothing is rejected by the tree. Very
long urls are read whole, and no depth is cut off: the number of steps is that of
branchings above each other, not of segments. An empty table gives an empty
result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common

Z, LEAST_LABELS, VARIES = 2.58, 10, 4
PRIOR, REJECT = 20.0, 0.5
#: (verdict, rule): the host's end up to the first slash, then the path's beginning.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_path(url: Column) -> tuple[Column, Column]:
    parts = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return common.lower_ascii(parts(1)), parts(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of the longest rule that fits, and its verdict; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment with what varies by its form left out.

    Only classes of characters are repeated, never groups: the engine of regular
    expressions calls itself for each turn of a group, which long segments don't
    survive. So words joined by hyphens are counted by splitting.
    """
    words = F.split(segment, "-")
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(segment.rlike(r"^[0-9a-fA-F]{8}[0-9a-fA-F-]*$"), F.lit("{x}"))
        .when((F.length(segment) > 40) | (F.size(words) >= 4) & ~F.array_contains(words, ""), F.lit("{s}"))
        .otherwise(segment)
    )


def path_shape(path: Column) -> Column:
    """Shapes of the path's segments; an empty path has none."""
    return F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), shape)


NODE = ("host", "above")


def branchings(active: DataFrame) -> DataFrame:
    """host, above, and how many segments all paths below have in common; null if there is but one path."""
    ends = active.groupBy(*NODE).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    # What the first and the last in order share, all share.
    differs = F.array_position(F.zip_with("lo", "hi", lambda x, y: ~x.eqNullSafe(y)), True)
    return ends.select(*NODE, F.when(F.col("lo") != F.col("hi"), (differs - 1).cast("int")).alias("shared"))


def grouped(nodes: DataFrame) -> DataFrame:
    """The children (host, above, child, pages, labels, bad) with their group, as often split as children differ."""
    now = common.materialise(nodes.withColumn("group", F.lit("")), "nodes")
    while True:
        whole = now.groupBy(*NODE, "group").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"))
        some = lambda c: F.nullif(c, F.lit(0).cast("long"))
        n, m = some(F.col("labels")), some(F.col("all_labels") - F.col("labels"))
        rate = F.col("all_bad") / some(F.col("all_labels"))
        error = F.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
        apart = F.col("bad") / n - (F.col("all_bad") - F.col("bad")) / m
        told = (n >= LEAST_LABELS) & (m >= LEAST_LABELS)
        move = F.when(told & (F.abs(apart) > Z * error), F.when(apart > 0, "+").otherwise("-")).otherwise("")
        new = now.join(whole, [*NODE, "group"]).select(*NODE, "child", "pages", "labels", "bad", F.concat("group", move).alias("group"), (move != "").alias("moved"))
        new = common.materialise(new, "nodes")
        common.discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now


def names_of(children: DataFrame) -> DataFrame:
    """host, above, child and the name of its branch."""
    levels = children.groupBy(*NODE).agg((F.sum("pages") < VARIES * F.count("*")).alias("varies"))
    groups = children.groupBy(*NODE, "group").agg(F.count_if(F.col("labels") >= LEAST_LABELS).alias("similar"))
    known = F.col("labels") >= LEAST_LABELS
    merged = F.when(known, (F.col("similar") > 1) | (F.col("varies") & (F.col("group") == ""))).otherwise(F.col("varies"))
    joined = children.join(levels, list(NODE)).join(groups, [*NODE, "group"])
    return joined.select(*NODE, "child", F.when(merged, F.concat(F.lit("*"), "group")).otherwise(F.col("child")).alias("name"))


def build_tree(paths: DataFrame) -> DataFrame:
    """host, shape and template of each of (host, shape, n, labels, bad)."""
    counts = ("n", "labels", "bad")
    active = common.materialise(paths.select("host", F.array().cast("array<string>").alias("above"), F.col("shape").alias("rest"), "shape", *counts), "active")
    done = []
    while not active.isEmpty():
        rows = active.join(branchings(active), list(NODE))
        whole = F.col("shared").isNull()  # a single path: nothing varies below
        ended = F.size("rest") == F.coalesce("shared", F.size("rest"))
        above = F.concat("above", F.slice("rest", F.lit(1), F.coalesce("shared", F.size("rest"))))
        rows = rows.select("host", above.alias("above"), (whole | ended).alias("ended"), F.get("rest", F.col("shared")).alias("child"), F.slice("rest", F.coalesce("shared", F.lit(0)) + 2, F.size("rest")).alias("rest"), "shape", *counts)
        rows = common.materialise(rows, "rows")
        done.append(rows.where("ended").select("host", "shape", F.col("above").alias("template")))
        open_ = rows.where("not ended")
        nodes = open_.groupBy(*NODE, "child").agg(F.sum("n").alias("pages"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
        children = grouped(nodes)
        named = common.materialise(names_of(children), "named")
        new = open_.join(named, [*NODE, "child"]).select("host", F.concat("above", F.array("name")).alias("above"), "rest", "shape", *counts)
        new = common.materialise(new, "active")
        common.discard(active, children, named)
        active = new
    found = paths.select("host", "shape", F.col("shape").alias("template")).limit(0)
    for d in done:
        found = found.unionByName(d)
    return common.materialise(found.join(paths, ["host", "shape"]), "tree")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the template with its smoothed purity.

    ``labels`` has id and bad (0 to 1).
    """
    host, path = host_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    shaped = urls.withColumn("shape", path_shape(F.col("path")))
    label = labels.select(F.col("id").cast("long").alias("id"), F.col("bad").cast("double").alias("bad")).where("id is not null and bad is not null").groupBy("id").agg(F.avg("bad").alias("bad"))
    marked = shaped.join(label, shaped.page_id == label.id, "left")
    paths = common.materialise(marked.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")), "paths")
    tree = build_tree(paths)
    share = tree.agg(F.sum("bad") / F.nullif(F.sum("labels"), F.lit(0))).first()[0] or 0.0
    totals = common.materialise(tree.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), "totals")
    purity = (F.col("all_bad") + PRIOR * share) / (F.col("all_labels") + PRIOR)
    judged = tree.select("host", "shape", "template").join(totals.select("host", "template", F.col("labels").alias("all_labels"), F.col("bad").alias("all_bad")), ["host", "template"])
    judged = common.materialise(judged.select("host", "shape", "template", purity.alias("bad_share"), F.col("all_labels").alias("template_labels")), "judged")
    out = shaped.join(judged, ["host", "shape"], "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    tree_says = F.when((F.col("bad_share") >= REJECT) & (F.col("template_labels") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", tree_says).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "bad_share")
