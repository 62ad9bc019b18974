"""URL filters: listed rules first, then a tree of path templates that labelled pages judge.

Paths grow into templates segment by segment. At each node (host and template so far) the
next segments are looked at together: if nearly each page has its own, the segment is
variable and only its shape stays ({n}, {h} or {w} with the file extension). Branches are
ranked by their share of bad labels, smoothed towards their node's, in BINS classes; from the
least class on, classes are joined to one group as long as a z-test doesn't tell them from
what the group has. So bad branches merge with bad ones and good with good, however they stand
among their siblings. The branches of a group go on as one (`*`, `*1`, ...), a lone one under its
own name. Segments that all pages of a node share stay as
they are, however many. A template's purity is its share of good labels, smoothed towards its host's, and
that towards the share overall; templates below the least purity are blocked. Branches that were
chosen for their labels would look pure or impure by chance alone, so groups are made by
one half of the labels (of the documents), and where a level has several groups, the purity of
one that joins branches is taken from the other half.

Counts are taken by (host, template, segment) and only then by node, and what a node decides
is looked up by its pages through salted joins, so a hot host is spread over tasks.

Cases: of several labels of a document the worst counts; a null url, or one without `://`, has an empty host and path, and is judged as a host
of its own; a page without label counts as unlabelled; repeated rows count each time; paths of
any depth grow to their last segment; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read, written

#: The listed rules, host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A segment varies if a node has at least this many, with fewer pages each than PAGES_EACH.
LEAST_BRANCHES = 8
PAGES_EACH = 3
#: Classes of smoothed shares, labels that a node's share is worth in them, and standard errors within which they are alike.
BINS, BRANCH_WEIGHT = 20, 4.0
SAME = 1.96
#: Labels that the host's (or overall) share is worth, and the least purity.
WEIGHT = 20.0
LEAST_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. For lists short enough to be one expression."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        at = text.index("/")
        fits = (host.eqNullSafe(F.lit(text[:at])) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def shape_of(segment: Column) -> Column:
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    base = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(base == "", F.lit("")).when(base.rlike(r"^[0-9]+$"), F.lit("{n}")).when(base.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{h}")).otherwise(F.lit("{w}"))
    return F.concat(kind, extension)


def _counts() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]


def _along(rows: DataFrame) -> DataFrame:
    """rows with the segments that all pages of a node share next moved to the template.

    A lone branch keeps its segment, so level by level would give the same; but a level is grown
    only where paths part, however deep they are.
    """
    node = ["host", "template"]
    ends = rows.groupBy(*node).agg(F.min("segments").alias("lo"), F.max("segments").alias("hi"))
    same = F.array_position(F.transform("lo", lambda x, i: F.get("hi", i).eqNullSafe(x)), False)
    shared = F.when(same > 0, F.slice("lo", 1, (same - 1).cast("int"))).otherwise(F.col("lo"))
    found = lookup(rows, ends.select(*node, shared.alias("shared")), node, ["key"])
    left = F.slice("segments", F.size("shared") + 1, F.size("segments"))
    return found.withColumns({"template": F.concat_ws("/", "template", "shared"), "segments": left}).drop("shared")


def _groups(branches: DataFrame) -> DataFrame:
    """(host, template, bin, group, groups, branches) from branches with bin: BINS + 1 rows a node at most, however many branches it has."""
    node = ["host", "template"]
    bins = branches.groupBy(*node, "bin").agg(F.count("*").alias("k"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    inorder = bins.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("bin", "k", "l", "b"))).alias("bins"))

    def add(a: Column, x: Column) -> Column:
        both, share = a["l"] + x["l"], (a["b"] + x["b"]) / (a["l"] + x["l"])
        error = F.sqrt(share * (1 - share) * both / (a["l"] * x["l"]))
        alike = (F.size(a["done"]) == 0) | (a["l"] == 0) | (x["l"] == 0) | (F.abs(a["b"] / a["l"] - x["b"] / x["l"]) <= SAME * error)
        here = F.struct(x["bin"].alias("bin"), F.when(alike, a["group"]).otherwise(a["group"] + 1).alias("group"), x["k"].alias("k"))
        keep = F.when(alike, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(here["group"].alias("group"), (keep * a["l"] + x["l"]).alias("l"), (keep * a["b"] + x["b"]).alias("b"), F.concat(a["done"], F.array(here)).alias("done"))

    none = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("group"), none.alias("l"), none.alias("b"), F.expr("cast(array() as array<struct<bin:int,group:int,k:bigint>>)").alias("done"))
    done = inorder.select(*node, F.aggregate("bins", start, add, lambda a: a["done"]).alias("done"))
    size = lambda g: F.aggregate(F.filter("done", lambda x: x["group"] == g), F.lit(0).cast("long"), lambda a, x: a + x["k"])
    return done.select(*node, F.inline(F.transform("done", lambda x: F.struct(x["bin"].alias("bin"), x["group"].alias("group"), (F.element_at("done", -1)["group"] + 1).alias("groups"), size(x["group"]).alias("branches")))))


def grow(pages: DataFrame) -> DataFrame:
    """pages (key, host, path, label: 1 bad, 0 good, null; fold: 0 or 1, else by key) with `template`, fold and `chosen`: whether labels of fold 0 chose what the template joins."""
    pages = pages.withColumn("chosen", F.lit(False))
    pages = pages if "fold" in pages.columns else pages.withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int"))
    segments = F.filter(F.split("path", "/"), lambda _, i: i > 0)
    rows = written(pages.withColumns({"segments": segments, "template": F.lit("")}))
    node = ["host", "template"]
    ended = F.size("segments") == 0
    done, rows = rows.where(ended), rows.where(~ended)
    while not rows.isEmpty():  # only pages whose paths still have a segment
        rows = written(_along(rows))
        done, rows = done.unionByName(rows.where(ended)), rows.where(~ended)
        rows = rows.withColumn("segment", F.get("segments", F.lit(0)))
        told = F.when(F.col("fold") == 0, F.col("label"))
        here = rows.groupBy(*node, "segment").agg(F.count("*").alias("n"), F.count(told).alias("labelled"), F.coalesce(F.sum(told), F.lit(0)).alias("bad"))
        here = written(here)
        nodes = here.groupBy(*node).agg(F.count("*").alias("branches"), *_counts())
        varies = nodes.select(*node, ((F.col("branches") >= LEAST_BRANCHES) & (F.col("n") < PAGES_EACH * F.col("branches"))).alias("varies"))
        label = F.when(F.col("varies"), shape_of(F.col("segment"))).otherwise(F.col("segment")).alias("branch")
        branches = lookup(here, varies, node, ["segment"], "inner").select(*node, "n", "labelled", "bad", label).groupBy(*node, "branch").agg(*_counts())
        share = F.coalesce(F.col("all_bad") / F.expr("nullif(all_labelled, 0)"), F.lit(0.0))
        both = lookup(branches, nodes.select(*node, F.col("labelled").alias("all_labelled"), F.col("bad").alias("all_bad")), node, ["branch"], "inner")
        both = both.withColumn("bin", F.floor(BINS * (F.col("bad") + BRANCH_WEIGHT * share) / (F.col("labelled") + BRANCH_WEIGHT)).cast("int")).drop("all_labelled", "all_bad")
        names = lookup(both, _groups(both), [*node, "bin"], ["branch"], "inner")
        names = names.select(*node, "branch", ((F.col("branches") > 1) & (F.col("groups") > 1)).alias("picked"), F.when(F.col("branches") == 1, F.col("branch")).otherwise(F.concat(F.lit("*"), F.expr("nullif(group, 0)").cast("string"))).alias("name"))
        names = names.withColumn("name", F.coalesce("name", F.lit("*")))
        rows = lookup(rows, varies, node, ["key"]).withColumn("branch", label)
        rows = lookup(rows, names, [*node, "branch"], ["key"])
        rows = rows.withColumns({"template": F.concat_ws("/", "template", "name"), "segments": F.slice("segments", 2, F.size("segments")), "chosen": F.col("chosen") | F.col("picked")}).drop("segment", "varies", "branch", "name", "picked")
        rows = written(rows)
        done, rows = done.unionByName(rows.where(ended)), rows.where(~ended)
    return done.drop("segments")


def purity(rows: DataFrame) -> DataFrame:
    """(host, template, purity) of rows that grow() returned."""
    rows = rows.withColumn("label", F.when(~F.col("chosen") | (F.col("fold") == 1), F.col("label")))
    leaves = rows.groupBy("host", "template").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    total = rows.agg(F.avg("label")).first()[0] or 0.0
    share = (F.col("host_bad") + WEIGHT * total) / (F.col("host_labelled") + WEIGHT)
    return lookup(leaves, hosts, ["host"], ["template"], "inner").select("host", "template", F.round(1 - (F.col("bad") + WEIGHT * share) / (F.col("labelled") + WEIGHT), 6).alias("purity"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = LEAST_PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for pages (page_id, url).

    labels (key, label) judge templates; a page's key is the number that ends its path, the
    document that it shows.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("page_id", "url").alias("key"))
    shows = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) as bigint)")
    known = labels.groupBy(F.col("key").alias("shows")).agg(F.max("label").alias("label"))
    # pages that show no document get keys of their own, which no label has: else null is a hot key
    rows = named.withColumn("shows", F.coalesce(shows, -1 - F.abs("key") % (1 << 40))).withColumn("fold", F.pmod(F.xxhash64("shows"), F.lit(2)).cast("int"))
    rows = lookup(rows, known, ["shows"], ["key"]).drop("shows")
    grown = grow(rows)
    rule, listed = rule_for(F.col("host"), F.col("path"), rules)
    judged = lookup(grown, purity(grown), ["host", "template"], ["key"])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(listed, F.when(F.col("purity") < least, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), bad.alias("label")))
