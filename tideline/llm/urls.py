"""Filters on web addresses: explicit rules, and verdicts learnt on a tree of path templates.

Per host, paths form a tree of segments. Variable segments become wildcards, sibling branches whose
labelled shares do not differ statistically are merged, and a template is rejected when the smoothed share of
good labels among its pages is too low.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tideline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``domain/path`` that fits, as a struct of ``rule`` and ``verdict``; null if none does.

    ``rules`` is a short list written by hand; a long list belongs into a table that is joined on the domain.
    """
    fits = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        domain, _, rest = rule.partition("/")
        test = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if fits is None else fits


def masked_segments(path: Column) -> Column:
    """The non-empty segments; one that holds a digit is variable by its shape and becomes a wildcard."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"\d"), F.lit(WILD)).otherwise(s))


def template_tree(pages: DataFrame, levels: int | None, min_share: float, min_pages: int, prior: float, z: float) -> DataFrame:
    """One row per host and masked path: its ``template`` and the labelled pages ``good`` and ``labelled`` of the template.

    ``pages`` has ``host``, ``segments`` and ``good`` (1.0, 0.0 or null where unlabelled). The tree is walked from
    the top, a level at a time, on counts per distinct masked path. At each node a child of ``min_pages`` pages stays literal
    if it holds ``min_share`` of the node's pages or if a two-sample test at ``z`` separates its labels from those of the rest of
    the wildcard, which is what all other children become. Kept siblings, ordered by their smoothed share of good
    labels, are merged while the test does not separate neighbours. The walk ends where all paths do, or after ``levels``
    segments if given; a node of fewer than ``min_pages`` pages has wildcards only and is not walked.
    """
    tree = cut_lineage(pages.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("good"), F.lit(0.0))).alias("good"), F.count("good").alias("labelled")))
    at, level, done = tree.withColumn("template", F.lit("")), 0, []
    node, columns, size = ["host", "template"], ["host", "segments", "n", "good", "labelled", "template"], F.size("segments")
    while (levels is None or level < levels) and not at.filter(size > level).isEmpty():
        child = F.coalesce(F.get("segments", F.lit(level)), F.lit(""))  # the empty child: the path ends here
        at = at.withColumn("child", child)
        sums = at.groupBy(*node, "child").agg(*[F.sum(c).alias(c) for c in ("n", "good", "labelled")])
        totals = sums.groupBy(*node).agg(F.sum("n").alias("all"))
        sums = cut_lineage(sums.join(totals, node).withColumn("large", (F.col("child") != WILD) & (
            (F.col("child") == "") | ((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("all"))))))
        others = sums.filter("not large")
        pool = others.groupBy(*node).agg(F.sum("good").alias("p_good"), F.sum("labelled").alias("p_labelled"))
        own = smoothed(F.col("good"), F.col("labelled"), prior)
        rest = smoothed(F.col("p_good") - F.col("good"), F.col("p_labelled") - F.col("labelled"), prior)
        told = others.filter((F.col("child") != WILD) & (F.col("n") >= min_pages)).join(pool, node).filter(separated(own, rest, z))
        kept = sums.filter("large").unionByName(told.select(sums.columns))
        merged = merge_similar(kept, node, prior, z).select(*node, "child", "branch")
        at = at.join(merged, [*node, "child"], "left").join(totals, node)
        step = F.when(F.col("child") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit(WILD))))
        small = F.col("all") < min_pages
        deep = size if levels is None else F.least(size, F.lit(levels))
        step = F.when(small, F.repeat(F.lit(f"/{WILD}"), F.greatest(deep - level, F.lit(0)))).otherwise(step)
        at = cut_lineage(at.select(*columns[:-1], F.concat("template", step).alias("template"), small.alias("small")))
        level += 1
        done.append(at.filter(F.col("small") | (size < level)).select(columns))
        at = at.filter(~F.col("small") & (size >= level)).select(columns)
    tree = at.select(columns)
    for part in done:
        tree = tree.unionByName(part)
    tree = cut_lineage(tree)
    sums = tree.groupBy("host", "template").agg(F.sum("n").alias("template_pages"), F.sum("good").alias("t_good"), F.sum("labelled").alias("t_labelled"))
    return tree.select("host", "segments", "template").join(sums, ["host", "template"])


def smoothed(good: Column, labelled: Column, prior: float) -> tuple[Column, Column]:
    """Share of good labels, smoothed with ``prior`` pages of one half, and its variance."""
    share = (good + 0.5 * prior) / (labelled + prior)
    return share, share * (1 - share) / (labelled + prior)


def separated(one: tuple[Column, Column], other: tuple[Column, Column], z: float) -> Column:
    return F.abs(one[0] - other[0]) > z * F.sqrt(one[1] + other[1])


CELLS = 1024  # of the order of siblings
NAMED = 20  # merged siblings that a template names one by one


def merge_similar(kept: DataFrame, node: list[str], prior: float, z: float) -> DataFrame:
    """Adds ``branch``: the names of the siblings merged with a child, or its own name.

    Children with the same labels are one entry. Entries are ordered within cells of their share; the first of a cell is
    compared with the last of the cell before, so a window holds a cell of a node or its cells. Of more than ``NAMED`` merged
    siblings the name has the first and their number. Ends of paths stay apart.
    """
    share, spread = smoothed(F.col("good"), F.col("labelled"), prior)
    kept = kept.withColumn("is_end", F.col("child") == "")
    same, cell = [*node, "is_end", "good", "labelled"], [*node, "is_end", "cell"]
    entries = kept.select(same).distinct().withColumn("share", share).withColumn("spread", spread).withColumn("cell", F.floor(share * CELLS))
    order = ["share", "labelled"]
    last = F.max(F.struct(*order, "spread"))
    cells = entries.groupBy(*cell).agg(last.alias("last"))
    before = cells.select(*cell, F.lag("last").over(W.partitionBy(*cell[:-1]).orderBy("cell")).alias("before"))
    within = W.partitionBy(*cell).orderBy(*order)
    met = entries.join(before, cell)
    o_share, o_spread = (F.coalesce(F.lag(c).over(within), F.col("before")[c]) for c in ("share", "spread"))
    apart = F.coalesce(separated((F.col("share"), F.col("spread")), (o_share, o_spread), z), F.lit(True))
    met = cut_lineage(met.withColumn("apart", apart.cast("int")))
    ends = met.groupBy(*cell).agg(F.sum("apart").alias("cuts"))
    earlier = F.coalesce(F.sum("cuts").over(W.partitionBy(*cell[:-1]).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = met.join(ends.select(*cell, earlier.alias("earlier")), cell)
    met = met.withColumn("part", F.col("earlier") + F.sum("apart").over(within.rowsBetween(W.unboundedPreceding, 0)))
    cut = kept.join(met.select(*same, "part"), same)
    part = [*node, "is_end", "part"]
    counts = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("many"), F.min("child").alias("least"))
    few = cut.join(counts.filter(F.col("many") <= NAMED).select(part), part).groupBy(*part).agg(F.array_sort(F.collect_list("child")).alias("names"))
    names = counts.join(few, part, "left").withColumn("inner", F.coalesce(F.array_join("names", "|"), F.concat("least", F.lit("|..."), F.col("many").cast("string"))))
    branch = F.when(F.col("many") == 1, F.col("child")).otherwise(F.concat(F.lit("{"), F.col("inner"), F.lit("}")))
    return cut.join(names.select(*part, "many", "inner"), part).withColumn("branch", branch)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", label: str | None = None, levels: int | None = None,
               min_share: float = 0.05, min_pages: int = 3, prior: float = 10.0, z: float = 1.96, least_good: float = 0.4) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and, from the tree, ``template``, ``purity`` and ``learnt``.

    ``label`` names a column with 1.0 for good pages, 0.0 for bad ones and null for the rest. ``purity`` is the
    share of good labels of the template, smoothed with ``prior`` pages at the host's share, which is itself
    smoothed with the share of all labels (1 where nothing is labelled). ``learnt`` is block if purity is below
    ``least_good``; ``verdict`` is the rule's, else ``learnt``. Every row stays, repeated rows too; a null url or one
    without ``://`` has an empty host and path and follows the purity of that template. An empty table gives an empty
    one; columns with the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "template", "purity", "learnt")
    keep = [c for c in pages.columns if c not in added]
    good = F.lit(None).cast("double") if label is None else F.col(label).cast("double")
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), good.alias("_good")) \
        .withColumn("_segments", masked_segments(F.col("path")))
    tree = cut_lineage(template_tree(rows.select("host", F.col("_segments").alias("segments"), F.col("_good").alias("good")),
                                     levels, min_share, min_pages, prior, z))
    once = tree.select("host", "template", "t_good", "t_labelled").distinct()
    hosts = once.groupBy("host").agg(F.sum("t_good").alias("h_good"), F.sum("t_labelled").alias("h_labelled"))
    total = hosts.agg(F.sum("h_good"), F.sum("h_labelled")).first()
    overall = total[0] / total[1] if total[1] else 1.0
    h_share = (F.col("h_good") + prior * overall) / (F.col("h_labelled") + prior)
    purity = (F.col("t_good") + prior * h_share) / (F.col("t_labelled") + prior)
    judged = tree.join(hosts, "host").select("host", F.col("segments").alias("_segments"), "template", purity.alias("purity"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("purity") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, ["host", "_segments"]).withColumn("learnt", learnt).withColumn("_rule", rule).select(
        *keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "learnt").alias("verdict"),
        "template", "purity", "learnt")
