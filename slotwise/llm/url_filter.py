"""URL filters by a tree of path templates, in DataFrame functions only.

Rules decide what they match. For the other URLs a tree of path templates is built per host:

* Segments that vary become wildcards: numbers and hashes by their form, other segments where a
  host has so many values at that depth that they look like identifiers.
* Every node counts the labelled URLs below it, those that a rule allows or blocks.
* Sibling branches whose share of blocked URLs does not differ from their common share by more than
  chance merge and use their common counts; a branch that differs keeps its own.
* A template's purity is its share of blocked URLs, smoothed along the tree: what the same template
  shows on all hosts is the prior of the host's root, and each node's value that of its children.
  Templates with a purity of one half or more are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the contract: verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A place of a host with more values than this, and than half its different paths, holds identifiers.
WIDE = 20
#: Labelled URLs that a prior counts for, and standard errors within which branches are alike.
WEIGHT = 4.0
ERRORS = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL and for one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    cases = [
        F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in longest
    ]
    return F.coalesce(*cases)


def _segments(path: Column) -> Column:
    """All segments of a path, numbers and hashes as wildcards; empty ones are left out, so ``/a//b`` is ``/a/b``."""
    form = lambda s: (
        F.when(s.rlike("^[0-9]+$"), F.lit("{n}"))
        .when(s.rlike("^[0-9]+[.][A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.regexp_extract(s, "[.]([A-Za-z0-9]+)$", 1)))
        .when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{hash}"))
        .otherwise(s)
    )
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), form)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template, purity.

    A null URL, or one without ``://``, has empty host and path and no rule; its template is that of
    the empty host. Without any labelled URL all templates have a purity of 0 and are allowed.
    Repeated rows each get their answer and change no template; an empty table gives an empty result.
    Paths count with all their segments; the nodes of a path are as many as its segments.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules)).select(
        "id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled"), _segments(F.col("path")).alias("segments")
    )
    # Places of a host where values vary, among its different paths, so that rows that come again count once.
    # Values are counted before hosts, so a hot host is spread.
    paths = rows.groupBy("host", "path").agg(F.first("segments").alias("segments"))
    values = paths.select("host", F.posexplode("segments").alias("place", "value")).groupBy("host", "place", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    varying = (
        values.groupBy("host", "place").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"))
        .filter((F.col("many") > WIDE) & (F.col("many") * 2 > F.col("n")))
        .groupBy(F.col("host").alias("wide_host")).agg(F.collect_list("place").alias("wide"))  # places of its longest path at most
    )
    template = F.transform(
        "segments", lambda s, i: F.when(F.array_contains("wide", i), F.lit("*")).otherwise(s)
    )
    placed = rows.join(varying, F.col("host") == F.col("wide_host"), "left").select(
        "id", "host", "path", "rule", "ruled",
        F.coalesce(F.concat_ws("/", template), F.concat_ws("/", "segments")).alias("template"),
    )
    templates = placed.groupBy("host", "template").agg(
        F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"),
        F.count("ruled").alias("labelled"),
    )
    # All prefixes of each template, the root of the host (depth 0) included.
    cut = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", "/", -1))
    chain = templates.withColumn("parts", cut).select(
        "host", "template", "blocked", "labelled", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts"
    ).select(
        "host", "template", "blocked", "labelled", "depth",
        F.concat_ws("/", F.slice("parts", 1, F.col("depth"))).alias("node"),
        F.when(F.col("depth") == 0, F.lit(None).cast("string")).otherwise(
            F.concat_ws("/", F.slice("parts", 1, F.greatest(F.col("depth") - 1, F.lit(0))))
        ).alias("parent"),
    )
    nodes = chain.groupBy("host", "depth", "node", "parent").agg(
        F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")
    )
    family = nodes.groupBy("host", "depth", "parent").agg(
        F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled")
    )
    beside = lambda a, b: reduce(
        lambda x, y: x & y, [a["host"] == b["host"], a["depth"] == b["depth"], a["parent"].eqNullSafe(b["parent"])]
    )
    share = F.col("all_blocked") / F.greatest(F.col("all_labelled"), F.lit(1))
    expected = F.col("labelled") * share
    spread = F.sqrt(F.col("labelled") * share * (1 - share))
    judged = nodes.alias("x").join(family.alias("y"), beside(_of("x"), _of("y"))).select(
        "x.*", (F.abs(F.col("blocked") - expected) <= ERRORS * spread + 0.5).alias("alike")
    )
    merged = judged.filter("alike").groupBy("host", "depth", "parent").agg(
        F.sum("blocked").alias("merged_blocked"), F.sum("labelled").alias("merged_labelled")
    )
    counted = judged.alias("x").join(merged.alias("y"), beside(_of("x"), _of("y")), "left").select(
        "x.host", "x.depth", "x.node",
        F.when(F.col("alike"), F.col("merged_blocked")).otherwise(F.col("blocked")).alias("b"),
        F.when(F.col("alike"), F.col("merged_labelled")).otherwise(F.col("labelled")).alias("n"),
    )
    everywhere = templates.agg(
        (F.coalesce(F.sum("blocked"), F.lit(0)) / F.greatest(F.coalesce(F.sum("labelled"), F.lit(0)), F.lit(1))).alias("overall")
    )
    priors = templates.groupBy(F.col("template").alias("same")).agg(
        F.sum("blocked").alias("pb"), F.sum("labelled").alias("pn")
    ).select("same", ((F.col("pb") + WEIGHT * everywhere.scalar()) / (F.col("pn") + WEIGHT)).alias("prior"))
    steps = (
        chain.select("host", "template", "depth", "node").join(counted, ["host", "depth", "node"])
        .groupBy("host", "template")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "b", "n"))).alias("steps"))  # one for each segment and the root
        .join(priors, F.col("template") == F.col("same"))
    )
    purity = F.aggregate("steps", F.col("prior"), lambda p, s: (s["b"] + WEIGHT * p) / (s["n"] + WEIGHT))
    verdicts = steps.select(
        F.col("host").alias("own_host"), F.col("template").alias("own_template"), F.round(purity, 9).alias("purity")
    )
    return placed.join(
        verdicts, (F.col("host") == F.col("own_host")) & (F.col("template") == F.col("own_template"))
    ).select(
        "id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )


class _of:
    """Columns of a frame by its alias."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, column: str) -> Column:
        return F.col(f"{self.alias}.{column}")
