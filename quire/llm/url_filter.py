"""URL filter: fixed rules first, then a path-template tree learnt from the urls that the rules judge.

Paths become templates: runs of digits and long hexadecimal names are wildcards, and so are the children of a node that has
too many different ones. Templates under one node whose blocked shares are statistically alike are merged into one
branch. A template is rejected if its smoothed share of blocked urls is above a limit. Urls that no rule fits get their
template's verdict; a template of which no url is judged is allowed.

DataFrame functions only. Counts are of distinct (host, path shape) after a grouped count, which is combined map-side, so
a host with a third of all urls is no single task's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
#: Different children of a node from which on they are one wildcard.
FANOUT = 32
#: Standard errors within which a branch's blocked share counts as its siblings' share.
ALIKE = 1.96
#: Judged urls that the overall blocked share counts as in a template's share, and the share above which it is rejected.
PRIOR = 5.0
LIMIT = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or null."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def template_verdicts(paths: DataFrame, fanout: int = FANOUT, alike: float = ALIKE, prior: float = PRIOR, limit: float = LIMIT) -> DataFrame:
    """``host``, ``shape``, ``template`` and ``rejected`` for distinct paths with counts ``n`` (judged) and ``b`` (blocked)."""
    steps = paths.select("host", "shape", F.posexplode(F.split("shape", "/")).alias("depth", "part"))
    steps = steps.withColumn("before", F.expr("substring_index(shape, '/', depth)"))
    literal = ~F.contains("part", F.lit("{"))
    wide = steps.where(literal).select("host", "depth", "before", "part").distinct().groupBy("host", "depth", "before").agg(F.count(F.lit(1)).alias("children"))
    wide = wide.where(F.col("children") > fanout).select("host", "depth", "before", F.lit(True).alias("wide"))
    parts = steps.join(wide, ["host", "depth", "before"], "left").withColumn("part", F.when(F.col("wide") & literal, F.lit("*")).otherwise(F.col("part")))
    # the parts of one path: as many as it has slashes
    whole = parts.groupBy("host", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "part"))), lambda s: s["part"]).alias("parts"))
    whole = whole.select("host", "shape", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("node"), F.element_at("parts", -1).alias("branch"))
    judged = paths.join(whole, ["host", "shape"])
    branches = judged.groupBy("host", "node", "branch").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    nodes = branches.groupBy("host", "node").agg(F.try_divide(F.sum("b"), F.sum("n")).alias("p"))
    spread = F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("n")))
    close = F.abs(F.try_divide("b", "n") - F.col("p")) <= alike * spread
    branches = branches.join(nodes, ["host", "node"]).withColumn("merged", F.when(F.coalesce(close, F.lit(False)), F.lit("*")).otherwise(F.col("branch")))
    overall = paths.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("n")), F.lit(0.5)).alias("share")).first().share
    groups = branches.groupBy("host", "node", "merged").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    groups = groups.withColumn("rejected", (F.col("n") > 0) & ((F.col("b") + prior * overall) / (F.col("n") + prior) > limit)).drop("n", "b")
    named = branches.select("host", "node", "branch", "merged").join(groups, ["host", "node", "merged"])
    named = whole.join(named, ["host", "node", "branch"])
    return named.select("host", "shape", F.concat_ws("/", F.nullif("node", F.lit("")), "merged").alias("template"), "rejected")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """One row per row: ``id``, ``host``, ``path``, ``rule`` (null if none fits), ``template`` and ``verdict``.

    A null url and one without ``://`` have an empty host and path, which no rule fits, and are allowed. Repeated rows
    stay; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    shape = F.transform(parts, lambda p: F.when(p.rlike("^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{36}$"), "{h}").otherwise(F.regexp_replace(p, "[0-9]+", "{n}")))
    urls = urls.withColumn("fit", fitting_rule(rules)).select("id", "host", "path", "fit", F.array_join(shape, "/").alias("shape"))
    paths = urls.groupBy("host", "shape").agg(F.count("fit").alias("n"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("b"))
    verdicts = template_verdicts(paths, **options)
    out = urls.join(verdicts, ["host", "shape"])
    verdict = F.coalesce("fit.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("id", "host", "path", F.col("fit.name").alias("rule"), "template", verdict.alias("verdict"))
