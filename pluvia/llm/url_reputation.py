"""URL filter: rule list plus empirical-Bayes reputation of hosts.

Labelled page outcomes (1 good, 0 bad) are summed by host. A beta-binomial prior is
shrunk down three levels: all pages -> public suffix -> registered domain -> host. Every
level's prior has the mean of its parent's posterior and a strength fitted by the method
of moments to the spread of that level's own rates. A page without a fitting rule is
blocked if the lower bound of its host's posterior good rate is under ``min_good``.

DataFrame functions only. Host sums combine on the map side; the pages are joined to a
written table of hosts, so that Spark broadcasts it only by its measured size and splits
a hot host otherwise.

Nulls, ties and other cases: a null url or one without ``://`` has an empty host and
path, fits no rule, and is judged by the prior of the whole table; outcomes that are null,
not 0 or 1, or of an unknown page are left out; a page id with several outcomes counts
each; repeated page rows give repeated results; no labels at all means the prior
``default_rate`` with strength 2; an empty table gives an empty result. Other columns of
the inputs are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au",
                      "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.nz", "co.za")
MAX_STRENGTH = 1000.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url_text")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_names(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, domain, suffix) of every page."""
    host, path = host_and_path(F.col("url_text"))
    named = pages.select("page_id", F.col("url").cast("string").alias("url_text")).select(
        "page_id", host.alias("host"), path.alias("path"))
    two = F.substring_index("host", ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    return named.select(
        "page_id", "host", "path",
        F.when(wide, F.substring_index("host", ".", -3)).otherwise(two).alias("domain"),
        F.when(wide, two).otherwise(F.substring_index("host", ".", -1)).alias("suffix"),
    )


def fitting_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (host, path), else nulls.

    The rules are a short list given by the caller and become one CASE expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        own = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = own & F.col("path").startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _strength(rates: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength per parent by moments: m(1-m) / spread of the child rates - 1.

    Children are weighted by their outcomes; sampling noise is taken off the spread.
    """
    n, p, m = F.col("n").cast("double"), F.col("good") / F.col("n"), F.col("parent_rate")
    sums = rates.where("n > 0").groupBy(*by).agg(
        F.sum(n).alias("total"), F.count(F.lit(1)).alias("children"),
        F.sum(n * (p - m) * (p - m)).alias("spread"), F.max(m).alias("m"))
    noise = F.col("m") * (1 - F.col("m"))
    between = (F.col("spread") - F.col("children") * noise) / F.col("total")
    found = F.when((noise > 0) & (between > 0), noise / between - 1).otherwise(F.lit(MAX_STRENGTH))
    return sums.select(*by, F.least(F.greatest(found, F.lit(1.0)), F.lit(MAX_STRENGTH)).alias("strength"))


def _level(child: DataFrame, parent: DataFrame, by: list[str]) -> DataFrame:
    """Posterior of each child under the prior of its parent (columns rate, strength)."""
    joined = child.join(parent.select(*by, F.col("rate").alias("parent_rate")), by, "left")
    strength = _strength(joined, by)
    both = joined.join(strength, by, "left").withColumn(
        "strength", F.coalesce("strength", F.lit(MAX_STRENGTH)))
    a = F.col("parent_rate") * F.col("strength") + F.col("good")
    b = (1 - F.col("parent_rate")) * F.col("strength") + F.col("n") - F.col("good")
    return both.select(*child.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate"))


def reputations(pages: DataFrame, outcomes: DataFrame, default_rate: float = 0.5,
                width: float = 1.645) -> DataFrame:
    """(host, good_rate, bound) of every host of ``pages``.

    ``outcomes`` has page_id and good (0 or 1). ``bound`` is the lower end of the
    posterior of the host's good rate: its mean less ``width`` standard deviations.
    """
    known = outcomes.where("page_id is not null and good in (0, 1)").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    hosts = materialise(
        with_names(pages).join(known, "page_id", "left").groupBy("host", "domain", "suffix")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")),
        "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")),
                          "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        F.lit(1).alias("one"),
        ((F.coalesce("good", F.lit(0)) + 2 * F.lit(default_rate)) / (F.coalesce("n", F.lit(0)) + 2)).alias("rate"))
    by_suffix = materialise(_level(suffixes.withColumn("one", F.lit(1)), top, ["one"]).select("suffix", "rate"),
                            "suffix-rates")
    by_domain = materialise(_level(domains, by_suffix, ["suffix"]).select("domain", "suffix", "rate"),
                            "domain-rates")
    by_host = _level(hosts, by_domain, ["domain", "suffix"])
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("a") + F.col("b") + 1))
    return by_host.select("host", F.col("rate").alias("good_rate"),
                          (F.col("rate") - width * spread).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_good: float = 0.5,
          default_rate: float = 0.5, width: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_rate, bound) of every page.

    The verdict is the longest fitting rule's, else ``allow`` or ``block`` by the
    posterior bound of the page's host.
    """
    table = materialise(reputations(pages, outcomes, default_rate, width), "reputations")
    text, verdict = fitting_rule(rules)
    own = F.when(F.col("bound") >= min_good, "allow").otherwise("block")
    return (with_names(pages).select("page_id", "host", "path").join(table, "host", "left")
            .select("page_id", "host", "path", text.alias("rule"),
                    F.coalesce(verdict, own).alias("verdict"),
                    F.round("good_rate", 6).alias("good_rate"), F.round("bound", 6).alias("bound")))
