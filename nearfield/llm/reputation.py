"""Host reputation by empirical Bayes, beside fixed rules.

Labelled outcomes of pages (bad or not) are counted by host.  A host's rate of bad pages has a beta prior around its
registered domain's rate, that one around its suffix's, and that one around the overall rate; the strength of each
level's prior is fitted to how far its units scatter (beta-binomial moments), and a unit's posterior mean is the prior
mean of the units below it.  A host is blocked if even the lower bound of its posterior rate is too high.
Null or malformed urls have an empty host and path, fit no rule, and share one host; hosts without labels get their
prior; outcomes of unknown pages and null ids are ignored, and a page labelled both ways is bad.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored

#: Suffixes of more than one label under which domains are registered, where no table of them is given.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
#: A host is blocked if its rate of bad pages is surely above this, by so many posterior deviations.
MAX_BAD, DEVIATIONS = 0.3, 1.645

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule for the columns host and path; null if none fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def registered(hosts: DataFrame, suffixes: DataFrame | Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``hosts`` (with ``host``) and their ``domain`` and ``suffix``.

    ``suffixes`` are the names under which domains are registered, as a list or a table (suffix) in the form of the public
    suffix list: the longest that ends a host counts, ``*.`` stands for any label, ``!`` takes a name out again, and
    a host that none ends has its last label as suffix.  A domain is its suffix and one label before it; an address in
    numbers is its own.  User parts and ports are not of the name.
    """
    spark = hosts.sparkSession
    if not isinstance(suffixes, DataFrame):
        suffixes = spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    rules = suffixes.select(F.lower(F.regexp_replace("suffix", r"^!|^[*][.]", "")).alias("tail"), F.substring("suffix", 1, 1).alias("kind"))
    rules = rules.where("tail <> ''").groupBy("tail").agg(
        F.max((F.col("kind") == "!").cast("int")).alias("less"), F.max((F.col("kind") == "*").cast("int")).alias("more")
    )
    rules = stored(rules, "suffix-rules")
    deepest = rules.agg(F.max(F.size(F.split("tail", "[.]")))).first()[0] or 1
    bare = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    named = hosts.withColumn("_bare", bare)
    tails = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(deepest)), lambda n: F.call_function("substring_index", F.col("_bare"), F.lit("."), -n)))
    asked = named.select("host", "_bare", F.explode(tails).alias("tail"))
    side = F.broadcast(rules) if rules.count() <= shared.BROADCAST_ROWS else rules
    labels = F.size(F.split("tail", "[.]"))
    # How many labels the suffix has; an exception goes before all other rules.
    length = F.when(F.col("less") == 1, F.lit(1000) + labels - 1).when(F.col("more") == 1, labels + 1).otherwise(labels)
    best = asked.join(side, "tail").groupBy("host").agg(F.max(length).alias("_labels"))
    found = named.join(best, "host", "left").withColumn("_labels", F.coalesce(F.when(F.col("_labels") >= 1000, F.col("_labels") - 1000).otherwise(F.col("_labels")), F.lit(1)))
    last = lambda n: F.call_function("substring_index", F.col("_bare"), F.lit("."), -n)
    address = F.col("_bare").rlike(r"^[0-9.]*$|\]$")
    found = found.withColumn("suffix", last(F.col("_labels"))).withColumn("domain", F.when(address, F.col("_bare")).otherwise(last(F.col("_labels") + 1)))
    return found.drop("_bare", "_labels")


def _strength(units: DataFrame) -> float:
    """Pseudo-observations of the prior for units (n, bad, mean): the fewer, the more their rates scatter around it.

    The squared distance of a rate from its mean m is m(1-m)/n (1 + (n-1) r) on average, r being the correlation of
    pages within a unit, and the strength is 1/r - 1.
    """
    v, rate = F.col("mean") * (1 - F.col("mean")), F.col("bad") / F.col("n")
    row = units.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("mean")) ** 2).alias("seen"), F.sum(v).alias("least"), F.sum(v * (F.col("n") - 1)).alias("slope")
    ).first()
    r = (row.seen - row.least) / row.slope if row.slope else 0.0
    return 1 / min(max(r, 1e-4), 0.9) - 1


def _shrunk(units: DataFrame) -> tuple[DataFrame, float]:
    """``units`` with ``post``, their posterior mean; and the strength of the prior."""
    strength = _strength(units)
    return units.withColumn("post", (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)), strength


def reputations(hosts: DataFrame, max_bad: float, deviations: float, suffixes: DataFrame | Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """Stored ``hosts`` (host, pages, n, bad) with rate, bound and verdict."""
    hosts = stored(registered(stored(hosts, "counted-hosts"), suffixes), "hosts")
    sums = [F.sum(c).alias(c) for c in ("pages", "n", "bad")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("units")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("units")), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total.bad + 0.5) / (total.n + 10.0)  # few outcomes say little against a page

    suffixes, _ = _shrunk(suffixes.withColumn("mean", F.lit(mean)))
    above = stored(suffixes.select("suffix", F.col("post").alias("mean"), "units"), "suffix-rates")
    domains = stored(shared.attach(domains, above, "suffix", "units", domains.count()), "domains")
    domains, _ = _shrunk(domains)
    above = stored(domains.select("domain", F.col("post").alias("mean"), "units"), "domain-rates")
    hosts = stored(shared.attach(hosts, above, "domain", "units", hosts.count()), "hosts")
    hosts, strength = _shrunk(hosts)
    weight = F.col("n") + strength
    bound = F.col("post") - deviations * F.sqrt(F.col("post") * (1 - F.col("post")) / (weight + 1))
    verdict = F.when(bound > max_bad, "block").otherwise("allow")
    return hosts.select("host", "pages", F.col("post").alias("rate"), bound.alias("bound"), verdict.alias("by_host"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    max_bad: float = MAX_BAD,
    deviations: float = DEVIATIONS,
    suffixes: DataFrame | Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's rate and bound; ``outcomes`` are (page_id, bad)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = stored(rows, "hosts-of-pages")
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = rows.select("page_id", "host").join(known, "page_id", "left")
    hosts = counted.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    rated = stored(reputations(hosts, max_bad, deviations, suffixes), "reputations")
    judged = shared.attach(rows, rated, "host", "pages", rows.count()).withColumn("found", fitting_rule(rules))
    verdict = F.coalesce("found.verdict", "by_host").alias("verdict")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict, "rate", "bound")
