"""URL filters: rules by host and path first, then the reputation of the host, in DataFrame functions only.

The reputation is empirical Bayes. Of pages whose outcome is known, the bad ones are counted for
each host. The rate of a suffix is drawn to that of all pages, that of a registered domain to its
suffix's, that of a host to its domain's, each with the strength of a beta prior that the spread
of the level itself gives (moments of the beta-binomial). A host is blocked where the lower bound
of its posterior bad rate is above a limit; hosts without known pages take their domain's rate as
it is, whose bound is wide, and so are allowed unless much speaks against the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import written

#: Public suffixes of more than one label; any other host ends in a suffix of one.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.au", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")
#: Most rules: they are part of the plan.
MOST_RULES = 1_000
#: Bounds of the correlation of outcomes within a level, and so of the prior's strength (1 / rho - 1).
RHO = (1e-4, 0.5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (like `net/`) and its verdict, null where none does.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts
    with its own. Of two of one length that fit, that of the longer host wins, then the first in order.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule = verdict = None
    for said, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, at + start) if rule is None else rule.when(fits, at + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The public suffix that a host ends in (one of `suffixes`, or else its last label), and the registered domain: one label more, if there.

    User names, ports and a last dot don't count; numeric addresses have no suffix and are domains of their own.
    """
    name = F.regexp_extract(host, r"^(?:.*@)?(\[[^\]]*\]|[^:]*?)\.?(?::[0-9]*)?$", 1)
    numeric = name.rlike(r"^[0-9.]*$") | name.startswith("[")
    last, two, three = (F.substring_index(name, ".", -i) for i in (1, 2, 3))
    listed = two.isin(*suffixes)
    return F.when(numeric, "").when(listed, two).otherwise(last), F.when(numeric, name).when(listed, three).otherwise(two)


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: pages of each host whose outcome is known, and those of them that are bad.

    A page shows the document whose number ends its path, and has that one's outcome: bad where
    labels call it poor or toxic (the worst of repeated labels; a null counts as fine, both null as
    unknown). Pages without a number, or whose number has no label, don't count. Pages of one
    document and host are added up before the join, so a hot page is one row in it.
    """
    host, path = parts(F.col("url"))
    number = F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]{1,18})(?:\\.html|/)?$', 1), '') AS BIGINT)")
    shown = pages.select(host.alias("host"), path.alias("path")).select("host", number.alias("doc_id")).where("doc_id IS NOT NULL")
    shown = shown.groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    met = shown.join(known, "doc_id")
    return met.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))


def _strength(rows: DataFrame) -> float:
    """Strength of the beta prior of rows (n, bad, mean): moments of the beta-binomial, one row of sums to the driver."""
    n, bad, m = F.col("n").cast("double"), F.col("bad").cast("double"), F.col("mean")
    over, scale = rows.select(F.sum((bad - n * m) ** 2 - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = round(min(max((over or 0.0) / scale, RHO[0]), RHO[1]), 9) if scale else RHO[1]
    return 1 / rho - 1


def reputations(hosts: DataFrame, known: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """host, n, bad, mean, bound of each distinct host of `hosts`: its posterior bad rate, and the lower bound of that.

    known: host, n, bad. The bound is the posterior mean less z posterior deviations. Hosts that
    share a domain, and domains that share a suffix, are added up before they are shuffled; with
    no known pages at all every rate is 1/2.
    """
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    each = hosts.select("host").distinct().join(known, "host", "left").na.fill(0, ["n", "bad"])
    each = written(each.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    domains = each.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    parent = F.lit((bad + 1) / (n + 2))
    post = lambda s: (s * F.col("mean") + F.col("bad")) / (s + F.col("n"))
    tops = tops.withColumn("mean", parent)
    tops = tops.select("suffix", post(_strength(tops)).alias("mean"))
    domains = domains.join(tops, "suffix")
    domains = domains.select("domain", "suffix", post(_strength(domains)).alias("mean"))
    each = each.join(domains, ["domain", "suffix"])
    s = _strength(each)
    mean = post(s)
    each = each.select("host", "n", "bad", mean.alias("mean"), (s + F.col("n")).alias("weight"))
    return each.select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def judged(pages: DataFrame, known: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.25, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the longest rule's verdict, or else `block` where the host's bound is above limit.

    A null url, or one without `://`, has an empty host and path, which is a host like others.
    Repeated rows are judged alike; other columns of pages are left out; an empty table gives no
    rows. Verdicts of hosts are joined as a table, of which Spark splits a hot host's pages.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = reputations(rows, known, z=z).select("host", F.when(F.col("bound") > limit, "block").otherwise("allow").alias("_own"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    return rows.join(verdicts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, "_own").alias("verdict"))
