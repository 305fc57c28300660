"""URL filter with rules and empirical-Bayes host reputation (DataFrame functions only).

Rules: (host, path, action) triples; a rule fits its host and all subdomains if the url's path starts
with the rule's; the longest wins. The rule list is a parameter, part of the plan, and bounded by
``MAX_RULES``.

Reputation: labelled page outcomes are counted per host (partial sums before the shuffle) and shrunk
through beta-binomial priors. The suffix's mean is the prior mean of its registered domains, the domain's
posterior mean that of its hosts. How many pages a prior is worth is estimated at both levels by moments:
the more the members of a level differ from their parents beyond chance, the less (between ``LEAST`` and
``MOST``; ``STRENGTH`` where no member has two pages). User part and port are no part of the host that is counted. The registered
domain is one label below the suffix; a suffix is the last label, or one of ``suffixes``, a list of at most
``MAX_SUFFIXES`` longer ones that is a parameter too (the default is a short one of common suffixes, not
the public list). An IP address is its own domain and suffix. A url without a rule is
blocked when the upper posterior bound of its host's good share lies below ``floor``: only hosts that
are surely bad go, hosts with little evidence stay.

Defined results: a url that is null or has no ``://`` has an empty host and path; an empty host has no
rule and no reputation and is allowed; an outcome that is null is not counted; an empty table gives an
empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1000
MAX_SUFFIXES = 10_000
# Suffixes of several labels under which unrelated owners register; pass a longer list where it matters.
SUFFIXES = tuple("""
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz ac.nz govt.nz
co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr com.cn net.cn org.cn edu.cn gov.cn com.tw org.tw edu.tw com.hk org.hk com.sg edu.sg
co.in net.in org.in ac.in gov.in com.br net.br org.br gov.br com.ar com.mx com.co com.pe com.tr com.ua com.pl co.za org.za co.il ac.il
com.my com.ph com.vn co.id ac.id co.th ac.th com.eg com.sa com.ng co.ke com.pk com.bd
github.io gitlab.io blogspot.com wordpress.com netlify.app vercel.app pages.dev web.app herokuapp.com azurewebsites.net cloudfront.net
tumblr.com weebly.com wixsite.com
""".split())
STRENGTH, LEAST, MOST = 8.0, 1.0, 10_000.0
FLOOR = 0.5
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host_name: Column, url_path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host_name == name) | host_name.endswith("." + name)) & url_path.startswith(start)
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return text, action


def bare(host_name: Column) -> Column:
    """The host without user part, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(host_name, r"(?s)^.*@", ""), r"\.*(:[0-9]*)?$", "")


def is_ip(host_name: Column) -> Column:
    return host_name.startswith("[") | host_name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def suffix(host_name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that ends the host at a label, else the last label; an IP is its own."""
    if len(suffixes) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} suffixes")
    found = F.substring_index(host_name, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(host_name, ".", -labels)
        found = F.when(end.isin([s for s in suffixes if s.count(".") + 1 == labels]), end).otherwise(found)
    return F.when(is_ip(host_name), host_name).otherwise(found)


def registered(host_name: Column, zone: Column) -> Column:
    """The suffix ``zone`` and the label before it; a host that is a suffix is its own."""
    before = F.substring(host_name, F.lit(1), F.length(host_name) - F.length(zone) - 1)
    return F.when(F.length(host_name) <= F.length(zone) + 1, host_name).otherwise(
        F.concat(F.substring_index(before, ".", -1), F.lit("."), zone))


def strength(members: DataFrame, n: str, k: str, prior: str, name: str) -> DataFrame:
    """One row with the strength of the beta-binomial prior of some members, whose prior means are given.

    With a within-level correlation r, n (k / n - mean)^2 has the expectation mean (1 - mean) (1 + (n - 1) r);
    r is what makes the sums of both sides equal, and the strength is 1 / r - 1. Members with one page say
    nothing about r and are left out of the sums.
    """
    mean, rate = F.col(prior), F.col(k) / F.col(n)
    spread = mean * (1 - mean)
    sums = members.filter(F.col(n) > 1).agg(F.sum(F.col(n) * (rate - mean) * (rate - mean)).alias("seen"), F.sum(spread).alias("chance"),
                       F.sum(spread * (F.col(n) - 1)).alias("room"))
    r = (F.col("seen") - F.col("chance")) / F.col("room")
    fitted = F.when(r > 0, F.least(F.greatest(1 / r - 1, F.lit(LEAST)), F.lit(MOST))).otherwise(F.lit(MOST))
    return sums.select(F.when(F.col("room") > 0, fitted).otherwise(F.lit(STRENGTH)).alias(name))


def reputation(pages: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, rep_pages, mean, upper) from columns host, as `bare` gives it, and good (0, 1 or null).

    The three levels are sums of the level below, so only the first reads pages; strengths are one row each.
    """
    hosts = (pages.filter("good is not null and host <> ''").groupBy("host")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
             .withColumn("zone", suffix(F.col("host"), suffixes)).withColumn("domain", registered(F.col("host"), F.col("zone"))))
    domains = hosts.groupBy("domain", "zone").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    zones = domains.groupBy("zone").agg(F.sum("dn").alias("zn"), F.sum("dk").alias("zk"))
    zones = zones.select("zone", ((F.col("zk") + 1) / (F.col("zn") + 2)).alias("z_mean"))
    domains = domains.join(zones, "zone")
    domains = domains.crossJoin(F.broadcast(strength(domains, "dn", "dk", "z_mean", "ds"))).select(
        "domain", ((F.col("dk") + F.col("z_mean") * F.col("ds")) / (F.col("dn") + F.col("ds"))).alias("d_mean"))
    hosts = hosts.join(domains, "domain")
    total = F.col("n") + F.col("hs")
    return (hosts.crossJoin(F.broadcast(strength(hosts, "n", "k", "d_mean", "hs")))
            .select("host", F.col("n").alias("rep_pages"), ((F.col("k") + F.col("d_mean") * F.col("hs")) / total).alias("mean"), total.alias("total"))
            .withColumn("upper", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1)))
            .select("host", "rep_pages", "mean", "upper"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]],
          floor: float = FLOOR, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for columns page_id, url and good."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                        F.col("good").cast("double").alias("good"))
    known = reputation(rows.select(bare(F.col("host")).alias("host"), "good"), z, suffixes).select(F.col("host").alias("rep_host"), "upper")
    rule, action = matched(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return (rows.select("page_id", "host", "path").join(known, bare(F.col("host")) == F.col("rep_host"), "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_host).alias("verdict")))
