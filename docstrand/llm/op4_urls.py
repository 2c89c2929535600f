"""URL filtering by rules and by empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import cut

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked when the lower bound of its share of bad pages, Z standard deviations below the mean, is above LIMIT.
LIMIT, Z = 0.5, 1.645
#: A prior counts as this many pages where the data do not tell, and at the least and most.
PRIOR, LEAST, MOST = 10.0, 1.0, 1000.0
#: Copies of the host table, so that a page of a hot host joins with one of that many tasks.
SALTS = 16

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A domain is the last two labels of a host, three where the middle one of them is a registry's and the last a country's;
#: its suffix is what follows its first label. The last label holds more than digits: a numeric address is a domain and
#: suffix by itself, so that it shares its reputation with no other.
DOMAIN = r"([^.:]+\.(?:co|com|net|org|ac|gov|edu)\.[a-z][a-z]|[^.:]+\.[^.:]*[^.:0-9][^.:]*)(?::[0-9]*)?$"
SUFFIX = r"^[^.]*\.(.*[^.:0-9][^.:]*)$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null or for what has no ://."""
    host = F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def prior_weight(counts: DataFrame) -> tuple[float, float]:
    """(m, mean) of the beta-binomial prior of groups with n outcomes and bad ones, by the method of moments."""
    r = counts.agg(
        F.count("*").alias("groups"), F.sum(F.col("n").cast("double")).alias("total"), F.sum(F.col("bad").cast("double")).alias("bad"),
        F.sum(F.col("bad").cast("double") / F.col("n") * F.col("bad")).alias("squares"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    if not r["total"]:
        return PRIOR, 0.0
    mean = r["bad"] / r["total"]
    spread = mean * (1 - mean)
    between = r["squares"] - mean * r["bad"] - spread * (r["groups"] - 1)
    within = spread * (r["total"] - r["nn"] / r["total"] - r["groups"] + 1)
    if within <= 1e-9:  # too few groups to tell
        return PRIOR, mean
    # no spread between groups beyond chance: the prior is as strong as allowed
    return (round(min(max(1 / (between / within) - 1, LEAST), MOST), 6) if between > 1e-9 else MOST), mean


def host_posteriors(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Hosts (host, n, bad, prior), domains and suffixes with their shrunk means, and the hosts' prior (m, mean).

    outcomes: (host, bad). Counts are summed by host before anything else; the levels above are sums of those. The
    share of bad pages of a suffix is shrunk toward the share of all, a domain's toward its suffix's, a host's toward
    its domain's, each with the weight that the spread between the groups of its level supports.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = cut(hosts.withColumns(levels(F.col("host"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(m: float, prior: Column) -> Column:
        return F.round((F.col("bad") + m * prior) / (F.col("n") + m), 9)

    m, mean = prior_weight(suffixes)
    s = suffixes.select("suffix", shrunk(m, F.lit(mean)).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(prior_weight(domains)[0], F.col("suffix_mean")).alias("domain_mean"))
    h = hosts.join(d, ["domain", "suffix"]).select("host", "n", "bad", F.col("domain_mean").alias("prior"))
    return h, d, s, prior_weight(hosts)


def levels(host: Column) -> dict[str, Column]:
    found = F.regexp_extract(host, DOMAIN, 1)
    domain = F.when(found == "", host).otherwise(found)
    suffix = F.regexp_extract(domain, SUFFIX, 1)
    return {"domain": domain, "suffix": F.when(suffix == "", domain).otherwise(suffix)}


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_bound of every page.

    outcomes: (page_id, bad boolean), at most one row a page counting; a null is no outcome. A page under a rule gets
    the rule's verdict. Any other is blocked if its host's posterior lower bound of the share of bad pages is above
    `limit`. A host without outcomes has its domain's mean, else its suffix's, else that of all, with the prior's
    weight. Each distinct host is judged once; pages join the hosts' table with salted keys, as one host may hold a
    third of the pages.

    A rule's path begins with "/", so a url without a path fits no rule, not even "org/". Urls of any length are read whole.
    A null url, or one without ://, has empty host and path, and is judged as the host "". Repeated rows are judged
    each; a null page_id has no outcome. Empty tables give no rows, or no outcomes. Other columns are not read.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    h, d, s, (m, mean_of_all) = host_posteriors(pages.join(bad, "page_id").select("host", "bad"))

    every = pages.select("host").distinct().withColumns(levels(F.col("host")))
    every = every.join(h.select("host", "n", "bad", "prior"), "host", "left").join(d, ["domain", "suffix"], "left").join(s, "suffix", "left")
    every = every.select(
        "host",
        F.coalesce("n", F.lit(0)).alias("n_labelled"),
        (F.coalesce("bad", F.lit(0)) + m * (p := F.coalesce("prior", "domain_mean", "suffix_mean", F.lit(mean_of_all)))).alias("alpha"),
        (F.coalesce("n", F.lit(0)) - F.coalesce("bad", F.lit(0)) + m * (1 - p)).alias("beta"),
    )
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    every = every.select("host", "n_labelled", F.round(mean, 6).alias("bad_mean"), F.round(bound, 6).alias("bad_bound"))

    salted = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    own = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "bad_mean", "bad_bound")


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from labels, whose doc_id is the page's: bad is low quality or toxic; null where neither label tells."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False))) | (F.coalesce(F.col("toxic") == 1, F.lit(False)))
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return labels.select(F.col("doc_id").alias("page_id"), F.when(known, bad).alias("bad"))


def op4_host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_urls(pages, label_outcomes(labels))


def oracle() -> str:
    rule = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{{}}'".replace("{}", r + "|" + v)
        for v, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
        for h, _, p in [r.partition("/")]
    )

    def weight(counts: str) -> str:
        return f"""(select round(coalesce(case when within > 1e-9 and between_ > 1e-9 then least(greatest(1 / (between_ / within) - 1, {LEAST}), {MOST}) end,
          case when within > 1e-9 then {MOST} end, {PRIOR}), 6) as m, coalesce(mean, 0.0) as mean from (
          select mean, squares - mean * bad - mean * (1 - mean) * (k - 1) as between_, mean * (1 - mean) * (total - nn / total - k + 1) as within from (
          select count(*) as k, sum(n)::double as total, sum(bad)::double as bad, sum(bad::double / n * bad) as squares, sum(n::double * n) as nn, sum(bad)::double / sum(n) as mean from {counts})))"""

    def level(column: str) -> str:
        return f"""select *, case when regexp_extract(d_, '{SUFFIX}', 1) = '' then d_ else regexp_extract(d_, '{SUFFIX}', 1) end as suffix, d_ as domain
          from (select *, case when regexp_extract(host, '{DOMAIN}', 1) = '' then host else regexp_extract(host, '{DOMAIN}', 1) end as d_ from {column})"""

    return f"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '{URL}', 2), '') as path from pages),
o as (select doc_id as page_id, max(case when coalesce(quality = 0, false) or coalesce(toxic = 1, false) then 1 else 0 end) as bad
    from labels where doc_id is not null and (quality is not null or toxic is not null) group by 1),
c as (select host, count(*) as n, sum(bad) as bad from p join o using (page_id) group by host),
hosts as ({level("c")}),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by 1),
s as (select suffix, round((bad + m * mean) / (n + m), 9) as suffix_mean from suffixes, {weight("suffixes")}),
d as (select domain, suffix, round((bad + m * suffix_mean) / (n + m), 9) as domain_mean from domains join s using (suffix), {weight("domains")}),
e as ({level("(select distinct host from p)")}),
j as (select e.host, coalesce(c.n, 0) as n, coalesce(c.bad, 0) as bad, coalesce(d.domain_mean, s.suffix_mean, w.mean) as prior, w.m
    from e left join c on c.host = e.host left join d on d.domain = e.domain and d.suffix = e.suffix left join s on s.suffix = e.suffix, {weight("hosts")} w),
k as (select host, n as n_labelled, mean, mean - {Z} * sqrt(mean * (1 - mean) / (n + m + 1)) as bound
    from (select *, (bad + m * prior) / (bad + m * prior + (n - bad + m * (1 - prior))) as mean from j)),
r as (select p.*, n_labelled, round(mean, 6) as bad_mean, round(bound, 6) as bad_bound, case {rule} end as hit from p join k using (host))
select page_id, host, path, split_part(hit, '|', 1) as rule, coalesce(split_part(hit, '|', 2), case when bad_bound > {LIMIT} then 'block' else 'allow' end) as verdict,
  n_labelled::bigint as n_labelled, bad_mean, bad_bound from r
"""
