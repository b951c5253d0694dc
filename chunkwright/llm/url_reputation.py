"""Host reputation by empirical Bayes: page outcomes shrunk from host to registered domain to public suffix.

A page's host is what its URL has between "//" (and user name) and port, path, query or fragment, in lower case, without a
last dot. Its suffix is the longest of SUFFIXES that ends it, else its last label; the registered domain is one label more (a host
that is a suffix, or an address of numbers, is its own domain and suffix). A page's outcome is the label of the document its URL names (the
first number of its path): good if quality = 1 and toxic = 0. Pages without a label have no outcome but are filtered as the others.

Beta-binomial shrinkage. With g good of n labelled pages, a node under prior mean m and strength k has the posterior
Beta(m k + g, (1 - m) k + n - g). The mean m of a suffix's prior is the share of good ones in all, of a domain its suffix's posterior
mean, of a host its domain's. The strength k of a level is the beta-binomial's moment estimate from all its nodes of two labelled pages or more:
with r = g / n, p the pooled mean, S = sum n (r - p)^2 / (number of nodes - 1) and N = (sum n - sum n^2 / sum n) / (nodes - 1),
the correlation is rho = (S - p (1 - p)) / ((N - 1) p (1 - p)) and k = 1 / rho - 1, held within [1, 1000]; with
too few nodes it is 10.

Filter: a page stays if the lower bound, posterior mean - Z standard deviations, is at least KEEP. Values are rounded to 9 digits.

Result: (page_id, host, n_host, posterior_mean, lower_bound, keep) of every page; a null or hostless URL has host '' and
is judged as a suffix of its own ''. Repeated rows count as often as they come; a document labelled twice counts with its
worst label. With no label at all the prior is 1/2. Only ids, URLs and labels are read, and sums by host are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za"]
Z, KEEP = 1.645, 0.5
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.$", ""), F.lit(""))


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    plain = (F.size(labels) < 2) | host.rlike(r"^[0-9.]+$")
    return F.when(plain, host).when(two.isin(SUFFIXES), two).otherwise(F.element_at(labels, -1))


def domain_of(host: Column, suffix: Column) -> Column:
    depth = F.size(F.split(suffix, r"\.")) + 1
    labels = F.split(host, r"\.")
    plain = host.rlike(r"^[0-9.]+$") | (host == suffix)
    return F.when(plain, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), depth), "."))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, good): good is null without a label."""
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    path = F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/(?:[^?#]*/)?([0-9]+)", 1)
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path.try_cast("bigint").alias("doc_id"))
    return named.join(judged, "doc_id", "left").select("page_id", "host", "good")


def strength(nodes: DataFrame) -> DataFrame:
    """One row: k, the moment estimate over (g, n)."""
    some = nodes.where("n >= 2").select(F.col("g").cast("double").alias("g"), F.col("n").cast("double").alias("n"))
    # sum n (g/n - p)^2 = sum g^2/n - (sum g)^2 / sum n
    s = some.agg(F.count("*").cast("double").alias("c"), F.sum("g").alias("sg"), F.sum("n").alias("sn"), F.sum(F.col("n") * F.col("n")).alias("snn"), F.sum(F.round(F.col("g") * F.col("g") * 1e6 / F.col("n")).cast("bigint")).cast("double").alias("sgg"))
    p = F.col("sg") / F.col("sn")
    v = p * (1 - p)
    sizes = (F.col("sn") - F.col("snn") / F.col("sn")) / (F.col("c") - 1)
    spread = (F.col("sgg") / 1e6 - F.col("sg") * F.col("sg") / F.col("sn")) / (F.col("c") - 1)
    s = s.where("c >= 2").select(v.alias("v"), sizes.alias("m"), spread.alias("s"))
    rho = F.when((F.col("v") > 0) & (F.col("m") > 1), (F.col("s") - F.col("v")) / ((F.col("m") - 1) * F.col("v")))
    k = F.when(rho.isNull(), F.lit(10.0)).when(rho <= 1 / 1001, F.lit(1000.0)).otherwise(F.greatest(1 / rho - 1, F.lit(1.0)))
    return s.select(F.round(k, 6).alias("k")).agg(F.coalesce(F.max("k"), F.lit(10.0)).alias("k"))


def reputation(judged: DataFrame) -> DataFrame:
    """(host, n, g, posterior_mean, lower_bound) of every host in (host, good)."""
    hosts = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    top = suffixes.agg(F.coalesce(F.sum("g") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("m"))

    def posterior(nodes: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
        joined = nodes.join(prior, on) if on else nodes.crossJoin(prior)
        joined = joined.crossJoin(strength(nodes))  # one row
        return joined.withColumns({"a": F.col("m") * F.col("k") + F.col("g"), "b": (1 - F.col("m")) * F.col("k") + F.col("n") - F.col("g")})

    mean = F.col("a") / (F.col("a") + F.col("b"))
    s = posterior(suffixes, top, []).select("suffix", mean.alias("m"))
    d = posterior(domains, s, ["suffix"]).select("suffix", "domain", mean.alias("m"))
    h = posterior(hosts, d, ["suffix", "domain"])
    deviation = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return h.select("host", "n", "g", F.round(mean, 9).alias("posterior_mean"), F.round(mean - Z * deviation, 9).alias("lower_bound"))


def judge(pages: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    judged = outcomes(pages, labels)
    known = reputation(judged)
    return judged.select("page_id", "host").join(known, "host").select("page_id", "host", F.col("n").alias("n_host"), "posterior_mean", "lower_bound", (F.col("lower_bound") >= keep).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    known = ", ".join(f"'{s}'" for s in SUFFIXES)

    def strength_sql(name: str, nodes: str) -> str:
        return f"""{name}_s as (select count(*)::double as c, sum(g::double) as sg, sum(n::double) as sn, sum(n::double * n::double) as snn, sum(round(g::double * g::double * 1e6 / n::double)::bigint)::double as sgg from {nodes} where n >= 2),
{name}_v as (select sg / sn * (1 - sg / sn) as v, (sn - snn / sn) / (c - 1) as m, (sgg / 1e6 - sg * sg / sn) / (c - 1) as s from {name}_s where c >= 2),
{name}_r as (select case when v > 0 and m > 1 then (s - v) / ((m - 1) * v) end as rho from {name}_v),
{name} as (select coalesce(max(round(case when rho is null then 10.0::double when rho <= 1 / 1001::double then 1000.0::double else greatest(1 / rho - 1, 1.0::double) end, 6)), 10.0::double) as k from {name}_r)"""

    return rf"""
with judged as (select doc_id, min((quality = 1 and coalesce(toxic, 0) = 0)::int) as good from labels where doc_id is not null group by doc_id),
p as (select page_id, coalesce(regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '\.$', ''), '') as host, try_cast(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/(?:[^?#]*/)?([0-9]+)', 1) as bigint) as doc_id from pages),
o as (select page_id, host, good from p left join judged using (doc_id)),
h0 as (select host, count(good) as n, coalesce(sum(good), 0)::bigint as g, string_split(host, '.') as x from o group by host),
h1 as (select *, case when len(x) < 2 or regexp_matches(host, '^[0-9.]+$') then host when array_to_string(x[-2:], '.') in ({known}) then array_to_string(x[-2:], '.') else x[-1] end as suffix from h0),
hosts as (select *, case when regexp_matches(host, '^[0-9.]+$') or host = suffix then host else array_to_string(x[greatest(len(x) - len(string_split(suffix, '.')), 1):], '.') end as domain from h1),
domains as (select suffix, domain, sum(n)::bigint as n, sum(g)::bigint as g from hosts group by all),
suffixes as (select suffix, sum(n)::bigint as n, sum(g)::bigint as g from domains group by all),
top as (select coalesce(sum(g) / nullif(sum(n), 0)::double, 0.5::double) as m from suffixes),
{strength_sql("k1", "suffixes")},
{strength_sql("k2", "domains")},
{strength_sql("k3", "hosts")},
s as (select suffix, (m * k + g) / (m * k + g + ((1 - m) * k + n - g)) as m from suffixes, top, k1),
d as (select suffix, domain, (m * k + g) / (m * k + g + ((1 - m) * k + n - g)) as m from domains join s using (suffix), k2),
b as (select host, n, m * k + g as a, (1 - m) * k + n - g as b from hosts join d using (suffix, domain), k3),
r as (select host, n, round(a / (a + b), 9) as posterior_mean, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) as lower_bound from b)
select page_id, host, n as n_host, posterior_mean, lower_bound, lower_bound >= {KEEP} as keep from o join r using (host)
"""


SQL = _sql()
