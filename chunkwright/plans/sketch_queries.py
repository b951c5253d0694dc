"""Sketches over orders and line items; hit rates, cost model."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions.hashing import full_md5_mod
from chunkwright.operators import cost
from chunkwright.operators import sketch as X
from chunkwright.plans.register import Register
from chunkwright.tables import table

R = Register()


def mod(seed, value: str, size: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {value}::varchar), 1, 15))::bigint % {size})"


def at_sql(source: str, key: str, size: int, first: int, n: int) -> str:
    return " union all ".join(f"select {key}, {k} as row, {mod(first + k, key, size)} as col from {source}" for k in range(n))


BLOOM = f"with p as ({at_sql('orders', 'o_custkey', X.HOT_SIZE, 0, 4)}), b as (select distinct col as position from p)"
PROBE = BLOOM + f", a as (select distinct c_custkey, col from ({at_sql('customer', 'c_custkey', X.HOT_SIZE, 0, 4)})), r as (select c_custkey, count(b.position) = count(*) as maybe from a left join b on a.col = b.position group by 1)"


@R("bloom_positions", BLOOM + " select position from b")
def bloom_positions(spark, sf_dir):
    return X.bloom(table(spark, sf_dir, "orders"), "o_custkey")


@R("bloom_probe", PROBE + " select * from r")
def bloom_probe(spark, sf_dir):
    return X.probe(table(spark, sf_dir, "customer"), "c_custkey", X.bloom(table(spark, sf_dir, "orders"), "o_custkey"))


@R("bloom_cold_probe", f"""with p as ({at_sql('orders', 'o_custkey', X.COLD_SIZE, 2000, 4)}), b as (select distinct col as position from p), a as (select distinct c_custkey, col from ({at_sql('customer', 'c_custkey', X.COLD_SIZE, 2000, 4)}))
select c_custkey, count(b.position) = count(*) as maybe from a left join b on a.col = b.position group by 1""")
def bloom_cold_probe(spark, sf_dir):
    return X.probe(table(spark, sf_dir, "customer"), "c_custkey", bloom_cold(spark, sf_dir), X.COLD_SIZE, 2000)


@R("bloom_cold", f"with p as ({at_sql('orders', 'o_custkey', X.COLD_SIZE, 2000, 4)}) select distinct col as position from p")
def bloom_cold(spark, sf_dir):
    return X.bloom(table(spark, sf_dir, "orders"), "o_custkey", X.COLD_SIZE, 2000)


@R("bloom_fpr", PROBE + f", e as (select r.*, c_custkey in (select o_custkey from orders) as there from r) select count(*) as queries, count(*) filter (maybe) as positives, count(*) filter (maybe and not there) as false_positives, round(avg((maybe and not there)::int::double), 9) as rate from e")
def bloom_fpr(spark, sf_dir):
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    wrong = F.col("maybe") & F.col("there").isNull()
    return bloom_probe(spark, sf_dir).join(there, "c_custkey", "left").agg(F.count("*").alias("queries"), F.sum(F.col("maybe").cast("bigint")).alias("positives"), F.sum(wrong.cast("bigint")).alias("false_positives"), F.round(F.avg(wrong.cast("double")), 9).alias("rate"))


CMS = f"with c as (select row, col, count(*) as count from ({at_sql('lineitem', 'l_partkey', X.HOT_WIDTH, 1000, 4)}) group by 1, 2)"


@R("cms_cells", CMS + " select * from c")
def cms_cells(spark, sf_dir):
    return X.cells(table(spark, sf_dir, "lineitem"), "l_partkey")


@R("cms_estimate", CMS + f", a as ({at_sql('part', 'p_partkey', X.HOT_WIDTH, 1000, 4)}) select p_partkey, min(coalesce(c.count, 0)) as estimate from a left join c on a.row = c.row and a.col = c.col group by 1")
def cms_estimate(spark, sf_dir):
    return X.estimate(table(spark, sf_dir, "part"), "p_partkey", cms_cells(spark, sf_dir))


@R("cms_merge", f"with p as ({at_sql('lineitem', 'l_partkey', X.COLD_WIDTH, 3000, 4)}) select row, col, count(*) as count from p group by 1, 2")
def cms_merge(spark, sf_dir):
    """The sketches of two halves, merged, are the sketch of all."""
    t = table(spark, sf_dir, "lineitem")
    return X.merge_cells(*(X.cells(t.where(f"l_linenumber % 2 = {k}"), "l_partkey", X.COLD_WIDTH, 3000) for k in (0, 1)))


@R("tiered_bloom", f"""with f as (select o_custkey as k, count(*) as n from orders group by 1), t as (select k, case when n between 1 and 2 then 'low' when n between 3 and 5 then 'medium' else 'high' end as tier from f),
p as ({' union all '.join(f"select tier, ('0x' || substr(md5('{k}' || k::varchar || tier), 1, 15))::bigint % ({X.HOT_SIZE} * case tier when 'low' then 1 when 'medium' then 2 else 4 end) as position from t" for k in range(3))}) select distinct tier, position from p""")
def tiered_bloom(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return X.tiered(counts, "o_custkey", "n")


@R("legacy_positions", "with p as (select o_custkey, unnest([0, 1, 2]) as i from (select distinct o_custkey from orders)), h as (select o_custkey, i, md5(i::varchar || o_custkey::varchar || 'low') as d from p) select o_custkey, i, (('0x' || d)::uhugeint % 100003)::bigint as position from h")
def legacy_positions(spark, sf_dir):
    """Positions by all 128 bits of md5, the form of the whole-file engine's filters."""
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    return keys.withColumn("position", full_md5_mod(F.concat(F.col("i").cast("string"), F.col("o_custkey").cast("string"), F.lit("low")), 100_003))


TYPES = "with t as (select event_type, count(*) as queries, count(*) filter (value > 50) as hits, round(avg(value), 6) as cost from events group by 1)"


def hit_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("queries"), F.sum((F.col("value") > 50).cast("bigint")).alias("hits"), F.round(F.avg("value"), 6).alias("cost"))


@R("beta_confidence", TYPES + " select event_type, round((1 + hits) / (2 + queries)::double, 9) as p from t")
def beta_confidence(spark, sf_dir):
    return hit_rates(spark, sf_dir).select("event_type", F.round(cost.beta_mean(F.col("hits"), F.col("queries")), 9).alias("p"))


@R("legacy_confidence", TYPES + ", c as (select event_type, case when queries > 0 then greatest((5 + hits) / (7 + queries)::double, 0.2::double) else 5 / 7::double end as p from t) select event_type, round(p, 9) as p, p > 0.5 as hot_first from c")
def legacy_confidence(spark, sf_dir):
    p = cost.floored_confidence(F.col("hits"), F.col("queries"))
    return hit_rates(spark, sf_dir).select("event_type", F.round(p, 9).alias("p"), (p > 0.5).alias("hot_first"))


@R("bayes_risk", TYPES + """, x as (select a.event_type as hot, b.event_type as cold, a.cost as c_hot, b.cost as c_cold, (1 + a.hits) / (2 + a.queries)::double as p_hot, (1 + b.hits) / (2 + b.queries)::double as p_cold from t a, t b where a.event_type <> b.event_type)
select hot, cold, round(c_hot + (1 - p_hot) * c_cold, 6) as risk_hot_first, round(c_cold + (1 - p_cold) * c_hot, 6) as risk_cold_first, round(c_hot + (1 - p_hot) * c_cold, 6) <= round(c_cold + (1 - p_cold) * c_hot, 6) as hot_first from x""")
def bayes_risk(spark, sf_dir):
    """Every event type as a hot layer against every other as a cold one."""
    t = hit_rates(spark, sf_dir).withColumn("p", cost.beta_mean(F.col("hits"), F.col("queries")))
    a, b = (t.select(F.col("event_type").alias(x), F.col("cost").alias(f"c_{x}"), F.col("p").alias(f"p_{x}")) for x in ("hot", "cold"))
    risks = cost.risks(F.col("c_hot"), F.col("p_hot"), F.col("c_cold"), F.col("p_cold"))
    return a.crossJoin(b).where("hot <> cold").select("hot", "cold", *(F.round(r, 6).alias(f"risk_{n}_first") for n, r in zip(("hot", "cold"), risks))).withColumn("hot_first", F.col("risk_hot_first") <= F.col("risk_cold_first"))
