"""Distributions, series and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.operators import analysis as X
from chunkwright.operators import cost
from chunkwright.operators import index as I
from chunkwright.operators.chunking import cdc_sql
from chunkwright.plans.register import Register
from chunkwright.plans.storage_queries import CDC, SEEN, TWO, chunks, chunks_v2
from chunkwright.tables import table

R = Register()


def hist_sql(source: str, v: str, bins: int) -> str:
    return f", v as (select {v} as v from {source}), e as (select min(v) as low, max(v) as high from v) select case when high > low then least(floor((v - low) / ((high - low) / {bins})), {bins - 1}) else 0 end::bigint as bin, count(*) as n from v, e group by 1"


FILES = ", f as (select doc_id, count(*) as chunk_count, count(*) filter (nth > 1) as duplicate_chunks, count(*) filter (nth = 1) as unique_chunks, sum(size)::bigint as logical_size from o group by doc_id)"


@R("chunk_size_hist", CDC + hist_sql("cdc", "size::double", 60))
def chunk_size_hist(spark, sf_dir):
    return X.histogram(chunks(spark, sf_dir), "size", 60)


@R("log_hist", "with x as (select 1)" + hist_sql("documents where n_chars > 0", "log10(n_chars)", 50))
def log_hist(spark, sf_dir):
    return X.histogram(table(spark, sf_dir, "documents").where("n_chars > 0"), "n_chars", 50, log=True)


def _describe_sql(c: str) -> str:
    return f"select '{c}' as column, count({c}) as count, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, min({c})::double as min, round(quantile_cont({c}::double, 0.25), 2) as q1, round(quantile_cont({c}::double, 0.5), 2) as median, round(quantile_cont({c}::double, 0.75), 2) as q3, max({c})::double as max from f"


@R("describe_files", CDC + SEEN + FILES + " " + " union all ".join(map(_describe_sql, ("chunk_count", "duplicate_chunks", "logical_size"))))
def describe_files(spark, sf_dir):
    return X.describe(I.file_summary(chunks(spark, sf_dir)), ["chunk_count", "duplicate_chunks", "logical_size"])


@R("rolling_cost_1000", "select event_id, round((sum(round(greatest(value, 1.0::double) * 1e6)::bigint) over w)::double / 1e6 / count(*) over w, 6) as moving_mean from events window w as (partition by event_type order by event_id rows between 999 preceding and current row)")
def rolling_cost_1000(spark, sf_dir):
    return cost.moving_mean(table(spark, sf_dir, "events"), "event_id", "value", "event_type").select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


@R("rolling_centered_50", "select event_id, case when count(*) over w = 50 then round(avg(value) over w, 6) end as centred_mean from events window w as (partition by event_type order by event_id rows between 25 preceding and 24 following)")
def rolling_centered_50(spark, sf_dir):
    return X.centred_mean(table(spark, sf_dir, "events"), "event_id", "value", "event_type").select("event_id", F.round("centred_mean", 6).alias("centred_mean"))


SERIES = "with c as (select event_type, event_id, value, row_number() over w as file_index, sum(value) over (w rows between unbounded preceding and current row) as cumulative from events window w as (partition by event_type order by event_id)), s as (select *, case when cumulative <> 0 then file_index / cumulative end as speed from c)"


@R("cumulative_speed", SERIES + " select event_id, file_index, round(cumulative, 4) as cumulative, round(speed, 9) as speed from s")
def cumulative_speed(spark, sf_dir):
    return X.cumulative(table(spark, sf_dir, "events"), "event_id", "value", "event_type").select("event_id", "file_index", F.round("cumulative", 4).alias("cumulative"), F.round("speed", 9).alias("speed"))


@R("series_summary", SERIES + " select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, min(value) as least, max(value) as most, round(stddev_samp(value), 6) as std, round(max(speed), 9) as peak_speed, round(min(speed), 9) as min_speed, round(arg_max(speed, file_index), 9) as last_speed from s group by 1")
def series_summary(spark, sf_dir):
    s = X.cumulative(table(spark, sf_dir, "events"), "event_id", "value", "event_type")
    return s.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.max("speed"), 9).alias("peak_speed"), F.round(F.min("speed"), 9).alias("min_speed"), F.round(F.max_by("speed", "file_index"), 9).alias("last_speed"))


@R("size_time_corr", "select round(corr(length(props)::double, value), 6) as r from events")
def size_time_corr(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.corr(F.length("props").cast("double"), "value"), 6).alias("r"))


def _rank_sql(p: float) -> str:
    return f"max(case when k = least(floor({p} * n), n - 1) then value end) as p{round(p * 100)}"


@R("latency_percentiles", "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null) select event_type, " + ", ".join(map(_rank_sql, (0.5, 0.95, 0.99))) + " from r group by 1")
def latency_percentiles(spark, sf_dir):
    return cost.rank_percentiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99), ["event_type"])


@R("latency_percentiles_all", "with r as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events where value is not null) select " + ", ".join(map(_rank_sql, (0.5, 0.95, 0.99))) + " from r")
def latency_percentiles_all(spark, sf_dir):
    return cost.percentiles_by_rank(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99))


@R("trial_summary", "select o_orderpriority as method, count(*) as trials, round(avg(o_totalprice), 4) as mean_time, round(coalesce(stddev_samp(o_totalprice), 0), 4) as std_time, max(o_totalprice) as peak, arg_max(o_custkey, o_orderkey) as last_count from orders group by 1")
def trial_summary(spark, sf_dir):
    """Orders stand for trials, priorities for methods."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("trials"), F.round(F.avg("o_totalprice"), 4).alias("mean_time"), F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)), 4).alias("std_time"), F.max("o_totalprice").alias("peak"), F.max_by("o_custkey", "o_orderkey").alias("last_count"))


@R("group_size_hist", "with g as (select count(*) as size from documents group by text having count(*) > 1) select size, count(*) as n from g group by 1")
def group_size_hist(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("size")).where("size > 1").groupBy("size").agg(F.count("*").alias("n"))


def run_row(c):
    t = I.totals(c)
    return t.withColumn("share_duplicate", F.col("duplicate_refs") / F.greatest("total_refs", F.lit(1)))


def _row_sql(name: str, source: str) -> str:
    return f"""{name}i as (select digest, any_value(size) as size, count(*) as n from {source} group by 1),
{name} as (select (select count(distinct doc_id) from {source}) as files, sum(n) as chunks, count(*) as unique_chunks, sum(n) - count(*) as duplicate_refs, sum(size * n) as logical_bytes, sum(size) as unique_bytes, (select round(avg(size), 6) from {source}) as avg_chunk, (select min(size) from {source}) as min_chunk, (select max(size) from {source}) as max_chunk, round(sum(size * n) / sum(size), 6) as dedup_ratio, (sum(n) - count(*)) / sum(n) as share_duplicate from {name}i)"""


NUMBERS = [(m, h) for m, h in X.METRICS if h != "str"]
UNIT = "case " + " ".join(f"when abs({{v}}) < {1024.0 ** (k + 1)} then printf('%.2f {u}', {{v}} / {1024.0**k}::double)" for k, u in enumerate(["B", "KB", "MB", "GB", "TB"])) + f" else printf('%.2f PB', {{v}} / {1024.0**5}::double) end"


def _shown_sql(v: str, pct: str) -> str:
    return f"case hint when 'int' then printf('%d', {v}::bigint) when 'bytes' then {UNIT.format(v=v)} when 'float0' then printf('%.0f', {v}) when 'pct' then printf('%.2f{pct}', {v} * 100) else printf('%.4f', {v}) end"


def _long_sql(name: str) -> str:
    return " union all ".join(f"select '{m}' as metric, '{h}' as hint, {m}::double as v from {name}" for m, h in NUMBERS)


@R("run_diff", TWO + f""", {_row_sql("r1", "cdc")}, {_row_sql("r2", "cdc2")}, x as (select metric, hint, a.v as a, b.v as b from ({_long_sql("r1")}) a join ({_long_sql("r2")}) b using (metric, hint)),
d as (select *, abs(b - a) as d from x)
select metric, {_shown_sql("a", "%%")} as first, {_shown_sql("b", "%%")} as second, case when b > a then '+' when b < a then '-' else '' end || {_shown_sql("d", " pp")} as delta from d""")
def run_diff(spark, sf_dir):
    pick = lambda c: run_row(c).withColumn("chunks", F.col("total_refs"))
    return X.run_diff(pick(chunks(spark, sf_dir)), pick(chunks_v2(spark, sf_dir)))


@R("key_metrics", CDC + f", {_row_sql('r1', 'cdc')}, x as ({_long_sql('r1')}) select metric, {_shown_sql('v', '%%')} as value from x")
def key_metrics(spark, sf_dir):
    long = X.long_form(run_row(chunks(spark, sf_dir)).withColumn("chunks", F.col("total_refs")), "v")
    return long.select("metric", X.shown(F.col("v"), F.col("hint")).alias("value"))


CHECKS = {
    "chunks_found": "chunks > 0",
    "sizes_vary": "max_chunk > min_chunk",
    "no_chunk_above_max": "max_chunk <= 4096",
    "duplicates_found": "duplicate_refs > 0",
    "saves_space": "unique_bytes < logical_bytes",
    "ratio_above_one": "dedup_ratio > 1",
    "references_add_up": "unique_chunks + duplicate_refs = chunks",
}


@R("requirement_checklist", CDC + f", {_row_sql('r1', 'cdc')}, x as (" + " union all ".join(f"select '{k}' as requirement, ({v}) as met from r1" for k, v in CHECKS.items()) + ") select requirement, met, sum(met::int) over ()::bigint as n_met from x")
def requirement_checklist(spark, sf_dir):
    row = run_row(chunks(spark, sf_dir)).withColumn("chunks", F.col("total_refs"))
    checks = F.array(*(F.struct(F.lit(k).alias("requirement"), F.expr(v).alias("met")) for k, v in CHECKS.items()))
    met = sum((F.expr(v).cast("bigint") for v in CHECKS.values()), F.lit(0).cast("bigint"))
    return row.select(met.alias("n_met"), F.explode(checks).alias("x")).select("x.requirement", "x.met", "n_met")




@R("pages_chunks", "with recursive " + cdc_sql(source="pages", key="page_id", text="html") + " select * from cdc")
def pages_chunks(spark, sf_dir):
    from chunkwright.operators.chunking import SMALL, chunk

    return chunk(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), "page_id", "content", SMALL)
