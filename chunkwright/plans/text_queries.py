"""Cleaning, filtering, placing and mutating texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chunkwright.functions.hashing import format_bytes
from chunkwright.operators import textprep as X
from chunkwright.plans.register import Register
from chunkwright.tables import table

R = Register()
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STEPS = [
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"),
    (rf"\[https?://[^{_BLANK}]+[{_BLANK}]+([^\]]+)\]", r"\1"),
    ("==+([^=]+)==+", r"\1"),
    ("''''+", ""),
    ("<[^>]+>", ""),
    (r"\n\n\n+", r"\n\n"),
    (rf"^[{_BLANK}]+", ""),
    (rf"[{_BLANK}]+$", ""),
]


def _clean(text: str) -> str:
    for pattern, to in _STEPS:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10) || chr(10)' if to.startswith(chr(92) + 'n') else repr(to)}, 'g')"
    return text


def _outside(texts: str) -> str:
    """CTEs up to ``kept``: (doc_id, text) of ``texts`` at depth 0. The depth is a running sum of +1 and -1 that never falls below 0."""
    return rf"""src as ({texts}),
tok as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as tok from (select doc_id, regexp_extract_all(text, '\{{\{{|\}}\}}|[^{{}}]+|[{{}}]') as x from src)),
run as (select *, sum(case tok when '{{{{' then 1 when '}}}}' then -1 else 0 end) over (partition by doc_id order by i) as s from tok),
deep as (select *, s - least(0, min(s) over (partition by doc_id order by i)) as depth from run),
seen as (select *, depth = 0 and lag(depth, 1, 0) over (partition by doc_id order by i) = 0 as out from deep),
shown as (select doc_id, string_agg(tok, '' order by i) filter (out) as text from seen group by doc_id),
kept as (select src.doc_id, case when src.text is null then null else coalesce(shown.text, '') end as text from src left join shown using (doc_id))"""


CLEAN = _clean("html")
#: Texts with nested templates, open ones and stray braces, made of the documents' own signs.
_BRACED = "select doc_id, replace(replace(text, ', ', '{{'), '. ', '}}') as text from documents"


@R("strip_markup", f"select page_id, {CLEAN} as text from pages")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@R("remove_templates", f"with {_outside('select doc_id, text from documents')} select * from kept")
def remove_templates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.remove_templates(F.col("text")).alias("text"))


@R("remove_nested_templates", f"with {_outside(_BRACED)} select * from kept")
def remove_nested_templates(spark, sf_dir):
    """Every document with its commas as opening and its full stops as closing braces."""
    braced = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("{{")), F.lit(". "), F.lit("}}"))
    return table(spark, sf_dir, "documents").select("doc_id", X.remove_templates(braced).alias("text"))


@R("article_filter", f"with c as (select page_id, url, {CLEAN} as text from pages) select page_id, length(text) as chars from c where trim(url) <> '' and text <> '' and not starts_with(upper(ltrim(text)), '#REDIRECT')")
def article_filter(spark, sf_dir):
    """pages has no namespace: all are in 0."""
    c = table(spark, sf_dir, "pages").select("page_id", "url", F.lit(0).alias("ns"), X.strip_markup(F.col("html")).alias("text"))
    return c.where(X.is_article(F.col("url"), F.col("ns"), F.col("text"))).select("page_id", F.length("text").cast("bigint").alias("chars"))


@R("length_filter", f"with {_outside('select doc_id, text from documents')}, c as (select doc_id, length({_clean('text')}) as chars from kept) select doc_id, chars from c where chars >= 500")
def length_filter(spark, sf_dir):
    """All documents of at least 500 characters once templates and markup are removed."""
    text = X.strip_markup(X.remove_templates(F.col("text")))
    # a filter on a column is moved below it and evaluates the text again
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.array(F.length(text).cast("bigint")), lambda n: n >= 500)).alias("chars"))


@R("shard_paths", "with n as (select doc_id, row_number() over (order by doc_id) - 1 as k from documents) select doc_id, lpad((k // 100)::varchar, 2, '0') || '/' || lpad(k::varchar, 6, '0') || '.txt' as path from n")
def shard_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / F.lit(4096)).alias("range"))
    base = docs.groupBy("range").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "base")
    k = F.col("base") + F.row_number().over(W.partitionBy("range").orderBy("doc_id")) - 1
    return docs.join(base, "range").select("doc_id", X.shard_path(k, 100).alias("path"))


@R("mutate_articles", f"select doc_id, {X._below('doc_id::varchar', '42', X.FRACTION)} as chosen from documents")
def mutate_articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.chosen(F.col("doc_id")).alias("chosen"))


@R("mutate_lines", f"select doc_id, {X.mutate_sql()} as text from documents")
def mutate_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.mutate_lines(F.col("text"), F.col("doc_id")).alias("text"))


@R("second_version", X.second_version_sql())
def second_version(spark, sf_dir):
    return X.second_version(table(spark, sf_dir, "documents"))


UNITS = "case " + " ".join(f"when abs(v) < {1024.0 ** (k + 1)} then printf('%.2f {u}', v / {1024.0**k}::double)" for k, u in enumerate(["B", "KB", "MB", "GB", "TB"])) + f" else printf('%.2f PB', v / {1024.0**5}::double) end"


@R("format_bytes", f"with x as (select doc_id, (octet_length(encode(text)) * power(1024, doc_id % 6))::double as v from documents) select doc_id, {UNITS} as size from x")
def byte_sizes(spark, sf_dir):
    size = F.octet_length(F.encode("text", "UTF-8")) * F.pow(F.lit(1024), F.col("doc_id") % 6)
    return table(spark, sf_dir, "documents").select("doc_id", format_bytes(size).alias("size"))
