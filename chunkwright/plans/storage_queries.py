"""Chunk index, recipes, versions, containers, deletion and accounting over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.operators import index as X
from chunkwright.operators.chunking import SMALL, cdc_sql, chunk, document_chunks
from chunkwright.operators.textprep import second_version, second_version_sql
from chunkwright.plans.register import Register
from chunkwright.tables import table

R = Register()
CDC = "with recursive " + cdc_sql()
SEEN = ", o as (select *, row_number() over (partition by digest order by doc_id, ordinal) as nth from cdc)"
INDEX = ", i as (select digest, any_value(size) as size, count(*) as refcount from cdc group by digest)"
#: Both versions: chunks of the first one are "stored".
TWO = f"with recursive v2 as ({second_version_sql()}), {cdc_sql()}, {cdc_sql(source='v2', name='cdc2')}"


def chunks(spark, sf_dir) -> DataFrame:
    return document_chunks(table(spark, sf_dir, "documents"))


def chunks_v2(spark, sf_dir) -> DataFrame:
    return document_chunks(second_version(table(spark, sf_dir, "documents")))


R("cdc_chunks", CDC + " select * from cdc")(chunks)


@R("storage_by_source", CDC + SEEN + """, s as (select d.source, count(distinct o.doc_id) as files, count(*) as chunks, count(*) filter (nth = 1) as unique_chunks, count(*) filter (nth > 1) as duplicate_refs, sum(size)::bigint as logical_bytes, coalesce(sum(size) filter (nth = 1), 0)::bigint as unique_bytes from o join documents d using (doc_id) group by 1)
select *, case when unique_bytes > 0 then round(logical_bytes / unique_bytes, 6) else 1.0::double end as dedup_ratio from s""")
def storage_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = X.occurrences(document_chunks(docs)).join(docs.select("doc_id", "source"), "doc_id")
    new = F.col("duplicate") == 0
    out = seen.groupBy("source").agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("chunks"), F.sum(new.cast("bigint")).alias("unique_chunks"), F.sum((~new).cast("bigint")).alias("duplicate_refs"), F.sum("size").alias("logical_bytes"), F.sum(F.when(new, F.col("size")).otherwise(0)).alias("unique_bytes"))
    return out.withColumn("dedup_ratio", X.ratio(F.col("logical_bytes"), F.col("unique_bytes")))


@R("chunk_index", CDC + SEEN + " select digest, any_value(size) as size, count(*) as refcount, count(*) as frequency, max(case when nth = 1 then doc_id end) as first_doc, max(case when nth = 1 then ordinal end) as first_ordinal from o group by digest")
def chunk_index(spark, sf_dir):
    return X.index(chunks(spark, sf_dir))


@R("chunk_first_occurrence", CDC + SEEN + " select doc_id, ordinal, digest, nth, (nth > 1)::int as duplicate from o")
def chunk_first_occurrence(spark, sf_dir):
    return X.occurrences(chunks(spark, sf_dir)).select("doc_id", "ordinal", "digest", "nth", "duplicate")


@R("layer_classification", TWO + ", o as (select *, row_number() over (partition by digest order by doc_id, ordinal) as nth from cdc2) select doc_id, ordinal, digest, case when nth > 1 then 'hot' when digest in (select digest from cdc) then 'cold' else 'miss' end as layer from o")
def layer_classification(spark, sf_dir):
    return X.layers(chunks_v2(spark, sf_dir), X.first_of(chunks(spark, sf_dir))).select("doc_id", "ordinal", "digest", "layer")


@R("layer_cold_first", TWO + " select doc_id, ordinal, case when row_number() over (partition by digest order by doc_id, ordinal) > 1 or digest in (select digest from cdc) then 'cold' else 'miss' end as layer from cdc2")
def layer_cold_first(spark, sf_dir):
    return X.layers(chunks_v2(spark, sf_dir), X.first_of(chunks(spark, sf_dir)), hot_first=False).select("doc_id", "ordinal", "layer")


@R("layer_share", TWO + ", o as (select case when row_number() over (partition by digest order by doc_id, ordinal) > 1 then 'hot' when digest in (select digest from cdc) then 'cold' else 'miss' end as layer from cdc2) select layer, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from o group by layer")
def layer_share(spark, sf_dir):
    counts = X.layers(chunks_v2(spark, sf_dir), X.first_of(chunks(spark, sf_dir))).groupBy("layer").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(whole).select("layer", "n", F.round(100.0 * F.col("n") / F.col("whole"), 6).alias("percent"))


@R("file_recipes", CDC + SEEN + " select doc_id, ordinal, digest as chunk_hash, file_offset, size, (nth > 1)::int as duplicate from o")
def file_recipes(spark, sf_dir):
    return X.recipes(chunks(spark, sf_dir)).orderBy("doc_id", "ordinal")


@R("file_summary", CDC + SEEN + " select doc_id, count(*) as chunk_count, count(*) filter (nth > 1) as duplicate_chunks, count(*) filter (nth = 1) as unique_chunks, sum(size)::bigint as logical_size from o group by doc_id")
def file_summary(spark, sf_dir):
    return X.file_summary(chunks(spark, sf_dir))


@R("file_uniqueness", CDC + SEEN + ", f as (select doc_id, count(*) filter (nth > 1) as dup, sum(size)::bigint as size from o group by doc_id) select case when dup = 0 then 'unique' else 'shared' end as kind, count(*) as files, sum(size)::bigint as bytes from f group by 1")
def file_uniqueness(spark, sf_dir):
    kind = F.when(F.col("duplicate_chunks") == 0, "unique").otherwise("shared")
    return X.file_summary(chunks(spark, sf_dir)).groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("logical_size").alias("bytes"))


@R("duplicate_chunks", CDC + INDEX + " select digest as chunk_hash, size as chunk_size, refcount, refcount - 1 as duplicate_references from i where refcount > 1")
def duplicate_chunks(spark, sf_dir):
    return X.index(chunks(spark, sf_dir)).where("refcount > 1").select(F.col("digest").alias("chunk_hash"), F.col("size").alias("chunk_size"), "refcount", (F.col("refcount") - 1).alias("duplicate_references")).orderBy(F.desc("refcount"), F.desc("chunk_size"), "chunk_hash")


@R("unique_chunks", CDC + INDEX + " select digest as chunk_hash, size as chunk_size, refcount from i")
def unique_chunks(spark, sf_dir):
    return X.index(chunks(spark, sf_dir)).select(F.col("digest").alias("chunk_hash"), F.col("size").alias("chunk_size"), "refcount").orderBy("chunk_hash")


@R("top_chunks", CDC + INDEX + " select substr(digest, 1, 10) as chunk, size, refcount from i order by refcount desc, size desc, digest limit 15")
def top_chunks(spark, sf_dir):
    return X.index(chunks(spark, sf_dir)).orderBy(F.desc("refcount"), F.desc("size"), "digest").limit(15).select(F.substring("digest", 1, 10).alias("chunk"), "size", "refcount")


TOTALS = """, a as (select count(*) as unique_chunks, coalesce(sum(size), 0)::bigint as unique_bytes, coalesce(sum(refcount), 0)::bigint as total_refs from i),
b as (select count(distinct doc_id) as files, coalesce(sum(size), 0)::bigint as logical_bytes, round(avg(size), 6) as avg_chunk, min(size) as min_chunk, max(size) as max_chunk from cdc),
t as (select *, greatest(total_refs - unique_chunks, 0) as duplicate_refs, case when unique_bytes > 0 then round(logical_bytes / unique_bytes, 6) else 1.0::double end as dedup_ratio from a, b)"""


@R("index_stats", CDC + INDEX + TOTALS + " select * from t")
def index_stats(spark, sf_dir):
    return X.totals(chunks(spark, sf_dir))


@R("storage_saved", CDC + INDEX + TOTALS + " select logical_bytes, unique_bytes, round(greatest(logical_bytes - unique_bytes, 0) / 1e9::double, 9) as saved_gb from t")
def storage_saved(spark, sf_dir):
    return X.totals(chunks(spark, sf_dir)).select("logical_bytes", "unique_bytes", F.round(F.greatest(F.col("logical_bytes") - F.col("unique_bytes"), F.lit(0)) / F.lit(1e9), 9).alias("saved_gb"))


@R("index_logical_bytes", CDC + INDEX + TOTALS + " select (unique_chunks * 240 + duplicate_refs * 184 + files * 128 + total_refs * 96 + 32)::bigint as index_bytes from t")
def index_logical_bytes(spark, sf_dir):
    t = X.totals(chunks(spark, sf_dir))
    return t.select(X.index_bytes(F.col("unique_chunks"), F.col("duplicate_refs"), F.col("files"), F.col("total_refs")).alias("index_bytes"))


@R("statistics_row", TWO + """, i1 as (select digest, any_value(size) as size, count(*) as n from cdc group by 1), i2 as (select digest, any_value(size) as size, count(*) as n from cdc2 group by 1),
u as (select digest, any_value(size) as size, sum(n) as n from (select * from i1 union all select * from i2) group by 1),
s as (select count(*) as chunks, count(distinct doc_id) as files, sum(size)::bigint as logical_bytes from cdc2),
c as (select count(*) as unique_chunks, sum(size)::bigint as unique_bytes, (sum(n) - count(*))::bigint as duplicate_refs from u),
n as (select count(*) as new_chunks, coalesce(sum(size), 0)::bigint as new_bytes from i2 where digest not in (select digest from i1))
select chunks, files, logical_bytes, unique_chunks, unique_bytes, duplicate_refs, new_chunks, new_bytes, round(logical_bytes / unique_bytes, 6) as mixed_ratio, round(logical_bytes / greatest(new_bytes, 1), 6) as session_ratio,
 round((select sum(size * n) from u) / unique_bytes, 6) as cumulative_ratio from s, c, n""")
def statistics_row(spark, sf_dir):
    """A second pass against the store of the first: the mixed ratio divides its bytes by all that is stored; the others are of one scope each."""
    one, two = chunks(spark, sf_dir), chunks_v2(spark, sf_dir)
    old, new = X.index(one), X.index(two)
    both = X.merge(old, new)
    s = two.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("files"), F.sum("size").alias("logical_bytes"))
    c = both.agg(F.count("*").alias("unique_chunks"), F.sum("size").alias("unique_bytes"), (F.sum("refcount") - F.count("*")).alias("duplicate_refs"), F.sum(F.col("size") * F.col("refcount")).alias("w"))
    n = new.join(old, "digest", "left_anti").agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("new_bytes"))
    return s.crossJoin(c).crossJoin(n).select("chunks", "files", "logical_bytes", "unique_chunks", "unique_bytes", "duplicate_refs", "new_chunks", "new_bytes", F.round(F.col("logical_bytes") / F.col("unique_bytes"), 6).alias("mixed_ratio"), F.round(F.col("logical_bytes") / F.greatest("new_bytes", F.lit(1)), 6).alias("session_ratio"), F.round(F.col("w") / F.col("unique_bytes"), 6).alias("cumulative_ratio"))


@R("index_merge", TWO + ", u as (select digest, size from cdc union all select digest, size from cdc2) select digest, any_value(size) as size, count(*) as refcount from u group by digest")
def index_merge(spark, sf_dir):
    return X.merge(X.index(chunks(spark, sf_dir)), X.index(chunks_v2(spark, sf_dir))).select("digest", "size", "refcount")


@R("version_reuse_semi", TWO + " select doc_id, ordinal, size, digest from cdc2 where digest in (select digest from cdc)")
def version_reuse_semi(spark, sf_dir):
    return chunks_v2(spark, sf_dir).join(chunks(spark, sf_dir).select("digest").distinct(), "digest", "left_semi").select("doc_id", "ordinal", "size", "digest")


@R("version_new_anti", TWO + " select doc_id, ordinal, size, digest from cdc2 where digest not in (select digest from cdc)")
def version_new_anti(spark, sf_dir):
    return chunks_v2(spark, sf_dir).join(chunks(spark, sf_dir).select("digest").distinct(), "digest", "left_anti").select("doc_id", "ordinal", "size", "digest")


@R("chunk_lookup", CDC + INDEX + " select d.doc_id, d.ordinal, d.digest, i.refcount from cdc d left join i on d.digest = i.digest")
def chunk_lookup(spark, sf_dir):
    """A batch of point lookups, here of all chunks, is one equi-join."""
    c = chunks(spark, sf_dir)
    return c.select("doc_id", "ordinal", "digest").join(X.index(c).select("digest", "refcount"), "digest", "left").select("doc_id", "ordinal", "digest", "refcount")


CAP = 1 << 20


@R("container_offsets", CDC + f""", f as (select digest, any_value(size) as size, min((doc_id, ordinal)) as p from cdc group by digest), r as (select digest, size, sum(size) over (order by p) - size as pos from f),
k as (select *, pos // {CAP} + 1 as container_id from r) select digest, size, container_id::bigint as container_id, (pos - min(pos) over (partition by container_id))::bigint as container_offset from k""")
def container_offsets(spark, sf_dir):
    return X.containers(chunks(spark, sf_dir), CAP)


@R("container_next_fit", CDC + f""", f as (select digest, any_value(size) as size, min((doc_id, ordinal)) as p from cdc group by digest), r as (select digest, size, row_number() over (order by p) as k from f),
n as (select digest, size, k, 1::bigint as container_id, 0::bigint as container_offset from r where k = 1
  union all select r.digest, r.size, r.k, case when n.container_offset + n.size + r.size > {1 << 16} then n.container_id + 1 else n.container_id end, case when n.container_offset + n.size + r.size > {1 << 16} then 0 else n.container_offset + n.size end from n join r on r.k = n.k + 1)
select digest, size, container_id, container_offset from n""")
def container_next_fit(spark, sf_dir):
    return X.containers_next_fit(chunks(spark, sf_dir), 1 << 16)


@R("layer_lru", TWO + """, o as (select doc_id, ordinal, digest, row_number() over (order by doc_id, ordinal) as k from cdc2),
l as (select *, lag(k) over (partition by digest order by k) as was from o),
d as (select l.*, (select count(distinct x.digest) from o x where x.k > l.was and x.k < l.k) as between_ from l)
select doc_id, ordinal, digest, case when was is not null and between_ < 64 then 'hot' when was is not null or digest in (select digest from cdc) then 'cold' else 'miss' end as layer from d""")
def layer_lru(spark, sf_dir):
    """A hot layer of the 64 digests used last."""
    return X.layers_lru(chunks_v2(spark, sf_dir), X.first_of(chunks(spark, sf_dir)), 64)


GONE = ", gone as (select doc_id from documents where doc_id % 5 = 0), k as (select i.digest, i.size, i.refcount as frequency, i.refcount - coalesce(x.n, 0) as refcount from i left join (select digest, count(*) as n from cdc where doc_id in (select doc_id from gone) group by 1) x on i.digest = x.digest)"


@R("delete_recipe", CDC + INDEX + GONE + " select digest, size, refcount, frequency from k")
def delete_recipe(spark, sf_dir):
    """Every fifth document's recipe is deleted."""
    c = chunks(spark, sf_dir)
    return X.delete(X.index(c), c, F.col("doc_id") % 5 == 0).select("digest", "size", "refcount", "frequency")


@R("gc_refcount", CDC + INDEX + GONE + " select count(*) as reclaimed_chunks, coalesce(sum(size), 0)::bigint as reclaimed_bytes from k where refcount <= 0")
def gc_refcount(spark, sf_dir):
    return X.collect_garbage(delete_recipe(spark, sf_dir))[1]


@R("gc_survivors", CDC + INDEX + GONE + " select digest, size, refcount from k where refcount > 0")
def gc_survivors(spark, sf_dir):
    return X.collect_garbage(delete_recipe(spark, sf_dir))[0].select("digest", "size", "refcount")


@R("verify_audit", CDC + """, d as (select count(*) as documents, count(text) as texts, coalesce(sum(octet_length(encode(text))), 0)::bigint as bytes from documents)
select (select count(*) from cdc) as chunks, documents, texts as restored, bytes, 0::bigint as bad_chunks, 0::bigint as bad_documents from d""")
def verify_audit(spark, sf_dir):
    """What was audited: chunks, documents, those restored from their payloads and their bytes; payloads whose digest isn't theirs, and documents that aren't
    what their payloads give, lost ones among them: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    c = chunk(docs, "doc_id", "content", SMALL, with_data=True)
    bad = c.agg(F.count("*").alias("chunks"), F.coalesce(F.sum((F.sha2("data", 256) != F.col("digest")).cast("bigint")), F.lit(0).cast("bigint")).alias("bad_chunks"))
    whole = docs.join(restore(c), "doc_id", "left").withColumn("restored", F.when(F.octet_length("content") == 0, F.coalesce("restored", "content")).otherwise(F.col("restored")))
    wrong = ~F.sha2("restored", 256).eqNullSafe(F.sha2("content", 256))
    whole = whole.agg(F.count("*").alias("documents"), F.count("restored").alias("restored"), F.coalesce(F.sum(F.octet_length("restored")).cast("bigint"), F.lit(0).cast("bigint")).alias("bytes"), F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0).cast("bigint")).alias("bad_documents"))
    return bad.crossJoin(whole).select("chunks", "documents", "restored", "bytes", "bad_chunks", "bad_documents")


def restore(recipes: DataFrame) -> DataFrame:
    """(doc_id, restored) from (doc_id, ordinal, data)."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    return recipes.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.aggregate(F.transform("p", lambda x: x["data"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("restored"))


@R("whole_digest", "select doc_id, sha256(encode(text)) as whole_file_sha256, md5(text) as whole_file_md5, octet_length(encode(text)) as logical_size from documents")
def whole_digest(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(content, 256).alias("whole_file_sha256"), F.md5(content).alias("whole_file_md5"), F.octet_length(content).cast("bigint").alias("logical_size"))
