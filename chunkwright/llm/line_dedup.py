"""Line dedup by passages of lines, removed where they repeat anywhere in the corpus.

The query finds passages by ``shared``: every LEAST lines in a row, at every line, so that a passage is found wherever it lies and whatever is
around it. An occurrence other than the first (that in the document of the smallest doc_id, there the first) is removed; those that share
lines make one run, and a run counts if it has a character other than blanks. A line thus goes if and only if it is in such a run, and
every line that goes is still where it came first.

``found`` is the coarser form by content-defined chunks. A text's lines are split at LF. A line's hash is the first 32 bits of its md5; a rolling hash over the last ROLL line hashes
of the text (0 before its first line) ends a chunk after a line where it is 0 modulo EVERY, and every MOST lines without such
an end. An end depends on ROLL lines alone, so lines put in or taken out elsewhere don't shift it.

A chunk of at least LEAST lines that has a character other than blanks counts; its bytes are those from its first line to its last, with
the LFs between. Of the chunks with equal bytes the first stays: the one in the document of the smallest doc_id, there the
first. All others are removed, each with the LF after it (at the end of a text, nothing but the chunk). Candidates share
a 64-bit hash; they are grouped by 128 bits and by their bytes, so different bytes of one 64-bit hash are told apart (of one 128-bit hash, they are left alone).

Result: the documents with ``text`` cut, ``removed_chunks`` and ``removed_bytes``; rows, order of lines and the other columns
stay, whatever their names (columns named like the new ones are replaced); ``removed_chunks`` counts runs or chunks. A null or empty text has no chunks. A row with a null id stays as
it is and doesn't count. Repeated rows of one id and text count once and get the same result; different texts under one id are in the order of their md5. An empty table
gives an empty result.

Shuffled are one hash a passage (summed before), a short row and the bytes of passages whose hash repeats, and documents
that lose something; the bits that tell them (``common.Marks``) follow their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from chunkwright.llm import common as C

ROLL, EVERY, LEAST, MOST = 3, 3, 2, 64


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks(text: bytes, roll: int = ROLL, every: int = EVERY, most: int = MOST) -> list[tuple[int, int, int]]:
    """(begin, end, lines) of each chunk; end is before the LF."""
    out, last, begin, at, lines = [], [0] * roll, 0, 0, 0
    factors = [31**k for k in range(roll)]
    for line in text.split(b"\n"):
        last = [line_hash(line), *last[:-1]]
        at += len(line)
        lines += 1
        if sum(f * h for f, h in zip(factors, last)) % every == 0 or lines == most:
            out.append((begin, at, lines))
            begin, lines = at + 1, 0
        at += 1
    if lines:
        out.append((begin, at - 1, lines))
    return out


def halves(data: bytes) -> tuple[int, int]:
    """The two halves of its md5."""
    d = hashlib.md5(data).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def found(text: bytes, least: int = LEAST):
    """(hash, second hash, begin, end, occurrence in the text) of the chunks that count."""
    seen: dict[tuple[int, int], int] = {}
    for begin, end, lines in chunks(text) if text else ():
        if lines >= least and (data := text[begin:end]).strip(b" \t\r\n"):
            h = halves(data)
            seen[h] = nth = seen.get(h, -1) + 1
            yield *h, begin, end, nth


def shared(text: bytes, least: int = LEAST):
    """As found, of every ``least`` lines in a row."""
    seen: dict[tuple[int, int], int] = {}
    ends, at = [], -1
    for line in text.split(b"\n"):
        at += 1 + len(line)
        ends.append(at)
    begin = 0
    for k in range(least - 1, len(ends)):
        h = halves(text[begin : ends[k]])
        seen[h] = nth = seen.get(h, -1) + 1
        yield *h, begin, ends[k], nth
        begin = ends[k - least + 1] + 1


def runs(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that share lines as one; what is blank doesn't count."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return [(a, b) for a, b in out if text[a:b].strip(b" \t\r\n")]


def remove(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for begin, end in sorted(spans):
        out.append(text[at:begin])
        at = min(end + 1, len(text))
    return b"".join([*out, text[at:]])


def rows_of(batch: pa.RecordBatch):
    for doc_id, text in zip(C.column(batch, "doc_id").to_pylist(), C.column(batch, "text")):
        if doc_id is not None and text.is_valid:
            yield doc_id, bytes(text.as_buffer())


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until docs has no column of it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def dedup(docs: DataFrame, find=found) -> DataFrame:
    columns = [c for c in docs.columns if c not in ("removed_chunks", "removed_bytes")]
    docs = docs.select(columns)

    def hashes(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for _, t in rows_of(part) for x in find(t)], pa.int64())], ["hash"])

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    marks = C.Marks(C.cut(texts.mapInArrow(hashes, "hash bigint").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")), "hash")

    def marked(part):
        """(doc_id, text, what find gives) of the hashes that may repeat."""
        for i, t in rows_of(part):
            if got := list(find(t)):
                for k in np.flatnonzero(marks.has(np.array([x[0] for x in got], np.int64))).tolist():
                    yield i, t, got[k]

    def scan(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                last, sig, got = None, 0, []
                for i, t, x in marked(part):
                    if t is not last:
                        last, sig = t, halves(t)[0]
                    got.append((i, sig, *x))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 4 else pa.int32()) for k, x in enumerate(zip(*got))], ["doc_id", "sig", "hash", "hash2", "begin", "stop", "nth"])

    repeated = texts.mapInArrow(scan, "doc_id bigint, sig bigint, hash bigint, hash2 bigint, begin int, stop int, nth int").distinct()

    def bytes_of(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                got = [(i, halves(t)[0], h, h2, t[a:b]) for i, t, (h, h2, a, b, _) in marked(part)]
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], ["doc_id", "sig", "hash", "hash2", "data"])

    where = F.struct("doc_id", "sig")
    equal = texts.mapInArrow(bytes_of, "doc_id bigint, sig bigint, hash bigint, hash2 bigint, data binary").groupBy("hash", "hash2", "data").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    first = equal.groupBy("hash", "hash2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1 and kinds = 1").select("hash", "hash2", "first")
    gone = C.cut(repeated.join(first, ["hash", "hash2"]).where((where != F.col("first")) | (F.col("nth") > 0)).groupBy("doc_id", "sig").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")))
    clear, touched = C.Marks(gone, "doc_id").split(docs, "doc_id")
    spans = free_name(docs, "spans")

    def cut(batches):
        for batch in batches:
            texts, cuts = C.column(batch, "text"), C.column(batch, spans).to_pylist()
            raw = [bytes(t.as_buffer()) if t.is_valid else None for t in texts]
            new, count, size = [], [], []
            for t, s in zip(raw, cuts):
                s = runs(t, [(x["begin"], x["stop"]) for x in s]) if s else []
                new.append(remove(t, s).decode() if s else None if t is None else t.decode())
                count.append(len(s))
                size.append(len(t) - len(new[-1].encode()) if s else 0)
            arrays = [pa.array(new, pa.string()) if c == "text" else C.column(batch, c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int32()), pa.array(size, pa.int64())], [*columns, "removed_chunks", "removed_bytes"])

    sig = free_name(docs, "sig")
    changed = touched.withColumn(sig, F.conv(F.substring(F.md5("text"), 1, 16), 16, -10).cast("bigint"))
    changed = changed.join(gone.select("doc_id", F.col("sig").alias(sig), F.col("spans").alias(spans)), ["doc_id", sig], "left").select(*columns, spans)
    schema = StructType([*docs.schema, StructField("removed_chunks", IntegerType()), StructField("removed_bytes", LongType())])
    same = clear.withColumns({"removed_chunks": F.lit(0), "removed_bytes": F.lit(0).cast("bigint")})
    return same.unionByName(changed.mapInArrow(cut, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared)


_KEPT = """k as (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) || case when last(gone order by i) and bool_or(not gone) then chr(10) else '' end as text from m group by doc_id)
select d.doc_id, case when d.text = '' then d.text else coalesce(k.text, '') end as text, d.lang, d.source, d.n_chars, coalesce(g.removed_chunks, 0)::int as removed_chunks,
  (octet_length(encode(d.text)) - octet_length(encode(case when d.text = '' then d.text else coalesce(k.text, '') end)))::bigint as removed_bytes
from documents d left join k using (doc_id) left join g using (doc_id)
"""
_LINES = "with l as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents where text <> ''))"
_BLANK = "trim({}, ' ' || chr(9) || chr(13) || chr(10)) = ''"

#: Every two lines in a row; those that aren't the first of their like, in runs.
SQL = f"""
{_LINES},
n as (select *, lead(line) over (partition by doc_id order by i) as after from l),
p as (select doc_id, i from (select doc_id, i, row_number() over (partition by line, after order by doc_id, i) as nth from n where after is not null) where nth > 1),
r as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from p),
s as (select doc_id, run, min(i) as a, max(i) + 1 as b from r group by all),
t as (select s.doc_id, run, a, b from s join l on l.doc_id = s.doc_id and l.i between a and b group by all having not bool_and({_BLANK.format("line")})),
m as (select l.doc_id, l.i, l.line, count(t.a) > 0 as gone from l left join t on t.doc_id = l.doc_id and l.i between t.a and t.b group by all),
g as (select doc_id, count(*) as removed_chunks from t group by doc_id),
{_KEPT}"""

#: ``dedup(docs)``, the form by chunks: a chunk is the group of lines between ends; equal chunks are grouped by their text.
CHUNKS_SQL = f"""
{_LINES},
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from l),
r as (select *, (h + 31 * coalesce(lag(h, 1) over w, 0) + 961 * coalesce(lag(h, 2) over w, 0)) % {EVERY} = 0 as stop from h window w as (partition by doc_id order by i)),
s as (select *, coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as run from r),
p as (select *, (row_number() over (partition by doc_id, run order by i) - 1) // {MOST} as piece from s),
c as (select doc_id, run, piece, min(i) as a, count(*) as n, string_agg(line, chr(10) order by i) as body from p group by all),
e as (select *, row_number() over (partition by body order by doc_id, a) > 1 and n >= {LEAST} and not {_BLANK.format("body")} as gone from c),
m as (select p.doc_id, p.i, p.line, e.gone from p join e using (doc_id, run, piece)),
g as (select doc_id, count(*) filter (gone) as removed_chunks from e group by doc_id),
{_KEPT}"""
