"""N-gram Jaccard self-join of documents: rare-first prefixes with length, positional and suffix filters.

A document is its set of word n-grams (the words of textscan; fewer than n words make one gram of them all, none make
no set). Every pair of sets with Jaccard similarity >= threshold is found. Approximate are hashes alone: n-grams stand as 56 bits
in prefixes and as 48 bits in verification (two words of a pair are mixed up once in some 10**9 pairs), sets as 64 bits (128 where
copies are told), anchors as 24 bits (a pair is missed if two anchors are mixed up: about once in 10**8 pairs).

How it runs, all of it over every document:

1. ``sketch``: one pass counts all n-grams in 2**sketch_bits buckets (a fixed size, whatever the corpus) and notes each
   document's set signature. The logarithm of a bucket's count, put in front of the n-gram's hash, is the global order:
   rare first. Any order is exact; this one keeps frequent n-grams out of prefixes.
2. ``candidates``: only each set's probing prefix leaves the scan, packed in one binary row per bucket of tokens and
   batch, with a few bytes of each set once a bucket; its signature only where ``own_sets`` found an equal set or another set under its id. Within a token, sets are met by size, so the length filter ends a scan early; the shorter set counts only by its
   (shorter) indexing prefix; then comes the positional filter. Prefixes are longer
   than needed for one common token, by ``asked_for(size)`` - 1, so that a pair must have as many common tokens there, which chance pairs don't.
   Near copies have a hundred tokens in common, in as many buckets. So each set has ANCHORS anchors: tokens of its indexing prefix, drawn by hash
   with the weight count ** 2, which prefers what a group shares to what an edit made, and DIGEST bytes of a min-hash digest of the whole set. A pair with a common
   anchor and ALIKE equal bytes is told at the first such anchor alone; other pairs at every common token, to be summed. A token of more than HOT sets is met in a grid of parts of its sets.
   The number of buckets follows the number of rows (BUCKET_ROWS), a task takes a bucket in pieces of whole tokens (PIECE) and gives pairs away as it goes (HELD), so its memory follows neither the input nor
   the pairs of a class.
3. ``verify``: the sets of documents in a pair that is left are made again and sent to where the pairs of their group of copies
   meet: the hub is the least id two steps away, the same one for nearly all of a group, so nearly every set is sent once. A hub of many
   pairs is cut in a grid of blocks of about BLOCK pairs. Each pair is verified once, by the suffix filter (the larger side cut at the
   smaller one's quartiles) and then the exact intersection, one set against all its partners at a time.

Documents of equal sets are one node: the smallest doc_id stands for it, so no set is joined twice.

Result of the query (``classes``): one row a doc_id, (doc_id, class_id, links, copies). ``class_id`` is the least id that links or equal sets lead to (its own
where there is none), ``links`` the number of different sets at or above the threshold with the document's own, ``copies`` the number of
other documents of an equal set. What is verified is counted and joined to classes where it is verified: pairs aren't written.
``ngram_join`` gives the pairs: (doc_a, doc_b, jaccard), doc_a < doc_b, of different sets by their smallest ids, and each further copy of a set with that id.

Null and empty texts have no links; rows with a null id take no part and have no row; repeated rows of one doc_id count once; different texts under one id
are sets of one document (its links are those of all of them, counted for each); other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import common as C
from chunkwright.llm.textscan import mix, ngrams, scan_words

N, THRESHOLD, SKETCH_BITS = 2, 0.6, 22
#: Common tokens asked for in prefixes: this number, or this share of the set.
COMMON, COMMON_SHARE = 4, 1 / 32
ENOUGH = 1 << 20
BLOCK = 50_000
#: Anchors of a set; sets of a token that meet in one task, by the sketch's count.
ANCHORS, HOT = 3, 20_000
#: Rows that a bucket has on average at most; rows whose tokens are met at a time; pairs that a task holds before it gives them away.
BUCKET_ROWS, PIECE, HELD = 3_000_000, 400_000, 400_000
#: Bytes of a set's digest, and how many must be equal for a pair to be told at an anchor. Bits of an anchor.
DIGEST, ALIKE = 4, 2
LOW = np.uint64((1 << 56) - 1)
VERIFIED = np.uint64((1 << 48) - 1)
EPS = 1e-9


def need(size, t: float):
    """The least overlap with a set at least as large, of a set of this size."""
    return np.ceil(t * size - EPS)


def asked_for(size):
    return np.maximum(COMMON, np.ceil(size * COMMON_SHARE))


def probe_prefix(size, t: float):
    return size - np.ceil(t * size - EPS) + asked_for(size)


def index_prefix(size, t: float):
    return size - np.ceil(2 * t / (1 + t) * size - EPS) + asked_for(size)


def gram_sets(batch: pa.RecordBatch, n: int):
    """(row, unsorted n-gram hashes with repeats) of each row that has words."""
    w = scan_words(C.column(batch, "text"))
    all_grams = ngrams(w.hashes, n)
    ptr = w.ptr.tolist()
    for k in range(batch.num_rows):
        a, b = ptr[k], ptr[k + 1]
        if b - a >= n:
            yield k, all_grams[a : b - n + 1]
        elif b > a:
            yield k, ngrams(w.hashes[a:b], b - a)[:1]


def unique_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def signature(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, whatever its order."""
    low = grams & LOW
    with np.errstate(over="ignore"):
        return int(mix(low).sum(dtype=np.uint64).view(np.int64)), int(mix(low ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def ordered(grams: np.ndarray, rank: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The set as sorted tokens: the rank of the bucket's count, then the hash."""
    return unique_sorted((rank[grams >> shift].astype(np.uint64) << np.uint64(56)) | (grams & LOW))


# 1 ------------------------------------------------------------------------------------------------------------------

INFO = pa.schema([("slice", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("size", pa.int32())])


def sketch(docs: DataFrame, n: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """Of each document (doc_id, sig, sig2, size); the rank of each bucket of n-grams by its count."""
    shift = 64 - bits

    def scan(batches):
        count = np.zeros(1 << bits, np.uint32)
        seen = False
        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = C.column(part, "doc_id").to_numpy(zero_copy_only=False)
                rows, sigs, sig2, sizes, grams = [], [], [], [], []
                for k, g in gram_sets(part, n):
                    u = unique_sorted(g & LOW)
                    s = signature(u)
                    rows.append(k), sigs.append(s[0]), sig2.append(s[1]), sizes.append(len(u)), grams.append(g)
                if rows:
                    seen = True
                    every = np.concatenate(grams)
                    np.add.at(count, (every >> np.uint64(shift)).astype(np.int64), np.uint32(1))
                    none = pa.nulls(len(rows))
                    yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), pa.array(ids[rows], pa.int64()), pa.array(sigs, pa.int64()), pa.array(sig2, pa.int64()), pa.array(sizes, pa.int32())], schema=INFO)
        if seen:
            for k in range(0, len(count), C.SLICE * 16):
                b = C.pack_slices(count[k : k + C.SLICE * 16])
                if b.num_rows:
                    none = pa.nulls(b.num_rows)
                    at = pa.array(b.column(0).to_numpy() + k // C.SLICE, pa.int32())
                    yield pa.RecordBatch.from_arrays([at, b.column(1), *[none.cast(t) for t in INFO.types[2:]]], schema=INFO)

    seen = C.cut(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(scan, "slice int, data binary, doc_id bigint, sig bigint, sig2 bigint, size int"))
    blobs = seen.where("slice is not null").select("slice", "data")
    total = C.gather_slices(C.sum_slices(blobs, "uint32", lambda a, b: a + b), 1 << bits, "uint32")
    rank = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    return seen.where("slice is null").select("doc_id", "sig", "sig2", "size"), rank


# 2 ------------------------------------------------------------------------------------------------------------------

KINDS = [("sig", "<i8"), ("doc", "<i8"), ("size", "<u4"), ("rows", "<u4"), ("digest", "<u4"), *((f"anchor{k}", "<u4") for k in range(ANCHORS)), ("token", "<u4"), ("pos", "<i4"), ("part", "<u1"), ("tag", "<u4")]
BY_SET = 5 + ANCHORS
TAG = np.uint32((1 << 24) - 1)
SHARES = np.exp2(np.arange(256) / 4)  # the square of the count that a rank stands for


def pack_rows(col: dict[str, np.ndarray]) -> bytes:
    """Columns by set and by token, byte planes after one another, compressed; ids and places as steps."""
    col = col | {f: np.diff(col[f].astype(np.int64), prepend=0) for f in ("doc", "pos")}
    planes = b"".join(np.ascontiguousarray(col[f].astype(kind).view(np.uint8).reshape(len(col[f]), -1).T).tobytes() for f, kind in KINDS)
    return len(col["sig"]).to_bytes(4, "little") + len(col["token"]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_rows(blob: bytes) -> dict[str, np.ndarray]:
    sets, rows = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    width = [np.dtype(kind).itemsize for _, kind in KINDS]
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=sets * sum(width[:BY_SET]) + rows * sum(width[BY_SET:]), codec="zstd", asbytes=True), np.uint8)
    at, out = 0, {}
    for k, ((f, kind), w) in enumerate(zip(KINDS, width)):
        n = sets if k < BY_SET else rows
        out[f] = np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(kind)
        at += n * w
    return out | {"doc": np.cumsum(out["doc"], dtype=np.int64), "pos": np.cumsum(out["pos"], dtype=np.int32)}


def parts_of(tokens: np.ndarray, hot: int) -> np.ndarray:
    """In how many parts a token's sets meet, by the count that its rank stands for."""
    return np.ceil(np.exp2((tokens >> np.uint64(56)).astype(np.float64) / 8) / hot).astype(np.int64)


def anchors(tokens: np.ndarray) -> list[int]:
    """Of an indexing prefix, ANCHORS tokens (TAG of each, mixed): equal hashes choose alike in sets that have much in common. Tokens of many sets count as well: what a large class shares is one of these."""
    h = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    share = SHARES[(tokens >> np.uint64(56)).astype(np.int64)]
    every = np.stack([(h >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1) for k in range(ANCHORS)]).astype(np.float64)
    at = (np.log((every + 0.5) / (1 << 21)) / share).argmax(axis=1)
    return (((mix(tokens[at]) >> np.uint64(32)).astype(np.uint32)) & TAG).tolist()


def digest(tokens: np.ndarray) -> int:
    """A byte of the least hash in each of DIGEST ranges of hashes (0 in an empty one)."""
    h = np.sort(mix(tokens + np.uint64(0x632BE59BD9B4E019)))
    edge = np.searchsorted(h, np.arange(DIGEST, dtype=np.uint64) << np.uint64(62))
    least = h[np.minimum(edge, len(h) - 1)]
    whole = (least >> np.uint64(62)) == np.arange(DIGEST, dtype=np.uint64)
    return int.from_bytes(np.where(whole, least & np.uint64(255), 0).astype(np.uint8).tobytes(), "little")


def prefix_rows(grams: np.ndarray, rank: np.ndarray, shift: np.uint64, t: float):
    """Of one set: the tokens of the probing prefix, signature, size, digest, anchors."""
    tokens = ordered(grams, rank, shift)
    n, sig = len(tokens), signature(tokens)[0]
    return tokens[: min(int(probe_prefix(n, t)), n)], sig, n, digest(tokens), anchors(tokens[: max(1, min(int(index_prefix(n, t)), n))])


def spread(tokens: np.ndarray, sig: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, mixed token, part, tag) of every row. A token that the sketch counts n > hot times has its sets in ceil(n / hot) parts, and a row for each pair of its
    own part with another: there, parts 0 and 1 meet each other alone; among themselves, as part 2. As such a row has a number of its own in the token's place, its tag
    is the token's TAG and the bit above it; other rows have 0."""
    mixed, part = mix(tokens), np.full(len(tokens), 2, np.uint8)
    many = parts_of(tokens, hot)
    row = np.arange(len(tokens))
    at = np.flatnonzero(many > 1)
    if not len(at):
        return row, mixed, part, np.zeros(len(tokens), np.uint32)
    copy = np.repeat(at, many[at])
    other = np.arange(len(copy)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
    own = (mix(sig[copy].view(np.uint64)) % many[copy].astype(np.uint64)).astype(np.int64)
    cell = mix(mixed[copy] ^ (np.minimum(own, other) * many[copy] + np.maximum(own, other) + 1).astype(np.uint64))
    sides = np.where(own == other, 2, np.where(own < other, 0, 1)).astype(np.uint8)
    cool = many <= 1
    tag = (mixed[copy] >> np.uint64(32)).astype(np.uint32) & TAG | (TAG + np.uint32(1))
    return np.r_[row[cool], copy], np.r_[mixed[cool], cell], np.r_[part[cool], sides], np.r_[np.zeros(int(cool.sum()), np.uint32), tag]


def pairs_of(col: dict[str, np.ndarray], t: float):
    """Candidate pairs among the rows of some tokens (all rows of each): the sets (sig, doc), and block by block arrays of a, b (numbers of sets) and weight. The smaller set comes first.
    Takes the columns out of col."""
    order = np.lexsort((col["doc"], col["sig"], col["size"]))
    first = np.ones(len(order), bool)
    differs = lambda x: x[order][1:] != x[order][:-1]
    first[1:] = differs(col["size"]) | differs(col["sig"]) | (col["sig"][order][1:] == 0) & differs(col["doc"])
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(first) - 1  # sets by size; rows of equal sets are one, of the least id
    heads = order[first]
    del order, first
    sig, doc, size_of, marks = (col.pop(f)[heads] for f in ("sig", "doc", "size", "digest"))
    anchor = [col.pop(f"anchor{k}")[heads] for k in range(ANCHORS)]
    marks = marks.view(np.uint8).reshape(-1, DIGEST)
    key = (col.pop("token").astype(np.uint64) << np.uint64(32)) | np.repeat(number, col.pop("rows"))
    del number, heads
    by = np.lexsort((col["part"], key))
    key, part = key[by], col.pop("part")[by]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    key, part, by = key[~same], part[~same], by[~same]
    pos, tag = col.pop("pos")[by], col.pop("tag")[by]
    del by, same
    nodes, tokens = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
    del key
    edges = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True]) if len(tokens) else np.zeros(1, np.int64)
    cuts = np.unique(np.r_[edges[np.searchsorted(edges, np.arange(0, len(tokens), PIECE))], len(tokens)])

    def piece(low: int, high: int):
        """Rows of whole tokens."""
        node, place, side, whose = nodes[low:high].astype(np.int64), pos[low:high].astype(np.int64), part[low:high], tag[low:high]
        whose = np.where(whose > 0, whose, tokens[low:high]) & TAG
        size = size_of[node].astype(np.int64)
        own = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high) + 1] - low
        end = np.repeat(own[1:], np.diff(own))
        at = np.flatnonzero(place < index_prefix(size, t))
        d = 1
        while len(at):
            at = at[at + d < end[at]]
            other = at + d
            fits = size[at] >= t * size[other] - EPS
            at, other = at[fits], other[fits]  # sizes only grow from here: the rest of the token is too long as well
            a, b = size[at], size[other]
            overlap = np.ceil(t / (1 + t) * (a + b) - EPS)
            good = np.minimum(place[at], place[other]) + 1 + np.minimum(a - place[at] - 1, b - place[other] - 1) >= overlap
            good &= (side[at] == 2) | (side[at] != side[other])
            good &= node[at] != node[other]
            x, y = at[good], other[good]
            if len(x):
                weight = np.ceil(ENOUGH / np.minimum(asked_for(size[x]), overlap[good])).astype(np.int64)
                untold = (marks[node[x]] == marks[node[y]]).sum(axis=1) >= ALIKE
                for one in anchor:
                    shared = untold & (one[node[x]] == one[node[y]])
                    weight[shared] = np.where(one[node[x[shared]]] == whose[x[shared]], ENOUGH, 0)
                    untold &= ~shared
                told = weight > 0
                yield node[x[told]], node[y[told]], weight[told]
            d += 1

    return sig, doc, (block for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for block in piece(low, high))


PAIR = ["doc_a", "sig_a", "doc_b", "sig_b", "weight"]


def bucket_pairs(blobs: Iterable[bytes], t: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a bucket, some at a time. What a pair weighs is the sum of its rows. Pairs that are told at one token aren't held to be summed; of
    the others, those that have come are given away at HELD."""
    got = [unpack_rows(x) for x in blobs]
    if not got:
        return
    col = {f: np.concatenate([g.pop(f) for g in got]) for f, _ in KINDS}
    del got
    sig, doc, blocks = pairs_of(col, t)

    def given(pairs: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pairs), HELD):
            a, b = np.divmod(pairs[k : k + HELD], len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[a], sig[a], doc[b], sig[b], weight[k : k + HELD])], PAIR)

    def summed(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate([x for x, _ in some]), return_inverse=True)
        return every, np.minimum(np.bincount(at, np.concatenate([w for _, w in some]), len(every)), ENOUGH).astype(np.int64)

    whole, open_, wholes, opens = [], [], 0, 0
    for a, b, w in blocks:
        pairs, told = a * len(sig) + b, w >= ENOUGH
        whole.append(pairs[told]), open_.append((pairs[~told], w[~told]))
        wholes, opens = wholes + len(whole[-1]), opens + len(open_[-1][0])
        if wholes > HELD:
            pairs = np.concatenate(whole)
            whole, wholes = [], 0
            yield from given(pairs, np.full(len(pairs), ENOUGH))
        if opens > HELD:
            open_ = [summed(open_)]
            if (opens := len(open_[0][0])) > HELD // 2:
                yield from given(*open_[0])
                open_, opens = [], 0
    if wholes:
        open_.append((pairs := np.concatenate(whole), np.full(len(pairs), ENOUGH)))
    if open_:
        yield from given(*summed(open_))


def buckets_for(info: DataFrame, t: float) -> int:
    """The number of buckets of tokens: a quarter of spark.sql.shuffle.partitions, or more if probing prefixes have more than BUCKET_ROWS tokens for each."""
    size = F.col("size")
    prefix = F.least(size, size - F.ceil(t * size - EPS) + F.greatest(F.lit(COMMON), F.ceil(size * COMMON_SHARE)))
    rows = info.agg(F.sum(prefix)).first()[0] or 0
    return max(16, int(info.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, math.ceil(rows / BUCKET_ROWS))


def candidates(docs: DataFrame, known: C.Marks, rank: np.ndarray, buckets: int, n: int, t: float, bits: int, hot: int = HOT) -> DataFrame:
    """(doc_a, sig_a, doc_b, sig_b), once a pair, by the least ids of its sets; sig is 0 for ids that known doesn't mark."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rank.tobytes())
    shift = np.uint64(64 - bits)

    def scan(batches):
        order = np.frombuffer(shared.value, np.uint8)
        heads, sets, held = [], [], 0

        def flush():
            count = np.array([len(h) for h in heads])
            doc, sig, size, marks, chosen = zip(*sets)
            doc, sig, size, marks, anchor = np.array(doc), np.array(sig), np.array(size), np.array(marks, np.uint32), np.array(chosen, np.uint32).T
            owner = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            row, token, part, tag = spread(np.concatenate(heads), np.where(sig == 0, doc, sig)[owner], hot)
            owner, pos = owner[row], pos[row]
            bucket = ((token & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((owner, bucket))
            owner, pos, part, tag, token = owner[by], pos[by], part[by], tag[by], (token >> np.uint64(32))[by]
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            kept = np.flatnonzero(np.diff(edges))
            blobs = []
            for i in kept:
                some = slice(edges[i], edges[i + 1])
                own, rows = np.unique(owner[some], return_counts=True)
                col = {"sig": sig[own], "doc": doc[own], "size": size[own], "rows": rows, "digest": marks[own], "token": token[some], "pos": pos[some], "part": part[some], "tag": tag[some]}
                blobs.append(pack_rows(col | {f"anchor{k}": a[own] for k, a in enumerate(anchor)}))
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = C.column(part, "doc_id").to_numpy(zero_copy_only=False)
                marked = known.has(ids)
                for k, g in gram_sets(part, n):
                    h, sig, *rest = prefix_rows(g, order, shift, t)
                    heads.append(h), sets.append((int(ids[k]), sig if marked[k] else 0, *rest))
                    held += len(h)
                if held > 700_000:
                    yield flush()
                    heads, sets, held = [], [], 0
        if heads:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bucket_pairs((x.as_py() for batch in batches for x in C.column(batch, "rows")), t)

    key = PAIR[:-1]
    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(scan, "bucket int, rows binary")
    met = rows.groupBy("bucket").applyInArrow(meet, ", ".join(f"{c} bigint" for c in PAIR))
    return met.groupBy(*key).agg(F.sum("weight").alias("weight")).where(F.col("weight") >= ENOUGH).select(*key)


# 3 ------------------------------------------------------------------------------------------------------------------


def pack_set(grams: np.ndarray) -> bytes:
    """A sorted set of 48-bit numbers: the low 32 bits as they are, of the high 16 the steps."""
    high = (grams >> np.uint64(32)).astype(np.int64)
    step = np.diff(high, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    return grams.astype("<u4").tobytes() + pa.compress(np.ascontiguousarray(step.T).tobytes(), codec="zstd", asbytes=True)


def unpack_set(blob: bytes, size: int) -> np.ndarray:
    low = np.frombuffer(blob, "<u4", size).astype(np.uint64)
    step = np.frombuffer(pa.decompress(blob[4 * size :], decompressed_size=2 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, size)
    return (np.cumsum(step[0].astype(np.uint64) + (step[1].astype(np.uint64) << np.uint64(8))) << np.uint64(32)) | low


def suffix_bounds(x: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A lower bound of the Hamming distance of x and each of the sets that lie in flat one after another: x is halved twice, the others are cut at the same tokens."""
    cuts = x[[len(x) // 4, len(x) // 2, 3 * len(x) // 4]]
    mine = np.diff(np.r_[0, np.searchsorted(x, cuts), len(x)])
    below = [np.add.reduceat(flat < c, starts, dtype=np.int64) for c in cuts]
    return sum(np.abs(m - (b - a)) for m, a, b in zip(mine, [0, *below], [*below, sizes]))


def similarities(x: np.ndarray, others: list[np.ndarray], t: float) -> np.ndarray:
    """Jaccard of the sorted set x with each of the others, or -1 where the suffix filter shows that it is below t."""
    sizes = np.array([len(y) for y in others])
    total = len(x) + sizes
    flat = np.concatenate(others)
    far = suffix_bounds(x, flat, np.cumsum(sizes) - sizes, sizes)
    near = far <= total - 2 * np.ceil(t / (1 + t) * total - EPS)
    out = np.full(len(others), -1.0)
    if near.any():
        if not near.all():
            flat = flat[np.repeat(near, sizes)]
        sizes, total = sizes[near], total[near]
        common = np.add.reduceat(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
        out[near] = common / (total - common)
    return out


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> list[int]:
    """Which of the edges join what wasn't joined by those before."""
    up, used = list(range(nodes)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            used.append(k)
    return used


def verify(docs: DataFrame, known: C.Marks, pairs: DataFrame, n: int, t: float, expand: bool) -> DataFrame:
    """expand: (doc_a, doc_b, jaccard) of the pairs at or above t. Otherwise (doc_id, sig, links) of each set and place, and (doc_a, doc_b) of edges that connect as all of
    the place's pairs do; the other columns are null."""
    spark = docs.sparkSession
    buckets = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = pairs.select("doc_a", "doc_b").union(pairs.select("doc_b", "doc_a"))
    one = edges.groupBy("doc_a").agg(F.min("doc_b").alias("m")).select(F.col("doc_a").alias("doc_b"), F.least("doc_a", "m").alias("hub"))
    two = edges.join(one, "doc_b").groupBy("doc_a").agg(F.min("hub").alias("hub"))
    at_hub = pairs.join(two, "doc_a")
    grid = at_hub.groupBy("hub").agg(F.ceil(F.sqrt(F.count("*") / BLOCK)).alias("side"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("side"))
    placed = C.cut(at_hub.join(grid, "hub").withColumn("bucket", F.pmod(F.xxhash64("hub", cell("doc_a"), cell("doc_b")), F.lit(buckets)).cast("int")).select("bucket", "doc_a", "sig_a", "doc_b", "sig_b"))
    side = lambda x: placed.select(F.col("bucket").alias("place"), F.col(f"doc_{x}").alias("doc_id"), F.col(f"sig_{x}").alias("sig"))
    asked = C.cut(side("a").union(side("b")).distinct())
    marks = C.Marks(asked, "doc_id")

    def sets(batches):
        for batch in batches:
            hit = marks.has(C.column(batch, "doc_id").to_numpy(zero_copy_only=False))
            for part in C.slices(batch.filter(pa.array(hit)), "text"):
                own, rows = C.column(part, "doc_id").to_numpy(zero_copy_only=False), []
                signed = known.has(own)
                for k, g in gram_sets(part, n):
                    u = unique_sorted(g & VERIFIED)
                    rows.append((own[k], signature(unique_sorted(g & LOW))[0] if signed[k] else 0, len(u), pack_set(u)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "sig", "size", "grams"])

    made = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(sets, "doc_id bigint, sig bigint, size int, grams binary").dropDuplicates(["doc_id", "sig"])
    sent = made.join(asked, ["doc_id", "sig"]).select("place", "sig", "doc_id", "size", "grams")

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        sig, doc = sets.column("sig").to_numpy(), sets.column("doc_id").to_numpy()
        held = [unpack_set(blob.as_buffer(), size.as_py()) for blob, size in zip(sets.column("grams"), sets.column("size"))]
        ids, sigs = np.unique(doc), np.unique(sig)
        key = lambda d, s: np.searchsorted(ids, d) * len(sigs) + np.searchsorted(sigs, s)
        keys = key(doc, sig)
        order = np.argsort(keys)
        a, b = (order[np.searchsorted(keys, key(pairs.column(f"doc_{c}").to_numpy(), pairs.column(f"sig_{c}").to_numpy()), sorter=order)] for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        j = np.full(len(a), -1.0)
        edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else np.zeros(1, np.int64)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            x = held[a[low]]
            step = max(1, 2_000_000 // len(x))
            for k in range(low, high, step):
                to = min(k + step, high)
                j[k:to] = similarities(x, [held[i] for i in b[k:to].tolist()], t)
        good = j >= t - EPS
        a, b, j = a[good], b[good], j[good]
        if expand:
            return pa.table({"doc_a": np.minimum(doc[a], doc[b]), "doc_b": np.maximum(doc[a], doc[b]), "jaccard": j})
        links = np.bincount(np.r_[a, b], minlength=len(sig)).astype(np.int64)
        linked = np.flatnonzero(links)
        used = forest(a, b, len(sig))
        none, none_too = pa.nulls(len(used), pa.int64()), pa.nulls(len(linked), pa.int64())
        whole = lambda x, y: pa.concat_arrays([x.cast(pa.int64()), y.cast(pa.int64())])
        return pa.table({"doc_id": whole(pa.array(doc[linked]), none), "sig": whole(pa.array(sig[linked]), none), "links": whole(pa.array(links[linked]), none), "doc_a": whole(none_too, pa.array(doc[a[used]])), "doc_b": whole(none_too, pa.array(doc[b[used]]))})

    return placed.groupBy("bucket").cogroup(sent.groupBy("place")).applyInArrow(check, "doc_a bigint, doc_b bigint, jaccard double" if expand else "doc_id bigint, sig bigint, links bigint, doc_a bigint, doc_b bigint")


def own_sets(info: DataFrame) -> DataFrame:
    """(doc_id, sig, sig2, rep, copies) of each document and set of it: the least id of an equal set, and how many other documents have one."""
    info = info.select("doc_id", "sig", "sig2").distinct()
    reps = info.groupBy("sig", "sig2").agg(F.min("doc_id").alias("rep"), (F.count("*") - 1).alias("copies"))
    return C.cut(info.join(reps, ["sig", "sig2"]))


def found(docs: DataFrame, n: int, threshold: float, sketch_bits: int, hot: int, expand: bool) -> tuple[DataFrame, DataFrame]:
    """What own_sets gives, and what verify gives."""
    with C.small_batches(docs.sparkSession):
        info, rank = sketch(docs, n, sketch_bits)
        own = own_sets(info)
        several = own.groupBy("doc_id").agg((F.sum("copies") + F.count("*")).alias("n")).where("n > 1").select("doc_id")
        known = C.Marks(C.cut(several), "doc_id")
        cand = C.cut(candidates(docs, known, rank, buckets_for(info, threshold), n, threshold, sketch_bits, hot))
        return own, C.cut(verify(docs, known, cand, n, threshold, expand))


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """All pairs of documents whose n-gram sets have Jaccard >= threshold; see the module's text for the result's form."""
    own, near = found(docs, n, threshold, sketch_bits, hot, expand=True)
    copies = own.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.where("doc_a <> doc_b").unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, links, copies) of each doc_id; see the module's text."""
    own, told = found(docs, n, threshold, sketch_bits, hot, expand=False)
    edges = told.where("doc_a is not null").select("doc_a", "doc_b").unionByName(own.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b")))
    label = components(edges)
    linked = told.where("doc_id is not null").groupBy(F.col("doc_id").alias("rep"), F.col("sig").alias("of")).agg(F.sum("links").alias("links"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint").alias("group")
    rows = docs.where("doc_id is not null").select("doc_id", none, zero.alias("links"), zero.alias("copies"))
    rows = rows.unionByName(label.select("doc_id", "group", zero.alias("links"), zero.alias("copies")))
    rows = rows.unionByName(own.where("copies > 0").select("doc_id", none, zero.alias("links"), "copies"))
    rows = rows.unionByName(own.join(linked, "rep").where("of = 0 or of = sig").select("doc_id", none, "links", zero.alias("copies")))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("group"), F.col("doc_id")).alias("class_id"), F.sum("links").alias("links"), F.sum("copies").alias("copies"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group) of every id in a pair; the group is its component's smallest id. Least labels spread with
    pointer jumping; every round is written to the shared folder, and the number of rounds follows the logarithm of the longest path."""
    edges = C.cut(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).union(pairs.select("doc_b", "doc_a")).distinct())
    label = C.cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group")).select(F.col("a").alias("doc_id"), "group"))
    while True:
        near = edges.join(label.select(F.col("doc_id").alias("b"), "group"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("group").alias("least"))
        step = label.join(near, "doc_id").select("doc_id", F.least("group", "least").alias("to"), F.col("group").alias("was"))
        jump = step.select(F.col("doc_id").alias("to"), F.col("to").alias("next"))
        after = C.cut(step.join(jump, "to", "left").select("doc_id", F.coalesce("next", "to").alias("group"), "was"))
        moved = after.where("group <> was").limit(1).count()
        label = after.select("doc_id", "group")
        if not moved:
            return label


def drop_near_copies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with one document of each class: the one of the smallest id. Rows without an id stay."""
    return C.without(docs, C.cut(classes.where("doc_id <> class_id").select("doc_id")), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over all pairs of distinct sets, in DuckDB.
SQL = rf"""
with recursive w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z\x{{c0}}-\x{{1fff}}\x{{2080}}-\x{{2fff}}\x{{3040}}-\x{{10ffff}}]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
s as (select distinct doc_id, list_sort(list_distinct(case when len(w) < {N} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) end)) as g from w where len(w) > 0),
r as materialized (select g, row_number() over () as k, min(doc_id) as rep, count(*) - 1 as copies, len(g) as size from s group by g),
e as materialized (select k, size, unnest(g) as t from r),
c as materialized (select x.k as a, y.k as b, count(*) as n, any_value(x.size) as sa, any_value(y.size) as sb from e x join e y on x.t = y.t and x.k < y.k and least(x.size, y.size) >= {THRESHOLD} * greatest(x.size, y.size) - 1e-9 group by 1, 2 having n / (sa + sb - n)::double >= {THRESHOLD} - 1e-9),
l as (select k, count(*) as links from (select a as k from c union all select b from c) group by k),
m as materialized (select s.doc_id, r.k, r.rep, r.copies from s join r on s.g = r.g),
p as (select x.rep as a, y.rep as b from c join r x on x.k = c.a join r y on y.k = c.b union select rep, doc_id from m),
q as materialized (select a, b from p union select b, a from p),
z as (select a, b from q union select z.a, q.b from z join q on z.b = q.a),
f as (select a as doc_id, min(b) as class_id from z group by a),
o as (select doc_id, sum(coalesce(links, 0)) as links, sum(copies) as copies from m left join l using (k) group by doc_id)
select d.doc_id, coalesce(f.class_id, d.doc_id) as class_id, coalesce(o.links, 0)::bigint as links, coalesce(o.copies, 0)::bigint as copies
from (select distinct doc_id from documents where doc_id is not null) d left join f using (doc_id) left join o using (doc_id)
"""
