"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND by every passage.

Index. Items are the documents of the index; a posting holds an item's BM25 impact of the term divided by the item's
score for itself, so that a score is the share of the item that a passage covers and one threshold serves all items.
Items lie in an order that brings like ones together and in ranges of RANGE items; every term keeps its largest impact
in all and in each range (the block maxima). An item of more than PASSAGE words fits no passage, so it is
indexed in equal pieces of at most half a passage, each with its own score for itself; a copied piece lies whole in some passage.

Search. A text is cut into passages of PASSAGE words, each beginning half a passage after the one before, to the end of
the text. Of every passage all items with score >= threshold are retrieved (none but those; no top k). For all passages of
a batch at once, postings of the rarer terms are summed by item, and the most that the common terms together can add in
an item's range is put on top; a range that stays below the threshold for all its items can't reach it. In the ranges
left, which are few, each passage's lists are walked with WAND pivots and block-max skips.

Verification. A retrieved item's last sentence is its answer and what is before it its question (of one sentence: its
second and its first half). Both must overlap: at least VERIFY of their word trigrams (shorter n-grams where they have
fewer words) occur in the passage with half a passage on each side. Of an item in pieces, the best scores of the pieces that a row retrieves are
averaged (a piece's weight is its score for itself, one not retrieved counts 0) and must reach the threshold; its overlaps are with all of these passages.

Result of ``leaks``: (doc_id, item_id, score, question_overlap, answer_overlap), the best score of each item in each row
of documents (rounded to 9 digits), no shuffle. Null and empty texts, and items of less than LEAST_WORDS words (any text with such a word would be a leak), give
nothing; repeated rows give repeated results; a null id is carried.
The index is in shards of at most SHARD items or pieces (one item's stay together), which bounds what a search holds at once; all shards go to the
executors together and every text is read and cut into words once, whatever the number of items. Document frequencies are those of all items. The benchmark's words must be at
most MOST_WORDS (an index of some 500 MB); for more there is an error that says so, and no executor is filled up.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import common as C
from chunkwright.llm.textscan import Words, ngrams, scan_words

K1, B = 1.2, 0.75
PASSAGE, THRESHOLD, VERIFY = 128, 0.5, 0.5
RANGE, SHARD = 8, 512
#: The least words of an item, and the most of all items together.
LEAST_WORDS, MOST_WORDS = 3, 5_000_000
#: Common terms are those of most items, as long as all together they give an item less than this share of the threshold.
COMMON = 0.5
GRAM = 3
#: What float32 sums of bounds may lose.
SLACK = 1e-4


def split_item(text: str, words: int) -> int | None:
    """Where the answer begins, in characters: after the last sentence end that is followed by more; None: by halves."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    return ends[-1] if ends else None


def grams_of(h: np.ndarray) -> np.ndarray:
    """Distinct GRAM-grams (or the one n-gram of fewer words)."""
    if not len(h):
        return h
    n = min(GRAM, len(h))
    return np.unique(ngrams(h, n)[: len(h) - n + 1])


class Index:
    """One shard: postings by term, block maxima, and what verification needs."""

    def __init__(self, whole: list[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]], idf: dict[int, float], mean_length: float, threshold: float):
        common = lambda words: max(set(words.tolist()), key=lambda t: (-idf[t], t))
        items = [(item_id, words, k) for k, (item_id, pieces, _, _) in enumerate(whole) for words in pieces]
        items = sorted(items, key=lambda x: (common(x[1]), x[0] if x[0] is not None else -1))
        #: Of each piece (an item up to PASSAGE words is one), the item; of each item, its id, its number of pieces and its parts.
        self.owner = [x[2] for x in items]
        self.ids = [x[0] for x in whole]
        self.pieces = [len(x[1]) for x in whole]
        self.parts = [(q, a) for _, _, q, a in whole]
        self_score = []
        self.ranges = -(-len(items) // RANGE)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, words, _) in enumerate(items):
            norm = K1 * (1 - B + B * len(words) / mean_length)
            impact = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(words.tolist()).items()}
            own = math.fsum(impact.values())
            self_score.append(own)
            for t, w in impact.items():
                postings[t].append((k, w / own))
        total = [0.0] * len(whole)
        for k, own in zip(self.owner, self_score):
            total[k] += own
        self.weight = [own / total[k] for k, own in zip(self.owner, self_score)]
        self.terms = np.array(sorted(postings), np.uint64)
        lists = [postings[t] for t in self.terms.tolist()]
        #: Of each term, the blocks by range: its largest impact there, and the postings.
        self.blocks: list[dict[int, tuple[float, list[tuple[int, float]]]]] = []
        for p in lists:
            by = defaultdict(list)
            for k, w in p:
                by[k // RANGE].append((k, w))
            self.blocks.append({r: (max(w for _, w in x), x) for r, x in by.items()})
        self.most = [max(w for _, w in p) for p in lists]
        common, held = set(), np.zeros(len(items))
        for i in sorted(range(len(lists)), key=lambda i: (-len(lists[i]), i)):
            more = held.copy()
            for k, w in lists[i]:
                more[k] += w
            if more.max() >= COMMON * threshold:
                break
            common.add(i)
            held = more
        self.rest = np.array([held[r * RANGE : (r + 1) * RANGE].max() for r in range(self.ranges)], np.float32)
        rare = [[] if i in common else p for i, p in enumerate(lists)] + [[]]
        self.from_ = np.r_[0, np.cumsum([len(p) for p in rare])]
        self.item = np.array([k for p in rare for k, _ in p], np.int64)
        self.impact = np.array([w for p in rare for _, w in p])
        none = len(self.terms)
        bits = max(8, int(none * 8).bit_length())
        self.bits = np.uint64(bits)
        high, low = self._slots(self.terms)
        self.first, self.second = np.full(1 << bits, none, np.int32), np.full(1 << bits, none, np.int32)
        self.first[high] = np.arange(none)
        lost = np.flatnonzero(self.first[high] != np.arange(none))  # another term took the slot
        self.second[low[lost]] = lost
        self.lost = lost[self.second[low[lost]] != lost]

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> (np.uint64(64) - self.bits)).astype(np.int64), (h & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers; len(terms) for words of no item."""
        none = len(self.terms)
        known = np.r_[self.terms, np.uint64(0)]
        high, low = self._slots(h)
        k = self.first[high]
        k = np.where(known[k] == h, k, self.second[low])
        k[(known[k] != h) | (k == none)] = none
        for i in self.lost.tolist():
            k[h == self.terms[i]] = i
        return k.astype(np.int64)

    def wand(self, terms: list[int], ranges: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items of these ranges whose score for the set of terms is at least the threshold."""
        mine = [(t, [self.blocks[t][r] for r in ranges if r in self.blocks[t]]) for t in terms]
        mine = [(t, x) for t, x in mine if x]
        lists = [[p for _, block in x for p in block] for _, x in mine]
        maxima = [{block[0][0] // RANGE: w for w, block in x} for _, x in mine]
        most = [self.most[t] for t, _ in mine]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while live:
            live.sort(key=lambda i: lists[i][at[i]][0])
            total, pivot = 0.0, None
            for n, i in enumerate(live):
                total += most[i]
                if total >= threshold - SLACK:
                    pivot = n
                    break
            if pivot is None:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            r = item // RANGE
            head = live[: pivot + 1]
            if sum(maxima[i].get(r, 0.0) for i in head) >= threshold - SLACK:
                if lists[live[0]][at[live[0]]][0] == item:
                    score = math.fsum(lists[i][at[i]][1] for i in head)
                    if score >= threshold - 1e-9:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # nothing in this range, up to where the next list begins
                to = (r + 1) * RANGE
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                to = max(to, item + 1)
            for i in head:
                p, k = lists[i], at[i]
                while k < len(p) and p[k][0] < to:
                    k += 1
                at[i] = k
            live = [i for i in live if at[i] < len(lists[i])]
        return found

    def search(self, h: np.ndarray, ptr: np.ndarray, threshold: float):
        """(text, first word, items and scores) of every passage that retrieves something."""
        half = PASSAGE // 2
        texts = len(ptr) - 1
        count = np.diff(ptr)
        blocks = -(-count // half)  # half passages
        first = np.r_[0, np.cumsum(blocks)]
        text_of = np.repeat(np.arange(texts), count)
        block_of = first[text_of] + (np.arange(len(h)) - ptr[:-1][text_of]) // half
        term = self.lookup(h)
        known = term < len(self.terms)
        width = len(self.terms) + 1
        key = np.sort(block_of[known] * width + term[known])
        if not len(key):
            return
        key = key[np.r_[True, key[1:] != key[:-1]]]
        b, t = key // width, key % width
        own = np.repeat(np.arange(texts), blocks)
        edge = np.searchsorted(b, np.arange(len(own) + 2))
        more = np.zeros(len(own), bool)  # the text goes on in the next block
        more[:-1] = own[1:] == own[:-1]
        items = self.ranges * RANGE
        for low in range(0, len(own), 4096):
            high = min(low + 4096, len(own))
            some = slice(edge[low], edge[min(high + 1, len(own))])  # with the block after
            each = self.from_[t[some] + 1] - self.from_[t[some]]
            place = np.repeat(self.from_[t[some]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            cell = np.repeat(b[some] - low, each) * items + self.item[place]
            sums = np.bincount(cell, self.impact[place], (high - low + 1) * items).reshape(-1, items)
            bound = sums[:-1] + np.where(more[low:high, None], sums[1:], 0)
            bound = bound.reshape(high - low, self.ranges, RANGE).max(axis=2) + self.rest
            at, ranges = np.nonzero(bound >= threshold - SLACK)
            for i in np.unique(at):
                k = low + int(i)
                words = np.unique(np.r_[t[edge[k] : edge[k + 1]], t[edge[k + 1] : edge[k + 2]]] if more[k] else t[edge[k] : edge[k + 1]])
                if got := self.wand(words.tolist(), ranges[at == i].tolist(), threshold):
                    yield int(own[k]), int((k - first[own[k]]) * half), got


def build(benchmark: DataFrame, threshold: float) -> list[Index]:
    """The index, in shards. The items come to the driver, as an inverted index of them must; their table is the benchmark's, not the corpus's."""
    read, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = r["text"] or ""
        w = scan_words(pa.array([text])).hashes
        if len(w) < LEAST_WORDS:
            continue
        held += len(w)
        if held > MOST_WORDS:
            raise ValueError(f"the benchmark has more than {MOST_WORDS} words; split it and take the leaks of all parts")
        at = split_item(text, len(w))
        n = len(scan_words(pa.array([text[:at]])).hashes) if at is not None else 0
        if not 0 < n < len(w):
            n = -(-len(w) // 2)
        read.append((r["item_id"], w, grams_of(w[:n]), grams_of(w[n:])))
    df = Counter(t for _, w, _, _ in read for t in set(w.tolist()))
    idf = {t: math.log(1 + (len(read) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean = sum(len(w) for _, w, _, _ in read) / max(1, len(read))
    shards, held = [], SHARD
    for item_id, w, q, a in read:
        pieces = np.array_split(w, -(-len(w) // (PASSAGE // 2))) if len(w) > PASSAGE else [w]
        if held + len(pieces) > SHARD:  # an item's pieces stay together
            shards.append([])
            held = 0
        shards[-1].append((item_id, pieces, q, a))
        held += len(pieces)
    return [Index(x, idf, mean, threshold) for x in shards]


def matches(shards: list[Index], texts: pa.Array, threshold: float, verify: float):
    """(row, item_id, score, question overlap, answer overlap), the best passage of each item in each row, or all passages of one in pieces."""
    w = scan_words(texts)
    for index in shards:
        yield from matches_of(index, w, threshold, verify)


def matches_of(index: Index, w: Words, threshold: float, verify: float):
    best: dict[tuple[int, int], tuple] = {}
    long: dict[tuple[int, int], tuple[dict[int, float], list[tuple[int, int]]]] = {}

    def shares_of(item: int, has: dict[int, np.ndarray]) -> list[float]:
        return [float(max((np.isin(part, g).mean() for g in has.values()), default=0.0) if len(part) else 1.0) for part in index.parts[item]]

    for row, word, got in index.search(w.hashes, w.ptr, threshold):
        a, b = int(w.ptr[row]), int(w.ptr[row + 1])
        begin, end = max(a, a + word - PASSAGE // 2), min(b, a + word + PASSAGE + PASSAGE // 2)
        has = grams_near(w.hashes, [(begin, end)])
        for piece, score in got:
            item = index.owner[piece]
            if index.pieces[item] > 1:
                scores, near = long.setdefault((row, item), ({}, []))
                scores[piece] = max(score, scores.get(piece, 0.0))
                near.append((begin, end))
                continue
            shares = shares_of(item, has)
            if min(shares) >= verify and (score, *shares) > best.get((row, item), (0.0,)):
                best[row, item] = (score, *shares)
    for (row, item), (scores, near) in long.items():
        score = math.fsum(index.weight[k] * x for k, x in scores.items())
        if score >= threshold - 1e-9 and min(shares := shares_of(item, grams_near(w.hashes, near))) >= verify:
            best[row, item] = (score, *shares)
    for (row, item), x in sorted(best.items()):
        yield row, index.ids[item], *(round(v, 9) for v in x)


def grams_near(h: np.ndarray, spans: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Of each n up to GRAM, the distinct n-grams within the spans (begin, end), as one where they overlap."""
    joined: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((begin, end))
    out = {}
    for n in range(1, GRAM + 1):
        if some := [ngrams(h[a:b], n)[: b - a - n + 1] for a, b in joined if b - a >= n]:
            out[n] = np.unique(np.concatenate(some))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, verify: float = VERIFY) -> DataFrame:
    """One row per row of docs and item found in it."""
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, threshold))

    def scan(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = C.column(part, "doc_id")
                rows = list(matches(shared.value, C.column(part, "text"), threshold, verify))
                if rows:
                    at, item, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(pa.int64()), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, verify: float = VERIFY) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows are tested where they are read: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, threshold))

    def scan(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in matches(shared.value, C.column(part, "text"), threshold, verify)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[0-9a-z\x{{c0}}-\x{{1fff}}\x{{2080}}-\x{{2fff}}\x{{3040}}-\x{{10ffff}}]+'), lambda x: x <> '')"
_HALF = PASSAGE // 2
_GRAMS = "list_distinct(case when len({0}) = 0 then [] else list_transform(range(1, len({0}) - least(len({0}), 3) + 2), lambda i: array_to_string({0}[i:i + least(len({0}), 3) - 1], ' ')) end)"
_QUESTION = _WORDS.format(r"regexp_extract(text, '^(.*[.!?][ \t\r\n\f\v]+)[^ \t\r\n\f\v]', 1, 's')")


def _overlap(part: str) -> str:
    return f"case when len({part}) = 0 then 1.0::double else len(list_filter({part}, lambda x: contains(' ' || array_to_string(near, ' ') || ' ', ' ' || x || ' '))) / len({part})::double end"


#: Scores of all passages and items, without an index, and their overlaps.
SQL = f"""
with t as (select item_id, {_WORDS.format("text")} as w, len({_QUESTION}) as n from benchmark where text is not null),
i as (select item_id, w, case when n > 0 and n < len(w) then n else (len(w) + 1) // 2 end as n from t where len(w) >= {LEAST_WORDS}),
p as (select item_id, w[:n] as q, w[n + 1:] as a from i),
g as (select item_id, {_GRAMS.format("q")} as q, {_GRAMS.format("a")} as a from p),
f as (select item_id, x, count(*) as f, any_value(size) as size from (select item_id, unnest(w) as x, len(w) as size from i) group by 1, 2),
c as (select count(*) as items, avg(len(w)) as mean from i),
d as (select x, ln(1 + (items - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from f, c group by x, items),
s as (select item_id, x, idf * f * {K1 + 1}::double / (f + {K1}::double * ({1 - B}::double + {B}::double * size / mean)) as s from f join d using (x), c),
m as (select item_id, x, s / sum(s) over (partition by item_id) as s from s),
dw as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
k as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) - 1 as pos from dw),
b as (select distinct doc_id, x, unnest(case when pos >= {_HALF} then [pos // {_HALF}, pos // {_HALF} - 1] else [0] end) as k from k where x in (select x from d)),
r as (select doc_id, k, item_id, sum(s) as score from b join m using (x) group by all having sum(s) >= {THRESHOLD} - 1e-9),
n as (select r.*, dw.w[greatest(k * {_HALF} - {_HALF}, 0) + 1:k * {_HALF} + {PASSAGE + _HALF}] as near from r join dw using (doc_id)),
o as (select doc_id, item_id, score, {_overlap("q")} as question_overlap, {_overlap("a")} as answer_overlap from n join g using (item_id)),
z as (select doc_id, item_id, max((score, question_overlap, answer_overlap)) as v from o where least(question_overlap, answer_overlap) >= {VERIFY} group by all)
select doc_id, item_id, round(v[1], 9) as score, round(v[2], 9) as question_overlap, round(v[3], 9) as answer_overlap from z
"""
