"""Token ids as bytes: ids ranked by frequency in the corpus, in byte-aligned variable-length coding with separate control bytes.

Tokens are those of a public byte-level BPE whose vocabulary file (tiktoken format) is a parameter; nothing is trained. Texts are cut into
the pieces of the usual pattern by numpy over whole batches (``pieces``), each different piece of a batch is encoded once,
and what is known is kept by the worker (at most CACHE pieces).

Every id is replaced by its rank: 0 for the most frequent in all documents, equal counts by id, so that most take one
byte. A rank takes 1 to 4 bytes, little-endian; two bits a rank tell how many, four ranks a control byte. Control and data
bytes are apart, so that decoding is look-ups in a table of 256 rows and one gather (``decode``).

Result of ``encode_corpus``: one row a document, kind "document" (doc_id, n_tokens, control, data), and one row of kind "dictionary",
whose ranks, decoded, are the ids in the order of their ranks; with it, everything can be decoded. A null text has null
control and data and 0 tokens, an empty one has empty ones. Repeated rows give repeated rows and count as often; null ids are carried; an empty table gives
the dictionary alone. Texts are tokenised once; the ids lie in the shared folder until they are coded. Counts are arrays of
the vocabulary's size, summed by slices; documents are never shuffled. The vocabulary file is read by the driver (it has some MB) and sent; pieces are told apart by
their bytes. The folder of ids goes when the driver ends.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import common as C
from chunkwright.llm.textscan import equal_spans, hash_spans, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point, what the pattern takes it for."""
    kind = np.zeros(0x110000, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    kind[first == "L"] = LETTER
    kind[first == "N"] = NUMBER
    kind[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kind


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character each byte is of; b ends in 8 spare bytes."""
    kind = classes()
    out = kind[:256][b[:-8]]
    lead = np.flatnonzero(b[:-8] >= 0xC0)
    if len(lead):
        x = [b[lead + k].astype(np.int32) for k in range(4)]
        low = [v & 0x3F for v in x]
        code = np.where(x[0] < 0xE0, (x[0] & 0x1F) << 6 | low[1], np.where(x[0] < 0xF0, (x[0] & 0x0F) << 12 | low[1] << 6 | low[2], (x[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
        own = kind[code]
        for k, some in ((0, x[0] >= 0), (1, x[0] >= 0xC0), (2, x[0] >= 0xE0), (3, x[0] >= 0xF0)):
            out[lead[some] + k] = own[some]
    return out


def pieces(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin, over all texts (which end where the next begins)."""
    n = len(b) - 8
    if n == 0:
        return np.zeros(0, np.int64)
    kind = byte_classes(b)
    edge = np.zeros(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    begins = at[:-1][at[:-1] < n]
    edge[begins] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], n]
    cls = kind[start]
    doc_start = np.zeros(n + 1, bool)
    doc_start[begins] = True
    doc_start[n] = True
    first, last = doc_start[start], doc_start[end]  # of its text
    blank = cls == SPACE
    lends = blank & ~last & (b[end - 1] == 32)  # its last blank goes to the next run
    char = end - 1
    for _ in range(3):  # the first byte of the run's last character
        char = np.where((b[char] & 0xC0) == 0x80, char - 1, char)
    borrowed = np.r_[False, lends[:-1]] & ~first
    marks = [start[~blank] - borrowed[~blank]]
    # Blank runs: what is before the last blank; a last character that isn't a blank stands alone.
    marks.append(start[blank & (~lends | (char > start))])
    marks.append(char[blank & ~last & ~lends & (char > start)])
    # Contractions: an apostrophe alone, not after a blank it took, before letters.
    quote = (cls == OTHER) & (end - start == 1) & (b[start] == 39) & ~borrowed & ~last
    quote[:-1] &= cls[1:] == LETTER
    quote[-1] = False
    q = np.flatnonzero(quote)
    if len(q):
        c, d = b[start[q] + 1], b[start[q] + 2]
        one = np.isin(c, [115, 116, 109, 100])
        two = ((c == 114) & (d == 101)) | ((c == 118) & (d == 101)) | ((c == 108) & (d == 108))
        size = np.where(one, 1, np.where(two & (end[q + 1] - start[q + 1] >= 2), 2, 0))
        q, size = q[size > 0], size[size > 0]
        gone = start[q + 1]
        mark = np.unique(np.concatenate(marks))
        mark = mark[~np.isin(mark, gone)]
        rest = gone + size
        return np.unique(np.r_[mark, rest[rest < end[q + 1]]])
    return np.unique(np.concatenate(marks))


class Tokenizer:
    """Ids of whole batches. One a worker: it keeps the pieces it has seen."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(k) for a, k in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, list[int]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        b, at = text_bytes(texts)
        start = pieces(b, at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        end = np.r_[start[1:], len(b) - 8]
        code, unique = pd.factorize(hash_spans(b, start, end))
        where = np.full(len(unique), -1)
        where[code[::-1]] = np.arange(len(code))[::-1]
        # Pieces of one hash are compared by their bytes; another one's would be encoded by itself.
        odd = np.flatnonzero(~equal_spans(b, start, start[where[code]], end - start, (end - start)[where[code]]))
        code[odd] = len(unique) + np.arange(len(odd))
        where = np.r_[where, odd]
        raw, known = b.tobytes(), self.known
        if len(known) > CACHE:
            known.clear()
        single = self.encoding._core_bpe.encode_single_piece
        lists = []
        for s, e in zip(start[where].tolist(), end[where].tolist()):
            piece = raw[s:e]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = single(piece)
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        each = size[code]
        total = np.cumsum(each)
        ids = flat[np.repeat(first[code] - (total - each), each) + np.arange(total[-1])]
        return ids, np.r_[0, total][np.searchsorted(start, at)]


_LENGTH = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 values."""
    v = np.ascontiguousarray(values, "<u4")
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = size
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values."""
    size = _LENGTH[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(size)
    spare = np.frombuffer(data + b"\0\0\0", np.uint8)
    if not n:
        return np.zeros(0, np.uint32)
    return np.ndarray((len(spare) - 3,), "<u4", buffer=spare, strides=(1,))[end - size] & _KEEP[size - 1]


def tokenise(docs: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(doc_id, ids as two or four bytes each) in the shared folder, and the vocabulary's size."""
    with open(path, "rb") as f:
        vocabulary = f.read()
    size = Tokenizer(vocabulary).size
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = "<u2" if size <= 65_536 else "<u4"

    def scan(batches):
        work = Tokenizer(shared.value)
        for batch in batches:
            for part in C.slices(batch, "text"):
                texts = C.column(part, "text")
                ids, at = work.encode(texts)
                ids = ids.astype(kind)
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([C.column(part, "doc_id").cast(pa.int64()), pa.array(raw, pa.binary(), mask=texts.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "ids"])

    folder = C.scratch(docs.sparkSession, "tokens")
    docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, ids binary").write.option("compression", "zstd").mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder), size


def ranks_of(tokens: DataFrame, size: int) -> np.ndarray:
    """The ids in the order of their ranks. The count has the vocabulary's size, whatever the corpus."""
    kind = "<u2" if size <= 65_536 else "<u4"

    def scan(batches):
        count = np.zeros(size, np.uint64)
        for batch in batches:
            for raw in C.column(batch, "ids"):
                if raw.is_valid:
                    count += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=size).astype(np.uint64) if len(raw.as_buffer()) > size else 0
                    if len(raw.as_buffer()) <= size:
                        np.add.at(count, np.frombuffer(raw.as_buffer(), kind).astype(np.int64), np.uint64(1))
        if count.any():
            yield C.pack_slices(np.r_[count, np.zeros(-size % C.SLICE, np.uint64)])

    packed = tokens.select("ids").mapInArrow(scan, "slice int, data binary")
    count = C.gather_slices(C.sum_slices(packed, "uint64", np.add), size + -size % C.SLICE, "uint64")[:size]
    return np.lexsort((np.arange(size), -count.astype(np.int64)))


def encode_corpus(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    spark = docs.sparkSession
    tokens, size = tokenise(docs, path)
    order = ranks_of(tokens, size)
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    kind = "<u2" if size <= 65_536 else "<u4"
    schema = "kind string, doc_id bigint, n_tokens bigint, control binary, data binary"

    def scan(batches):
        table = shared.value
        for batch in batches:
            n, control, data = [], [], []
            for raw in C.column(batch, "ids"):
                if not raw.is_valid:
                    n.append(0), control.append(None), data.append(None)
                    continue
                values = table[np.frombuffer(raw.as_buffer(), kind)]
                c, d = encode(values)
                n.append(len(values)), control.append(c), data.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(["document"] * len(n), pa.string()), C.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["kind", "doc_id", "n_tokens", "control", "data"])

    c, d = encode(order.astype(np.uint32))
    dictionary = spark.createDataFrame([("dictionary", None, size, bytearray(c), bytearray(d))], schema)
    return tokens.mapInArrow(scan, schema).unionByName(dictionary)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
