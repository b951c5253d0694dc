"""Language identification by a byte convolutional network, trained and run in numpy.

The network: every byte of a window of WINDOW bytes has an embedding; filters of several widths run over it, each filter
keeps its maximum over the window (after a ReLU), and a softmax over the pooled values gives the languages' probabilities. Trained by
Adam on windows of labelled texts: at most SAMPLE documents a language (those of least md5 of their id), WINDOWS windows of each.

At work a text is cut into fixed windows, one after another to its end, the last filled up with zeros; all windows of a batch go
through the network at once. As an embedding followed by a filter is linear in each byte, a filter of width w is w table
look-ups by byte, added (``tables``); bytes come in pairs through a table of 65,536 rows. A text's log-probabilities are the mean of its windows',
weighted by their bytes.

Decision: ``language`` is the most probable one; a document is accepted if its probability is at least MIN_PROB and
it has a letter. Null and empty texts have no language and are rejected. A null id is carried; repeated rows give the same
result; equal probabilities go to the first language in order. With no labelled row there is nothing to train, and a
ValueError says so, unless the table is empty (then the result is empty).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm import common as C
from chunkwright.llm.textscan import text_bytes

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
SAMPLE, WINDOWS, EPOCHS, BATCH, RATE = 400, 3, 4, 64, 0.01
MIN_PROB = 0.4


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # of each width: width * EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # widths * FILTERS x languages
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The maxima of windows x (n, WINDOW), by the definition; and where they are."""
        e = self.embed[x]
        kept, values = [], []
        for f, b in zip(self.filters, self.bias):
            w = len(f) // EMBED
            stack = np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            y = stack @ f + b
            at = y.argmax(axis=1)
            kept.append((stack, at))
            values.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.maximum(np.concatenate(values, axis=1), 0), kept

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def new_network(languages: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        languages,
        normal(256, EMBED, scale=0.5),
        [normal(w * EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(FILTERS * len(WIDTHS), len(languages), scale=0.1),
        np.zeros(len(languages), np.float32),
    )


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    pooled, kept = net.pooled(x)
    p = np.exp(net.log_probabilities(pooled))
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_pool = (p @ net.out.T) * (pooled > 0)
    d_embed = np.zeros_like(net.embed)
    d_filters, d_bias = [], []
    rows = np.arange(len(x))[:, None]
    for k, (f, (stack, at)) in enumerate(zip(net.filters, kept)):
        d = d_pool[:, k * FILTERS : (k + 1) * FILTERS]
        picked = stack[rows, at]  # n x FILTERS x width * EMBED: what each maximum saw
        d_filters.append(np.einsum("nfi,nf->if", picked, d))
        d_bias.append(d.sum(axis=0))
        back = d[:, :, None] * f.T[None]
        for j in range(len(f) // EMBED):
            np.add.at(d_embed, x[rows, at + j], back[:, :, j * EMBED : (j + 1) * EMBED])
    return [d_embed, *d_filters, *d_bias, pooled.T @ p, p.sum(axis=0)]


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (n, WINDOW), each window's text and its bytes."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][owner] + number * WINDOW
    filled = np.minimum(size[owner] - number * WINDOW, WINDOW)
    spread = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(spread, WINDOW)[begin] if len(begin) else np.zeros((0, WINDOW), np.uint8)
    if len(x):
        x = x.copy()
        for k in np.flatnonzero(filled < WINDOW):
            x[k, filled[k] :] = 0
    return x, owner, filled


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit on labelled texts. The order of the rows doesn't matter: they are sorted first."""
    rows = sorted(zip(labels, texts))
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for lang, text in rows:
        data, at = text_bytes(pa.array([text]))
        x, _, filled = windows_of(data, at)
        full = x[filled >= min(WINDOW, 64)] if (filled >= 64).any() else x
        pick = rng.permutation(len(full))[:WINDOWS]
        xs.append(full[pick])
        ys += [number[lang]] * len(pick)
    x, y = np.concatenate(xs), np.array(ys)
    net = new_network(languages, seed)
    weights = net.parameters()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            step += 1
            some = order[k : k + BATCH]
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, gradients(net, x[some], y[some]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


class Tables:
    """The network for whole batches: of every width, a table by pairs of bytes and, for odd widths, one by the last byte."""

    def __init__(self, net: Network):
        self.net = net
        single = lambda f, k: net.embed @ f[k * EMBED : (k + 1) * EMBED]
        pair = lambda f, k: (single(f, k)[None, :] + single(f, k + 1)[:, None]).reshape(65_536, -1)  # noqa: E731  (low byte first)
        self.parts = []
        for f in net.filters:
            w = len(f) // EMBED
            self.parts.append([(k, pair(f, k).astype(np.float32)) for k in range(0, w - 1, 2)] + ([(w - 1, single(f, w - 1).astype(np.float32))] if w % 2 else []))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        n, size = x.shape
        x = x.astype(np.int32)
        pairs = x[:, :-1] | (x[:, 1:] << 8)
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for j, (w, parts, b) in enumerate(zip(WIDTHS, self.parts, self.net.bias)):
            span = size - w + 1
            total = None
            for k, table in parts:
                got = table.take((pairs if len(table) > 256 else x)[:, k : k + span], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out[:, j * FILTERS : (j + 1) * FILTERS] = total.max(axis=1) + b
        return np.maximum(out, 0)

    def classify(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-probabilities by text, whether it has a letter)."""
        data, at = text_bytes(texts)
        x, owner, filled = windows_of(data, at)
        score = np.zeros((len(at) - 1, len(self.net.languages)))
        for k in range(0, len(x), 256):
            log_p = self.net.log_probabilities(self.pooled(x[k : k + 256])) * filled[k : k + 256, None]
            np.add.at(score, owner[k : k + 256], log_p)
        size = np.maximum(np.diff(at), 1)[:, None]
        letter = LETTER[data]
        count = np.r_[0, np.cumsum(letter)]
        return score / size, count[at[1:]] > count[at[:-1]]


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def labelled_sample(docs: DataFrame, sample: int) -> tuple[list[str], list[str]]:
    """At most ``sample`` labelled texts a language, those of least md5 of the id: first the ids, without the texts (each task keeps no more
    than ``sample`` a language before they meet), then the texts of those ids."""
    ids = docs.where("lang is not null and doc_id is not null").select("lang", "doc_id").groupBy("lang", "doc_id").agg(F.md5(F.col("doc_id").cast("string")).alias("h"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = [(r["lang"], r["doc_id"]) for r in ids.select("lang", "doc_id", least.alias("n")).where(F.col("n") <= sample).collect()]
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id bigint")
    got = docs.select("lang", "doc_id", "text").join(F.broadcast(wanted), ["lang", "doc_id"], "left_semi").where("length(text) > 0").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tables | None:
    texts, labels = labelled_sample(docs, sample)
    if not texts:
        if docs.limit(1).count():
            raise ValueError("no labelled text to train on")
        return None
    return Tables(train(texts, labels))


def identify(docs: DataFrame, tables: Tables | None, min_prob: float = MIN_PROB) -> DataFrame:
    """(doc_id, language, probability, accepted) of every row, where it is read."""
    spark = docs.sparkSession
    schema = "doc_id bigint, language string, probability double, accepted boolean"
    if tables is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(tables.net)

    def scan(batches):
        work = Tables(shared.value)
        for batch in batches:
            for part in C.slices(batch, "text"):
                language, probability, accepted = decide(work, C.column(part, "text"), min_prob)
                yield pa.RecordBatch.from_arrays([C.column(part, "doc_id").cast(pa.int64()), language, probability, accepted], ["doc_id", "language", "probability", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def decide(work: Tables, texts: pa.Array, min_prob: float) -> tuple[pa.Array, pa.Array, pa.Array]:
    score, letter = work.classify(texts)
    best = score.argmax(axis=1)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p = 1 / p.sum(axis=1)
    none = ~letter
    return pa.array(np.array(work.net.languages, object)[best], pa.string(), mask=none), pa.array(p, pa.float64(), mask=none), pa.array(letter & (p >= min_prob))


def keep_identified(docs: DataFrame, tables: Tables | None, min_prob: float = MIN_PROB) -> DataFrame:
    """docs without the rows whose language can't be told; all columns as they were."""
    if tables is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(tables.net)

    def scan(batches):
        work = Tables(shared.value)
        for batch in batches:
            for part in C.slices(batch, "text"):
                yield part.filter(decide(work, C.column(part, "text"), min_prob)[2])

    return docs.mapInArrow(scan, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
