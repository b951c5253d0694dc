import numpy as np

from chunkwright.llm import ngram_join as J

T = 0.6
SHIFT = np.uint64(64 - J.SKETCH_BITS)


def near_copies(sets, shared=60, own=3, seed=3):
    """Sets of hashes of one class: all are near copies of each other."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
    return [np.r_[common, rng.integers(0, 1 << 63, own).astype(np.uint64)] for _ in range(sets)]


def bucket(grams, rank, hot):
    """The packed rows of all tokens, as one bucket."""
    made = [J.prefix_rows(g, rank, SHIFT, T) for g in grams]
    count = [len(m[0]) for m in made]
    owner, pos = np.repeat(np.arange(len(made)), count), np.concatenate([np.arange(n) for n in count])
    doc = np.arange(len(made))
    row, token, part, tag = J.spread(np.concatenate([m[0] for m in made]), doc[owner], hot)
    row, token, part, tag = (x[np.argsort(owner[row], kind="stable")] for x in (row, token, part, tag))
    col = {"sig": 0 * doc, "doc": doc, "size": np.array([m[2] for m in made]), "rows": np.bincount(owner[row]), "digest": np.array([m[3] for m in made], np.uint32)}
    col |= {"token": token >> np.uint64(32), "pos": pos[row], "part": part, "tag": tag}
    return [J.pack_rows(col | {f"anchor{k}": np.array([m[4][k] for m in made], np.uint32) for k in range(J.ANCHORS)})]


def rank_of(grams):
    count = np.bincount((np.concatenate(grams) >> SHIFT).astype(np.int64), minlength=1 << J.SKETCH_BITS)
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def weights(blobs):
    got, rows = {}, 0
    for batch in J.bucket_pairs(blobs, T):
        rows += batch.num_rows
        for a, b, w in zip(*(J.C.column(batch, c).to_pylist() for c in ("doc_a", "doc_b", "weight"))):
            got[min(a, b), max(a, b)] = got.get((min(a, b), max(a, b)), 0) + w
    return got, rows


def test_pairs_of_a_large_class_leave_some_at_a_time(monkeypatch):
    monkeypatch.setattr(J, "HELD", 500)
    monkeypatch.setattr(J, "PIECE", 300)
    grams = near_copies(120)
    blobs = bucket(grams, rank_of(grams), J.HOT)
    batches = list(J.bucket_pairs(blobs, T))
    assert len(batches) > 10 and max(b.num_rows for b in batches) <= 500
    got, _ = weights(blobs)
    assert len(got) == 120 * 119 // 2 and min(got.values()) >= J.ENOUGH


def test_a_class_beyond_hot_is_told_at_anchors_too(monkeypatch):
    """Else each of its pairs comes at every common token of the prefixes."""
    monkeypatch.setattr(J, "HELD", 1)
    grams = near_copies(90)
    got, rows = weights(bucket(grams, rank_of(grams), hot=20))
    assert len(got) == 90 * 89 // 2 and min(got.values()) >= J.ENOUGH
    assert rows < 4 * len(got)


def test_buckets_follow_the_rows(spark, monkeypatch):
    info = spark.createDataFrame([(100,)] * 1000, "size int")
    assert J.buckets_for(info, T) == max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    monkeypatch.setattr(J, "BUCKET_ROWS", 100)
    assert J.buckets_for(info, T) == 1000 * int(J.probe_prefix(100, T)) // 100
    assert J.buckets_for(info.limit(0), T) >= 16
