import random

import numpy as np
import pytest

from chunkwright.llm import telephony as A


def mulaw(u):
    u = ~u & 0xFF
    t = ((u & 0x0F) << 3) + 0x84
    t <<= (u & 0x70) >> 4
    return 0x84 - t if u & 0x80 else t - 0x84


def alaw(a):
    a ^= 0x55
    t, seg = (a & 0x0F) << 4, (a & 0x70) >> 4
    t = t + 8 if seg == 0 else t + 0x108 if seg == 1 else (t + 0x108) << (seg - 1)
    return t if a & 0x80 else -t


def adpcm(p, block):
    out = []
    for k in range(0, len(p), block):
        q = p[k : k + block]
        if len(q) < 4:
            break
        v, i = int.from_bytes(q[:2], "little", signed=True), min(q[2], 88)
        out.append(v)
        for b in q[4:]:
            for h in (b & 15, b >> 4):
                s = int(A.STEPS[i])
                d = (s >> 3) + (s if h & 4 else 0) + (s >> 1 if h & 2 else 0) + (s >> 2 if h & 1 else 0)
                v = max(-32768, min(32767, v - d if h & 8 else v + d))
                i = max(0, min(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][h & 7]))
                out.append(v)
    return out


def resampled(s, factor):
    w, half = A.phases(factor), A.TAPS // 2
    out = []
    for i in range(len(s)):
        for k in range(factor):
            y = sum(float(w[k][j]) * s[i + j - half + 1] for j in range(A.TAPS) if 0 <= i + j - half + 1 < len(s))
            out.append(max(-32768, min(32767, round(y))))
    return out


def test_tables():
    assert A.MULAW.tolist() == [mulaw(k) for k in range(256)] and A.ALAW.tolist() == [alaw(k) for k in range(256)]
    assert (A.MULAW[0], A.MULAW[0x80], A.ALAW[0xD5], A.ALAW[0x2A]) == (-32124, 32124, 8, -32256)


def test_adpcm_blocks():
    rng = random.Random(0)
    payloads = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 256, 257, 259, 260, 511, 512, 3000)]
    assert [x.tolist() for x in A.adpcm_blocks(payloads)] == [adpcm(p, A.BLOCK) for p in payloads]
    assert [x.tolist() for x in A.adpcm_blocks(payloads[:3])] == [[], [], []]


@pytest.mark.parametrize("factor", [1, 2, 3])
def test_resample(factor):
    rng = np.random.default_rng(0)
    pieces = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (0, 1, 5, 40, 0, 3)]
    starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
    got = A.resample(np.concatenate(pieces), starts, factor)
    want = [y for p in pieces for y in resampled(p.tolist(), factor)]
    assert np.abs(got.astype(int) - np.array(want)).max() <= 1
    assert got[::factor].tolist() == np.concatenate(pieces).tolist()


def test_a_tone_stays_a_tone():
    t = np.arange(4000) / A.RATE
    s = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    got = A.resample(s, np.array([0, len(s)]), 2)[100:-100]
    want = 8000 * np.sin(2 * np.pi * 440 * (np.arange(8000) / 16000))[100:-100]
    assert np.abs(got - want).max() < 80


def test_nasty(spark):
    long = bytes(range(256)) * 4000
    rows = [(1, "mulaw", b"\x00\xff"), (2, "alaw", b"\x55"), (3, "adpcm", b"\x00\x01\x02\x03\x04"), (4, None, b"x"), (5, "mp3", b"x"), (6, "mulaw", None), (7, "mulaw", b""), (8, "adpcm", b"abc"), (None, "mulaw", long), (1, "mulaw", b"\x00\xff")]
    df = spark.createDataFrame([(i, c, p if p is None else bytearray(p)) for i, c, p in rows], "id bigint, codec string, payload binary").selectExpr("*", "1 as pcm", "2 as n_samples")
    got = [(r.id, r.n_samples, None if r.pcm is None else bytes(r.pcm)) for r in A.decode_audio(df).collect()]
    assert len(got) == len(rows)
    by = {i: (n, p) for i, n, p in got}
    assert by[4] == by[5] == by[6] == (0, None) and by[7] == by[8] == (0, b"")
    assert by[1][0] == 4 and by[3][0] == 6 and by[None][0] == 2 * len(long)
    assert np.frombuffer(by[1][1], "<i2")[::2].tolist() == [-32124, 0]
    assert A.decode_audio(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        A.decode_audio(df, 8000, 11025)


def test_calls(nasty):
    got = A.decode_audio(A.calls(nasty)).collect()
    assert len(got) == nasty.count() and all((r.pcm is None) == (r.codec is None or r.id == 1) for r in got)
