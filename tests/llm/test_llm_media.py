import hashlib

import numpy as np
import pytest

from pagewright.llm import flac, media


def decoded(data):
    rows = list(flac.blocks(data))
    return rows, b"".join(r["pcm"] or b"" for r in rows)


def signals(seed):
    r = np.random.default_rng(seed)
    t = np.arange(r.integers(1, 3000))
    tone = 9000 * np.sin(t / 17.0) + r.normal(0, 30, len(t))
    yield np.stack([tone, 0.7 * tone + r.normal(0, 9, len(t))]).astype(np.int64), 16
    yield r.integers(-32768, 32768, (2, len(t))), 16  # noise
    yield np.full((1, len(t)), -5), 16  # constant
    yield (r.integers(-20, 20, (1, len(t))) << 4), 16  # wasted bits
    yield r.integers(-128, 128, (1, len(t))), 8
    yield r.integers(-(1 << 23), 1 << 23, (2, len(t))), 24
    yield np.cumsum(r.integers(-3, 4, (2, len(t))), axis=1).clip(-2000, 2000), 12
    x = np.zeros((1, len(t)), np.int64)
    x[:, :: max(1, len(t) // 3)] = 30000  # long unary runs
    yield x, 16


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("lpc", [0, 2, 5])
def test_round_trip(seed, lpc):
    for x, bits in signals(seed):
        block = int(np.random.default_rng(seed).choice([16, 192, 576, 4096]))
        data = flac.encode(x, 44100, bits, block, lpc)
        rows, body = decoded(data)
        assert body == flac.pcm(x, bits)
        assert {r["status"] for r in rows} == {"ok"} and rows[-1]["md5_ok"] is True
        assert [r["sample_offset"] for r in rows] == list(range(0, x.shape[1], block))
        assert {(r["sample_rate"], r["channels"], r["bits"]) for r in rows} == {(44100, x.shape[0], bits)}
        for r in rows:  # each block is found again at its byte
            f, y, _ = flac.frame(data, r["frame_offset"], flac.header(data))
            assert f.offset == r["sample_offset"] and flac.pcm(y, bits) == r["pcm"]


def test_linear_prediction_equals_the_recurrence():
    r = np.random.default_rng(3)
    residual, warm, c = r.integers(-50, 50, 200), r.integers(-500, 500, 4), [3, -2, 1, 1]
    x = warm.tolist()
    for e in residual.tolist():
        x.append(e + (sum(c[j] * x[-1 - j] for j in range(4)) >> 2))
    assert flac.restore_linear(warm, residual, c, 2).tolist() == x
    for order in range(5):
        y = r.integers(-500, 500, 90)
        d = y
        for _ in range(order):
            d = np.diff(d)
        assert flac.restore_fixed(y[:order], d).tolist() == y.tolist()


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


def test_damaged_frames_are_told_and_skipped():
    x = np.random.default_rng(1).integers(-3000, 3000, (2, 1000))
    data = flac.encode(x, block=100)
    whole, _ = decoded(data)
    for k in (0, 4, 9):
        at = whole[k]["frame_offset"] + 40
        rows, _ = decoded(data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :])
        good = {r["sample_offset"]: r["pcm"] for r in rows if r["status"] == "ok"}
        assert good == {r["sample_offset"]: r["pcm"] for i, r in enumerate(whole) if i != k}
        assert any(r["status"] != "ok" and r["pcm"] is None for r in rows) and rows[-1]["md5_ok"] is None
    rows, _ = decoded(data[:-30])
    assert [r["status"] for r in rows] == ["ok"] * 9 + ["truncated"]
    wrong = bytearray(data)
    wrong[26:42] = hashlib.md5(b"other").digest()
    assert decoded(bytes(wrong))[0][-1]["md5_ok"] is False


def test_the_whole_query_against_the_samples_that_were_put_in(load):
    """op10_flac: every block's samples and offsets, and that the streams hold what the method names."""
    vectors = load("embeddings")
    made = media.from_vectors(vectors)
    by = {}
    for r in media.decode(made).collect():
        assert r.status == "ok"
        by.setdefault(r.media_id, []).append(r)
    assert len(by) == vectors.count()
    for v in vectors.collect():
        rows, at = sorted(by[v.vec_id], key=lambda r: r.block), 0
        x = media.waves(np.array([v.embedding], float))[0]
        assert x.shape[1] == media.WAVE * -(-len(v.embedding) // media.VALUES)
        for r in rows:
            assert r.sample_offset == at and r.bits == 16 and r.channels == 2
            want = x[:, at : at + r.samples].T.astype("<i2")
            assert bytes(r.pcm) == want.tobytes()
            at += r.samples
        assert at == x.shape[1] and rows[-1].md5_ok
    kinds, parts = set(), set()
    for r in made.limit(100).collect():
        data = bytes(r.content)
        for f in by[r.media_id]:
            for s in flac.read_frame(data, f.frame_offset, flac.header(data))[1]:
                kinds.add(len(s.coefficients))
    assert 8 in kinds  # general linear predictors
    partitions = flac._residual

    def counted(b, n, order):
        b.take(2)
        parts.add(b.take(4))
        b.pos -= 6
        return partitions(b, n, order)

    flac._residual = counted
    try:
        for r in made.limit(100).collect():
            list(flac.blocks(bytes(r.content)))
    finally:
        flac._residual = partitions
    assert max(parts) > 0  # several Rice partitions


#: The examples that RFC 9639 works out, with their samples by channel.
RFC = [
    ("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a", [[25588], [10416]]),
    (
        "664c614300000022001000100000170000440ac442f000000013d5b0564975e98b8d8b930422757b8103030000120000000000000000000000000000000000100400003a200000007265666572656e6365206c6962464c414320312e332e332032303139303830340100"
        "00000e0000005449544c453dd7a9d79cd795d79d81000006000000000000fff86998000f9912086701623d1442998f5df70d6fe00c17caeb21000ee7a77a24a1590c1217b603097b784faa9a33d285e070ad5b1b4851b4010d99d2cd1a68f1e6b810fff86918"
        "0102a402c382c40bc14a03ee48dd03b67c1330",
        [[10372, 18041, 14942, 17876, 15627, 17899, 16242, 18077, 16824], None],
    ),
    ("664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3", [[0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]]),
]


@pytest.mark.parametrize("example", range(3))
def test_examples_of_the_specification(example):
    """Streams of another encoder, whose own sums they carry."""
    text, want = RFC[example]
    data = bytes.fromhex(text)
    rows = list(flac.blocks(data))
    assert {r["status"] for r in rows} == {"ok"} and rows[-1]["md5_ok"] is True
    _, x, _ = flac.frame(data, rows[0]["frame_offset"], flac.header(data))
    for channel, samples in zip(x.tolist(), want):
        assert samples is None or channel[: len(samples)] == samples


def test_predictors_side_by_side_equal_one_by_one():
    r = np.random.default_rng(6)
    subframes = []
    for order, n in ((1, 40), (8, 40), (8, 100), (32, 70)) * 12:
        subframes.append(flac.Subframe(0, None, r.integers(-500, 500, order), r.integers(-90, 90, n - order), r.integers(-(400 // order), 400 // order + 1, order).tolist(), 9))
    for s, x in zip(subframes, flac.restored(subframes)):
        assert x.tolist() == flac.restore_linear(s.warm, s.residual, s.coefficients, s.shift).tolist()


def test_sums_equal_the_loop_over_bytes():
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4095, 4096, 4097, 8192, 8193, 20_000):
        data, sum_ = r.integers(0, 256, n, dtype=np.uint8).tobytes(), 0
        for b in data:
            sum_ = (sum_ << 8 & 0xFFFF) ^ flac._CRC16[sum_ >> 8 ^ b]
        assert flac.crc16(data) == sum_


def test_streams_are_told_apart_and_totals_are_held_against_the_header():
    a, b = (flac.encode(np.random.default_rng(k).integers(-3000, 3000, (2, 1000)), block=100) for k in (1, 2))
    edge = list(flac.blocks(a))[7]["frame_offset"]
    short, silent = a[:edge], bytearray(a[:edge])
    silent[26:42] = bytes(16)  # no sum of its own
    streams = [("a", a), ("none", None), ("short", short), ("silent", bytes(silent)), ("b", b), ("bad", b"x"), ("a again", a), ("head", a[:42])]
    got = list(flac.blocks_of(streams))
    for key, data in streams:
        mine = [r for k, r in got if k == key]
        assert mine == list(flac.blocks(data))
        assert [r["status"] for r in mine] == {"short": ["ok"] * 7 + ["truncated"], "silent": ["ok"] * 7 + ["truncated"], "none": ["null"], "bad": ["not flac"], "head": ["no frames"]}.get(key, ["ok"] * 10)
        assert mine[-1]["md5_ok"] is (True if key in ("a", "b", "a again") else None)
    assert [k for k, _ in got] == [k for k, d in streams for _ in flac.blocks(d)]


def test_odd_rows(spark):
    sound = flac.encode(np.arange(400).reshape(2, 200), block=64)
    rows = [(1, sound), (1, sound), (2, None), (3, b""), (None, sound), (4, b"no flac at all"), (5, b"fLaC"), (6, flac.encode(np.zeros((1, 700_000), np.int64) + np.arange(700_000) % 7))]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "media_id long, content binary, status string")
    got = media.decode(df).collect()
    assert [r.status for r in got if r.media_id in (2, 3, 4, 5)] == ["null", "not flac", "not flac", "truncated"]
    assert sum(r.samples for r in got if r.media_id == 6) == 700_000
    assert [r.sample_offset for r in got if r.media_id is None] == [0, 64, 128, 192]
    assert sum(r.media_id == 1 for r in got) == 8
    assert media.decode(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.5]), (4, [2.0, -2.0, float("nan")])], "vec_id long, embedding array<float>")
    assert {r.media_id: r.status for r in media.decode(media.from_vectors(odd)).collect()} == {1: "null", 2: "null", 3: "ok", 4: "ok"}
