import struct

import numpy as np
import pytest

from lodestone.llm import tiff as T


def image(shape, dtype, seed=1):
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(rng.integers(0, 3, shape), axis=1)
    return smooth.astype(dtype)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("dtype,predictor", [("u1", 1), ("u1", 2), ("u2", 1), ("u2", 2), ("u4", 2), ("f4", 3), ("f8", 3), ("f4", 1)])
@pytest.mark.parametrize("layout", [{}, {"rows": 7}, {"tile": 16}])
def test_round_trip(big, compression, dtype, predictor, layout):
    for shape, planar in (((37, 41, 3), 1), ((20, 33, 3), 2), ((5, 3, 1), 1)):
        a = image(shape, dtype)
        raw = T.build([(a, compression, predictor, planar)], big, **layout)
        got = list(T.pages(raw))
        assert [g[-1] for g in got] == [None]
        k, width, height, samples, bits, name, pred, pixels, _ = got[0]
        assert (k, height, width, samples, bits, name, pred) == (0, *shape, a.dtype.itemsize * 8, T.NAMES[compression], predictor)
        assert pixels == a.astype(a.dtype.newbyteorder("<")).tobytes()


@pytest.mark.parametrize("size", [0, 1, 2, 127, 128, 129, 5000, 300_000])
def test_codecs(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, np.uint8).tobytes(), rng.integers(0, 2, size, np.uint8).tobytes(), b"a" * size, (b"the cat " * size)[:size]):
        assert T.unpack_lzw(T.pack_lzw(data), size) == data
        assert T.unpack_bits(T.pack_bits(data), size) == data


def test_known_streams():
    assert T.unpack_bits(bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", "")), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # clear, 7, 258, 8, 8, 258, 6, 6, end: the worked example of the format's description
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.unpack_lzw(raw, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_bilevel_rows():
    def tag(n, kind, v):
        return struct.pack("<HHI", n, kind, 1) + struct.pack("<H" if kind == 3 else "<I", v).ljust(4, b"\0")

    body = bytes([0b10110000, 0b01000000, 0b11111111, 0b11000000])
    tags = [tag(256, 3, 10), tag(257, 3, 2), tag(258, 3, 1), tag(259, 3, 1), tag(273, 4, 8), tag(279, 4, 4)]
    raw = b"II*\0" + struct.pack("<I", 12) + body + struct.pack("<H", len(tags)) + b"".join(tags) + b"\0" * 4
    pixels = list(T.pages(raw))[0][-2]
    assert pixels == bytes([1, 0, 1, 1, 0, 0, 0, 0, 0, 1] + [1] * 10)


def test_64_bit_file():
    a = image((4, 6, 1), "u1")
    body = a.tobytes()
    entries = b"".join(struct.pack("<HHQQ", t, 4, 1, v) for t, v in ((256, 6), (257, 4), (258, 8), (259, 1), (273, 16), (277, 1), (278, 4), (279, 24)))
    raw = b"II" + struct.pack("<HHHQ", 43, 8, 0, 40) + body + struct.pack("<Q", 8) + entries + struct.pack("<Q", 0)
    assert list(T.pages(raw))[0][-2] == body


def test_several_pages_and_faults(spark):
    a, b = image((9, 8, 1), "u1"), image((3, 4, 3), "u2", 2)
    raw = T.build([(a, 5, 2, 1), (b, 8, 1, 2), (a, 1, 1, 1)])
    assert [(p[0], p[-1]) for p in T.pages(raw)] == [(0, None), (1, None), (2, None)]
    at = raw.index(struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 8))
    odd = raw[: at + 8] + struct.pack("<H", 7) + raw[at + 10 :]
    got = list(T.pages(odd))
    assert [p[-1] is None for p in got] == [True, False, True] and got[1][-2] is None and got[1][5] == "7"
    end = len(raw) - 4
    first = struct.unpack_from("<I", raw, 4)[0]
    assert len(list(T.pages(raw[:end] + struct.pack("<I", first)))) == 3  # a loop ends
    rows = [(1, raw), (1, raw), (2, None), (3, b""), (4, b"II*\0"), (5, b"junk of any kind"), (6, raw[: len(raw) // 2]), (None, raw)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x), "x") for i, x in rows], "image_id bigint, media binary, page string")
    out = T.read_pages(df).collect()
    assert sorted((r.page, r.error is None) for r in out if r.image_id == 1) == [(0, True), (0, True), (1, True), (1, True), (2, True), (2, True)]
    assert sum(r.image_id is None for r in out) == 3
    assert all(r.page == -1 and r.error and r.pixels is None for r in out if r.image_id in (2, 3, 4, 5))
    assert any(r.error for r in out if r.image_id == 6)
    assert T.read_pages(df.limit(0)).count() == 0


def test_parts_make_up_the_pages(spark, monkeypatch):
    a, b = image((37, 41, 3), "u2"), image((20, 33, 3), "u1", 3)
    files = [(1, T.build([(a, 8, 2, 1), (b, 5, 1, 2)], tile=16)), (2, T.build([(b, 1, 1, 1)], rows=7)), (3, b"junk"), (4, None)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x), 1) for i, x in files], "image_id bigint, media binary, y int")
    whole = {(r.image_id, r.page): r for r in T.read_pages(df).collect()}
    made = {}
    for r in T.read_parts(df).collect():
        if r.error:
            assert r.page == -1 and r.image_id in (3, 4)
            continue
        w = whole[r.image_id, r.page]
        own = made.setdefault((r.image_id, r.page), np.zeros((w.height, w.width, w.samples), f"<u{w.bits // 8}"))
        part = np.frombuffer(r.pixels, own.dtype).reshape(r.height, r.width, r.samples)
        own[r.y : r.y + r.height, r.x : r.x + r.width, r.plane : r.plane + r.samples] = part
    assert {k: v.tobytes() for k, v in made.items()} == {k: bytes(w.pixels) for k, w in whole.items() if w.error is None} and len(made) == 3
    # a page too large for one value has its fault there, and its parts all the same
    monkeypatch.setattr(T, "VALUE", 2000)
    assert [p[-1] is None for p in T.pages(files[0][1])] == [False, True]
    assert len(list(T.parts(files[0][1], next(T.directories(files[0][1])), T.layout(next(T.directories(files[0][1])))))) == 9


def test_random_damage_never_crashes():
    raw = T.build([(image((9, 8, 1), "u1"), c, 1, 1) for c in (1, 5, 8, 32773)])
    rng = np.random.default_rng(0)
    for _ in range(400):
        bad = bytearray(raw)
        for at in rng.integers(0, len(bad), 4):
            bad[at] = rng.integers(256)
        assert all(p[-1] is None or p[-2] is None for p in T.pages(bytes(bad)))


def test_scans_are_the_texts(spark):
    df = spark.createDataFrame([(0, "é" * 9000), (1, ""), (2, None), (None, "abc")], "page_id bigint, html string")
    out = {}
    for r in T.read_pages(T.scans(df)).orderBy("image_id", "page").collect():
        assert r.error is None
        out[r.image_id] = out.get(r.image_id, b"") + bytes(r.pixels)
    assert {k: v.rstrip(b"\0").decode() for k, v in out.items()} == {0: "é" * 9000, 1: "", 2: "", None: "abc"}
