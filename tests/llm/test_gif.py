"""GIF: round trips, disposal and transparency, damaged files, and the stored digests."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import gif
from rasterloom.llm.queries import op5_gif


def plain_lzw(stream: bytes, bits: int) -> bytes:
    """A decoder by the book: a code at a time, a table of strings."""
    clear, end, width, at, out, table, before = 1 << bits, (1 << bits) + 1, bits + 1, 0, b"", {}, None
    while at + width <= 8 * len(stream):
        code = int.from_bytes(stream[at // 8 : at // 8 + 3], "little") >> at % 8 & (1 << width) - 1
        at += width
        if code == clear:
            table, width, before = {k: bytes([k]) for k in range(clear)}, bits + 1, None
            free = end + 1
            continue
        if code == end:
            break
        text = table[code] if code in table else before + before[:1]
        out += text
        if before is not None and free < 4096:
            table[free] = before + text[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        before = text
    return out


SAMPLES = [b"", b"a", b"ab" * 500, bytes(64), bytes(range(256)) * 40, random.Random(3).randbytes(70_000), b"the quick brown fox " * 4000, b"a" * 200_000]


@pytest.mark.parametrize("data", SAMPLES)
def test_code_streams(data):
    stream = gif.lzw_encode(data)
    assert plain_lzw(stream, 8) == data
    got, error = gif.lzw_decode(stream, 8, max(1, len(data)))
    assert got == data and (error is None or not data)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = gif.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(data)] == data
    assert gif.read_samples(gif.encode_samples(payload))[0] == payload


def codes_in(codes, bits):
    return gif._pack_codes(np.array(codes), bits)


def test_a_full_table_that_is_kept():
    """Writers may go on with a full table instead of clearing it."""
    rng = random.Random(5)
    codes = [4] + [rng.randrange(4) for _ in range(30_000)] + [5]
    stream = codes_in(codes, 2)
    wanted = plain_lzw(stream, 2)
    assert len(wanted) == 30_000 and gif.lzw_decode(stream, 2, len(wanted))[0] == wanted


def frame(pixels, *, bits=2, at=(0, 0), delay=5, disposal=0, transparent=None, interlaced=False, palette=None):
    pixels = np.array(pixels, np.uint8)
    h, w = pixels.shape
    if interlaced:
        pixels = pixels[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]]
    flags = (0x40 if interlaced else 0) | (0x80 | 1 if palette else 0)
    out = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    out += struct.pack("<BHHHHB", 0x2C, at[0], at[1], w, h, flags) + (bytes(x for c in palette for x in c) if palette else b"") + bytes([bits])
    return out + gif._in_blocks(gif.lzw_encode(pixels.tobytes(), bits))


COLOURS = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]


def animation(*parts, width=3, height=2):
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 1, 0, 0) + bytes(x for c in COLOURS for x in c) + b"".join(parts) + b"\x3b"


def composed(data):
    return [f["canvas"].copy() for f in gif.frames(data) if not f.get("error")]


def test_disposal_and_transparency():
    red, green = [[1] * 3] * 2, [[2]]
    kept = composed(animation(frame(red), frame(green, at=(1, 1)), frame(green, at=(0, 0))))
    assert kept[2][0, 0].tolist() == kept[2][1, 1].tolist() == [0, 255, 0, 255] and kept[2][0, 2].tolist() == [255, 0, 0, 255]
    cleared = composed(animation(frame(red), frame(green, at=(1, 1), disposal=2), frame([[3, 0]], at=(0, 0), transparent=0)))
    assert cleared[2][1, 1].tolist() == [0, 0, 0, 0] and cleared[2][0, 0].tolist() == [0, 0, 255, 255] and cleared[2][0, 1].tolist() == [255, 0, 0, 255]
    restored = composed(animation(frame(red), frame(green, at=(1, 1), disposal=3), frame(green, at=(0, 0))))
    assert restored[2][1, 1].tolist() == [255, 0, 0, 255]
    own = composed(animation(frame([[1]], palette=[(9, 9, 9), (7, 7, 7), (0, 0, 0), (0, 0, 0)])))
    assert own[0][0, 0].tolist() == [7, 7, 7, 255] and own[0][1, 1].tolist() == [0, 0, 0, 0]
    tall = np.arange(11)[:, None] % 4 * np.ones((1, 3), int)
    assert composed(animation(frame(tall, interlaced=True), height=11))[0][..., 0].tolist() == np.where(tall == 1, 255, 0).tolist()


def test_decode_table(spark):
    good = animation(frame([[1, 1, 2]] * 2, delay=7), frame([[3]], at=(2, 1), delay=9))
    wide = animation(frame([[1] * 9] * 9, at=(1, 1)))
    rows = [("a", bytearray(good)), ("a", bytearray(good)), ("b", None), ("c", bytearray()), ("d", bytearray(b"PNG")), ("e", bytearray(good[:-30])), ("f", bytearray(good[:60])), ("g", bytearray(wide)), (None, bytearray(good))]
    found = gif.decode(spark.createDataFrame(rows, "image_id string, gif binary").selectExpr("*", "1 AS frame")).collect()
    a = sorted((r for r in found if r.image_id == "a"), key=lambda r: r.frame)
    assert [(r.frame, r.start_cs, r.delay_cs) for r in a] == [(0, 0, 7), (0, 0, 7), (1, 7, 9), (1, 7, 9)]
    assert a[0].hist_red == [2, 0, 0, 0, 0, 0, 0, 4] and a[2].hist_blue == [5, 0, 0, 0, 0, 0, 0, 1] and sum(a[0].hist_luma) == 6
    assert all(r.error == "not a GIF" for r in found if r.image_id in ("b", "c", "d"))
    assert any(r.error for r in found if r.image_id in ("e", "f")) and [r.frame for r in found if r.image_id == "g"] == [0]
    assert gif.decode(spark.createDataFrame([], "image_id string, gif binary")).count() == 0


def test_headers_that_claim_more_than_there_is(spark):
    """796 bytes that ask for a canvas of 65,535 x 65,535, or for such a frame: an error row, and no room made for it."""
    head = struct.pack("<HHBBB", 65_535, 65_535, 0xF7, 0, 0)
    canvas = (b"GIF89a" + head + bytes(768) + struct.pack("<BHHHHB", 0x2C, 0, 0, 1, 1, 0) + b"\x02\x00").ljust(796, b"\0")
    small = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0xF7, 0, 0) + bytes(768)
    framed = small + struct.pack("<BHHHHB", 0x2C, 0, 0, 65_535, 65_535, 0) + b"\x08\x00\x3b"
    tracemalloc.start()
    assert [list(gif.frames(x)) for x in (canvas, framed)] == [[{"error": f"a {n} of more than {gif.MOST_PIXELS} pixels"}] for n in ("canvas", "frame")]
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    found = gif.decode(spark.createDataFrame([("a", bytearray(canvas)), ("b", bytearray(framed))], "image_id string, gif binary")).collect()
    assert len(found) == 2 and all("pixels" in r.error and r.frame is None for r in found)


def test_long_texts_take_several_frames():
    payload = random.Random(1).randbytes(64) * 70_000
    data = gif.encode_samples(payload)
    back, told = gif.read_samples(data)
    assert back == payload and len(told) == 2
    with pytest.raises(ValueError):
        gif.encode_samples(b"abc")


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op5_gif(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode_samples(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_edge_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 32, "x"), (3, "é" * 32, "x"), (None, "a" * 65, "x")], "doc_id long, text string, gif string")
    got = {r.doc_id: r for r in gif.inspect(gif.store(docs)).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == got[3].payload_bytes == 64 and got[None].payload_bytes == 128
    assert (got[1].n_bytes, got[1].payload_sha256, got[1].feature) == (got[2].n_bytes, got[2].payload_sha256, got[2].feature)
    assert gif.inspect(gif.store(docs.limit(0))).count() == 0
