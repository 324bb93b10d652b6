"""Image file formats, text formats, and readers over folders."""

import struct

import numpy as np
import pytest

from rasterloom.sources import formats, readers, sinks

PLANE = np.random.default_rng(3).integers(0, 256, (6, 9)).astype(np.uint8)
RGB = np.random.default_rng(4).integers(0, 256, (5, 4, 3)).astype(np.uint8)


def tiff(pixels: np.ndarray, *, order="<", photometric=1, strips=1, **changes) -> bytes:
    height, width = pixels.shape[:2]
    samples = 1 if pixels.ndim == 2 else 3
    data = pixels.tobytes()
    cut = np.linspace(0, height, strips + 1).astype(int) * (len(data) // height)
    parts = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    body, offsets = b"", []
    for part in parts:
        offsets.append(8 + len(body))
        body += part
    fields = {256: [width], 257: [height], 258: [8] * samples, 259: [1], 262: [photometric], 273: offsets, 277: [samples], 279: [len(p) for p in parts], 284: [1], 339: [1]}
    fields.update(changes.get("fields", {}))
    entries, extra = b"", b""
    start = 8 + len(body)
    after = start + 2 + 12 * len(fields) + 4
    for tag, values in sorted(fields.items()):
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > 4:
            where = struct.pack(f"{order}I", after + len(extra))
            extra += packed
        else:
            where = packed
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + where
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, start)
    return head + body + struct.pack(f"{order}H", len(fields)) + entries + bytes(4) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("strips", [1, 3])
def test_tiff(order, strips):
    assert np.array_equal(formats.decode_gray(tiff(PLANE, order=order, strips=strips)), PLANE)
    assert np.array_equal(formats.decode_gray(tiff(PLANE, order=order, photometric=0)), 255 - PLANE)
    assert np.array_equal(formats.decode_rgb(tiff(RGB, order=order, photometric=2, strips=strips)), RGB)
    assert np.array_equal(formats.decode_gray(tiff(RGB, photometric=2)), (RGB.astype(int) @ [299, 587, 114] + 500) // 1000)


@pytest.mark.parametrize("fields", [{259: [5]}, {258: [16]}, {284: [2]}, {262: [3]}, {339: [2]}, {279: [3]}, {273: [8, 9]}, {256: [0]}])
def test_tiff_that_is_not_supported(fields):
    with pytest.raises(formats.FormatError):
        formats.decode(tiff(PLANE, fields=fields))


def test_damaged_files():
    for data in (b"", b"XX", b"II*\0", b"MM\0+1234", tiff(PLANE)[:60], b"P5\n3 3\n255\nab", b"P2\n2 2", formats.encode_png(PLANE)[:50], b"P2\n1 1\n255\nx"):
        with pytest.raises(formats.FormatError):
            formats.decode(data)


def test_png_and_pgm():
    assert np.array_equal(formats.decode_gray(formats.encode_png(PLANE)), PLANE)
    assert np.array_equal(formats.decode_rgb(formats.encode_png(RGB)), RGB)
    assert np.array_equal(formats.decode_gray(formats.encode_pgm(PLANE)), PLANE)
    assert formats.decode_gray(b"P2\n# a\n3 2\n255\n1 2 3\n4 5 # b\n6").tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(formats.FormatError):
        formats.encode_png(np.zeros((0, 3), np.uint8))


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    import zlib

    raw = b""
    above = [0] * 9
    for row in PLANE.tolist():
        line = []
        for k, v in enumerate(row):
            a, b, c = (row[k - 1] if k else 0), above[k], (above[k - 1] if k else 0)
            near = min((a, b, c), key=lambda g, a=a, b=b, c=c: abs(a + b - c - g))
            line.append(v - {1: a, 2: b, 3: (a + b) // 2, 4: near}[kind] & 255)
        raw += bytes([kind, *line])
        above = row
    plain = formats.encode_png(PLANE)
    at, end = plain.index(b"IDAT") - 4, plain.index(b"IEND") - 4
    packed = zlib.compress(raw)
    data = plain[:at] + struct.pack(">I", len(packed)) + b"IDAT" + packed + b"\0\0\0\0" + plain[end:]
    assert np.array_equal(formats.decode_gray(data), PLANE)


def test_matrices():
    assert readers.parse_kernel("0, 0;0\n\n0 1 0\n0 0 0\n").tolist() == [[0, 0, 0], [0, 1, 0], [0, 0, 0]]
    assert readers.parse_aperture("0 1 0\n1 1 1\n0 1 0").sum() == 5
    for text in ("", "1 2\n3", "1 x 2", "1 nan 2", "1 2\n3 4"):
        with pytest.raises(ValueError):
            readers.parse_kernel(text)
    with pytest.raises(ValueError):
        readers.parse_aperture("0 2 0")


def test_folders(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(formats.encode_png(PLANE))
    (tmp_path / "b.tif").write_bytes(tiff(RGB, photometric=2))
    got = {r.image_id.rsplit("/", 1)[1]: r for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"].pixels == PLANE.tobytes() and (got["b.tif"].width, got["b.tif"].height) == (4, 5)
    assert readers.gray_of(readers.read_rgb(spark, str(tmp_path / "b.tif"))).count() == 20
    assert sinks.image_files_rgb(readers.read_rgb(spark, str(tmp_path / "b.tif"))).first().file == formats.encode_png(RGB)


def test_a_folder_is_read_whole(spark, tmp_path):
    """Every format side by side; JPEG by the JVM; one that can't be decoded is an error that names it."""
    image = spark._jvm.java.awt.image.BufferedImage(4, 5, 10)  # 10: gray
    for k, v in enumerate(PLANE.ravel().tolist()):
        image.getRaster().setSample(k % PLANE.shape[1], k // PLANE.shape[1], 0, 128) if PLANE.shape == (5, 4) else None
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "j.JPG")))
    for ending, encode in formats.ENCODERS.items():
        (tmp_path / f"x.{ending}").write_bytes(encode(PLANE))
    (tmp_path / "t.pgm").write_bytes(formats.encode_pnm(PLANE, text=True))
    got = {r.image_id.rsplit("/", 1)[1]: r for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {*(f"x.{e}" for e in formats.ENCODERS), "t.pgm", "j.JPG"}
    assert all(r.pixels == PLANE.tobytes() for n, r in got.items() if n != "j.JPG") and (got["j.JPG"].width, got["j.JPG"].height) == (4, 5)
    (tmp_path / "notes.txt").write_text("no image")
    with pytest.raises(Exception, match="notes.txt: unknown image format"):
        readers.read_images(spark, str(tmp_path)).collect()
    (tmp_path / "notes.txt").unlink()
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    with pytest.raises(Exception, match="bad.jpg"):
        readers.read_images(spark, str(tmp_path)).collect()


def test_portable_maps():
    assert formats.decode(b"P1\n# bits\n3 2\n101\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert formats.decode(b"P4\n10 2\n" + bytes([0b10100000, 0b01000000, 0, 0])).tolist() == [[0, 255, 0] + [255] * 6 + [0], [255] * 10]
    assert formats.decode(b"P3 2 1 15 0 15 3  1 2 3").tolist() == [[[0, 255, 51], [17, 34, 51]]]
    for text in (False, True):
        assert np.array_equal(formats.decode(formats.encode_pnm(RGB, text=text)), RGB) and np.array_equal(formats.decode(formats.encode_pnm(PLANE, text=text)), PLANE)
    for bad in (b"P1\n3 2\n10", b"P3 2 1 255 0 1", b"P6\n2 2\n255\nabc", b"P2 1 1 7 9 ", b"P7\n"):
        with pytest.raises(formats.FormatError):
            formats.decode(bad)


def test_bitmaps():
    assert np.array_equal(formats.decode(formats.encode_bmp(RGB)), RGB)
    assert np.array_equal(formats.decode_gray(formats.encode_bmp(PLANE)), PLANE)
    for bad in (formats.encode_bmp(RGB)[:60], b"BM", formats.encode_bmp(RGB).replace(struct.pack("<H", 24), struct.pack("<H", 16), 1)):
        with pytest.raises(formats.FormatError):
            formats.decode(bad)


@pytest.mark.parametrize("compression", [1, 8])
@pytest.mark.parametrize("order", ["<", ">"])
def test_written_tiff(order, compression):
    for image in (PLANE, RGB):
        for rows in (1, 2, None):
            data = formats.encode_tiff(image, order=order, strip_rows=rows, compression=compression)
            assert np.array_equal(formats.decode(data, packed=True), image)
            if compression != 1:
                with pytest.raises(formats.FormatError, match="uncompressed"):
                    formats.decode_rgb(data)
    assert np.array_equal(formats.decode(formats.encode_tiff(PLANE, white_is_zero=True)), PLANE)


def test_packed_strips():
    assert formats._packbits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])
    # 256 (clear), 7, 258 (the entry that this code completes), 7, 257 (end): 7, 7 7, 7
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 7, 257))
    assert formats._tiff_lzw(int(codes.ljust(48, "0"), 2).to_bytes(6, "big")) == bytes([7] * 4)


def test_endings():
    assert formats.encoder(".PNG") is formats.encode_png
    with pytest.raises(formats.FormatError, match="jpg"):
        formats.encoder(".jpg")


def test_signals(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1, 2;3\n4 x 5\n\n-6.5e1\n")
    got = [(r.idx, r.value) for r in readers.read_signals(spark, str(tmp_path / "s.txt")).orderBy("idx").collect()]
    assert got == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, -65.0)]
    (tmp_path / "e.txt").write_text("x\n")
    with pytest.raises(Exception, match="no samples"):
        readers.read_signals(spark, str(tmp_path / "e.txt")).collect()
