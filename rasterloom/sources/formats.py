"""Decoding and encoding of image files held as bytes: PNM, PNG, BMP and TIFF."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


class FormatError(ValueError):
    """The bytes aren't a file of the format, or of a kind that isn't supported."""


def rgb_to_gray(rgb: np.ndarray) -> np.ndarray:
    """Integer luma, rounded."""
    wide = rgb.astype(np.uint32)
    return ((299 * wide[..., 0] + 587 * wide[..., 1] + 114 * wide[..., 2] + 500) // 1000).astype(np.uint8)


def _pnm(data: bytes) -> np.ndarray:
    """P1 to P6: bits, grays and colours as text or binary, up to 8 bits a sample; 1 is black in bits."""
    kind = data[1] - 48
    channels, bits, text = (3 if kind in (3, 6) else 1), kind in (1, 4), kind < 4
    fields, at = [], 2
    while len(fields) < (2 if bits else 3):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise FormatError("PNM: the header breaks off")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields[0], fields[1], 1 if bits else fields[2]
    if not (width > 0 and height > 0 and 0 < top < 256):
        raise FormatError("PNM: bad size or maximum")
    wanted = width * height * channels
    if text:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        # bits need no blanks between them
        values = np.frombuffer(b"".join(body.split()), np.uint8)[:wanted].astype(np.int64) - 48 if bits else np.array(body.split()[:wanted], np.int64)
    elif bits:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, offset=at + 1)[: height * stride]
        values = np.unpackbits(rows.reshape(-1, stride), axis=1)[:, :width].ravel().astype(np.int64) if len(rows) == height * stride else rows
    else:
        values = np.frombuffer(data, np.uint8, offset=at + 1)[:wanted].astype(np.int64)
    if len(values) < wanted:
        raise FormatError("PNM: too few pixels")
    if bits:
        values = 255 * (1 - values)
    elif top != 255:
        values = (values * 255 + top // 2) // top
    if values.min() < 0 or values.max() > 255:
        raise FormatError("PNM: a sample beyond the maximum")
    return values.astype(np.uint8).reshape((height, width, 3) if channels == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 8 bits with a palette, 24 or 32 bits."""
    begin, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3) or width <= 0 or height == 0:
        raise FormatError("BMP: this kind isn't supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, offset=begin)[: abs(height) * stride]
    if len(rows) < abs(height) * stride:
        raise FormatError("BMP: too few pixels")
    rows = rows.reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        if rows.max() >= used:
            raise FormatError("BMP: a colour outside the palette")
        return palette[rows]
    return rows.reshape(abs(height), width, bits // 8)[..., 2::-1]


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            now, up = line.tolist(), above.tolist()
            for k in range(stride):
                a, b = (now[k - step] if k >= step else 0), up[k]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[k - step] if k >= step else 0
                    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                now[k] = now[k] + guess & 255
            line = np.array(now, np.uint8)
        elif kind:
            raise FormatError("PNG: unknown filter")
        out[y] = above = line
    return out


def _png(data: bytes) -> np.ndarray:
    """Gray, RGB, palette, with or without alpha (which is dropped), not interlaced; 16 bits are cut to 8."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(chunk)
        elif kind == b"IEND":
            break
    if head is None:
        raise FormatError("PNG: no header")
    width, height, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced:
        raise FormatError("PNG: this kind isn't supported")
    stride = (width * channels * bits + 7) // 8
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise FormatError(f"PNG: {e}") from None
    if len(raw) < height * (stride + 1):
        raise FormatError("PNG: too few pixels")
    rows = _unfilter(raw, height, stride, max(1, channels * bits // 8))
    if bits == 16:
        rows = rows[:, 0::2]
    elif bits < 8:
        spread = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = spread.dot(1 << np.arange(bits)[::-1]).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << bits) - 1))
    pixels = rows[:, : width * channels].reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise FormatError("PNG: a colour outside the palette")
        return palette[pixels[..., 0]]
    return pixels[..., 0] if channels < 3 else pixels[..., :3]


#: Fixed: TIFF tags that are read, bytes of each field type, and field types that hold numbers.
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "offsets", 277: "samples", 278: "rows_per_strip", 279: "counts", 284: "planar", 317: "predictor", 339: "sample_format"}
TIFF_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
TIFF_NUMBERS = {1: "B", 3: "H", 4: "I"}


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def _tiff_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a width ends one code early."""
    roots = [bytes([k]) for k in range(256)] + [b"", b""]
    table, before, out, bits, width, at = list(roots), b"", [], 0, 9, 0
    whole, total = int.from_bytes(data, "big"), 8 * len(data)
    while at + width <= total:
        code = whole >> (total - at - width) & (1 << width) - 1
        at += width
        if code == 257:
            break
        if code == 256:
            table, before, width = list(roots), b"", 9
            continue
        if code > len(table) or (code == len(table) and not before):
            raise FormatError("TIFF: a code that isn't in the table")
        found = table[code] if code < len(table) else before + before[:1]
        out.append(found)
        if before:
            table.append(before + found[:1])
        before = found
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


#: Fixed: how strips are packed, by the compression tag.
TIFF_UNPACK = {1: bytes, 5: _tiff_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _tiff(data: bytes, packed: bool = False) -> np.ndarray:
    """The first directory: 8-bit gray (0 is white or black) or RGB in strips, either byte order; packed strips where asked for."""
    if data[:2] not in (b"II", b"MM"):
        raise FormatError("TIFF: unknown byte order")
    order = "<" if data[:2] == b"II" else ">"

    def read(kind: str, at: int, n: int = 1) -> tuple:
        if at < 0 or at + struct.calcsize(kind) * n > len(data):
            raise FormatError("TIFF: truncated")
        return struct.unpack_from(f"{order}{n}{kind}", data, at)

    if read("H", 2)[0] != 42:
        raise FormatError("TIFF: bad magic number")
    at = read("I", 4)[0]
    found = {"compression": [1], "planar": [1], "samples": [1], "sample_format": [1]}
    for k in range(read("H", at)[0]):
        entry = at + 2 + 12 * k
        tag, kind = read("H", entry, 2)
        count = read("I", entry + 4)[0]
        if tag not in TIFF_TAGS:
            continue
        if kind not in TIFF_NUMBERS:
            raise FormatError(f"TIFF: field type {kind} of tag {tag}")
        where = entry + 8 if TIFF_TYPE_BYTES[kind] * count <= 4 else read("I", entry + 8)[0]
        found[TIFF_TAGS[tag]] = list(read(TIFF_NUMBERS[kind], where, count))
    missing = {"width", "height", "bits", "photometric", "offsets", "counts"} - found.keys()
    if missing:
        raise FormatError(f"TIFF: no {', '.join(sorted(missing))}")
    width, height, samples, photometric = (found[k][0] for k in ("width", "height", "samples", "photometric"))
    if width <= 0 or height <= 0:
        raise FormatError("TIFF: empty image")
    unpack = TIFF_UNPACK.get(found["compression"][0]) if packed else bytes if found["compression"][0] == 1 else None
    if unpack is None or found["planar"][0] != 1 or found.get("predictor", [1])[0] != 1:
        raise FormatError("TIFF: only uncompressed, chunky images" if not packed else "TIFF: this compression isn't supported")
    if (samples, photometric) not in ((1, 0), (1, 1), (3, 2)):
        raise FormatError("TIFF: only 8-bit gray and RGB")
    for name, value in (("bits", 8), ("sample_format", 1)):
        each = found[name] * samples if len(found[name]) == 1 else found[name]
        if len(each) != samples or any(x != value for x in each):
            raise FormatError(f"TIFF: {name} must be {value}")
    if not found["offsets"] or len(found["offsets"]) != len(found["counts"]):
        raise FormatError("TIFF: offsets and counts of strips differ")
    wanted, parts = width * height * samples, []
    for offset, count in zip(found["offsets"], found["counts"], strict=True):
        if offset + count > len(data):
            raise FormatError("TIFF: truncated")
        parts.append(unpack(data[offset : offset + count]))
    pixels = b"".join(parts)
    if len(pixels) < wanted:
        raise FormatError("TIFF: too few pixels")
    image = np.frombuffer(pixels, np.uint8, wanted)
    if samples == 3:
        return image.reshape(height, width, 3)
    image = image.reshape(height, width)
    return 255 - image if photometric == 0 else image


def decode(data: bytes, *, packed: bool = False) -> np.ndarray:
    """A plane (height, width) or an RGB array (height, width, 3); packed: TIFF strips may be compressed."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _pnm(data)
        if data[:8] == PNG_MAGIC:
            return _png(data)
        if data[:2] in (b"II", b"MM"):
            return _tiff(data, packed)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, ValueError, IndexError, zlib.error) as e:
        raise e if isinstance(e, FormatError) else FormatError(str(e)) from None
    raise FormatError("unknown image format")


def decode_gray(data: bytes) -> np.ndarray:
    image = decode(data, packed=True)
    return rgb_to_gray(image) if image.ndim == 3 else image


def decode_rgb(data: bytes) -> np.ndarray:
    image = decode(data)
    return image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)


def encode_png(image: np.ndarray) -> bytes:
    """A gray plane or an RGB array."""
    if image.size == 0:
        raise FormatError("an empty image can't be written")
    height, width = image.shape[:2]
    raw = np.zeros((height, 1 + image[0].size), np.uint8)
    raw[:, 1:] = image.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_pgm(plane: np.ndarray) -> bytes:
    if plane.size == 0 or plane.ndim != 2:
        raise FormatError("a PGM holds one plane that isn't empty")
    return b"P5\n%d %d\n255\n" % (plane.shape[1], plane.shape[0]) + plane.astype(np.uint8).tobytes()


def encode_pnm(image: np.ndarray, *, text: bool = False) -> bytes:
    """A gray plane as P5 or an RGB array as P6; as P2 or P3 in text."""
    if image.size == 0:
        raise FormatError("an empty image can't be written")
    if image.ndim == 2 and not text:
        return encode_pgm(image)
    head = b"P%d\n%d %d\n255\n" % ((3 if image.ndim == 3 else 2) + 3 * (not text), image.shape[1], image.shape[0])
    flat = image.reshape(image.shape[0], -1).astype(np.uint8)
    return head + (b"\n".join(b" ".join(b"%d" % v for v in row) for row in flat.tolist()) + b"\n" if text else flat.tobytes())


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom up."""
    if image.size == 0:
        raise FormatError("an empty image can't be written")
    rgb = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
    height, width = rgb.shape[:2]
    rows = np.zeros((height, (3 * width + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIII", b"BM", 54 + rows.size, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def encode_tiff(image: np.ndarray, *, order: str = "<", strip_rows: int | None = None, white_is_zero: bool = False, compression: int = 1) -> bytes:
    """A gray plane or an RGB array, 8 bits a sample, in strips of so many rows (64 kB by default); compression 1 or 8."""
    if image.size == 0:
        raise FormatError("an empty image can't be written")
    height, width = image.shape[:2]
    samples = 3 if image.ndim == 3 else 1
    per = strip_rows or max(1, (1 << 16) // (width * samples))
    stored = 255 - image if white_is_zero and samples == 1 else image
    strips = [stored[y : y + per].astype(np.uint8).tobytes() for y in range(0, height, per)]
    strips = [zlib.compress(s) for s in strips] if compression == 8 else strips
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 0 if white_is_zero else 1])]
    fields += [(273, 4, [0] * len(strips)), (277, 3, [samples]), (278, 4, [per]), (279, 4, [len(s) for s in strips]), (284, 3, [1])]
    at = 8 + 2 + 12 * len(fields) + 4
    at += sum(n for _, kind, v in fields if (n := TIFF_TYPE_BYTES[kind] * len(v)) > 4)
    offsets = (at + np.concatenate(([0], np.cumsum([len(s) for s in strips])))).tolist()
    head, far, after = struct.pack(f"{order}H", len(fields)), b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        values = offsets[:-1] if tag == 273 else values
        body = struct.pack(f"{order}{len(values)}{TIFF_NUMBERS[kind]}", *values)
        head += struct.pack(f"{order}HHI", tag, kind, len(values))
        head += body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(f"{order}I", after + len(far))
        far += body if len(body) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + head + bytes(4) + far + b"".join(strips)


#: Encoders by file ending.
ENCODERS = {"png": encode_png, "pgm": encode_pnm, "ppm": encode_pnm, "pnm": encode_pnm, "bmp": encode_bmp, "tif": encode_tiff, "tiff": encode_tiff}


def encoder(ending: str):
    """The encoder for a file ending, with or without its point."""
    found = ENCODERS.get(ending.lower().lstrip("."))
    if found is None:
        raise FormatError(f"images can't be written as {ending!r}: one of {', '.join(sorted(ENCODERS))} is asked for")
    return found
