"""GIF images: decoding of LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

`decode` gives a row for each frame: when it appears, how long it stays, the composed RGBA canvas and the canvas's histograms.
`encode_samples` writes 8-bit samples as a GIF of one grey palette, losslessly: 64 samples a line, as many frames as it takes.

Defined results: a null or empty image and anything that isn't a GIF has no frames and an `error`; a file that breaks off, or
claims a canvas or frame of more than MOST_PIXELS, keeps the frames before and says so. Delays under 2 hundredths stay as written. Rows are independent; extra columns
are ignored, frames refer to images by id.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bound_batches

SIGNATURES = (b"GIF87a", b"GIF89a")
LINE, MOST_LINES = 64, 65_535
#: Bins of each histogram.
BINS = 8
MOST_CODES = 4096
#: Pixels of a canvas or frame that `decode` makes room for: a header of a few bytes may claim 4 thousand million.
MOST_PIXELS = 1 << 24
_GREY = bytes(x for k in range(256) for x in (k, k, k))

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("frame", T.IntegerType()),
        T.StructField("start_cs", T.LongType()),
        T.StructField("delay_cs", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("frame_width", T.IntegerType()),
        T.StructField("frame_height", T.IntegerType()),
        T.StructField("disposal", T.IntegerType()),
        T.StructField("transparent", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("rgba", T.BinaryType()),
        *[T.StructField(f"hist_{c}", T.ArrayType(T.LongType())) for c in ("red", "green", "blue", "luma")],
        T.StructField("error", T.StringType()),
    ]
)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples, cleared whenever the table of 4096 codes is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes = [clear]
    put = codes.append
    # a node of the table is the dict of the nodes that follow it, with its own code at -1
    roots = [{-1: k} for k in range(clear)]
    node, free = None, end + 1
    for sample in samples:
        if node is None:
            node = roots[sample]
            continue
        after = node.get(sample)
        if after is not None:
            node = after
            continue
        put(node[-1])
        if free < MOST_CODES:
            node[sample] = {-1: free}
            free += 1
        else:
            put(clear)
            roots = [{-1: k} for k in range(clear)]
            free = end + 1
        node = roots[sample]
    if node is not None:
        put(node[-1])
    put(end)
    return _pack_codes(np.array(codes, np.int64), bits)


def _widths(codes: np.ndarray, bits: int) -> np.ndarray:
    """The width in which each code stands: it follows from how many codes there were since the last clear."""
    clear = 1 << bits
    place = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == clear, place, -1))
    # a decoder has added (codes since the clear - 2) entries when it reads a code; the writer's width follows it
    since = place - np.concatenate(([-1], last[:-1]))
    entries = clear + 2 + np.maximum(0, since - 2)
    return np.minimum(12, np.frexp(entries.astype(float))[1]).astype(np.int64)


def _pack_codes(codes: np.ndarray, bits: int) -> bytes:
    widths = _widths(codes, bits)
    ends = np.cumsum(widths)
    total = int(ends[-1])
    first = ends - widths
    # a code of up to 12 bits touches at most 3 bytes
    out = np.zeros(total // 8 + 4, np.uint32)
    shifted = codes << (first & 7)
    for k in range(3):
        part = np.bincount(first >> 3, (shifted >> 8 * k) & 255, len(out) - k).astype(np.uint32)
        out[k:] += part[: len(out) - k]
    return out.astype(np.uint8).tobytes()[: (total + 7) // 8]


@cache
def _running_widths(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear, and their running sum."""
    entries = (1 << bits) + 2 + np.maximum(0, np.arange(most) - 1)
    widths = np.minimum(12, np.frexp(entries.astype(float))[1]).astype(np.int64)
    return widths, np.cumsum(widths)


def _segment(data: np.ndarray, at: int, bits: int, most: int) -> np.ndarray:
    """Codes from the bit `at` on as they stand if no clear comes: widths grow with the codes read."""
    widths, ends = _running_widths(bits, most)
    first = at + ends - widths
    there = first + widths <= 8 * (len(data) - 4)
    n = int(there.sum())
    first, widths = first[:n], widths[:n]
    byte = first >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return np.stack((word >> (first & 7) & ((1 << widths) - 1), first + widths))


def lzw_decode(stream: bytes, bits: int, wanted: int) -> tuple[bytes, str | None]:
    """Up to `wanted` samples of a code stream, and what is wrong with it if anything is.

    Entries beyond code 4095 are made but no code can name them, as if the table stayed full until the next clear.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8)
    out, at = bytearray(), 0
    literals = [bytes([k]) for k in range(clear)] + [b"", b""]
    while True:
        codes, after = _segment(data, at, bits, 1 << 13)
        if not len(codes):
            return bytes(out), "the code stream breaks off"
        stop = np.flatnonzero((codes == clear) | (codes == end))
        most = 1 << 13
        while not len(stop) and len(codes) == most:  # the writer keeps a full table: read on
            most *= 4
            codes, after = _segment(data, at, bits, most)
            stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        table = literals.copy()
        grow, parts = table.append, []
        put = parts.append
        following = iter(codes[:n].tolist())
        before = literals[next(following, clear)] if not n or codes[0] < clear else None
        if before is None:
            return bytes(out[:wanted]), "a code that isn't in the table"
        put(before)
        for code in following:
            try:
                written = table[code]
            except IndexError:  # the entry that this very code completes, or none
                if code != len(table):
                    return (bytes(out) + b"".join(parts))[:wanted], "a code that isn't in the table"
                written = before + before[:1]
            grow(before + written[:1])
            put(written)
            before = written
        out += b"".join(parts)
        if len(out) >= wanted:
            return bytes(out[:wanted]), None
        if not len(stop):
            return bytes(out), "the code stream breaks off"
        if codes[n] == end:
            return bytes(out), "too few samples"
        at = int(after[n])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _in_blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)) + b"\0"


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = np.concatenate([np.arange(0, n, 8), np.arange(4, n, 8), np.arange(2, n, 4), np.arange(1, n, 2)])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def frames(data: bytes | None):
    """The frames of a GIF as dicts by FRAME_SCHEMA, without histograms; `canvas` is the composed height x width x 4 array."""
    if not data or data[:6] not in SIGNATURES or len(data) < 13:
        yield {"error": "not a GIF"}
        return
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
        at += size
    if width * height > MOST_PIXELS:
        yield {"error": f"a canvas of more than {MOST_PIXELS} pixels"}
        return
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    transparent, number, start = -1, 0, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, struct.unpack_from("<H", block, 1)[0]
                transparent = block[3] if block[0] & 1 else -1
            continue
        if kind != 0x2C or at + 10 > len(data):
            yield {"error": "the file breaks off"}
            return
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if w * h > MOST_PIXELS:
            yield {"error": f"a frame of more than {MOST_PIXELS} pixels"}
            return
        palette = shared
        if local & 0x80:
            size = 3 << (local & 7) + 1
            palette = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
            at += size
        if at >= len(data) or palette is None or not 1 <= data[at] <= 8:
            yield {"error": "a frame without palette or code size"}
            return
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        samples, error = lzw_decode(stream, bits, w * h)
        pixels = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        pixels = _deinterlaced(pixels) if local & 0x40 else pixels
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3], colours[: len(palette), 3] = palette, 255
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        shown = pixels[: view.shape[0], : view.shape[1]]
        painted = colours[shown]
        if transparent >= 0:
            painted = np.where((shown == transparent)[..., None], view, painted)
        canvas[top : top + h, left : left + w] = painted
        yield {"frame": number, "start_cs": start, "delay_cs": delay, "left": left, "top": top, "frame_width": w, "frame_height": h, "disposal": disposal, "transparent": transparent, "width": width, "height": height, "canvas": canvas, "error": error}
        if error:
            return
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        start += delay
        number, delay, disposal, transparent = number + 1, 0, 0, -1
    yield {"error": "no trailer"}


def histograms(canvas: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the visible pixels in BINS equal bins of red, green, blue and luma."""
    seen = canvas[canvas[..., 3] > 0].astype(np.int64)
    luma = (299 * seen[:, 0] + 587 * seen[:, 1] + 114 * seen[:, 2] + 500) // 1000
    return {f"hist_{n}": np.bincount(v * BINS >> 8, minlength=BINS) for n, v in zip(("red", "green", "blue", "luma"), (seen[:, 0], seen[:, 1], seen[:, 2], luma), strict=True)}


def encode_samples(samples: bytes, delay_cs: int = 10) -> bytes:
    """A GIF whose frames, one after the other, hold the samples; their number is a positive multiple of LINE."""
    lines = len(samples) // LINE
    if not lines or len(samples) % LINE:
        raise ValueError(f"a positive multiple of {LINE} samples is asked for")
    height = min(lines, MOST_LINES)
    out = [b"GIF89a", struct.pack("<HHBBB", LINE, height, 0xF7, 0, 0), _GREY]
    for first in range(0, lines, MOST_LINES):
        n = min(MOST_LINES, lines - first)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, LINE, n, 0) + b"\x08")
        out.append(_in_blocks(lzw_encode(samples[first * LINE : (first + n) * LINE])))
    return b"".join([*out, b"\x3b"])


def read_samples(data: bytes) -> tuple[bytes, list[dict]]:
    """The samples that encode_samples stored, by way of the composed frames, and the frames' histograms."""
    parts, told = [], []
    for f in frames(data):
        if f.get("error"):
            raise ValueError(f["error"])
        shown = f["canvas"][: f["frame_height"]]
        parts.append(shown[..., 0].tobytes())
        told.append({"delay_cs": f["delay_cs"]} | histograms(shown))
    return b"".join(parts), told


def decode(images: DataFrame, *, id_col: str = "image_id", data_col: str = "gif") -> DataFrame:
    """image id and the columns of FRAME_SCHEMA, a row for each frame; images without frames have one row with an error."""
    bound_batches(images.sparkSession)
    schema = T.StructType([T.StructField(id_col, images.schema[id_col].dataType), *FRAME_SCHEMA.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in frames(data):
                    row = {id_col: name} | {k: f.get(k) for k in FRAME_SCHEMA.names}
                    if (canvas := f.get("canvas")) is not None:
                        row |= {"rgba": canvas.tobytes()} | {k: v.tolist() for k, v in histograms(canvas).items()}
                    yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return images.select(F.col(id_col), F.col(data_col).alias("gif to decode")).mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    """The text with zero bytes after it, up to a positive multiple of LINE."""
    return text.ljust(max(LINE, -(-len(text) // LINE) * LINE), b"\0")


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and gif, which holds the padded UTF-8 text as samples. A null text is empty."""
    bound_batches(docs.sparkSession)
    schema = docs.select(id_col).schema.add("n_bytes", "long").add("gif", "binary")

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode_samples(padded(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "gif"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text to store")).mapInArrow(run, schema)


def inspect(stored: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What the stored images hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and as feature the
    number of frames, their time in hundredths and the luma histogram over all frames."""
    names = [c for c in stored.columns if c != "gif"]
    schema = stored.select(*names).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                payload, told = read_samples(data)
                luma = sum(t["hist_luma"] for t in told)
                feature = f"frames={len(told)};time={sum(t['delay_cs'] for t in told)};luma={','.join(map(str, luma.tolist()))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return stored.select(*names, "gif").mapInArrow(run, schema)
