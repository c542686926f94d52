"""GIF media columns: a decoder for LZW streams, palettes, disposal and transparency, and an encoder to store byte payloads.

The LZW decoder is array code. After a clear code the width of the i-th code follows from i alone, so all codes of a segment
are cut out at once. The string of a dictionary code is a slice of the segment's own output (that of the earlier code j and
one byte more), so lengths and bytes are found by pointer jumping, in a number of rounds logarithmic in the chain length.
Frames of stored payloads hold at most ``FRAME_ROWS`` rows, which bounds the working memory for any text.

The payload encoder writes literal codes only (12-bit once the dictionary is full): a legal stream that any GIF reader
decodes, stored at about 1.5 bytes a byte. ``encode_gif(compress=True)`` builds real dictionary codes; it works symbol by
symbol in Python and is meant for small images.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

WIDTH, FRAME_ROWS, DELAY_CS, TAIL, ALIKE = 192, 16, 10, 16, 0.0625
LIMIT = 4096  # codes of at most 12 bits


class GifError(ValueError):
    """The bytes are no GIF that can be decoded."""


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # rows x columns
    palette: np.ndarray  # n x 3
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]


@lru_cache(maxsize=64)
def _offsets(min_size: int) -> np.ndarray:
    """Bit offset of each code behind a clear code, until the width stays at 12; one more than there are growing codes."""
    first = (1 << min_size) + 2
    next_code = first + np.maximum(np.arange(LIMIT - first + 2) - 1, 0)
    width = np.minimum(12, np.maximum(min_size + 1, np.floor(np.log2(next_code)).astype(np.int64) + 1))
    return np.concatenate([[0], np.cumsum(width)])


def _layout(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the first n codes behind a clear code."""
    grown = _offsets(min_size)
    if n < len(grown):
        return grown[:n], np.diff(grown[: n + 1])
    more = n - len(grown) + 1
    return np.concatenate([grown[:-1], grown[-1] + 12 * np.arange(more)]), np.concatenate([np.diff(grown), np.full(more, 12)])


def _pack(parts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Codes of given widths, least significant bit first."""
    bits = [((codes.astype(np.uint16)[:, None] >> np.arange(width, dtype=np.uint16)) & 1).astype(np.uint8).ravel() for codes, width in parts if len(codes)]
    return np.packbits(np.concatenate(bits), bitorder="little")


def lzw_encode_literal(pixels: np.ndarray, min_size: int = 8) -> np.ndarray:
    """A clear code, a literal code for each pixel, an end code."""
    clear = 1 << min_size
    codes = np.append(pixels.astype(np.uint16), np.uint16(clear + 1))
    _, widths = _layout(min_size, len(codes))
    parts = [(np.array([clear], dtype=np.uint16), min_size + 1)]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(codes)]])
    parts += [(codes[a:b], int(widths[a])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _pack(parts)


def lzw_encode(pixels: np.ndarray, min_size: int = 8) -> np.ndarray:
    """Dictionary codes, with a clear code whenever the dictionary is full."""
    clear = 1 << min_size
    out: list[tuple[np.ndarray, int]] = [(np.array([clear]), min_size + 1)]
    data = pixels.tolist()
    if not data:
        return _pack([*out, (np.array([clear + 1]), min_size + 1)])
    known: dict[int, int] = {}
    codes: list[int] = []
    add = codes.append

    def close(last: int) -> None:
        """The codes so far and ``last`` (clear or end), cut where the width grows."""
        add(last)
        own, widths = np.array(codes, dtype=np.uint16), _layout(min_size, len(codes))[1]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(own)]])
        out.extend((own[x:y], int(widths[x])) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        codes.clear()
        known.clear()

    prefix, entry = data[0], clear + 2
    for p in islice(data, 1, None):
        key = prefix << 8 | p
        if key in known:
            prefix = known[key]
        else:
            add(prefix)
            known[key] = entry
            entry += 1
            prefix = p
            if entry == LIMIT - 1:
                close(clear)
                entry = clear + 2
    add(prefix)
    close(clear + 1)
    return _pack(out)


def _segment(codes: np.ndarray, min_size: int) -> np.ndarray:
    """The pixels of codes between two clear codes."""
    clear = 1 << min_size
    deep = codes >= clear
    if not deep.any():
        return codes.astype(np.uint8)
    n = len(codes)
    at = np.arange(n)
    j = np.where(deep, codes - clear - 2, at)
    if (j[deep] >= at[deep]).any() or (j[deep] < 0).any():
        raise GifError("a code refers to an entry that doesn't exist yet")
    parent, depth = j.copy(), deep.astype(np.int64)
    while True:
        step = depth[parent]
        if not step.any():
            break
        depth = depth + step
        parent = parent[parent]
    length = depth + 1
    pos = np.cumsum(length) - length
    total = int(pos[-1] + length[-1])
    source = np.arange(total) + np.repeat(np.where(deep, pos[j] - pos, 0), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(total, dtype=np.uint8)
    value[pos[~deep]] = codes[~deep]
    return value[source]


def lzw_decode(data: np.ndarray, min_size: int, n_pixels: int) -> np.ndarray:
    """At most ``n_pixels`` pixels of a code stream; a stream that ends early gives fewer."""
    if not 2 <= min_size <= 8:
        raise GifError(f"minimum code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    wide = np.concatenate([data.astype(np.int32), np.zeros(3, dtype=np.int32)])
    bits, at, out, got = 8 * len(data), 0, [], 0
    while got < n_pixels and at + min_size + 1 <= bits:
        most, ask = n_pixels - got + 1, LIMIT
        while True:
            offsets, widths = _layout(min_size, min(most, ask))
            offsets = offsets + at
            inside = int(np.searchsorted(offsets + widths, bits, side="right"))
            offsets, widths = offsets[:inside], widths[:inside]
            byte = offsets >> 3
            codes = ((wide[byte] | wide[byte + 1] << 8 | wide[byte + 2] << 16) >> (offsets & 7)) & ((1 << widths) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or ask >= most or inside < min(most, ask):
                break
            ask = most
        cut = int(stops[0]) if len(stops) else len(codes)
        if cut:
            pixels = _segment(codes[:cut], min_size)
            out.append(pixels)
            got += len(pixels)
        if not len(stops) or codes[cut] == end:
            break
        at = int(offsets[cut] + widths[cut])
    return np.concatenate(out)[:n_pixels] if out else np.zeros(0, dtype=np.uint8)


def _blocks(data: np.ndarray) -> bytes:
    full = len(data) // 255
    framed = np.empty((full, 256), dtype=np.uint8)
    framed[:, 0] = 255
    framed[:, 1:] = data[: full * 255].reshape(full, 255)
    rest = data[full * 255 :].tobytes()
    return framed.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int, compress: bool = True) -> bytes:
    """Each frame with a palette of its own of up to 256 colours, or with the global one where it is the first frame's."""
    common = frames[0].palette if frames else np.zeros((2, 3), dtype=np.uint8)

    def depth(palette: np.ndarray) -> int:
        return max(1, int(np.ceil(np.log2(max(2, len(palette))))))

    def colours(palette: np.ndarray) -> bytes:
        return palette.astype(np.uint8).tobytes().ljust(3 << depth(palette), b"\0")

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | depth(common) - 1, 0, 0), colours(common)]
    for f in frames:
        rows, cols = f.indices.shape
        own = f.palette is not common and not np.array_equal(f.palette, common)
        size = max(2, depth(f.palette))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, cols, rows, 0x80 | depth(f.palette) - 1 if own else 0) + (colours(f.palette) if own else b""))
        out.append(bytes([size]) + _blocks((lzw_encode if compress else lzw_encode_literal)(f.indices.ravel(), size)))
    return b"".join(out) + b"\x3b"


def decode_gif(data: bytes) -> Gif:
    """Raises GifError for bytes that are cut off or malformed."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise GifError(str(e)) from e


def _decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, None

    def colours(n: int) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)

    def chain(at: int) -> tuple[list[bytes], int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return parts, at + 1

    if flags & 0x80:
        common = colours(2 << (flags & 7))
        at += common.size
    frames, control = [], (0, 0, None)
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            parts, at = chain(at + 2)
            if label == 0xF9 and parts and len(parts[0]) >= 4:
                bits, delay, index = struct.unpack("<BHB", parts[0][:4])
                control = (delay, bits >> 2 & 7, index if bits & 1 else None)
            continue
        if kind != 0x2C:
            raise GifError(f"block {kind:#x}")
        left, top, cols, rows, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if bits & 0x80:
            palette = colours(2 << (bits & 7))
            at += palette.size
        if palette is None:
            raise GifError("a frame without palette")
        parts, after = chain(at + 1)
        pixels = lzw_decode(np.frombuffer(b"".join(parts), dtype=np.uint8), data[at], rows * cols)
        at = after
        full = np.zeros(rows * cols, dtype=np.uint8)
        full[: len(pixels)] = pixels
        full = full.reshape(rows, cols)
        if bits & 0x40:  # interlaced
            order = np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(full)
            straight[order] = full
            full = straight
        frames.append(Frame(left, top, full, palette, *control))
        control = (0, 0, None)
    return Gif(width, height, frames)


def composed(gif: Gif):
    """The canvas (rows x columns x RGBA) as shown for each frame, after the disposal of the frame before."""
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for f in gif.frames:
        rows, cols = (min(f.indices.shape[0], gif.height - f.top), min(f.indices.shape[1], gif.width - f.left))
        here = (slice(f.top, f.top + max(0, rows)), slice(f.left, f.left + max(0, cols)))
        before = canvas.copy() if f.disposal == 3 else None
        index = f.indices[: max(0, rows), : max(0, cols)]
        rgba = np.full((256, 4), 255, dtype=np.uint8)
        rgba[:, :3] = 0
        rgba[: len(f.palette), :3] = f.palette
        if f.transparent is None:
            canvas[here] = rgba[index]
        else:
            canvas[here] = np.where((index == f.transparent)[:, :, None], canvas[here], rgba[index])
        yield canvas
        if f.disposal == 2:
            canvas[here] = 0
        elif f.disposal == 3:
            canvas = before


def store_payload(payload: bytes) -> bytes:
    """A GIF that shows the payload's bytes as grey samples, 192 to a row, in frames of at most FRAME_ROWS rows."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    values = np.flatnonzero(np.bincount(samples, minlength=256)).astype(np.uint8)
    number = np.zeros(256, dtype=np.uint8)
    number[values] = np.arange(len(values), dtype=np.uint8)
    grid = number[samples].reshape(-1, WIDTH)
    # one colour more than there are bytes is transparent, if there is one
    free = len(values) if len(values) < 256 else None
    palette = np.repeat(np.append(values, np.zeros(int(free is not None), dtype=np.uint8))[:, None], 3, axis=1)
    frames: list[Frame] = []
    before = None
    for k in range(0, len(grid), FRAME_ROWS):
        rows = grid[k : k + FRAME_ROWS]
        frame = Frame(0, 0, rows, palette, DELAY_CS, 2)
        if before is not None and free is not None:
            same = rows == before[: len(rows)]
            if same.mean() >= ALIKE:
                frames[-1].disposal = 1
                frame.indices, frame.transparent = np.where(same, np.uint8(free), rows), free
        frames.append(frame)
        before = rows
    return encode_gif(frames, WIDTH, min(len(grid), FRAME_ROWS))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 4 x 4 x 4 colour cells."""
    c = canvas.reshape(-1, 4)
    c = c[c[:, 3] > 0] >> 6
    return np.bincount(c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], minlength=64)


def frame_rows(gif: Gif) -> tuple[list[dict], bytes]:
    """A row for each timed frame (its number, start and duration in centiseconds, and the colour histogram of what is shown), and the
    red samples shown inside each frame's area."""
    out, start, samples = [], 0, []
    for k, (f, canvas) in enumerate(zip(gif.frames, composed(gif), strict=True)):
        out.append({"frame": k, "start_cs": start, "delay_cs": f.delay_cs, "histogram": histogram(canvas).tolist()})
        start += f.delay_cs
        rows, cols = f.indices.shape
        samples.append(canvas[f.top : f.top + rows, f.left : f.left + cols, 0].tobytes())
    return out, b"".join(samples)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


MEDIA = "doc_id long, n_bytes long, media binary, payload binary, frames array<struct<frame:int,start_cs:int,delay_cs:int,histogram:array<int>>>"


def media_row(text: str | None) -> tuple:
    n, payload = padded(text)
    media = store_payload(payload)
    rows, back = frame_rows(decode_gif(media))
    return n, media, back, rows


def stored_media(docs: DataFrame, batch_rows: int = 128) -> DataFrame:
    """Stores each row's text as a GIF (media), reads it back (payload) and describes its frames: number, start, duration, colour histogram.

    Null texts count as empty (one row of 192 spaces); ties and repeated rows give a row each, equal texts equal values; null ids are kept;
    an empty table gives no rows; further columns are ignored. No shuffle: each text, of any length, is handled where it is read.
    """

    def rows(texts):
        return list(zip(*map(media_row, texts), strict=True))

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, MEDIA, batch_rows)


def query(spark, sf_dir: str) -> DataFrame:
    """The stored media by digests. feature: frames, duration, and the cells of the summed histogram that aren't empty."""
    frames = F.col("frames")
    duration = F.aggregate(frames, F.lit(0).cast("long"), lambda a, f: a + f["delay_cs"])
    total = F.aggregate(F.transform(frames, lambda f: f["histogram"]), F.array_repeat(F.lit(0).cast("long"), 64), lambda a, h: F.zip_with(a, h, lambda x, y: x + y))
    cells = F.filter(F.transform(total, lambda n, k: F.when(n > 0, F.concat(k.cast("string"), F.lit(":"), n.cast("string")))), lambda c: c.isNotNull())
    return stored_media(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -TAIL, TAIL)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size(frames), F.lit("f"), duration, F.lit("cs|"), F.array_join(cells, ",")).alias("feature"),
        F.size(frames).cast("long").alias("n_frames"),
        duration.alias("duration_cs"),
    )
