"""Media columns as GIF: timed frames with colour histograms, and bytes kept losslessly as pixels.

The reader decodes any GIF: LZW code streams of 2 to 12 bits, global and local palettes, interlacing,
transparency and the four disposal rules, composed onto the logical screen frame by frame. Codes are
taken from the stream by whole segments between clear codes, for a segment's code widths follow from
its code positions alone; a segment's codes then go through the code table one by one. The writer keeps
bytes as indexes into a grey palette, 64 columns wide, frames of up to 1024 rows, compressed by the same
table, which is cleared when it is full.

Null and empty texts are 64 zero bytes. Null media give null columns; a stream that breaks a rule of the
format raises ValueError naming it. Equal texts give equal media. A null id is carried; repeated rows are
kept. Columns other than the two named are not read. Memory follows the largest single text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, slices

COLUMNS, ROWS, DELAY_CS, BINS = 64, 1024, 10, 8
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
FULL = 4096  # entries of a full code table


def padded(data: bytes, unit: int = COLUMNS) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def sub_blocks(data: bytes) -> bytes:
    full, rest = divmod(len(data), 255)
    blocks = np.full((full, 256), 255, np.uint8)
    blocks[:, 1:] = np.frombuffer(data, np.uint8, 255 * full).reshape(full, 255)
    return blocks.tobytes() + (bytes([rest]) + data[-rest:] if rest else b"") + b"\0"


def compressed(samples: bytes) -> bytes:
    """The LZW stream of eight-bit samples: a clear code, codes until the table is full, again a clear code, and the end."""
    table: dict[int, int] = {}
    fresh, codes, segments = 258, [], []
    known, emit = table.get, codes.append
    prefix = samples[0]
    for sample in memoryview(samples)[1:]:
        pair = prefix << 8 | sample
        found = known(pair)
        if found is not None:
            prefix = found
            continue
        emit(prefix)
        prefix = sample
        if fresh < FULL:
            table[pair] = fresh
            fresh += 1
        else:
            emit(256)
            segments.append(len(codes))
            table.clear()
            fresh = 258
    codes += [prefix, 257]
    starts = [0, *segments]
    widths = np.concatenate([[9], *(schedule(8, b - a)[1] for a, b in zip(starts, [*segments, len(codes)]))])
    flat = np.array([256, *codes], "<u2")
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def write_gif(payload: bytes) -> bytes:
    """``payload``, of a positive multiple of 64 bytes, as grey frames."""
    rows = len(payload) // COLUMNS
    out = [b"GIF89a", struct.pack("<HHBBB", COLUMNS, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        samples = payload[top * COLUMNS : (top + n) * COLUMNS]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, COLUMNS, n, 0), b"\x08", sub_blocks(compressed(samples))]
    return b"".join([*out, b";"])


_schedules: dict[int, np.ndarray] = {}


def schedule(root_bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each of the first ``n`` codes after a clear code."""
    if root_bits not in _schedules:
        _schedules[root_bits] = np.zeros(1, np.int64)
    if len(_schedules[root_bits]) <= n:
        i = np.arange(max(n + 1, 8192))
        entries = np.minimum((1 << root_bits) + 2 + np.maximum(i - 1, 0), 4095)
        width = np.maximum(root_bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1)
        _schedules[root_bits] = np.concatenate(([0], np.cumsum(width)))
    offsets = _schedules[root_bits]
    return offsets[:n], np.diff(offsets[: n + 1])


def codes_at(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    at = start >> 3
    word = data[at].astype(np.uint32) | (data[at + 1].astype(np.uint32) << 8) | (data[at + 2].astype(np.uint32) << 16)
    return (word >> (start & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)


def expand(codes: list[int], clear: int) -> bytes:
    """Samples of one segment's codes by the code table."""
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    if codes[0] >= clear:
        raise ValueError("GIF: a segment begins with a code that is not a root")
    last, size = table[codes[0]], clear + 2
    out = [last]
    emit, enter = out.append, table.append
    for c in codes[1:]:
        if c < size:
            now = table[c]
        elif c == size and c < FULL:
            now = last + last[:1]
        else:
            raise ValueError("GIF: a code stands for no entry")
        if size < FULL:
            enter(last + now[:1])
            size += 1
        emit(now)
        last = now
    return b"".join(out)


def read_lzw(stream: bytes, root_bits: int, n: int) -> np.ndarray:
    """``n`` samples of an LZW stream."""
    clear, end = 1 << root_bits, (1 << root_bits) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8)
    total, at, found, out = len(stream) * 8, 0, 0, []
    size = 512  # codes to look at for the segment's end
    while found < n:
        while True:
            offsets, widths = schedule(root_bits, size)
            inside = at + offsets + widths <= total
            codes = codes_at(data, at + offsets[inside], widths[inside])
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or not inside.all():
                break
            size *= 8
        k = int(stop[0]) if len(stop) else len(codes)
        if k:
            out.append(expand(codes[:k].tolist(), clear))
            found += len(out[-1])
        if not len(stop) or codes[k] == end:
            break
        at += int(offsets[k] + widths[k])
        size = max(512, k + 8)  # the next one is often as long
    samples = np.frombuffer(b"".join(out), np.uint8)[:n]
    if len(samples) < n:
        raise ValueError("GIF: the code stream ends before the frame is full")
    return samples


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    screen: np.ndarray  # rows x columns x RGBA of the logical screen while the frame shows

    def own(self) -> np.ndarray:
        return self.screen[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> list[int]:
        """BINS counts each of red, green and blue over the screen's opaque pixels."""
        seen = self.screen[self.screen[..., 3] > 0]
        return [int(x) for c in range(3) for x in np.bincount(seen[:, c] // (256 // BINS), minlength=BINS)]


def read_gif(media: bytes) -> list[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("GIF: no signature")
    columns, rows, packed, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        colours = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    common, frames = palette(packed), []
    screen = np.zeros((rows, columns, 4), np.uint8)
    disposal, delay, clear_index = 0, 0, None
    try:
        while (kind := media[at]) != 0x3B:
            at += 1
            if kind == 0x21:
                label = media[at]
                at += 1
                body = blocks()
                if label == 0xF9:
                    flags, delay, index = struct.unpack_from("<BHB", body)
                    disposal, clear_index = flags >> 2 & 7, index if flags & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("GIF: an unknown block")
            left, top, width, height, flags = struct.unpack_from("<HHHHB", media, at)
            at += 9
            colours = palette(flags)
            colours = common if colours is None else colours
            if colours is None:
                raise ValueError("GIF: a frame has no palette")
            root_bits = media[at]
            at += 1
            index = read_lzw(blocks(), root_bits, width * height).reshape(height, width)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            if index.size and int(index.max()) >= len(colours):
                raise ValueError("GIF: an index beyond the palette")
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + height, left : left + width]
            index = index[: area.shape[0], : area.shape[1]]
            drawn = np.ones(index.shape, bool) if clear_index is None else index != clear_index
            area[drawn, :3] = colours[index[drawn]]
            area[drawn, 3] = 255
            frames.append(Frame(10 * delay, left, top, width, height, screen.copy()))
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                screen = before
            disposal, delay, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("GIF: the file ends early") from e
    return frames


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): each whole text's UTF-8 bytes, padded, as a GIF."""
    kind = require(docs, id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t.as_py() or "").encode("utf-8") for t in part.column(1)]
                sizes = [len(b) for b in raw]
                raw = [padded(b) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([len(b) for b in raw], pa.int64()), pa.array([write_gif(b) for b in raw], pa.binary())], names=[id_col, "n_bytes", "payload_bytes", "media"])

    return require(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, payload_bytes long, media binary")


FRAMES = "array<struct<delay_ms: int, left: int, top: int, width: int, height: int, histogram: array<int>{}>>"


def read_media(media: DataFrame, column: str = "media", pixels: bool = False) -> DataFrame:
    """``media`` with ``samples`` (red channel of each frame's own area, in order) and ``frames``; with ``pixels``, each frame also has its screen as RGBA bytes."""
    kinds = FRAMES.format(", rgba: binary" if pixels else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + f", samples binary, frames {kinds}"
    item = pa.struct([(n, pa.int32()) for n in ("delay_ms", "left", "top", "width", "height")] + [("histogram", pa.list_(pa.int32()))] + [("rgba", pa.binary())] * pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            for part in slices(batch, at):
                samples, frames = [], []
                for m in part.column(at):
                    if not m.is_valid:
                        samples.append(None)
                        frames.append(None)
                        continue
                    read = read_gif(m.as_py())
                    samples.append(b"".join(f.own()[..., 0].tobytes() for f in read))
                    frames.append([{"delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "histogram": f.histogram()} | ({"rgba": f.screen.tobytes()} if pixels else {}) for f in read])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(samples, pa.binary()), pa.array(frames, pa.list_(item))], names=[*part.schema.names, "samples", "frames"])

    return media.mapInArrow(run, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back, and the digests and histogram feature of what was read."""
    back = read_media(store_media(docs, id_col, text_col))
    return back.select(
        id_col,
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(samples, -{COLUMNS})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("frames", lambda f: F.concat(f["delay_ms"].cast("string"), F.lit(":"), F.array_join(f["histogram"].cast("array<string>"), ","))), ";").alias("feature"),
    )
