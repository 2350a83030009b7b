"""Media columns: GIF images decoded into timed frames with colour histograms.

The decoder reads the LZW code streams, global and local palettes, interlacing, disposal (none, keep,
background, previous) and transparency, and returns every frame both as stored indices and as the
composed canvas.  The encoder writes the same format with real LZW codes.

LZW: after a clear code, codes are 9 bits wide for 255 codes, 10 for 512, 11 for 1024 and 12 from there on
(8-bit samples; other sizes alike), so a stream is cut into codes in a few vectorised steps between clear
codes and only the dictionary walk is a loop over codes.

A stream that ends early leaves the rest of its frame at index 0, samples beyond a frame's size are ignored,
and indices beyond the palette take its last colour.  Other damage raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Fixed values of the format: signature, block introducers and labels.
SIGNATURE, EXTENSION, IMAGE, TRAILER = b"GIF89a", 0x21, 0x2C, 0x3B
CONTROL_LABEL = 0xF9
#: Code limit of a full dictionary.
FULL = 4096
#: Rows and columns of a frame that stores bytes, its delay in hundredths of a second, and histogram bins a channel.
WIDTH, ROWS, DELAY, BINS = 192, 256, 10, 16


def _phases(size: int) -> list[tuple[int, int]]:
    """(codes, width) after a clear code, for samples of ``size`` bits, while the width grows; then it is 12 to the next clear code."""
    out, next_code = [], (1 << size) + 2
    for width in range(size + 1, 12):
        out.append(((1 << width) - next_code + (1 if width == size + 1 else 0), width))
        next_code = 1 << width
    return out


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples, starting with a clear code; the dictionary is cleared when full."""
    clear = 1 << size
    codes, table, next_code = [], {}, clear + 2
    emit, known = codes.append, table.get
    if data:
        it = iter(data)
        at = next(it)
        for b in it:
            key = (at << 8) | b
            k = known(key)
            if k is not None:
                at = k
                continue
            emit(at)
            if next_code < FULL:
                table[key] = next_code
                next_code += 1
            else:
                emit(clear)
                table.clear()
                next_code = clear + 2
            at = b
        emit(at)
    emit(clear + 1)
    # codes between two clear codes, the second one included, are as many each time
    run = FULL - clear
    widths = np.full(run, 12, np.uint8)
    done = 0
    for n, width in _phases(size):
        widths[done : done + n] = width
        done += n
    values = np.array([clear, *codes], "<u2")
    width = np.concatenate([[size + 1], np.tile(widths, len(codes) // run + 1)[: len(codes)]]).astype(np.uint8)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16, dtype=np.uint8) < width[:, None]], bitorder="little").tobytes()


_POWERS = (1 << np.arange(12)).astype(np.int32)


def lzw_decode(stream: bytes, size: int = 8) -> bytes:
    """The samples of a code stream; ends at the end code or with the stream.  Raises on impossible codes."""
    clear, end = 1 << size, (1 << size) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = 0
    while True:
        table, last = single.copy(), None
        for n, width in chain(_phases(size), repeat((FULL, 12))):
            m = min(n, (len(bits) - at) // width)
            codes = bits[at : at + m * width].reshape(m, width).astype(np.int32) @ _POWERS[:width]
            stop = np.flatnonzero((codes == clear) | (codes == end))
            ended = len(stop) > 0
            use = codes[: stop[0]] if ended else codes
            for c in use.tolist():
                if last is None:
                    entry = table[c]
                elif c < len(table):
                    entry = table[c]
                    if len(table) < FULL:
                        table.append(last + entry[:1])
                elif c == len(table) and c < FULL:
                    entry = last + last[:1]
                    table.append(entry)
                else:
                    raise ValueError("GIF: code beyond the dictionary")
                out.append(entry)
                last = entry
            at += (int(stop[0]) + 1 if ended else m) * width
            if ended:
                if codes[stop[0]] == end:
                    return b"".join(out)
                break
            if m < n:
                return b"".join(out)


@dataclass
class Frame:
    """A frame: its place, time and disposal, the stored indices, and the canvas once it is drawn."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray

    def histogram(self) -> np.ndarray:
        """Counts of the canvas' red, green and blue in BINS equal bins each."""
        bins = (self.canvas >> 4).reshape(-1, 3) + np.arange(0, 3 * BINS, BINS, dtype=np.uint8)
        return np.bincount(bins.ravel(), minlength=3 * BINS).reshape(3, BINS)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(rows: np.ndarray) -> np.ndarray:
    order = np.concatenate([np.arange(a, len(rows), s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, composed in order on a black canvas.

    A code stream that ends early leaves index 0.  Bytes that are no GIF, or end before the trailer, raise ValueError.
    """
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:  # a length or a place beyond the bytes
        raise ValueError("GIF: the bytes end early") from e


def _decode(data: bytes) -> list[Frame]:
    if data[:6] not in (b"GIF87a", SIGNATURE):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas, frames = np.zeros((height, width, 3), np.uint8), []
    delay, disposal, transparent = 0, 0, None
    while data[at] != TRAILER:
        if data[at] == EXTENSION:
            label, (block, after) = data[at + 1], _sub_blocks(data, at + 2)
            if label == CONTROL_LABEL:
                control, delay, index = struct.unpack_from("<BHB", block)
                disposal, transparent = (control >> 2) & 7, index if control & 1 else None
            at = after
            continue
        if data[at] != IMAGE:
            raise ValueError("GIF: unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if local & 0x80:
            n = 2 << (local & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("GIF: no palette")
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, size), np.uint8)[: w * h]
        indices = np.zeros(w * h, np.uint8)
        indices[: len(flat)] = flat
        indices = indices.reshape(h, w)
        if local & 0x40:
            indices = _interlaced(indices)
        before = canvas.copy() if disposal == 3 else None
        place = canvas[top : top + h, left : left + w]
        seen = indices[: place.shape[0], : place.shape[1]]
        drawn = colours[np.minimum(seen, len(colours) - 1)]
        if transparent is None:
            place[:] = drawn
        else:
            opaque = seen != transparent
            place[opaque] = drawn[opaque]
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, indices, canvas.copy()))
        if disposal == 2:
            place[:] = 0 if palette is None or transparent is not None else palette[min(background, len(palette) - 1)]
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return frames


_GREYS = bytes(v for i in range(256) for v in (i, i, i))


def encode_bytes(payload: bytes) -> bytes:
    """A GIF whose frames' indices are the payload, WIDTH columns wide and at most ROWS rows a frame."""
    step = WIDTH * ROWS
    chunks = [payload[i : i + step] for i in range(0, len(payload), step)]
    out = [SIGNATURE, struct.pack("<HHBBB", WIDTH, len(chunks[0]) // WIDTH, 0xF7, 0, 0), _GREYS]
    for chunk in chunks:
        stream = lzw_encode(chunk)
        blocks = b"".join(bytes([len(p)]) + p for p in (stream[i : i + 255] for i in range(0, len(stream), 255)))
        out += [
            bytes([EXTENSION, CONTROL_LABEL, 4]) + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0),
            bytes([IMAGE]) + struct.pack("<HHHHB", 0, 0, WIDTH, len(chunk) // WIDTH, 0),
            b"\x08" + blocks + b"\x00",
        ]
    return b"".join([*out, bytes([TRAILER])])


def padded(text: str | None) -> tuple[bytes, int]:
    """A text in UTF-8 with spaces up to a positive multiple of WIDTH, and its length before that."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes of the text and the GIF that stores it; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_bytes(p) for p, _ in made], pa.binary())],
                    names=[id_col, "n_bytes", "media"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


CHANNELS = ("red", "green", "blue")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, place, delay, disposal, transparent index, indices, and histogram columns.

    Null media give no rows; repeated ids give their frames as often.  ``start`` is the frame's time in hundredths
    of a second; red, green and blue count the composed canvas in BINS bins.
    """
    names = ["frame", "start", "delay", "left", "top", "width", "height", "disposal", "transparent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw = b.column(1)[r].as_py()
                if raw is None:
                    continue
                found, start, rows = decode(raw), 0, []
                for i, f in enumerate(found):
                    rows.append([i, start, f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent])
                    start += f.delay
                hist = [f.histogram() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([b.column(0).slice(r, 1)] * len(found)) if found else b.column(0).slice(r, 0),
                        *(pa.array([x[c] for x in rows], pa.int32()) for c in range(len(names))),
                        pa.array([f.indices.tobytes() for f in found], pa.binary()),
                        *(pa.array([h[c].tolist() for h in hist], pa.list_(pa.int64())) for c in range(3)),
                    ],
                    names=[id_col, *names, "indices", *CHANNELS],
                )

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` int" for n in names) + ", indices binary, red array<long>, green array<long>, blue array<long>"
    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a GIF, read the stored bytes back into timed frames, and describe what was read.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes), media_bytes,
    media_sha256, feature (frames, total delay, and the summed red, green and blue histograms), and the timed frames:
    starts (hundredths of a second) and red, green and blue, a histogram for each frame.  Null texts are empty,
    repeated ids keep a row each.
    """
    media = written(stored_media(docs, id_col, text_col), "op8-media")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                raw = m.as_py()
                found = decode(raw)
                payload = b"".join(f.indices.tobytes() for f in found)
                hist = [f.histogram() for f in found]
                delays = [f.delay for f in found]
                feature = ":".join([str(len(found)), str(sum(delays)), *(",".join(map(str, c.tolist())) for c in sum(hist))])
                rows.append(
                    (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature,
                        np.cumsum([0, *delays[:-1]]).tolist(), *([h[c].tolist() for h in hist] for c in range(3)),
                    )
                )
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "starts", *CHANNELS]
    lists = pa.list_(pa.list_(pa.int64()))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), lists, lists, lists)
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, starts array<long>"
    return media.mapInArrow(run, schema + "".join(f", {c} array<array<long>>" for c in CHANNELS))
