"""Media columns: GIF files as binary columns, and the timed frames that they hold.

Reading follows the format: LZW code streams with growing code sizes, clear codes and deferred clears,
global and local palettes, interlacing, transparency and the disposal rules. Each frame comes with
its delay, its rectangle as far as it is on the screen, what that shows after compositing, and a histogram of its colours. Where
nothing was drawn yet, or was cleared, pixels are black and `alpha` is 0; without such pixels `alpha` is null.

Writing stores bytes as 8-bit samples, one code for one grey, in rows of `WIDTH`; long payloads go on in
further frames, so no code table or canvas grows with the payload.

A null or empty text gives one row of zeros; equal texts give equal files; a file that isn't a GIF, or is cut
off or damaged, has null columns; repeated rows stay; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes, keyed, named, utf8

WIDTH, FRAME_ROWS, DELAY_MS = 64, 1024, 100
_CLEAR, _END = 256, 257
_SINGLE = [bytes([i]) for i in range(256)]
_GREY = bytes(i for i in range(256) for _ in range(3))


class GifError(ValueError):
    """The bytes are not a whole GIF."""


def _widths(count: int, least: int) -> np.ndarray:
    """Bits of the code at each place after a clear code."""
    after = np.arange(count) + (1 << least) + 1  # codes known when it is read
    return np.clip(np.floor(np.log2(np.maximum(after, 1))).astype(np.int64) + 1, least + 1, 12)


_STEP = 4096
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _bit_starts(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each code begins after a clear code, and its width."""
    if least not in _TABLES:
        widths = _widths(_STEP, least)
        _TABLES[least] = np.concatenate(([0], np.cumsum(widths))), widths
    return _TABLES[least]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; a full table is cleared."""
    codes, table, following, prefix = [_CLEAR], {}, 258, samples[0]
    emit, find = codes.append, table.get
    clears = [0]
    for b in samples[1:]:
        if (code := find(key := prefix << 8 | b)) is not None:
            prefix = code
            continue
        emit(prefix)
        if following < 4096:
            table[key] = following
            following += 1
        else:
            clears.append(len(codes))
            emit(_CLEAR)
            table.clear()
            following = 258
        prefix = b
    emit(prefix)
    emit(_END)
    codes = np.array(codes, np.int64)
    bounds = [*clears, len(codes)]
    widths = np.concatenate([np.full(1, 9), *[_widths(e - s, 8) for s, e in zip(bounds, bounds[1:])]])[: len(codes)]
    # After a clear code the next code is at place 0; the clear code itself still has the width of its own place.
    starts = np.concatenate(([0], np.cumsum(widths)))
    place, shifted = starts[:-1] >> 3, codes << (starts[:-1] & 7)
    size = int(starts[-1] + 7) // 8
    out = sum(np.bincount(place + k, (shifted >> 8 * k) & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least: int, wanted: int) -> bytes:
    """The samples of a code stream whose smallest code size is `least`."""
    clear, bits = 1 << least, np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    (starts, widths), total = _bit_starts(least), 8 * len(data)
    base, out, made, at, done = [*_SINGLE[:clear], b"", b""], [], 0, 0, False
    while not done and made < wanted:
        table, previous, first, emit = list(base), None, True, out.append
        while True:
            # As many codes as the table's growth tells the widths of; a full table goes on with 12 bits.
            where, wide = (starts[:-1], widths) if first else (np.arange(_STEP) * 12, np.full(_STEP, 12))
            where = where + at
            fit = int(np.searchsorted(where + wide, total, "right"))
            where, wide = where[:fit], wide[:fit]
            byte = where >> 3
            codes = ((bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (where & 7)) & ((1 << wide) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            stop = int(stops[0]) if len(stops) else -1
            entries = (codes if stop < 0 else codes[:stop]).tolist()
            if entries and previous is None:
                if entries[0] >= clear:
                    raise GifError("code before its entry")
                previous = table[entries[0]]
                emit(previous)
                entries = entries[1:]
            room = 4096 - len(table)
            size, add = len(table), table.append
            for code in entries[:room]:
                if code < size:
                    entry = table[code]
                    add(previous + entry[:1])
                elif code == size:
                    entry = previous + previous[:1]
                    add(entry)
                else:
                    raise GifError("code beyond the table")
                size += 1
                emit(entry)
                previous = entry
            out += [table[code] for code in entries[room:]]
            if stop >= 0:
                at = int(where[stop] + wide[stop])
                done = codes[stop] == clear + 1
                break
            if fit < _STEP:
                done = True
                break
            at, first = int(where[-1] + wide[-1]), False
        out = [b"".join(out)]
        made = len(out[0])
    samples = b"".join(out)
    if len(samples) < wanted:
        raise GifError("samples are missing")
    return samples[:wanted]


def write_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF whose frames hold the payload's bytes; its length must be a positive multiple of `width`."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill its rows")
    rows = len(payload) // width
    out = [b"GIF89a", width.to_bytes(2, "little"), min(rows, frame_rows).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for start in range(0, rows, frame_rows):
        height = min(frame_rows, rows - start)
        # Control block: leave the frame as it is, no transparent colour, the delay in hundredths.
        out.append(b"\x21\xf9\x04\x04" + (delay_ms // 10).to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\0\x08")
        codes = lzw_encode(payload[start * width : (start + height) * width])
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("cut off in a block")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        if at + 1 + size > len(data):
            raise GifError("cut off in a block")
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def _rows_in_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> tuple[int, int, list[dict]]:
    """Screen width and height, and the frames in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, shared = 13, None

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        size = 3 << (bits + 1)
        if at + size > len(data):
            raise GifError("cut off in a palette")
        found = np.zeros((256, 3), np.uint8)
        found[: size // 3] = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
        at += size
        return found

    if flags & 0x80:
        shared = palette(flags & 7)
    canvas, drawn, frames = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool), []
    delay, disposal, clear = 0, 0, None
    while True:
        if at >= len(data):
            raise GifError("no end mark")
        mark = data[at]
        if mark == 0x3B:
            return width, height, frames
        if mark == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                delay, disposal = 10 * int.from_bytes(block[1:3], "little"), block[0] >> 2 & 7
                clear = block[3] if block[0] & 1 else None
            continue
        if mark != 0x2C or at + 11 > len(data):
            raise GifError("neither frame nor extension")
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        local = data[at + 9]
        at += 10
        colours = palette(local & 7) if local & 0x80 else shared
        if colours is None or at >= len(data) or not 1 <= data[at] <= 8:
            raise GifError("no palette or code size")
        least = data[at]
        codes, at = _blocks(data, at + 1)
        indexes = np.frombuffer(lzw_decode(codes, least, w * h), np.uint8).reshape(h, w)
        if local & 0x40:
            indexes = indexes[np.argsort(_rows_in_order(h))]
        indexes = indexes[: max(0, height - top), : max(0, width - left)]
        h, w = indexes.shape
        before = (canvas.copy(), drawn.copy()) if disposal == 3 else None
        here = slice(top, top + h), slice(left, left + w)
        part, solid = canvas[here], drawn[here]
        if clear is None:
            part[...], solid[...] = colours[indexes], True
        else:
            shows = indexes != clear
            part[shows], solid[shows] = colours[indexes[shows]], True
        shown = part.copy()
        grey = bool((shown[..., 0] == shown[..., 1]).all() and (shown[..., 1] == shown[..., 2]).all())
        bins = [np.bincount(shown[..., c].ravel() >> 5, minlength=8).tolist() for c in range(1 if grey else 3)] * (3 if grey else 1)
        alpha = None if solid.all() else np.where(solid, np.uint8(255), np.uint8(0)).tobytes()
        frames.append({"index": len(frames), "delay_ms": delay, "disposal": disposal, "left": left, "top": top, "width": w, "height": h, "transparent": clear, "mode": "L" if grey else "RGB", "pixels": (shown[..., 0] if grey else shown).tobytes(), "alpha": alpha, "red": bins[0], "green": bins[1], "blue": bins[2]})
        if disposal == 2:
            part[...], solid[...] = 0, False
        elif disposal == 3:
            canvas, drawn = before
        delay, disposal, clear = 0, 0, None


_FRAME = pa.struct([("index", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("transparent", pa.int32()), ("mode", pa.string()), ("pixels", pa.binary()), ("alpha", pa.binary()), ("red", pa.list_(pa.int64())), ("green", pa.list_(pa.int64())), ("blue", pa.list_(pa.int64()))])
_FRAME_SQL = "array<struct<index:int,delay_ms:int,disposal:int,left:int,top:int,width:int,height:int,transparent:int,mode:string,pixels:binary,alpha:binary,red:array<bigint>,green:array<bigint>,blue:array<bigint>>>"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__text", 4 << 20):
        raw = utf8(batch.column("__text"))
        media = [write_gif(x + b"\0" * (-len(x) % WIDTH or (0 if x else WIDTH))) for x in raw]
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "media"])


def store(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, n_bytes and media: each text's bytes as a GIF, zeros added up to a whole row."""
    kept = keyed(docs, keys, __text=F.col(f"`{text}`").cast("string"))
    return named(kept.mapInArrow(_written, kept.drop("__text").schema.add("n_bytes", "long").add("media", "binary")), keys)


def _read(data: bytes | None):
    try:
        return None if data is None else read_gif(data)
    except GifError:
        return None


def _added(media: DataFrame, made: T.StructType, arrays) -> DataFrame:
    """The rows with columns that `arrays` makes of what is read of their column `media`."""
    kept = keyed(media, media.columns)
    own = f"__key{media.columns.index('media')}"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, own, 4 << 20):
            found = [_read(x) for x in batch.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays(found)], [*batch.schema.names, *made.fieldNames()])

    return named(kept.mapInArrow(add, T.StructType([*kept.schema.fields, *made.fields])), media.columns)


def frames(media: DataFrame) -> DataFrame:
    """The rows with screen_width, screen_height and frames of their column `media`."""
    made = T.StructType().add("screen_width", "integer").add("screen_height", "integer").add("frames", T.DataType.fromDDL(_FRAME_SQL))
    return _added(media, made, lambda found: [pa.array([f and f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.list_(_FRAME)))])


def _digest(read: tuple[int, int, list[dict]] | None) -> tuple:
    if read is None:
        return (None,) * 7
    digest, size, tail, grey = hashlib.sha256(), 0, b"", np.zeros(8, np.int64)
    for frame in read[2]:
        digest.update(frame["pixels"])
        size += len(frame["pixels"])
        tail = (tail + frame["pixels"][-64:])[-64:]
        grey += frame["red"]
    return len(read[2]), read[2][0]["delay_ms"] if read[2] else None, size, digest.hexdigest(), zlib.crc32(tail), grey.tolist(), read[2][0]["mode"] if read[2] else None


def digests(media: DataFrame) -> DataFrame:
    """The rows with n_frames, delay_ms and mode of the first frame, and over all frames' pixels in order: n_pixel_bytes, pixels_sha256, tail_crc32 (of the last 64) and the sum of the red (or grey) histograms.

    Frames are hashed one by one where they are read, so the cost is in proportion to the pixels.
    """
    kinds = {"n_frames": ("integer", pa.int32()), "delay_ms": ("integer", pa.int32()), "n_pixel_bytes": ("long", pa.int64()), "pixels_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "histogram": ("array<bigint>", pa.list_(pa.int64())), "mode": ("string", pa.string())}
    made = T.StructType([T.StructField(n, T.DataType.fromDDL(k)) for n, (k, _) in kinds.items()])
    return _added(media, made, lambda found: [pa.array(c, kind) for c, (_, kind) in zip(zip(*map(_digest, found)) if found else [()] * len(kinds), kinds.values())])
