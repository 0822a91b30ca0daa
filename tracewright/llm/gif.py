"""GIF images in binary columns: an LZW code stream reader and writer, palettes, disposal and transparency, timed frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.textops import slices

CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
#: Sides of the frames that hold a payload; so few samples never fill a code table.
FRAME_WIDTH, FRAME_ROWS = 64, 48
#: Frames that are coded side by side.
SIDE_BY_SIDE = 1024
#: Streams that are read side by side.
READ_SIDE_BY_SIDE = 512
#: Bins of each colour channel's histogram.
BINS = 8
#: Bytes of payload that are stored and read at once in a Python worker.
SLICE_BYTES = 4 << 20


class GifError(ValueError):
    """The bytes are not a whole GIF."""


@dataclass
class Frame:
    """A composed picture: rgb is uint8[height, width, 3]; indices are the frame's own samples before composing."""

    rgb: np.ndarray
    indices: np.ndarray
    delay_ms: int
    disposal: int


# --- LZW ------------------------------------------------------------------------------------------------------------


def _layout(first_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code after a clear code: the table grows with every code but the first."""
    clear = 1 << (first_bits - 1)
    k = np.arange(FULL - clear)
    widths = np.minimum(np.floor(np.log2(np.maximum(clear + 1 + k, clear))).astype(np.int64) + 1, 12)
    widths[0] = first_bits
    return np.cumsum(widths) - widths, widths


_LAYOUTS = {bits: _layout(bits) for bits in range(3, 10)}


_SLOTS, _SHIFT = 8192, np.uint32(19)
_EMPTY = np.uint32(0xFFFFFFFF)


def lzw_encode_many(rows: list[bytes]) -> list[bytes]:
    """The code streams of frames of 8-bit samples, at most FRAME_WIDTH * FRAME_ROWS each: greedy matching for many
    frames in step, each with a hash table of its own from (prefix code, sample) to code."""
    out: list[bytes] = [b""] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    for a in range(0, len(order), SIDE_BY_SIDE):
        part = order[a : a + SIDE_BY_SIDE]
        for i, stream in zip(part, _encode_in_step([rows[i] for i in part]), strict=True):
            out[i] = stream
    return out


def _encode_in_step(rows: list[bytes]) -> list[bytes]:
    """rows: the longest first."""
    lengths = np.array([len(r) for r in rows])
    assert lengths[0] <= FRAME_WIDTH * FRAME_ROWS and lengths[-1] > 0, "frame size"
    n, longest = len(rows), int(lengths[0])
    samples = np.zeros((longest, n), np.uint32)
    for k, r in enumerate(rows):
        samples[: len(r), k] = np.frombuffer(r, np.uint8)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # rows longer than t
    table = np.full(n * _SLOTS, _EMPTY, np.uint32)
    base = np.arange(n, dtype=np.int64) * _SLOTS
    codes = np.zeros((longest + 1, n), np.uint16)
    flat = codes.ravel()
    count = np.zeros(n, np.int64)
    prefix = samples[0].copy()
    for t in range(1, longest):
        m = int(active[t])
        byte = samples[t, :m]
        key = prefix[:m] << 8 | byte
        slot = base[:m] + (key * np.uint32(2654435761) >> _SHIFT)
        found = table.take(slot)
        hit = found >> 12 == key
        miss = np.flatnonzero(~hit)
        wait = miss.compress(found.take(miss) != _EMPTY)
        if len(wait):
            while len(wait):
                own = base.take(wait)
                next_slot = own + ((slot.take(wait) - own + 1) & (_SLOTS - 1))
                slot[wait] = next_slot
                there = table.take(next_slot)
                found[wait] = there
                same = there >> 12 == key.take(wait)
                hit[wait] = same
                wait = wait.compress(~same & (there != _EMPTY))
            miss = np.flatnonzero(~hit)
        at = count.take(miss)
        new = key.take(miss)
        flat[at * n + miss] = new >> 8
        table[slot.take(miss)] = new << 12 | (at + FIRST).astype(np.uint32)
        count[miss] = at + 1
        longer = found & 4095
        np.copyto(longer, byte, where=~hit)
        prefix[:m] = longer
    flat[count * n + np.arange(n)] = prefix
    count += 1
    starts, widths = _LAYOUTS[9]
    sizes = (9 + starts[count] + widths[count] + 7) >> 3
    room = np.cumsum(sizes + 3) - (sizes + 3)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # a code's number in its frame
    which = np.repeat(np.arange(n), count)
    stream = np.zeros(int((sizes + 3).sum()), np.uint8)

    def put(values: np.ndarray, bit: np.ndarray, row: np.ndarray) -> None:
        shifted, byte = values.astype(np.uint32) << (bit & 7).astype(np.uint32), room[row] + (bit >> 3)
        for j in range(3):  # codes have over 8 bits, so for each j no two begin in the same byte
            stream[byte + j] |= (shifted >> (8 * j)).astype(np.uint8)

    rows_of = np.arange(n)
    put(np.full(n, CLEAR), np.zeros(n, np.int64), rows_of)
    put(flat.take(k * n + which), 9 + starts.take(k), which)
    put(np.full(n, END), 9 + starts[count], rows_of)
    return [stream[a : a + m].tobytes() for a, m in zip(room.tolist(), sizes.tolist(), strict=True)]


def lzw_decode_many(streams: list[tuple[bytes, int, int]]) -> list[bytes | GifError]:
    """Samples of (code stream, code size, samples) each. Streams of 8-bit samples that begin with a clear code and end
    before the table is full are read in step; others by lzw_decode."""
    out: list[bytes | GifError] = [b""] * len(streams)
    rest = [i for i, x in enumerate(streams) if x[1] != 8 or len(x[0]) > 5500]
    quick = sorted((i for i, x in enumerate(streams) if x[1] == 8 and len(x[0]) <= 5500), key=lambda i: len(streams[i][0]))
    for a in range(0, len(quick), READ_SIDE_BY_SIDE):
        part = quick[a : a + READ_SIDE_BY_SIDE]
        for i, got in zip(part, _decode_in_step([streams[i] for i in part]), strict=True):
            if got is None:
                rest.append(i)
            else:
                out[i] = got
    for i in rest:
        try:
            out[i] = lzw_decode(*streams[i])
        except GifError as e:
            out[i] = e
    return out


def _decode_in_step(streams: list[tuple[bytes, int, int]]) -> list[bytes | None]:
    n, size = len(streams), max(len(s[0]) for s in streams)
    raw = np.zeros((n, size + 4), np.uint32)
    for k, (s, _, _) in enumerate(streams):
        raw[k, : len(s)] = np.frombuffer(s, np.uint8)
    starts, widths = _LAYOUTS[9]
    last = int(np.searchsorted(9 + starts + widths, 8 * size, "right"))
    at = np.concatenate([[0], 9 + starts[:last]])
    width = np.concatenate([[9], widths[:last]])
    byte = at >> 3
    codes = (raw[:, byte] | raw[:, byte + 1] << 8 | raw[:, byte + 2] << 16) >> (at & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
    fine = codes[:, 0] == CLEAR
    codes = np.ascontiguousarray(codes[:, 1:].T).astype(np.int32)  # by code, then stream
    ends = codes == END
    fine &= ends.any(axis=0)
    count = ends.argmax(axis=0)
    used = np.arange(len(codes))[:, None] < count
    entry = codes - FIRST
    step = np.arange(len(codes))[:, None]
    fine &= ~(used & ((codes == CLEAR) | (entry >= step) | (codes == END))).any(axis=0)
    literal = codes < CLEAR
    lengths = np.ones_like(codes)
    columns = np.arange(n)
    safe = np.where(literal | ~used | ~fine, 0, entry) * n + columns  # the entry's code, in a flat table
    flat = lengths.ravel()
    for j in range(1, int(count.max(initial=0))):
        lengths[j] += np.where(literal[j], 0, flat.take(safe[j]))
    lengths[~used | ~fine] = 0
    begin = np.cumsum(lengths, axis=0, dtype=np.int32) - lengths
    total = lengths.sum(axis=0, dtype=np.int64)
    first = np.cumsum(total) - total
    begin += first.astype(np.int32)
    # every sample of a longer string was written before, where its entry's string began
    real = used.T & fine[:, None]
    sizes, own = lengths.T[real], begin.T[real]
    single = literal.T[real]
    behind = np.where(single, 0, own - begin.ravel().take(safe.T[real]))
    source = np.arange(int(total.sum()), dtype=np.int32) - np.repeat(behind, sizes)
    is_literal = np.repeat(single, sizes)
    values = np.repeat(np.where(single, codes.T[real], 0).astype(np.uint8), sizes)
    unsettled = np.flatnonzero(~is_literal)
    while len(unsettled):
        further = source.take(source.take(unsettled))
        source[unsettled] = further
        unsettled = unsettled.compress(~is_literal.take(further))
    samples = values[source].tobytes()
    return [samples[a : a + need] if ok and got >= need else None for a, got, ok, (_, _, need) in zip(first.tolist(), total.tolist(), fine.tolist(), streams, strict=True)]


def lzw_decode(stream: bytes, code_size: int, samples: int) -> bytes:
    """Samples of a code stream; a short stream or a code outside the table raises GifError."""
    if not 2 <= code_size <= 8:
        raise GifError("LZW code size")
    clear = 1 << code_size
    starts, widths = _LAYOUTS[code_size + 1]
    raw = np.zeros(len(stream) + 8, np.uint32)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    bits = 8 * len(stream)
    at, out = 0, bytearray()
    while len(out) < samples:
        n = int(np.searchsorted(starts + widths, bits - at, "right"))
        if n == 0:
            raise GifError("LZW stream ends early")
        pos = at + starts[:n]
        byte = pos >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (window >> (pos & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(special[0]) if len(special) else n
        _expand(codes[:stop].tolist(), clear, out, samples)
        if len(special):
            if codes[stop] == clear + 1:
                break
            at = int(pos[stop] + widths[stop])
        elif n == len(starts):  # the table is full and no clear code came: 12-bit codes that add nothing
            at = _full_table(raw, int(pos[-1] + widths[-1]), bits, codes.tolist(), clear, out, samples)
            if at < 0:
                break
        else:
            break
    if len(out) < samples:
        raise GifError("LZW stream ends early")
    return bytes(out[:samples])


def _expand(codes: list[int], clear: int, out: bytearray, samples: int) -> None:
    """Appends the strings of codes since a clear code. An entry's string is where its code's string was written, one sample longer."""
    first = clear + 2
    begin, end = [], []
    here = len(out)
    for c in codes:
        begin.append(here)
        if c < clear:
            out.append(c)
            here += 1
        else:
            e = c - first
            if e < 0 or e > len(begin) - 2:
                raise GifError("LZW code outside the table")
            a = begin[e]
            piece = out[a : end[e] + 1]
            out += piece
            if end[e] == here:  # the entry that this very code completes
                out.append(out[a])
                here += len(piece) + 1
            else:
                here += len(piece)
        end.append(here)
        if here >= samples:
            return


def _full_table(raw: np.ndarray, at: int, bits: int, codes: list[int], clear: int, out: bytearray, samples: int) -> int:
    strings: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    before = None
    for c in codes:
        if before is not None and len(strings) < FULL:
            strings.append(before + (strings[c] if c < len(strings) else before)[:1])
        before = strings[c]
    while at + 12 <= bits and len(out) < samples:
        k = at >> 3
        c = int(raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (at & 7) & 4095
        at += 12
        if c == clear:
            return at
        if c == clear + 1:
            return -1
        if c >= len(strings):
            raise GifError("LZW code outside the table")
        out += strings[c]
    return -1


# --- container ------------------------------------------------------------------------------------------------------


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block is cut off")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        if len(parts[-1]) < n:
            raise GifError("a block is cut off")
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("a palette is cut off")
    table = np.zeros((256, 3), np.uint8)
    table[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return table, at + 3 * n


@dataclass
class Coded:
    """A frame as the file has it: its place, palette, control values and code stream."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    delay_ms: int
    disposal: int
    transparent: int
    size: int
    stream: bytes


def read_gif(data: bytes) -> tuple[int, int, list[Coded]]:
    """Screen width and height, and the frames in order; GifError for anything that is not a whole GIF."""
    try:
        return _read(data)
    except (struct.error, IndexError) as e:
        raise GifError("the file is cut off") from e


def _read(data: bytes) -> tuple[int, int, list[Coded]]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common, out = 13, None, []
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    delay, disposal, transparent = 0, 0, -1
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return width, height, out
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                transparent = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError("unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = common
        if local & 0x80:
            palette, at = _palette(data, at, local)
        if palette is None or left + w > width or top + h > height:
            raise GifError("a frame has no palette or leaves the screen")
        size = data[at]
        stream, at = _blocks(data, at + 1)
        out.append(Coded(left, top, w, h, palette, bool(local & 0x40), delay, disposal, transparent, size, stream))
        delay, disposal, transparent = 0, 0, -1


def compose(width: int, height: int, coded: list[Coded], decoded: list[bytes]) -> Iterator[Frame]:
    """The pictures shown: palettes, interlacing, transparent index, and disposal of the frame before (0 and 1 keep it,
    2 clears its rectangle, 3 restores what was there)."""
    canvas = np.zeros((height, width, 3), np.uint8)
    for f, got in zip(coded, decoded, strict=True):
        samples = np.frombuffer(got, np.uint8).reshape(f.height, f.width)
        if f.interlaced:
            order = np.concatenate([np.arange(a, f.height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven = np.empty_like(samples)
            woven[order] = samples
            samples = woven
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        before = area.copy() if f.disposal == 3 else None
        shown = f.palette[samples]
        area[:] = np.where((samples == f.transparent)[..., None], area, shown) if f.transparent >= 0 else shown
        yield Frame(canvas.copy(), samples, f.delay_ms, f.disposal)
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            area[:] = before


def decode_gif(data: bytes) -> list[Frame]:
    """The composed frames of a GIF in order."""
    return decode_gifs([data])[0]


def decode_gifs(files: list[bytes | None]) -> list[list[Frame] | GifError | None]:
    """The composed frames of each file; None for None, the error for what is not a whole GIF."""
    heads: list = []
    streams = []
    for data in files:
        try:
            heads.append(None if data is None else read_gif(data))
            streams += [] if data is None else [(f.stream, f.size, f.width * f.height) for f in heads[-1][2]]
        except GifError as e:
            heads.append(e)
    decoded = lzw_decode_many(streams)
    out, at = [], 0
    for head in heads:
        if head is None or isinstance(head, GifError):
            out.append(head)
            continue
        own = decoded[at : at + len(head[2])]
        at += len(own)
        out.append(next((x for x in own if isinstance(x, GifError)), None) or list(compose(*head, own)))
    return out


def write_gif(sides: list[tuple[int, int]], streams: list[bytes], palette: np.ndarray, delay_ms: int = 100, disposal: int = 1) -> bytes:
    """A GIF89a of frames given by (width, height) and code stream, at the screen's upper left corner."""
    out = [b"GIF89a", struct.pack("<HHBBB", max(w for w, _ in sides), max(h for _, h in sides), 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for (w, h), stream in zip(sides, streams, strict=True):
        out.append(struct.pack("<BBBBHBBBHHHHBB", 0x21, 0xF9, 4, disposal << 2, delay_ms // 10, 0, 0, 0x2C, 0, 0, w, h, 0, 8))
        for a in range(0, len(stream), 255):
            piece = stream[a : a + 255]
            out += (bytes([len(piece)]), piece)
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """GIFs whose samples are the payloads' bytes (each a positive multiple of FRAME_WIDTH) over a grey palette."""
    unit = FRAME_WIDTH * FRAME_ROWS
    frames = [p[a : a + unit] for p in payloads for a in range(0, len(p), unit)]
    streams, out, at = lzw_encode_many(frames), [], 0
    for p in payloads:
        n = -(-len(p) // unit)
        out.append(write_gif([(FRAME_WIDTH, len(f) // FRAME_WIDTH) for f in frames[at : at + n]], streams[at : at + n], GREYS))
        at += n
    return out


def pad(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def histogram(rgb: np.ndarray) -> list[int]:
    """Pixels by BINS equal ranges of each channel: red, then green, then blue."""
    levels = rgb.reshape(-1, 3) >> 5
    if (rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 0] == rgb[..., 2]).all():
        return np.bincount(levels[:, 0], minlength=BINS).tolist() * 3
    return np.concatenate([np.bincount(levels[:, c], minlength=BINS) for c in range(3)]).tolist()


def texts_to_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to 64, as a GIF. Null text is the empty text;
    a null id stays null; equal texts give equal bytes; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            ids, texts = part.column("doc_id"), part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(store_payloads([pad(t or b"") for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = "array<struct<frame_no:int,start_ms:bigint,delay_ms:int,width:int,height:int,disposal:int,samples:binary,colour_histogram:array<int>>>"
_FRAMES = pa.list_(pa.struct([("frame_no", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("samples", pa.binary()), ("colour_histogram", pa.list_(pa.int32()))]))


def frame_rows(frames: list[Frame] | GifError | None) -> list[dict] | None:
    if not isinstance(frames, list):
        return None
    clock, out = 0, []
    for n, f in enumerate(frames):
        out.append({"frame_no": n, "start_ms": clock, "delay_ms": f.delay_ms, "width": f.rgb.shape[1], "height": f.rgb.shape[0], "disposal": f.disposal, "samples": f.indices.tobytes(), "colour_histogram": histogram(f.rgb)})
        clock += f.delay_ms
    return out


def gif_frames(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with column frames, one entry for each composed frame in order: frame_no, start_ms, delay_ms, width, height,
    disposal, samples (palette indices as stored), colour_histogram (BINS counts for each of red, green and blue).
    Null media, or bytes that are not a whole GIF, give null frames. A column of df named frames is replaced."""
    kept = df.drop("frames")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"frames {FRAMES}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col, SLICE_BYTES):
            files = part.column(media_col).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([frame_rows(x) for x in decode_gifs(files)], _FRAMES)], names=[*part.schema.names, "frames"])

    return kept.mapInArrow(run, schema)


def gif_payloads(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what its GIFs hold: payload (all frames' samples in order), n_frames, duration_ms, colour_histogram (the
    composed frames' counts, summed). All four are null where media is null or not a whole GIF. Columns of df with these
    names are replaced."""
    kept = df.drop("payload", "n_frames", "duration_ms", "colour_histogram")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "payload binary, n_frames int, duration_ms bigint, colour_histogram array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col, SLICE_BYTES):
            payloads, counts, spans, colours = [], [], [], []
            for frames in decode_gifs(part.column(media_col).to_pylist()):
                fine = isinstance(frames, list)
                payloads.append(b"".join(f.indices.tobytes() for f in frames) if fine else None)
                counts.append(len(frames) if fine else None)
                spans.append(sum(f.delay_ms for f in frames) if fine else None)
                colours.append(np.sum([histogram(f.rgb) for f in frames], axis=0, dtype=np.int64).tolist() if fine and frames else [0] * (3 * BINS) if fine else None)
            new = [pa.array(payloads, pa.binary()), pa.array(counts, pa.int32()), pa.array(spans, pa.int64()), pa.array(colours, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "payload", "n_frames", "duration_ms", "colour_histogram"])

    return kept.mapInArrow(run, schema)
