"""Media columns: baseline JPEG with a decoder of DC-only luminance thumbnails.

The decoder parses markers, Huffman-decodes baseline scans and keeps the DC coefficient of every luminance block:
an image of one pixel per 8x8 block.  Restart intervals are independent, so all intervals of a batch of images are
decoded in lockstep with numpy, one block of each interval at a time.

Text is stored as grey JPEG whose blocks are flat: block value = payload byte, DC quantiser 8, so that the DC
difference of a block is the difference of two bytes and the thumbnail is the payload, without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

#: Payload bytes come in multiples of this: one row group of 24 x 24 blocks.
UNIT = 576
WIDTH = 24
#: A frame's height has 16 bits: at most 8191 rows of blocks, rounded down to whole units.
FRAME = 8184 * WIDTH
#: Bytes that are coded or decoded at once; either takes some hundred times as much memory.
GROUP = 1 << 20

#: The standard's luminance DC code lengths; the AC table holds only end-of-block, one bit.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
AC_BITS = bytes([1] + [0] * 15)
AC_VALUES = bytes([0])


class JpegError(ValueError):
    """Not a baseline JPEG that this decoder reads."""


def _codes(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(code, length, value) in the canonical order."""
    out, code, at = [], 0, 0
    for length, count in enumerate(bits, 1):
        for value in values[at : at + count]:
            out.append((code, length, value))
            code += 1
        at += count
        code <<= 1
    return out


def _lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For every 16-bit prefix: length << 8 | value; 0 where no code begins so."""
    table = np.zeros(1 << 16, dtype=np.int32)
    for code, length, value in _codes(bits, values):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return table


# ---- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quantiser = bytes([8]) + bytes([1]) * 63
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, b"\0" + quantiser),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_BITS + DC_VALUES),
        _segment(0xC4, b"\x10" + AC_BITS + AC_VALUES),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _emitted() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference d, at d + 255: the bits of its code, its amplitude and end-of-block; their number."""
    code = {value: (bits, length) for bits, length, value in _codes(DC_BITS, DC_VALUES)}
    word, size = np.zeros(511, dtype=np.uint64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        bits, length = code[k]
        word[d + 255] = ((bits << k) | (d if d >= 0 else d + (1 << k) - 1)) << 1
        size[d + 255] = length + k + 1
    return word, size


_WORD, _SIZE = _emitted()


def _scans(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each restart interval of WIDTH samples, stuffed and padded with ones."""
    samples = payload.reshape(-1, WIDTH).astype(np.int64) - 128
    d = np.diff(samples, axis=1, prepend=0) + 255
    size = _SIZE[d]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    at = base[:, None] * 8 + ends - size
    shifted = _WORD[d] << (np.uint64(32) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
    first = at >> 3
    total = int(n_bytes.sum())
    out = np.zeros(total + 4, dtype=np.float64)
    for lane in range(4):  # the bits of one byte come from different samples, so sums are unions
        out += np.bincount((first + lane).ravel(), weights=(shifted >> np.uint64(24 - 8 * lane) & np.uint64(255)).ravel(), minlength=total + 4)[: total + 4]
    data = out[:total].astype(np.uint8)
    spare = n_bytes * 8 - ends[:, -1]
    data[base + n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(base.tolist(), (base + n_bytes).tolist())]


def _frame(intervals: list[bytes]) -> bytes:
    parts = [_header(len(intervals))]
    last = len(intervals) - 1
    for k, data in enumerate(intervals):
        parts.append(data)
        if k < last:
            parts.append(b"\xff" + bytes([0xD0 + (k & 7)]))
    parts.append(b"\xff\xd9")
    return b"".join(parts)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as one JPEG, or as several in a row beyond FRAME bytes."""
    parts = [(k, payload[at : at + FRAME]) for k, payload in enumerate(payloads) for at in range(0, len(payload), FRAME)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for group in _groups(parts, lambda part: len(part[1])):
        scans = _scans(np.frombuffer(b"".join(part for _, part in group), dtype=np.uint8))
        at = 0
        for k, part in group:
            rows = len(part) // WIDTH
            out[k].append(_frame(scans[at : at + rows]))
            at += rows
    return [b"".join(frames) for frames in out]


def _groups(items: list, size: Callable[[object], int]) -> Iterator[list]:
    """Neighbouring items, so many that they take about GROUP bytes; one at least."""
    group, held = [], 0
    for item in items:
        if group and held + size(item) > GROUP:
            yield group
            group, held = [], 0
        group.append(item)
        held += size(item)
    if group:
        yield group


def padded(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))


# ---- decoding


class _Image:
    """One parsed frame: what its scan needs, and where the scan's restart intervals lie."""

    __slots__ = ("blocks_h", "blocks_w", "height", "intervals", "key", "layout", "order", "quantiser", "restart", "tables", "width")


def _parse(data: bytes, at: int = 0) -> tuple[_Image, int]:
    """The frame at ``at`` and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    image, quantisers, tables, parts = _Image(), {}, {}, []
    image.restart, at = 0, at + 2
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quantisers[number] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("samples are not of 8 bits")
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError("not baseline")
        elif marker == 0xDD:
            (image.restart,) = struct.unpack(">H", body[:2])
        elif marker == 0xDA:
            break
    if not parts or body[0] != len(parts):
        raise JpegError("one interleaved scan of all components is expected")
    used = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    single = len(parts) == 1
    layout, order = [], []
    for k, (ident, h, v, _) in enumerate(parts):
        h, v = (1, 1) if single else (h, v)
        layout.append((h, v))
        order += [(k, used[ident] >> 4, used[ident] & 15)] * (h * v)
    top_h, top_v = max(h for h, _ in layout), max(v for _, v in layout)
    image.blocks_w, image.blocks_h = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
    image.layout, image.order, image.quantiser, image.tables = layout, order, quantisers[parts[0][3]], tables
    image.key = (tuple(order), tuple(sorted((k, v) for k, v in tables.items())))
    image.intervals, at = _intervals(data, at)
    return image, at


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    close = data.find(b"\xff\xd9", at)  # the end of the image, if nothing else ends the scan before
    raw = np.frombuffer(data[at : close + 2] if close >= 0 else data[at:], dtype=np.uint8)
    mark = np.flatnonzero(raw[:-1] == 0xFF)
    kind = raw[mark + 1]
    stop = np.flatnonzero((kind != 0) & ((kind < 0xD0) | (kind > 0xD7)) & (kind != 0xFF))
    if not len(stop):
        raise JpegError("the scan does not end")
    end = int(mark[stop[0]])
    cuts = mark[: stop[0]][(kind[: stop[0]] >= 0xD0) & (kind[: stop[0]] <= 0xD7)]
    edges = [0, *(cuts + 2).tolist()], [*cuts.tolist(), end]
    out = [data[at + a : at + b].replace(b"\xff\x00", b"\xff") for a, b in zip(*edges)]
    return out, at + end + 2


def _decode_group(images: list[_Image]) -> list[np.ndarray]:
    """DC values (not dequantised) in scan order, of images with the same tables; intervals move in lockstep."""
    order, tables = images[0].order, images[0].tables
    look = {k: _lookup(*tables[k]) for k in {d for _, d, _ in order} | {16 + a for _, _, a in order}}
    lanes = [x for image in images for x in image.intervals]
    mcus = []
    for image in images:
        total = image.blocks_w * image.blocks_h
        step = image.restart or total
        mcus += [min(step, total - k * step) for k in range(len(image.intervals))]
    left = np.array(mcus)
    data = np.frombuffer(b"".join(x + b"\0\0\0\0\0\0\0\0" for x in lanes), dtype=np.uint8)
    length = np.array([len(x) + 8 for x in lanes])
    limit = (np.cumsum(length) - 8) * 8
    at = (np.cumsum(length) - length) * 8
    wide = data.astype(np.int64)
    wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    n_comp = 1 + max(k for k, _, _ in order)
    keep = sum(1 for k, _, _ in order if k == 0)
    steps = int(left.max(initial=0))
    out = np.zeros((len(lanes), steps * keep), dtype=np.int16)
    last = np.zeros((n_comp, len(lanes)), dtype=np.int64)

    def peek(at):  # 25 bits are valid
        return (wide[at >> 3] << (at & 7)) & 0xFFFFFFFF

    uniform = bool(len(left)) and int(left.min()) == steps
    for step in range(steps):
        live = slice(None) if uniform else np.flatnonzero(left > step)
        slot = 0
        for comp, dc, ac in order:
            own = at[live]
            bits = peek(own)
            code = look[dc][bits >> 16]
            used, size = code >> 8, code & 255
            if not used.all() or size.max(initial=0) > 11:
                raise JpegError("bad code")
            value = (bits >> (32 - used - size)) & ((1 << size) - 1) if used.max() + size.max() <= 25 else (peek(own + used) >> (32 - size)) & ((1 << size) - 1)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            last[comp, live] += value
            if comp == 0:
                out[live, step * keep + slot] = last[0, live]
                slot += 1
            own = own + used + size
            place = np.zeros(len(own), dtype=np.int64)
            todo = None
            while True:  # skip AC coefficients
                here = own if todo is None else own[todo]
                code = look[16 + ac][peek(here) >> 16]
                used, run, size = code >> 8, code >> 4 & 15, code & 15
                if not used.all():
                    raise JpegError("bad code")
                stop = (size == 0) & (run != 15)
                if todo is None:
                    own = own + used + size
                    if stop.all():
                        break
                    place = np.where(stop, 63, run + 1)
                    todo = np.flatnonzero(place < 63)
                else:
                    own[todo] += used + size
                    place[todo] = np.where(stop, 63, place[todo] + run + 1)
                    todo = todo[place[todo] < 63]
                if not len(todo):
                    break
            at[live] = own
    if (at > limit).any():
        raise JpegError("the scan is too short")
    result, lane = [], 0
    for image in images:
        n = len(image.intervals)
        flat = out[lane : lane + n]
        counts = left[lane : lane + n] * keep
        result.append(flat.ravel() if (counts == flat.shape[1]).all() else np.concatenate([row[:k] for row, k in zip(flat, counts)]))
        lane += n
    return result


def thumbnails(blobs: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each blob its frames: width, height and the luminance thumbnail, one grey byte per 8x8 block."""
    frames: list[list[_Image]] = []
    for blob in blobs:
        own, at = [], 0
        while at < len(blob):
            image, at = _parse(blob, at)
            own.append(image)
        frames.append(own)
    groups: dict = {}
    for own in frames:
        for image in own:
            groups.setdefault(image.key, []).append(image)
    done = {}
    for images in groups.values():
        for some in _groups(images, lambda image: sum(map(len, image.intervals))):
            done |= {id(i): v for i, v in zip(some, _decode_group(some))}
    return [[(i.width, i.height, _grey(i, done[id(i)])) for i in own] for own in frames]


def _grey(image: _Image, dc: np.ndarray) -> np.ndarray:
    h, v = image.layout[0]
    grid = dc.reshape(image.blocks_h, image.blocks_w, v, h).swapaxes(1, 2).reshape(image.blocks_h * v, image.blocks_w * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)].astype(np.int32)
    return np.clip((grid * image.quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(grey: np.ndarray) -> str:
    """64 bits, 16 hex digits: cells of an 8x8 grid that are brighter than the thumbnail's mean."""
    cells = [[grey[r0:r1, c0:c1].mean() for c0, c1 in _cells(grey.shape[1])] for r0, r1 in _cells(grey.shape[0])]
    bits = (np.array(cells) > grey.mean()).ravel()
    return np.packbits(bits).tobytes().hex()


def _cells(n: int) -> list[tuple[int, int]]:
    return [(k * n // 8, max((k + 1) * n // 8, k * n // 8 + 1)) if n >= 8 else (min(k, n - 1), min(k, n - 1) + 1) for k in range(8)]


# ---- columns


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.chunks(batches, "text", 1 << 20):
        texts = c.text_bytes(batch.column("text"))
        media = encode([padded(x) for x in texts])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_text(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as lossless grey JPEG.  Null and empty texts are one unit of 255s; an
    empty table gives an empty result.

    Texts beyond FRAME bytes become several frames in a row, which are coded and decoded a bounded number at a time.  Repeated rows and null ids are kept as they are; other
    columns are not used.
    """
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.chunks(batches, "media", 2 << 20):
        media = batch.column("media").to_pylist()
        rows = []
        for blob, own in zip(media, thumbnails(media)):
            payload = b"".join(grey.tobytes() for _, _, grey in own)
            width, height = own[0][0], sum(h for _, h, _ in own)
            grey = own[0][2] if len(own) == 1 else np.vstack([g for _, _, g in own])
            rows.append((payload, width, height, average_hash(grey), blob))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(p) for p, *_ in rows], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p, *_ in rows], pa.string()),
                pa.array([zlib.crc32(p[-32:]) for p, *_ in rows], pa.int64()),
                pa.array([len(b) for *_, b in rows], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for *_, b in rows], pa.string()),
                pa.array([f"{w}x{h}:{x}" for _, w, h, x, _ in rows], pa.string()),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_features(media: DataFrame) -> DataFrame:
    """Read every stored blob back: digests of payload and blob, dimensions and thumbnail hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_features, schema)
