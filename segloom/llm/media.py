"""Media columns: dimensions and DC-only luminance thumbnails of baseline JPEGs, decoded in Python and numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


class Damaged(ValueError):
    """What keeps an image from being read."""


@lru_cache(256)
def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits the code's length (0: none) and symbol."""
    size, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            low = code << (16 - n)
            size[low : low + (1 << (16 - n))], value[low : low + (1 << (16 - n))] = n, symbol
            code += 1
        at += count
        code <<= 1
    return size.tolist(), value.tolist()


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, payload, offset after it) up to and with the start of the first scan."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("not a JPEG")
    at = 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise Damaged("truncated")
        marker = data[at + 1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker == 0xD9:
            raise Damaged("no scan")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise Damaged("truncated")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def _split_scan(data: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, without stuffing."""
    parts, at, begin = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Damaged("truncated")
        follows = data[at + 1]
        if 0xD0 <= follows <= 0xD7:
            parts.append(data[begin:at])
            begin = at + 2
        elif follows not in (0x00, 0xFF):
            parts.append(data[begin:at])
            return [p.replace(b"\xff\x00", b"\xff") for p in parts]
        at += 1 if follows == 0xFF else 2


def thumbnail(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, luminance thumbnail of one byte for each 8 x 8 block) of a baseline JPEG."""
    quant: dict[int, int] = {}
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    frame, every, scan = None, 0, 0
    chosen: list[tuple[int, int, int]] = []
    for marker, body, after in segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = 2 if body[at] >> 4 else 1
                if at + 1 + 64 * wide > len(body):
                    raise Damaged("bad table")
                quant[body[at] & 15] = int.from_bytes(body[at + 1 : at + 1 + wide], "big")
                at += 1 + 64 * wide
        elif marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                tables[body[at] >> 4, body[at] & 15] = counts, body[at + 17 : at + 17 + n]
                at += 17 + n
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or not body[5] or len(body) < 6 + 3 * body[5]:
                raise Damaged("bad frame")
            if body[0] != 8:
                raise Damaged("unsupported precision")
            frame = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if not height or not width or not all(0 < h <= 4 and 0 < v <= 4 for _, h, v, _ in frame):
                raise Damaged("bad frame")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Damaged("not baseline")
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not body or len(body) < 1 + 2 * body[0]:
                raise Damaged("bad scan")
            chosen = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            scan = after
    if frame is None:
        raise Damaged("no frame")
    known = {c: (h, v, q) for c, h, v, q in frame}
    if not chosen or chosen[0][0] != frame[0][0] or any(c not in known for c, _, _ in chosen):
        raise Damaged("bad scan")
    most_h, most_v = max(h for _, h, _, _ in frame), max(v for _, _, v, _ in frame)
    own_h, own_v, own_q = known[frame[0][0]]
    if own_q not in quant:
        raise Damaged("bad table")
    # blocks of the luminance, and how the scan goes through them
    blocks_w, blocks_h = -(-width * own_h // (8 * most_h)), -(-height * own_v // (8 * most_v))
    if len(chosen) == 1:
        across, down, layout = blocks_w, blocks_h, [(1, 1)]
        own_h = own_v = 1
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        layout = [known[c][:2] for c, _, _ in chosen]
    try:
        coders = [(*_lookup(*tables[0, d]), *_lookup(*tables[1, a])) for _, d, a in chosen]
    except KeyError:
        raise Damaged("bad table") from None
    dc = _scan(_split_scan(data[scan:]), across * down, every, [h * v for h, v in layout], coders)
    grid = np.array(dc, np.int64).reshape(down, across, own_v, own_h).transpose(0, 2, 1, 3).reshape(down * own_v, across * own_h)
    grid = grid[:blocks_h, :blocks_w] * quant[own_q]
    return width, height, len(frame), np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _scan(parts: list[bytes], units: int, every: int, blocks: list[int], coders) -> list[int]:
    """Quantised DC of all blocks of the first component."""
    dc: list[int] = []
    done = 0
    for part in parts:
        if done >= units:
            break
        here = min(every or units, units - done)
        stream = int.from_bytes(part + b"\xff\xff\xff\xff", "big") if len(part) < 512 else None
        total = len(part) * 8
        last = [0] * len(blocks)
        at = 0

        def peek(at: int) -> int:
            if stream is not None:
                return stream >> max(0, total + 16 - at) & 0xFFFF
            byte = at >> 3
            return int.from_bytes(part[byte : byte + 3].ljust(3, b"\xff"), "big") >> (8 - (at & 7)) & 0xFFFF

        for _ in range(here):
            for c, n in enumerate(blocks):
                dc_size, dc_value, ac_size, ac_value = coders[c]
                for _ in range(n):
                    bits = peek(at)
                    if not dc_size[bits]:
                        raise Damaged("bad code")
                    at += dc_size[bits]
                    size = dc_value[bits]
                    if size:
                        if size > 15:
                            raise Damaged("bad code")
                        value = peek(at) >> (16 - size)
                        at += size
                        last[c] += value if value >> (size - 1) else value - (1 << size) + 1
                    if c == 0:
                        dc.append(last[0])
                    k = 1
                    while k < 64:
                        bits = peek(at)
                        if not ac_size[bits]:
                            raise Damaged("bad code")
                        symbol = ac_value[bits]
                        at += ac_size[bits] + (symbol & 15)
                        if not symbol & 15:
                            if symbol != 0xF0:
                                break
                            k += 16
                        else:
                            k += (symbol >> 4) + 1
                    if at > total:
                        raise Damaged("truncated")
        done += here
    if done < units:
        raise Damaged("truncated")
    return dc


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the cells of a grid; cells of a smaller image repeat its pixels."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.cumsum(0, dtype=np.int64).cumsum(1)
    y0, x0 = np.arange(height) * image.shape[0] // height, np.arange(width) * image.shape[1] // width
    y1 = np.maximum(y0 + 1, (np.arange(height) + 1) * image.shape[0] // height)
    x1 = np.maximum(x0 + 1, (np.arange(width) + 1) * image.shape[1] // width)
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return sums // ((y1 - y0)[:, None] * (x1 - x0))


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 grid is lighter than its right neighbour; near images differ in few."""
    small = resize(thumb, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big", signed=True)


def describe(data: bytes | None) -> dict:
    row = dict.fromkeys(("width", "height", "components", "thumb_width", "thumb_height", "thumb_hash", "thumb_digest", "mean"))
    row["n_bytes"] = None if data is None else len(data)
    if data is None:
        return row | {"status": "null"}
    try:
        width, height, components, thumb = thumbnail(data)
    except Damaged as why:
        return row | {"status": str(why)}
    return row | {
        "status": "ok", "width": width, "height": height, "components": components,
        "thumb_width": thumb.shape[1], "thumb_height": thumb.shape[0], "thumb_hash": difference_hash(thumb),
        "thumb_digest": hashlib.sha256(thumb.shape[1].to_bytes(4, "big") + thumb.tobytes()).hexdigest()[:32], "mean": float(thumb.mean()),
    }


_SCHEMA = pa.struct(
    [("status", pa.string()), ("n_bytes", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("thumb_width", pa.int32()),
     ("thumb_height", pa.int32()), ("thumb_hash", pa.int64()), ("thumb_digest", pa.string()), ("mean", pa.float64())]
)
_DDL = "struct<status string, n_bytes long, width int, height int, components int, thumb_width int, thumb_height int, thumb_hash long, thumb_digest string, mean double>"


def media_columns(images: DataFrame, key: str, column: str = "jpeg") -> DataFrame:
    """key, and for each row of images: status, n_bytes, width, height, components, thumbnail size, hashes and mean.

    status is "ok" or what is wrong: "null", "not a JPEG" (empty ones too), "truncated", "not baseline",
    "bad table" and so on; the other columns but n_bytes are then null. Images of several scans are read
    by their first, which has to hold the first component. Repeated rows and null keys are each described.
    Only the two columns named are read.
    """
    read = F.arrow_udf(lambda a: pa.array([describe(x) for x in a.to_pylist()], _SCHEMA), _DDL)
    return images.select(F.col(key), read(F.col(column)).alias("m")).select(key, "m.*")


# Encoding, for making test and demonstration images

_DC_COUNTS, _DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))


@lru_cache(1)
def _ac_table() -> tuple[bytes, bytes]:
    """A code of our own for runs and sizes: end of block in 2 bits, small sizes in few."""
    order = sorted((r << 4 | s for r in range(16) for s in range(1, 11)), key=lambda x: ((x >> 4) + 2 * (x & 15), x))
    symbols = [0x00, *order, 0xF0]
    counts, left, room = [0] * 16, len(symbols), 2
    for n in range(1, 17):
        room = 2 if n == 1 else room * 2
        take = 0 if n == 1 else min(left, max(1, room // 3) if n < 16 else left)
        counts[n - 1] = take
        left, room = left - take, room - take
    return bytes(counts), bytes(symbols)


@lru_cache(4)
def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    found, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            found[symbol] = code, n
            code += 1
        at += count
        code <<= 1
    return found


_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def encode(planes: list[np.ndarray], width: int, height: int, sampling: tuple[int, int] = (1, 1), step: int = 8, every: int = 0) -> bytes:
    """A baseline JPEG of luminance and perhaps two chroma planes, all given at full size; chroma is averaged down to sampling."""
    h, v = sampling if len(planes) > 1 else (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    blocks = []
    for c, plane in enumerate(planes):
        full = np.pad(plane[:height, :width].astype(float), ((0, down * 8 * v - height), (0, across * 8 * h - width)), mode="edge")
        if c:
            full = full.reshape(down * 8, v, across * 8, h).mean((1, 3))
        ch, cv = (h, v) if c == 0 else (1, 1)
        b = full.reshape(down, cv, 8, across, ch, 8).transpose(0, 3, 1, 4, 2, 5) - 128
        q = np.rint(_COS @ b @ _COS.T / step).astype(int).reshape(down * across, cv * ch, 64)[:, :, ZIGZAG]
        blocks.append(q)
    dc_code, ac_code = _codes(_DC_COUNTS, _DC), _codes(*_ac_table())
    parts, acc, n, last = [], 0, 0, [0] * len(planes)

    def put(code: int, size: int) -> None:
        nonlocal acc, n
        acc, n = acc << size | code, n + size

    def flush() -> None:
        nonlocal acc, n, last
        pad = -n % 8
        put((1 << pad) - 1, pad)
        parts.append(acc.to_bytes(n // 8, "big").replace(b"\xff", b"\xff\x00"))
        acc, n, last = 0, 0, [0] * len(planes)

    for unit in range(across * down):
        if every and unit and unit % every == 0:
            flush()
            parts.append(bytes([0xFF, 0xD0 + (unit // every - 1) % 8]))
        for c, q in enumerate(blocks):
            for block in q[unit]:
                value, last[c] = int(block[0]) - last[c], int(block[0])
                size = abs(value).bit_length()
                put(*dc_code[size])
                put(value if value > 0 else value + (1 << size) - 1, size)
                run = 0
                some = np.flatnonzero(block[1:]) + 1
                before = 0
                for k in some:
                    run, before = int(k) - before - 1, int(k)
                    while run > 15:
                        put(*ac_code[0xF0])
                        run -= 16
                    value = int(block[k])
                    size = abs(value).bit_length()
                    put(*ac_code[run << 4 | size])
                    put(value if value > 0 else value + (1 << size) - 1, size)
                if before < 63:
                    put(*ac_code[0])
    flush()
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    count = len(planes)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([count]) + b"".join(bytes([c + 1, (h << 4 | v) if c == 0 else 0x11, 0]) for c in range(count))
    head = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, bytes([0]) + bytes([step]) * 64) + segment(0xC0, frame)
    head += segment(0xC4, bytes([0x00]) + _DC_COUNTS + _DC) + segment(0xC4, bytes([0x10]) + b"".join(_ac_table()))
    head += segment(0xDD, every.to_bytes(2, "big")) if every else b""
    head += segment(0xDA, bytes([count]) + b"".join(bytes([c + 1, 0]) for c in range(count)) + bytes([0, 63, 0]))
    return b"\xff\xd8" + head + b"".join(parts) + b"\xff\xd9"


def render(vector: np.ndarray, label: int) -> bytes:
    """A picture of a vector: each value a cell's light, with a slope inside; size, colours and restarts vary with label."""
    side = int(np.ceil(np.sqrt(max(len(vector), 1))))
    cells = np.zeros(side * side)
    cells[: len(vector)] = np.nan_to_num(np.asarray(vector, float))
    light = np.clip(128 + 200 * cells, 8, 240).reshape(side, side)
    plane = np.kron(light, np.ones((8, 8))) + np.tile(np.linspace(-6, 6, 8), side)
    height, width = max(1, side * 8 - label % 5), max(1, side * 8 - label % 3)
    planes = [plane] if label % 3 == 0 else [plane, np.kron(light.T, np.ones((8, 8))), 255 - plane]
    return encode(planes, width, height, (2, 2) if label % 3 == 2 else (1, 1), every=4 if label % 2 else 0)


def with_pictures(vectors: DataFrame) -> DataFrame:
    """(vec_id, jpeg) of (vec_id, embedding, label); a null embedding has a null picture, a null label counts as 0."""
    draw = F.arrow_udf(
        lambda e, k: pa.array([None if v is None else render(np.array([x or 0.0 for x in v]), abs(n or 0)) for v, n in zip(e.to_pylist(), k.to_pylist())], pa.binary()), "binary"
    )
    return vectors.select("vec_id", draw(F.col("embedding"), F.col("label")).alias("jpeg"))
