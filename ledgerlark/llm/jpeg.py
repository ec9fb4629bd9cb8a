"""Baseline JPEG in numpy: a lossless carrier for bytes and a decoder for DC-only luminance thumbnails.

The carrier writes each payload byte as one quantized coefficient of a grey image (the unit that the format keeps
without loss), never zero, so that every block has 64 coded coefficients. Restart intervals make the entropy-coded data
independent; intervals of many images are coded and decoded side by side, one symbol of each at a step.

The decoder reads any baseline image (any tables, sampling, components and restart interval).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: Blocks in a restart interval, and intervals that are coded side by side (which bounds memory).
INTERVAL = 4
TOGETHER = 8192
#: The payload byte with the smallest coefficients near it: text lies around it.
CENTRE = 104
#: Huffman code lengths by symbol: sizes 0 to 11 for DC; end of block, run of 16 zeros and (no run, size 1 to 10) for AC.
DC_LENGTHS = {0: 3, 1: 4, 2: 3, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9}
AC_LENGTHS = {1: 3, 2: 3, 3: 2, 4: 2, 5: 4, 6: 4, 7: 5, 8: 6, 0x00: 7, 9: 8, 10: 9, 0xF0: 10}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, before = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - before
        out[symbol] = (code, length)
        code, before = code + 1, length
    return out


def _table(lengths: dict[int, int]) -> bytes:
    """Counts by length and symbols, as a DHT segment has them."""
    order = sorted((n, s) for s, n in lengths.items())
    return bytes(sum(n == k for n, _ in order) for k in range(1, 17)) + bytes(s for _, s in order)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _coded(lengths: dict[int, int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for every value of low..high: the code of its size, then the value itself."""
    codes, bits, many = _codes(lengths), [], []
    for v in range(low, high + 1):
        size = abs(v).bit_length()
        code, n = codes[size]
        bits.append(code << size | (v if v >= 0 else v + (1 << size) - 1))
        many.append(n + size)
    return np.array(bits, np.uint32), np.array(many, np.uint8)


_BYTE = np.arange(256) - CENTRE
_VALUE = np.where(_BYTE >= 0, _BYTE + 1, _BYTE).astype(np.int16)  # never zero
_FROM = np.zeros(512, np.uint8)
_FROM[_VALUE.astype(int) + 256] = np.arange(256)
_LOW, _HIGH = -400, 400
_DC_BITS, _DC_MANY = _coded(DC_LENGTHS, _LOW, _HIGH)
_AC_BITS, _AC_MANY = _coded(AC_LENGTHS, _LOW, _HIGH)


def grid(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of an image that holds so many blocks, about square."""
    width = max(1, int(np.ceil(np.sqrt(blocks))))
    return width, -(-blocks // width)


def _entropy(blocks: np.ndarray) -> list[bytes]:
    """Coded and stuffed restart intervals of whole intervals' blocks: (intervals, INTERVAL, 64) values; value 0 in front: no block."""
    n = len(blocks)
    there = blocks[:, :, 0] != 0
    dc = blocks[:, :, 0].astype(np.int32)
    diff = dc.copy()
    diff[:, 1:] -= dc[:, :-1]
    bits, many = _AC_BITS[blocks.astype(np.int32) - _LOW], _AC_MANY[blocks.astype(np.int32) - _LOW]
    bits[:, :, 0], many[:, :, 0] = _DC_BITS[np.clip(diff, _LOW, _HIGH) - _LOW], _DC_MANY[np.clip(diff, _LOW, _HIGH) - _LOW]
    many[~there] = 0
    bits, many = bits.reshape(n, -1), many.reshape(n, -1)
    pad = (-many.sum(1, dtype=np.int64) % 8).astype(np.uint8)
    bits = np.concatenate([bits, ((1 << pad.astype(np.uint32)) - 1)[:, None].astype(np.uint32)], 1).ravel()
    many = np.concatenate([many, pad[:, None]], 1)
    sizes = many.sum(1, dtype=np.int64) // 8
    many = many.ravel()
    ends = np.repeat(np.cumsum(many, dtype=np.int64), many)
    spread = np.repeat(bits, many) >> (ends - 1 - np.arange(len(ends))).astype(np.uint32)
    raw = np.packbits((spread & 1).astype(np.uint8)).tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(at, at[1:], strict=False)]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG of each payload; the payload's length stands in a comment."""
    rows, owners = [], []
    for i, payload in enumerate(payloads):
        width, height = grid(max(1, -(-len(payload) // BLOCK)))
        if 8 * max(width, height) > 65_535:
            raise ValueError("the payload is too long for one image")
        values = _VALUE[np.frombuffer(payload.ljust(width * height * BLOCK, b" "), np.uint8)].reshape(-1, BLOCK)
        short = -len(values) % INTERVAL
        if short:
            values = np.concatenate([values, np.zeros((short, BLOCK), np.int16)])
        rows.append(values.reshape(-1, INTERVAL, BLOCK))
        owners.append((width, height, len(rows[-1])))
    everything = np.concatenate(rows) if rows else np.zeros((0, INTERVAL, BLOCK), np.int16)
    coded: list[bytes] = []
    for at in range(0, len(everything), TOGETHER):
        coded += _entropy(everything[at : at + TOGETHER])
    out, at = [], 0
    for payload, (width, height, n) in zip(payloads, owners, strict=True):
        parts = coded[at : at + n]
        at += n
        scan = [parts[0]]
        for k, part in enumerate(parts[1:]):
            scan += [bytes([0xFF, 0xD0 + k % 8]), part]
        head = [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xFE, b"payload %d" % len(payload)),
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, b"\x08" + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + b"\1\1\x11\0"),
            _segment(0xC4, b"\x00" + _table(DC_LENGTHS) + b"\x10" + _table(AC_LENGTHS)),
            _segment(0xDD, INTERVAL.to_bytes(2, "big")),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
        out.append(b"".join(head + scan + [b"\xff\xd9"]))
    return out


@dataclass
class Image:
    """A parsed image: what its markers say, and its restart intervals without stuffing."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, int] = field(default_factory=dict)  # the DC step of each table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quant table
    huffman: dict[int, bytes] = field(default_factory=dict)  # class and id -> counts and symbols
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's index, DC table, AC table
    parts: list[bytes] = field(default_factory=list)


def parse(media: bytes) -> Image:
    """Read the markers of a baseline image with one interleaved scan."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide, table = body[0] >> 4, body[0] & 15
                image.quant[table] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("only 8 bits a sample are baseline")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            index = {c[0]: i for i, c in enumerate(image.components)}
            image.scan = [(index[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    end = media.rfind(b"\xff\xd9")
    image.parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", media[at : end if end >= at else len(media)])]
    return image


def _lookup(table: bytes) -> np.ndarray:
    """For every 16 bits: length of the code they begin with, times 256, and its symbol; 0 where there is none."""
    out, code, symbols = np.zeros(1 << 16, np.uint16), 0, iter(table[16:])
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | next(symbols)
            code += 1
        code <<= 1
    return out


def _decode_lanes(parts: list[bytes], blocks: np.ndarray, tables: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """Coefficients (lane, block, 64), in zigzag order, DC as differences.

    parts: the bits of each lane; blocks: its number of blocks; tables: look-ups; plan: (DC, AC) tables of each block of an MCU.
    """
    starts = np.concatenate([[0], np.cumsum([len(p) + 8 for p in parts])])[:-1]
    raw = np.frombuffer(b"".join([p + b"\xff" * 8 for p in parts]), np.uint8).astype(np.uint64)
    window = np.zeros(len(raw), np.uint64)  # 40 bits from each byte on
    for k in range(5):
        window[: len(raw) - k] |= raw[k:] << np.uint64(32 - 8 * k)
    limit = (starts + np.array([len(p) + 2 for p in parts])) * 8
    out = np.zeros((len(parts), max(1, int(blocks.max(initial=0))), BLOCK), np.int16)
    lane = np.flatnonzero(blocks > 0)
    at, block, k = starts[lane] * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    flat, wide = tables.ravel(), out.shape[1] * BLOCK
    target = out.reshape(-1)
    while len(lane):
        bits = window[at >> 3] << (at & 7).astype(np.uint64) & np.uint64((1 << 40) - 1)
        which = plan[block % len(plan), (k > 0).astype(np.int64)]
        found = flat[(which << 16) + (bits >> np.uint64(24)).astype(np.int64)].astype(np.int64)
        length, symbol = found >> 8, found & 255
        size, run = symbol & 15, np.where(k > 0, symbol >> 4, 0)
        if not length.all() or (at > limit[lane]).any():
            raise ValueError("broken entropy-coded data")
        value = (bits >> (40 - length - size).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        at = at + length + size
        k = k + run
        put = (size > 0) & (k < BLOCK)
        target[(lane * wide + block * BLOCK + k)[put]] = value[put]
        k = np.where((k - run > 0) & (symbol == 0), BLOCK, k + 1)
        over = k >= BLOCK
        block = block + over
        k = np.where(over, 0, k)
        going = block < blocks[lane]
        if not going.all():
            lane, at, block, k = lane[going], at[going], block[going], k[going]
    return out


@dataclass
class Decoded:
    width: int
    height: int
    thumbnail: np.ndarray  # luminance, one pixel a block
    coefficients: np.ndarray  # of the first component: (block, 64), zigzag order, in the order of coding
    comment: bytes


def decode_many(media: list[bytes]) -> list[Decoded]:
    """Decode images; those with equal tables and sampling share their steps."""
    images = [parse(m) for m in media]
    alike: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        alike.setdefault((tuple(sorted(x.huffman.items())), tuple(x.components), tuple(x.scan)), []).append(i)
    out: list[Decoded | None] = [None] * len(images)
    for (huffman, components, scan), members in alike.items():
        names = {name: n for n, (name, _) in enumerate(huffman)}
        tables = np.stack([_lookup(t) for _, t in huffman])
        plan, owner = [], []
        for c, dc, ac in scan:
            many = components[c][1] * components[c][2] if len(scan) > 1 else 1
            plan += [(names[dc], names[0x10 | ac])] * many
            owner += [c] * many
        lanes: list[bytes] = []
        counts: list[int] = []
        shapes = []
        for i in members:
            x = images[i]
            most = (max(c[1] for c in components), max(c[2] for c in components)) if len(scan) > 1 else (1, 1)
            across, down = -(-x.width // (8 * most[0])), -(-x.height // (8 * most[1]))
            mcus = across * down
            step = x.interval or mcus
            expected = -(-mcus // step)
            if len(x.parts) < expected:
                raise ValueError("restart intervals are missing")
            lanes += x.parts[:expected]
            counts += [min(step, mcus - k * step) * len(plan) for k in range(expected)]
            shapes.append((i, across, down, expected))
        blocks, first = np.array(counts, np.int64), 0
        picks = np.array([n for n, c in enumerate(owner) if c == scan[0][0]])
        firsts: list[np.ndarray] = []
        for at in range(0, len(lanes), TOGETHER):
            found = _decode_lanes(lanes[at : at + TOGETHER], blocks[at : at + TOGETHER], tables, np.array(plan))
            found = found.reshape(len(found), -1, len(plan), BLOCK)[:, :, picks].reshape(len(found), -1, BLOCK)
            found[:, :, 0] = np.cumsum(found[:, :, 0], 1, dtype=np.int16)
            own = blocks[at : at + TOGETHER] // len(plan) * len(picks)
            firsts += [row[:n] for row, n in zip(found, own.tolist(), strict=True)]
        for i, across, down, expected in shapes:
            x = images[i]
            coefficients = np.concatenate(firsts[first : first + expected])
            first += expected
            c = components[scan[0][0]]
            h, v = (c[1], c[2]) if len(scan) > 1 else (1, 1)
            light = np.clip(coefficients[:, 0].astype(np.int32) * x.quant.get(c[3], 1) // 8 + 128, 0, 255).astype(np.uint8)
            light = light.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            out[i] = Decoded(x.width, x.height, light, coefficients, x.comment)
    return out


def payload_of(image: Decoded) -> bytes:
    """The payload of an image that encode_many() wrote."""
    if not image.comment.startswith(b"payload "):
        raise ValueError("the image carries no payload")
    return _FROM[image.coefficients.astype(np.int32) + 256].tobytes()[: int(image.comment[8:])]


def thumbnail_hash(light: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail: whether each of 8 x 8 sampled pixels is lighter than the next to its right."""
    rows = np.arange(8) * light.shape[0] // 8
    columns = np.arange(9) * light.shape[1] // 9
    small = light[np.ix_(rows, columns)]
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()
