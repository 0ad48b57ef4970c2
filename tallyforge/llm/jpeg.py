"""Progressive JPEG: scans accumulated into coefficient arrays, inverse transform in numpy, chroma upsampled, RGB tensors.

``decode`` reads any Huffman-coded baseline or progressive file of one or three 8-bit components: spectral selection and
successive approximation, first and refining scans, interleaved or not, restart intervals, end-of-band runs. Scans whose
Huffman table holds one code only, so that every symbol is forced, are read as arrays of bits at once; any other
goes symbol by symbol.

``store`` keeps a byte payload losslessly in a file's own units, quantised coefficients: each 64 payload bytes are one
8 x 8 block. A byte b is an AC coefficient of magnitude category 8 (b itself from 128 on, else b - 255) or a DC
coefficient of category 7 with one refining bit, so every scan has one code. Six blocks make a unit of 16 x 16 pixels with
4:2:0 chroma (four luma, Cb, Cr). Scans: DC without the low bit, AC 1-5 and AC 6-63 without the low bit, then the low bits.
A comment segment holds the payload's length. ``restore`` gives the payload back from the coefficients alone.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Order of coefficients in a block, from low to high frequency: by anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_RUN0 = 0x00
UNIT = 6


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    blocks_wide: int = 0  # with the padding of whole units
    blocks_high: int = 0
    own_wide: int = 0  # blocks that a scan of this component alone covers
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    progressive: bool = False
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class _Table:
    """A Huffman table: (length, code) to symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bit(self) -> int:
        if not self.n:
            self.held, self.n = (self.data[self.at] if self.at < len(self.data) else 0), 8
            self.at += 1
        self.n -= 1
        return self.held >> self.n & 1

    def bits(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def symbol(self, table: _Table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (s := table.codes.get((n, code))) is not None:
                return s
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        x = self.bits(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _scan_end(data: bytes, at: int) -> int:
    """Where the entropy-coded bytes from ``at`` end: at a marker other than a restart."""
    found = _NEXT.search(data, at)
    return found.start() if found else len(data)


def _segments(raw: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, unstuffed."""
    out, start, at = [], 0, 0
    while (at := raw.find(b"\xff", at)) >= 0:
        if at + 1 < len(raw) and 0xD0 <= raw[at + 1] <= 0xD7:
            out.append(raw[start:at])
            start = at + 2
        at += 2
    out.append(raw[start:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _forced(image: Image, comps: list[tuple[Component, int, int]], ss: int, se: int, ah: int, al: int, raw: bytes, restart: int, tables: dict) -> bool:
    """Reads a scan of one component whose symbols are all forced; False where it isn't of that kind."""
    if len(comps) != 1:
        return False
    comp, dc, ac = comps[0]
    if (comp.own_wide, comp.own_high) != (comp.blocks_wide, comp.blocks_high):
        return False
    blocks = comp.coefficients.reshape(-1, 64)
    n = len(blocks)
    if ss == 0 and se == 0 and ah and not restart:  # one bit for each block
        bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8))
        if len(bits) < n:
            return False
        blocks[:, 0] |= bits[:n].astype(np.int32) << al
        return True
    if ss == 0 and se == 0 and not ah and restart == 1:  # code, then 7 bits: a byte for each block, set apart by restarts
        if tables.get((0, dc)) is None or tables[0, dc].only != 7 or len(raw) != 3 * n - 2:
            return False
        data = np.frombuffer(raw + b"\xff\xd0", np.uint8).reshape(n, 3)
        if (data[:, 1] != 255).any() or (data[:, 2] & 0xF8 != 0xD0).any() or (data[:, 0] > 127).any():
            return False
        x = data[:, 0].astype(np.int32)
        blocks[:, 0] = np.where(x >= 64, x, x - 127) << al
        return True
    if ss and not restart and tables.get((1, ac)) is not None:
        only = tables[1, ac].only
        if not ah and only is not None and only >> 4 == 0 and only & 15:  # run 0, so every coefficient of the band: code and ``only`` bits
            size, width = only & 15, se - ss + 1
            data = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)
            if size == 7:
                if len(data) != n * width:
                    return False
                x = data.reshape(n, width).astype(np.int32)
            else:
                bits = np.unpackbits(data)[: n * width * (size + 1)].reshape(n, width, size + 1)
                x = bits[:, :, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
            blocks[:, ss : se + 1] = np.where(x >> (size - 1), x, x - (1 << size) + 1) * (1 << al)
            return True
        band = blocks[:, ss : se + 1]
        if ah and only == _RUN0 and (band != 0).all():  # end of band at once: code, then a bit for each coefficient
            width = se - ss + 2
            bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8))
            if len(bits) < n * width:
                return False
            bits = bits[: n * width].reshape(n, width)[:, 1:].astype(np.int32)
            band += np.where(band > 0, 1, -1) * (bits << al)
            return True
    return False


def _scan(image: Image, comps: list[tuple[Component, int, int]], ss: int, se: int, ah: int, al: int, raw: bytes, restart: int, tables: dict) -> None:
    if _forced(image, comps, ss, se, ah, al, raw, restart, tables):
        return
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(comps) == 1:
        c = comps[0][0]
        units = [[(0, y * c.blocks_wide + x)] for y in range(c.own_high) for x in range(c.own_wide)]
    else:
        across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        units = [[(k, (my * c.v + y) * c.blocks_wide + mx * c.h + x) for k, (c, _, _) in enumerate(comps) for y in range(c.v) for x in range(c.h)] for my in range(down) for mx in range(across)]
    parts = iter(_segments(raw))
    bits, predicted, run = None, [0] * len(comps), 0
    for i, unit in enumerate(units):
        if bits is None or restart and i % restart == 0:
            bits, predicted, run = _Bits(next(parts)), [0] * len(comps), 0
        for k, index in unit:
            comp, dc, ac = comps[k]
            block = comp.coefficients.reshape(-1, 64)[index]
            at = ss
            if ss == 0:
                if ah:
                    block[0] |= bits.bit() << al
                else:
                    predicted[k] += bits.signed(bits.symbol(tables[0, dc]))
                    block[0] = predicted[k] << al
                at = 1
            if se == 0 or at > se:
                continue
            if ah:
                run = _refine(block, bits, at, se, al, tables[1, ac], run)
                continue
            if run:
                run -= 1
                continue
            while at <= se:
                s = bits.symbol(tables[1, ac])
                r, n = s >> 4, s & 15
                if n:
                    at += r
                    block[at] = bits.signed(n) * (1 << al)
                    at += 1
                elif r == 15:
                    at += 16
                else:
                    run = (1 << r) + bits.bits(r) - 1
                    break


def _refine(block: np.ndarray, bits: _Bits, at: int, se: int, al: int, table: _Table, run: int) -> int:
    one = 1 << al

    def correct(k: int) -> None:
        if bits.bit():
            block[k] += one if block[k] > 0 else -one

    if not run:
        while at <= se:
            s = bits.symbol(table)
            r, n = s >> 4, s & 15
            new = 0
            if n:
                new = one if bits.bit() else -one
            elif r < 15:
                run = (1 << r) + bits.bits(r)
                break
            while at <= se:
                if block[at]:
                    correct(at)
                elif r:
                    r -= 1
                else:
                    break
                at += 1
            if new and at <= se:
                block[at] = new
            at += 1
    if run:
        for k in range(at, se + 1):
            if block[k]:
                correct(k)
        run -= 1
    return run


def coefficients(data: bytes) -> Image:
    """An image with each component's quantised coefficients (blocks, 64) in zigzag order, all scans accumulated."""
    image, tables, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1, 0xC2):
            image.progressive = marker == 0xC2
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.blocks_wide, c.blocks_high = -(-image.width // (8 * h)) * c.h, -(-image.height // (8 * v)) * c.v
                c.own_wide, c.own_high = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
                c.coefficients = np.zeros((c.blocks_wide * c.blocks_high, 64), np.int32)
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            n = body[0]
            by = {c.ident: c for c in image.components}
            comps = [(by[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            end = _scan_end(data, at)
            _scan(image, comps, ss, se, a >> 4, a & 15, data[at:end], restart, tables)
            at = end
            if data[at + 1 : at + 2] == b"\xd9":
                break
        elif 0xC3 <= marker <= 0xCF:
            raise ValueError(f"frames of kind {marker:#x} aren't read")
    return image


def _basis() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= 2**0.5
    return basis


_BASIS = _basis().astype(np.float32)


def plane(image: Image, c: Component) -> np.ndarray:
    """A component's samples, whole numbers of 8 bits, before upsampling and cropping."""
    values = (c.coefficients * image.quants[c.quant]).astype(np.float32)
    blocks = np.empty_like(values)
    blocks[:, ZIGZAG] = values
    blocks = np.matmul(np.matmul(_BASIS.T, blocks.reshape(-1, 8, 8)), _BASIS) + 128
    np.clip(np.rint(blocks, out=blocks), 0, 255, out=blocks)
    return blocks.reshape(c.blocks_high, c.blocks_wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.blocks_high, 8 * c.blocks_wide)


def rgb(image: Image) -> np.ndarray:
    """Full-resolution uint8 tensor (height, width, 3)."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = [np.repeat(np.repeat(plane(image, c), v // c.v, 0), h // c.h, 1)[: image.height, : image.width] for c in image.components]
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return rgb(coefficients(data))


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def _single(kind: int, ident: int, symbol: int) -> bytes:
    return _marker(0xC4, bytes([kind << 4 | ident, 1, *[0] * 15, symbol]))


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def padded(payload: bytes) -> bytes:
    """``payload`` with bytes 0 up to a positive multiple of 64."""
    return payload + bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))


#: Largest width in units; a file's sides are below 65536 pixels, so this many units of payload fit: 4095 x 4095.
_MOST = 4095


def store(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 64 bytes, as the coefficients of a progressive JPEG file."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = -(-len(blocks) // UNIT)
    wide = min(_MOST, int(np.ceil(units**0.5)))
    high = -(-units // wide)
    if high > _MOST:
        raise ValueError("a payload of over 6 GB doesn't fit one file")
    full = np.zeros((wide * high * UNIT, 64), np.uint8)
    full[: len(blocks)] = blocks
    n = wide * high
    parts = [full[: 4 * n], full[4 * n : 5 * n], full[5 * n :]]  # luma, Cb, Cr, each in raster order
    out = [
        b"\xff\xd8", _marker(0xFE, b"payload %d" % len(payload)), _marker(0xDB, bytes([0, *[1] * 64])),
        _marker(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _single(0, 0, 7), _single(1, 0, 7), _single(1, 1, _RUN0),
    ]
    scan = lambda ident, table, ss, se, a: _marker(0xDA, bytes([1, ident, table, ss, se, a]))
    out.append(_marker(0xDD, b"\0\1"))
    for ident, x in enumerate(parts, 1):
        spaced = np.empty((len(x), 3), np.uint8)
        spaced[:, 0], spaced[:, 1], spaced[:, 2] = x[:, 0] >> 1, 255, 0xD0 + np.arange(len(x)) % 8
        out += [scan(ident, 0, 0, 0, 0x01), spaced.tobytes()[:-2]]
    out.append(_marker(0xDD, b"\0\0"))
    for ident, x in enumerate(parts, 1):
        # Magnitude bits without the lowest: a coefficient is b from 128 on, else b - 255, whose magnitude 255 - b halves
        # to 127 - b // 2; as seven bits that is b // 2 either way.
        out += [scan(ident, 0, 1, 5, 0x01), (x[:, 1:6] >> 1).tobytes(), scan(ident, 0, 6, 63, 0x01), (x[:, 6:] >> 1).tobytes()]
    for ident, x in enumerate(parts, 1):
        out += [scan(ident, 0, 0, 0, 0x10), _stuffed(np.packbits(x[:, 0] & 1).tobytes())]
        low = np.where(x >> 7, x & 1, 1 - (x & 1))
        low[:, 0] = 0  # the code of an end of band
        out += [scan(ident, 1, 1, 63, 0x10), _stuffed(np.packbits(low, axis=1).tobytes())]
    return b"".join([*out, b"\xff\xd9"])


def restore(image: Image) -> bytes:
    """The payload from the coefficients."""
    full = np.concatenate([c.coefficients for c in image.components])
    x = np.where(full > 0, full, full + 255)
    dc = full[:, 0]
    half = dc >> 1
    x[:, 0] = np.where(half > 0, half, half + 127) * 2 + (dc & 1)
    return x.astype(np.uint8).tobytes()[: int(image.comment.split()[1])]
