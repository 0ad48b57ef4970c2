"""Progressive files with Huffman tables of their own, written here by the standard's rules, read by the operator."""

import heapq
import struct
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import jpeg, media

WIDTH, HEIGHT = 61, 45


class Scan:
    """The tokens of one scan: Huffman symbols and raw bits; then its table and its bytes."""

    def __init__(self):
        self.parts, self.eob, self.late = [[]], 0, []

    def symbol(self, s):
        self.parts[-1].append((s, None))

    def bits(self, value, n):
        if n:
            self.parts[-1].append((value & ((1 << n) - 1), n))

    def end_bands(self):
        if self.eob:
            n = self.eob.bit_length() - 1
            self.symbol(n << 4)
            self.bits(self.eob, n)
            for b in self.late:
                self.bits(b, 1)
        self.eob, self.late = 0, []

    def restart(self):
        self.end_bands()
        self.parts.append([])

    def table(self):
        """(counts by length, symbols): a Huffman code without the word of ones alone."""
        heap = [(n, s, (s,)) for s, n in Counter(s for p in self.parts for s, n in p if n is None).items()] + [(0, 999, (999,))]
        heapq.heapify(heap)
        depth = Counter()
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            depth.update(x + y)
            heapq.heappush(heap, (a + b, max(i, j), x + y))
        order = sorted(depth, key=lambda s: (depth[s], s))
        assert order[-1] == 999 and depth[999] <= 16
        order.pop()
        self.codes, code, last = {}, 0, 0
        for s in order:
            code <<= depth[s] - last
            last = depth[s]
            self.codes[s] = (code, last)
            code += 1
        return bytes(sum(depth[s] == n for s in order) for n in range(1, 17)), bytes(order)

    def data(self):
        out = b""
        for k, part in enumerate(self.parts):
            text = "".join(format(v, f"0{n}b") for v, n in ((self.codes[s] if n is None else (s, n)) for s, n in part))
            text += "1" * (-len(text) % 8)
            out += (bytes([255, 0xD0 + (k - 1) % 8]) if k else b"") + bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")
        return out


def magnitude(scan, run, v):
    n = abs(v).bit_length()
    scan.symbol(run << 4 | n)
    scan.bits(v if v > 0 else v - 1, n)


def first_band(scan, block, ss, se, al):
    run = 0
    for k in range(ss, se + 1):
        v = int(np.sign(block[k])) * (abs(int(block[k])) >> al)
        if not v:
            run += 1
            continue
        scan.end_bands()
        while run > 15:
            scan.symbol(0xF0)
            run -= 16
        magnitude(scan, run, v)
        run = 0
    if run:
        scan.eob += 1


def refined_band(scan, block, ss, se, al):
    size = [abs(int(v)) >> al for v in block]
    last = max((k for k in range(ss, se + 1) if size[k] == 1), default=-1)
    run, held = 0, []
    for k in range(ss, se + 1):
        if not size[k]:
            run += 1
            continue
        while run > 15 and k <= last:
            scan.end_bands()
            scan.symbol(0xF0)
            for b in held:
                scan.bits(b, 1)
            run, held = run - 16, []
        if size[k] > 1:
            held.append(size[k] & 1)
            continue
        scan.end_bands()
        scan.symbol(run << 4 | 1)
        for b in (int(block[k] > 0), *held):
            scan.bits(b, 1)
        run, held = 0, []
    if run or held:
        scan.eob += 1
        scan.late += held


def file_of(blocks, quants, sampling, restart):
    """blocks: per component (high, wide, 64) in whole units, zigzag order."""
    out = [b"\xff\xd8"]
    for k, q in enumerate(quants):
        out.append(jpeg._marker(0xDB, bytes([k, *q.tolist()])))
    parts = b"".join(bytes([k + 1, h << 4 | v, k]) for k, (h, v) in enumerate(sampling))
    out.append(jpeg._marker(0xC2, struct.pack(">BHHB", 8, HEIGHT, WIDTH, len(blocks)) + parts))
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = [(y, x) for y in range(-(-HEIGHT // (8 * most_v))) for x in range(-(-WIDTH // (8 * most_h)))]

    def put(scan, ids, ss, se, a, symbols=True):
        if symbols:
            counts, order = scan.table()
            out.append(jpeg._marker(0xC4, bytes([0x10 if ss else 0x00]) + counts + order))
        out.append(jpeg._marker(0xDD, struct.pack(">H", restart if len(ids) == 1 and ss else 0)))
        out.append(jpeg._marker(0xDA, bytes([len(ids), *(x for k in ids for x in (k + 1, 0)), ss, se, a])) + scan.data())

    every = list(range(len(blocks)))
    for al, refine in ((1, False), (0, True)):  # DC of all components together
        scan, before = Scan(), [0] * len(blocks)
        for my, mx in units:
            for k, (h, v) in enumerate(sampling):
                for y in range(v):
                    for x in range(h):
                        dc = int(blocks[k][my * v + y, mx * h + x, 0]) >> al
                        if refine:
                            scan.bits(dc, 1)
                        else:
                            d, before[k] = dc - before[k], dc
                            n = abs(d).bit_length()
                            scan.symbol(n)
                            scan.bits(d if d > 0 else d - 1, n)
        put(scan, every, 0, 0, 0x10 if refine else 0x01, not refine)
    for ss, se, ah, al in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
        for k, (h, v) in enumerate(sampling):
            scan = Scan()
            high, wide = -(-(-(-HEIGHT * v // most_v)) // 8), -(-(-(-WIDTH * h // most_h)) // 8)
            for i, (y, x) in enumerate((y, x) for y in range(high) for x in range(wide)):
                if restart and i and i % restart == 0:
                    scan.restart()
                (refined_band if ah else first_band)(scan, blocks[k][y, x], ss, se, al)
            scan.end_bands()
            put(scan, [k], ss, se, ah << 4 | al)
    return b"".join([*out, b"\xff\xd9"])


def made(seed, sampling):
    rng = np.random.default_rng(seed)
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    blocks = []
    for h, v in sampling:
        high, wide = -(-HEIGHT // (8 * most_v)) * v, -(-WIDTH // (8 * most_h)) * h
        b = np.where(rng.random((high, wide, 64)) < 0.15, rng.integers(-40, 41, (high, wide, 64)), 0)
        b[..., 0] = rng.integers(-60, 61, (high, wide))
        own_high, own_wide = -(-(-(-HEIGHT * v // most_v)) // 8), -(-(-(-WIDTH * h // most_h)) // 8)
        b[own_high:, :, 1:] = 0  # padding, which scans of one component leave out
        b[:, own_wide:, 1:] = 0
        blocks.append(b)
    return blocks, [rng.integers(1, 9, 64) for _ in sampling]


def plain_rgb(blocks, quants, sampling):
    """The inverse transform by its definition, a pixel at a time for each basis function, and chroma repeated."""
    scans = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    scale = lambda u: (1 / 8) ** 0.5 if u == 0 else 0.5
    wave = {(u, v): np.outer([scale(u) * np.cos((2 * y + 1) * u * np.pi / 16) for y in range(8)], [scale(v) * np.cos((2 * x + 1) * v * np.pi / 16) for x in range(8)]) for u, v in scans}
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for b, q, (h, v) in zip(blocks, quants, sampling, strict=True):
        plane = np.zeros((b.shape[0] * 8, b.shape[1] * 8))
        for y in range(b.shape[0]):
            for x in range(b.shape[1]):
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = 128 + sum(b[y, x, k] * q[k] * wave[scans[k]] for k in range(64))
        plane = np.clip(np.rint(plane), 0, 255)
        planes.append(np.kron(plane, np.ones((most_v // v, most_h // h)))[:HEIGHT, :WIDTH])
    if len(planes) == 1:
        planes += [np.full_like(planes[0], 128)] * 2
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255)


@pytest.mark.parametrize("restart", [0, 5])
@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)]])
def test_files_with_tables_of_their_own(spark, sampling, restart):
    blocks, quants = made(restart, sampling)
    file = file_of(blocks, quants, sampling, restart)
    image = jpeg.coefficients(file)
    for c, b in zip(image.components, blocks, strict=True):
        assert (c.coefficients.reshape(b.shape) == b).all()
    want = plain_rgb(blocks, quants, sampling)
    assert np.abs(jpeg.decode(file).astype(int) - want).max() <= 1  # single precision
    if restart:
        rows = media.tensors(spark.createDataFrame([(7, bytearray(file)), (8, None)], "doc_id long, media binary")).collect()
        got = {r["id"]: r for r in rows}
        assert (got[7]["height"], got[7]["width"]) == (HEIGHT, WIDTH) and got[8]["rgb"] is None
        assert np.frombuffer(got[7]["rgb"], np.uint8).tobytes() == jpeg.decode(file).tobytes()
