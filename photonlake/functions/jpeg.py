"""A baseline JPEG encoder on arrays, with Huffman codes made for each picture."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: example quantisation tables by row for luminance and chrominance.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of a block by diagonals, every other one upwards.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
LONGEST = 16


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    """A quantisation table for a quality of 1 to 100."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def _cosines() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * n + 1) * k * np.pi / 16))


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each block, in zigzag order."""
    h, w = plane.shape
    cells = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8) - 128.0
    d = _cosines()
    return np.rint((d @ cells @ d.T).reshape(-1, 64) / table).astype(int)[:, ZIGZAG]


def _lengths(counts: Counter) -> dict[int, int]:
    """The length of each symbol's code, LONGEST at most; one code more than symbols is left free, as all ones isn't allowed."""
    heap = [(n, i, {s: 0}) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, {None: 0})]
    heapq.heapify(heap)
    ties = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, ties, {s: d + 1 for s, d in (x | y).items()}))
        ties += 1
    depth = heap[0][2]
    # Too long codes are cut, and the shortest that may grow make room until all fit.
    found = {s: min(max(d, 1), LONGEST) for s, d in depth.items()}
    while sum(2.0**-d for d in found.values()) > 1:
        s = max((s for s in found if found[s] < LONGEST), key=lambda s: (found[s], -counts.get(s, 0)))
        found[s] += 1
    # The free code is to be the longest: it changes places with one that is.
    top = max((s for s in found), key=lambda s: (found[s], s is None))
    found[None], found[top] = found[top], found[None]
    del found[None]
    return found


def _codes(counts: Counter) -> tuple[dict[int, tuple[int, int]], bytes]:
    """(code and length of each symbol, the table as the file has it)."""
    lengths = sorted((d, s) for s, d in _lengths(counts).items())
    codes, code, last = {}, 0, 0
    for d, s in lengths:
        code <<= d - last
        codes[s] = (code, d)
        code, last = code + 1, d
    sizes = Counter(d for d, _ in lengths)
    return codes, bytes(sizes[d] for d in range(1, LONGEST + 1)) + bytes(s for _, s in lengths)


def _symbols(block: np.ndarray, before: int) -> Iterator[tuple[int, int, int]]:
    """(symbol, value, bits) of a block; the first is that of the difference from the block before."""
    def part(value: int) -> tuple[int, int]:
        size = abs(value).bit_length()
        return size, value if value > 0 else value + (1 << size) - 1

    size, value = part(int(block[0]) - before)
    yield size, value, size
    last = 0
    for at in np.flatnonzero(block[1:]) + 1:
        run = int(at) - last - 1
        while run > 15:
            yield 0xF0, 0, 0
            run -= 16
        size, value = part(int(block[at]))
        yield run << 4 | size, value, size
        last = int(at)
    if last < 63:
        yield 0, 0, 0


def encode(rgb: np.ndarray, quality: int) -> bytes:
    """A file of an 8-bit RGB picture."""
    h, w = rgb.shape[:2]
    full = np.pad(rgb[..., :3].astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = np.moveaxis(full, 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    tables = [scaled(LUMINANCE, quality), scaled(CHROMINANCE, quality)]
    parts = [_blocks(plane, tables[i > 0]) for i, plane in enumerate(planes)]
    counts: list[Counter] = [Counter() for _ in range(4)]
    stream: list[tuple[int, int, int, int]] = []
    before = [0, 0, 0]
    for blocks in zip(*parts, strict=True):
        for i, block in enumerate(blocks):
            for n, (symbol, value, bits) in enumerate(_symbols(block, before[i])):
                kind = 2 * (i > 0) + (n > 0)
                counts[kind][symbol] += 1
                stream.append((kind, symbol, value, bits))
            before[i] = int(block[0])
    made = [_codes(c) for c in counts]
    bits = "".join(f"{made[k][0][s][0]:0{made[k][0][s][1]}b}" + (f"{v:0{n}b}" if n else "") for k, s, v, n in stream)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i, table in enumerate(tables):
        out += segment(0xDB, bytes([i]) + bytes(table[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\x01\x11\0\x02\x11\x01\x03\x11\x01")
    for kind, (_, table) in enumerate(made):
        out += segment(0xC4, bytes([(kind % 2) << 4 | kind // 2]) + table)
    return out + segment(0xDA, b"\x03\x01\0\x02\x11\x03\x11\0\x3f\0") + data + b"\xff\xd9"
