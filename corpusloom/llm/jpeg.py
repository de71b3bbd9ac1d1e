"""Progressive JPEG, decoded with numpy for many images at once.

Scans are accumulated into coefficient arrays: spectral selection (bands of the
zigzag order) and successive approximation (a first scan of the upper bits, then
one bit a scan). Every restart interval of every image is a segment of its own,
and a step decodes one table lookup of all segments together. Then blocks are
dequantised, inverse-transformed, chroma is upsampled and RGB tensors result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from corpusloom.llm import _bytes as B

# The zigzag order of an 8 by 8 block.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)

#: Blocks that are decoded, transformed or put together at a time.
STRIPE_BLOCKS = 1 << 14


class JpegError(ValueError):
    """The bytes are no progressive JPEG that this decoder reads."""


@dataclass(frozen=True)
class Huffman:
    """Lookups by the next 16 bits: one symbol, or as many whole coefficients as fit."""

    symbol: np.ndarray  # 0..255, or 256 where no code matches
    length: np.ndarray
    several: np.ndarray  # coefficients that fit
    bits: np.ndarray
    reach: np.ndarray  # positions passed up to and with each of them
    value: np.ndarray


@lru_cache(maxsize=64)
def huffman(spec: bytes) -> Huffman:
    """``spec``: 16 counts of codes by length, then the symbols."""
    symbol, length = np.full(1 << 16, 256, np.int64), np.ones(1 << 16, np.int64)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(spec[size - 1]):
            low = code << (16 - size)
            if low >= 1 << 16 or at >= len(spec):
                raise JpegError("bad Huffman table")
            symbol[low : low + (1 << (16 - size))] = spec[at]
            length[low : low + (1 << (16 - size))] = size
            code, at = code + 1, at + 1
        code <<= 1
    window = np.arange(1 << 16)
    several, bits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    reach, value = np.zeros((1 << 16, 8), np.int16), np.zeros((1 << 16, 8), np.int16)
    alive, passed = np.ones(1 << 16, bool), np.zeros(1 << 16, np.int64)
    for k in range(8):
        look = (window << bits) & 0xFFFF
        s, used = symbol[look], length[look]
        run, size = s >> 4, s & 15
        alive &= (s < 256) & (size > 0) & (bits + used + size <= 16)
        if not alive.any():
            break
        raw = (look << used & 0xFFFF) >> (16 - size)
        signed = np.where(raw < 1 << np.maximum(size - 1, 0), raw - (1 << size) + 1, raw)
        passed = np.where(alive, passed + run + 1, passed)
        reach[:, k], value[:, k] = passed, signed
        several += alive
        bits = np.where(alive, bits + used + size, bits)
    width = max(1, int(several.max()))
    return Huffman(symbol, length, several, bits, reach[:, :width].copy(), value[:, :width].copy())


@dataclass
class Scan:
    parts: list[tuple[int, bytes, bytes]]  # component, DC table, AC table
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    begin: int  # of the entropy-coded bytes
    end: int


@dataclass
class Image:
    height: int = 0
    width: int = 0
    factors: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.factors), max(v for _, v in self.factors)

    @property
    def mcus(self) -> tuple[int, int]:
        """Columns and rows of minimum coded units."""
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        cols, rows = self.mcus
        return [cols * h * rows * v for h, v in self.factors]


def parse(data: bytes, marks: np.ndarray, base: int) -> Image:
    """Read the headers; ``marks`` are the positions of markers in the batch that ``data`` begins at ``base``."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    image, at, n = Image(), 2, len(data)
    tables: dict[int, bytes] = {}
    quants: dict[int, np.ndarray] = {}
    names: dict[int, int] = {}
    chosen: list[int] = []
    restart = 0
    while at + 4 <= n:
        if data[at] != 0xFF:
            raise JpegError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body, after = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                count = 17 + sum(body[1:17])
                tables[body[0]] = body[1:count]
                body = body[count:]
        elif kind == 0xC2:
            if body[0] != 8:
                raise JpegError("only 8-bit samples are read")
            image.height, image.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            for k in range(body[5]):
                name, factor, q = body[6 + 3 * k : 9 + 3 * k]
                names[name] = k
                image.factors.append((factor >> 4, factor & 15))
                chosen.append(q)
            if not image.height or not image.width or body[5] not in (1, 3):
                raise JpegError("unsupported frame")
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise JpegError("no progressive Huffman frame")
        elif kind == 0xDD:
            restart = body[0] << 8 | body[1]
        elif kind == 0xDA:
            m = body[0]
            parts = [(names[body[1 + 2 * k]], tables.get(body[2 + 2 * k] >> 4, b""), tables.get(0x10 | body[2 + 2 * k] & 15, b"")) for k in range(m)]
            ss, se, a = body[1 + 2 * m : 4 + 2 * m]
            stop = int(marks[np.searchsorted(marks, base + after)]) - base if len(marks) and marks[-1] >= base + after else n
            image.scans.append(Scan(parts, ss, se, a >> 4, a & 15, restart, after, min(stop, n)))
            after = min(stop, n)
        at = after
    if not image.factors:
        raise JpegError("no frame")
    image.quant = [quants[q] for q in chosen]
    return image


@lru_cache(maxsize=4096)
def _order(size: tuple[int, int], factors: tuple[tuple[int, int], ...], parts: tuple[int, ...]) -> np.ndarray:
    """The blocks of a scan in coding order, counted over all components."""
    image = Image(size[1], size[0], list(factors))
    cols, rows = image.mcus
    first = np.concatenate(([0], np.cumsum(image.blocks())))
    if len(parts) == 1:
        c = parts[0]
        h, v = factors[c]
        most_h, most_v = image.most
        wide, high = -(-(-(-size[0] * h // most_h)) // 8), -(-(-(-size[1] * v // most_v)) // 8)
        return first[c] + (np.arange(high)[:, None] * (cols * h) + np.arange(wide)).ravel()
    grids = []
    for c in parts:
        h, v = factors[c]
        grid = first[c] + np.arange(cols * h * rows * v).reshape(rows, v, cols, h)
        grids.append(grid.transpose(0, 2, 1, 3).reshape(rows * cols, h * v))
    return np.concatenate(grids, axis=1).ravel()


def _levels(image: Image) -> list[int]:
    """Scans of one level touch different coefficients, so that they can be decoded together."""
    done: list[tuple[int, int, int, int]] = []
    out = []
    for scan in image.scans:
        level = 0
        for c, _, _ in scan.parts:
            level = max([level, *(1 + x[3] for x in done if x[0] == c and x[1] <= scan.se and scan.ss <= x[2])])
        done += [(c, scan.ss, scan.se, level) for c, _, _ in scan.parts]
        out.append(level)
    return out


class _Bits:
    """Random access to the bits of unstuffed bytes."""

    def __init__(self, data: np.ndarray) -> None:
        wide = np.concatenate((data, np.full(8, 0xFF, np.uint8))).astype(np.uint32)
        self.words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        self.data, self.last = data, 8 * len(data)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        at = np.minimum(at, self.last)
        return (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def one(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.last - 1)
        return self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1


def _signed(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(raw < (1 << np.maximum(size, 1) >> 1), raw - (1 << size) + 1, raw)


def _dc_first(bits: _Bits, coefs: np.ndarray, at: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, part_of: list[int], tables: list[Huffman], al: int) -> None:
    """Differences to the block before of the same component, from 0 at each segment's start."""
    period = len(part_of)
    last = np.zeros((len(at), max(part_of) + 1), np.int64)
    live = np.arange(len(at))
    for step in range(int(count.max(initial=0))):
        live = live[count[live] > step]
        table, part = tables[step % period], part_of[step % period]
        window = bits.peek(at[live])
        size = table.symbol[window] & 15
        if (table.symbol[window] > 11).any():
            raise JpegError("bad DC code")
        at[live] += table.length[window]
        raw = bits.peek(at[live]) >> (16 - size)
        last[live, part] += np.where(size > 0, _signed(raw, size), 0)
        at[live] += size
        coefs[order[begin[live] + step], 0] = last[live, part] << al


def _dc_refine(bits: _Bits, coefs: np.ndarray, at: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, al: int) -> None:
    coefs[order[B.ranges(begin, count)], 0] |= bits.one(B.ranges(at, count)).astype(np.int32) << al


def _ac_first(bits: _Bits, flat: np.ndarray, at: np.ndarray, place: np.ndarray, begin: np.ndarray, count: np.ndarray, band: int, table: Huffman, al: int) -> None:
    """``place``: the flat coefficient of each position; a segment's positions run over its bands."""
    here, stop = begin * band, (begin + count) * band
    live = np.flatnonzero(here < stop)
    columns = np.arange(table.reach.shape[1])
    while len(live):
        window = bits.peek(at[live])
        several = table.several[window]
        many = several > 0
        if many.any():
            fast, w, n = live[many], window[many], several[many]
            used = columns < n[:, None]
            target = here[fast, None] + table.reach[w] - 1
            used &= target < stop[fast, None]
            flat[place[target[used]]] = table.value[w][used].astype(np.int32) << al
            here[fast] += table.reach[w, n - 1]
            at[fast] += table.bits[w]
        if not many.all():
            slow = live[~many]
            w = window[~many]
            symbol = table.symbol[w]
            if (symbol > 255).any():
                raise JpegError("bad AC code")
            at[slow] += table.length[w]
            run, size = symbol >> 4, symbol & 15
            extra = np.where((size == 0) & (run < 15), run, size)
            raw = np.where(extra > 0, bits.peek(at[slow]) >> (16 - np.maximum(extra, 1)), 0)
            at[slow] += extra
            ends = (size == 0) & (run < 15)
            valued = size > 0
            target = here[slow] + run
            put = valued & (target < stop[slow])
            flat[place[target[put]]] = _signed(raw, size)[put].astype(np.int32) << al
            over = here[slow] // band * band + band * ((1 << np.minimum(run, 14)) + raw)
            here[slow] = np.where(ends, over, target + 1)
        live = live[here[live] < stop[live]]


def _ac_refine(bits: _Bits, flat: np.ndarray, at: np.ndarray, place: np.ndarray, begin: np.ndarray, count: np.ndarray, band: int, table: Huffman, al: int) -> None:
    """One more bit of what is set, and coefficients that become set."""
    here, stop = begin * band, (begin + count) * band
    one = np.int32(1 << al)
    live = np.flatnonzero(here < stop)
    while len(live):
        window = bits.peek(at[live])
        symbol = table.symbol[window]
        if (symbol > 255).any() or ((symbol & 15) > 1).any():
            raise JpegError("bad refinement code")
        at[live] += table.length[window]
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        extra = np.where(ends, run, size)
        raw = np.where(extra > 0, bits.peek(at[live]) >> (16 - np.maximum(extra, 1)), 0)
        at[live] += extra
        block_end = (here[live] // band + 1) * band
        until = np.where(ends, block_end + band * ((1 << np.minimum(run, 14)) + raw - 1), block_end)
        until = np.minimum(until, stop[live])
        positions = B.ranges(here[live], until - here[live])
        owner = np.repeat(np.arange(len(live)), until - here[live])
        index = place[positions]
        history = flat[index] != 0
        if not ends.all():  # a run counts unset positions; stop at the one after it
            free = np.cumsum(~history)
            head = np.cumsum(until - here[live]) - (until - here[live])
            before = np.where(head > 0, free[np.maximum(head - 1, 0)], 0)
            nth = free - before[owner]
            limit = np.where(ends, np.int64(1) << 40, run + 1)[owner]
            keep = (nth < limit) | ((nth == limit) & ~history)
            final = (nth == limit) & ~history
            until = here[live] + np.bincount(owner[keep], minlength=len(live))
            positions, owner, index, history, final = positions[keep], owner[keep], index[keep], history[keep], final[keep]
        else:
            final = None
        old = np.flatnonzero(history)
        rank = np.arange(len(old)) - np.searchsorted(owner[old], np.arange(len(live)))[owner[old]]
        bit = bits.one(at[live][owner[old]] + rank).astype(bool)
        changed = index[old[bit]]
        value = flat[changed]
        flat[changed] = value + np.where(value > 0, one, -one)
        at[live] += np.bincount(owner[old], minlength=len(live))
        if final is not None:
            new = np.flatnonzero(final & (size[owner] == 1))
            flat[index[new]] = np.where(raw[owner[new]] == 1, one, -one)
        here[live] = until
        live = live[here[live] < stop[live]]


def decode_coefficients(data: np.ndarray, offsets: np.ndarray) -> tuple[list[Image | None], np.ndarray, np.ndarray]:
    """Images of a batch (None where damaged), their coefficients (blocks by 64, zigzag), first block of each."""
    follow = np.concatenate((data[1:], np.zeros(1, np.uint8)))
    marks = np.flatnonzero((data == 0xFF) & (follow != 0) & (follow != 0xFF) & ((follow < 0xD0) | (follow > 0xD7)))
    resets = np.flatnonzero((data == 0xFF) & (follow >= 0xD0) & (follow <= 0xD7))
    images: list[Image | None] = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        try:
            images.append(parse(data[a:b].tobytes(), marks, a))
        except (JpegError, IndexError, KeyError, ValueError):
            images.append(None)
    first = np.concatenate(([0], np.cumsum([sum(i.blocks()) if i else 0 for i in images])))
    coefs = np.zeros((int(first[-1]), 64), np.int32)
    groups: dict[tuple, list[tuple[int, Scan]]] = {}
    for k, image in enumerate(images):
        if image:
            for level, scan in zip(_levels(image), image.scans, strict=True):
                key = (level, scan.ss, scan.se, scan.ah, scan.al, tuple((p[1] if scan.ss == 0 else p[2]) for p in scan.parts), tuple(image.factors[p[0]] for p in scan.parts) if scan.ss == 0 else ())
                groups.setdefault(key, []).append((k, scan))
    for key in sorted(groups, key=lambda g: g[0]):
        _scan_group(data, offsets, resets, images, first, coefs, groups[key])
    return images, coefs, first


def _scan_group(data: np.ndarray, offsets: np.ndarray, resets: np.ndarray, images: list, first: np.ndarray, coefs: np.ndarray, group: list[tuple[int, Scan]]) -> None:
    """Decode scans of equal kind and tables, all their segments together."""
    lead = group[0][1]
    orders, begins, counts, lows, highs, done = [], [], [], [], [], 0
    for k, scan in group:
        image = images[k]
        order = _order((image.width, image.height), tuple(image.factors), tuple(p[0] for p in scan.parts))
        unit = sum(image.factors[p[0]][0] * image.factors[p[0]][1] for p in scan.parts) if len(scan.parts) > 1 else 1
        each = scan.restart * unit or len(order)
        begin = np.arange(0, len(order), each)
        low, high = offsets[k] + scan.begin, offsets[k] + scan.end
        cuts = resets[np.searchsorted(resets, low) : np.searchsorted(resets, high)][: len(begin) - 1]
        begin = begin[: len(cuts) + 1]
        orders.append(order + first[k])
        begins.append(begin + done)
        counts.append(np.minimum(each, len(order) - begin))
        lows.append(np.concatenate(([low], cuts + 2)))
        highs.append(np.concatenate((cuts, [high])))
        done += len(order)
    order, begin, count = np.concatenate(orders), np.concatenate(begins), np.concatenate(counts)
    low, high = np.concatenate(lows), np.concatenate(highs)
    # Segments stand alone, so a few at a time are decoded; what is held besides the coefficients stays small.
    for some, a, b in B.stretches(begin, begin + count, STRIPE_BLOCKS):
        _segments_of(data, lead, [images[group[0][0]].factors[p[0]] for p in lead.parts], coefs, order[a:b], begin[some] - a, count[some], low[some], high[some])


def _segments_of(data: np.ndarray, lead: Scan, factors: list, coefs: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    source = B.ranges(low, high - low)
    raw = data[source]
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 0xFF)
    size = high - low
    owner_first = np.cumsum(size) - size
    stuffed[owner_first[(size > 0) & (owner_first < len(raw))]] = False
    dropped = np.concatenate(([0], np.cumsum(stuffed)))
    at = 8 * (owner_first - dropped[owner_first])
    bits = _Bits(raw[~stuffed])
    if lead.ss == 0:
        if lead.ah:
            _dc_refine(bits, coefs, at, order, begin, count, lead.al)
            return
        part_of = [c for c, (h, v) in enumerate(factors) for _ in range(h * v if len(factors) > 1 else 1)]
        _dc_first(bits, coefs, at, order, begin, count, part_of, [huffman(lead.parts[c][1]) for c in part_of], lead.al)
        return
    band = lead.se - lead.ss + 1
    place = (order[:, None] * 64 + np.arange(lead.ss, lead.se + 1)).ravel()
    step = _ac_refine if lead.ah else _ac_first
    step(bits, coefs.reshape(-1), at, place, begin, count, band, huffman(lead.parts[0][2]), lead.al)


def _samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks of 8 by 8 samples; ``quant`` is one table or one for each block."""
    natural = np.zeros((len(coefs), 64), np.float32)
    natural[:, ZIGZAG] = coefs * np.asarray(quant, np.float32)
    half = natural.reshape(-1, 8) @ _DCT
    samples = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _DCT
    return np.clip(np.rint(samples.reshape(-1, 8, 8).transpose(0, 2, 1) + 128), 0, 255).astype(np.float32)


def _colours(image: Image, parts: list[np.ndarray], rows: int) -> np.ndarray:
    """RGB of so many rows of units from the samples of each component, chroma upsampled."""
    cols, (most_h, most_v) = image.mcus[0], image.most
    planes = []
    for (h, v), own in zip(image.factors, parts, strict=True):
        plane = own.reshape(rows * v, cols * h, 8, 8).transpose(0, 2, 1, 3).reshape(rows * v * 8, cols * h * 8)
        if (most_h, most_v) != (h, v):
            plane = plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
        planes.append(plane[:, : image.width])
    if len(planes) == 1:
        return np.clip(np.rint(np.stack(planes * 3, axis=2)), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)), 0, 255).astype(np.uint8)


def _by_stripes(image: Image, coefs: np.ndarray) -> np.ndarray:
    """A large image, some rows of units at a time."""
    cols, rows = image.mcus
    tall = 8 * image.most[1]
    out = np.empty((image.height, image.width, 3), np.uint8)
    step = max(1, STRIPE_BLOCKS // (cols * sum(h * v for h, v in image.factors)))
    starts = np.concatenate(([0], np.cumsum(image.blocks())))
    for r in range(0, rows, step):
        n = min(step, rows - r)
        parts = [_samples(coefs[at + r * v * cols * h : at + (r + n) * v * cols * h], image.quant[c]) for c, ((h, v), at) in enumerate(zip(image.factors, starts, strict=False))]
        stripe = out[r * tall : (r + n) * tall]
        stripe[:] = _colours(image, parts, n)[: len(stripe)]
    return out


def render(images: list[Image | None], coefs: np.ndarray, first: np.ndarray) -> list[np.ndarray | None]:
    """Full-resolution RGB tensors, height by width by 3; small images are transformed together, large ones by stripes."""
    small = [k for k, image in enumerate(images) if image and sum(image.blocks()) <= STRIPE_BLOCKS]
    held = np.concatenate([coefs[first[k] : first[k + 1]] for k in small] or [coefs[:0]]) if len(small) < len(images) else coefs
    scale = np.concatenate([np.repeat(np.asarray(images[k].quant[c], np.float32)[None], n, axis=0) for k in small for c, n in enumerate(images[k].blocks())] or [np.ones((0, 64), np.float32)])
    samples, at = _samples(held, scale), 0
    out: list[np.ndarray | None] = [None] * len(images)
    for k in small:
        image, parts = images[k], []
        for n in image.blocks():
            parts.append(samples[at : at + n])
            at += n
        out[k] = _colours(image, parts, image.mcus[1])[: image.height]
    for k, image in enumerate(images):
        if image and out[k] is None:
            out[k] = _by_stripes(image, coefs[first[k] : first[k + 1]])
    return out
