"""Media columns: payloads kept losslessly in progressive JPEG, and RGB tensors.

A payload byte becomes one quantised DCT coefficient, the format's own unit, as
samples would be rounded. Byte b < 128 is stored as b + 128 and any other as -b,
so every coefficient has a magnitude of 128 to 255. Blocks of 64 bytes fill the
Y, Cb and Cr planes of a 4:2:0 image one after another. Scans: upper bits of DC,
upper bits of the zigzag bands 1-5 and 6-63 of each component, then the last bit
of each. Restart intervals are eight units long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches
from corpusloom.llm.jpeg import STRIPE_BLOCKS, decode_coefficients, render

UNIT = 64
RESTART = 8
BANDS = ((1, 5), (6, 63))
_DC_BITS = 4
# Code lengths and symbols: DC sizes 0-9 in 4 bits; size 7 without a run in 1 bit;
# ends of runs of 1, 2-3, 4-7 and 8-15 blocks in 8, 7, 6 and 5 bits, so that code and run take a byte.
_DC_TABLE = bytes([0, 0, 0, 10] + [0] * 12 + list(range(10)))
_FIRST_TABLE = bytes([1] + [0] * 15 + [0x07])
_REFINE_TABLE = bytes([0, 0, 0, 0, 1, 1, 1, 1] + [0] * 8 + [0x30, 0x20, 0x10, 0x00])


# What each payload byte becomes: its coefficient; the seven bits after the one-bit code 0; the last bit.
_COEFFICIENT = np.array([b + 128 if b < 128 else -b for b in range(256)], np.int64)
_SEVEN = np.where(_COEFFICIENT < 0, 127 - (-_COEFFICIENT >> 1), _COEFFICIENT >> 1).astype(np.uint8)
_LOW = (np.abs(_COEFFICIENT) & 1).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(width: int, height: int, n_bytes: int, n_blocks: int) -> bytes:
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(bytes([at]) + spec for at, spec in ((0x00, _DC_TABLE), (0x10, _FIRST_TABLE), (0x11, _REFINE_TABLE)))
    note = b"payload" + n_bytes.to_bytes(8, "big") + n_blocks.to_bytes(8, "big")
    return b"\xff\xd8" + _segment(0xFE, note) + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, RESTART.to_bytes(2, "big"))


def _scan_head(parts: list[int], table: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, table]) for c in parts) + bytes([ss, se, ah << 4 | al]))


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 4:2:0 units, of six blocks each, that hold so many blocks."""
    units = max(1, -(-n_blocks // 6))
    rows = -(-units // 2048)
    return -(-units // rows), rows


def _lay(raw: np.ndarray, size: np.ndarray, ordinal: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuff the bytes of segments and put a restart marker after each that is not ``last``; the new ends."""
    ends = np.cumsum(size)
    laid = [_lay_some(raw[a:b], size[some], ordinal[some], last[some]) for some, a, b in B.stretches(ends - size, ends)]
    return np.concatenate([out for out, _ in laid]), np.cumsum(np.concatenate([width for _, width in laid]))


def _lay_some(raw: np.ndarray, size: np.ndarray, ordinal: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of a few segments; the new sizes."""
    full = raw == 0xFF
    owner = np.repeat(np.arange(len(size)), size)
    extra = np.bincount(owner[full], minlength=len(size))
    width = size + extra + np.where(last, 0, 2)
    begin = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    head = np.cumsum(size) - size
    shift = np.cumsum(full) - full
    lead = np.where(head < len(raw), shift[np.minimum(head, max(len(raw) - 1, 0))], 0) if len(raw) else head
    out[begin[owner] + np.arange(len(raw)) - head[owner] + shift - lead[owner]] = raw
    at = (begin + size + extra)[~last]
    out[at] = 0xFF
    out[at + 1] = 0xD0 + ordinal[~last] % 8
    return out, width


def _segments(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For scans of so many units: units, ordinal and lastness of each segment, segments of each scan."""
    n = -(-units // RESTART)
    ordinal = B.ranges(np.zeros(len(units), np.int64), n)
    last = ordinal == np.repeat(n, n) - 1
    count = np.where(last, np.repeat(units - (n - 1) * RESTART, n), RESTART)
    return count, ordinal, last, n


def _pack_bits(value: np.ndarray, width: np.ndarray, owner: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of given widths as bits, each segment filled up to whole bytes with ones."""
    total = np.bincount(owner, width, minlength=segments).astype(np.int64)
    size = -(-total // 8)
    bits = np.ones(int(size.sum()) * 8, np.uint8)
    first = 8 * (np.cumsum(size) - size)
    end = np.cumsum(width)
    inside = end - width - (np.cumsum(total) - total)[owner]
    spread = B.ranges(first[owner] + inside, width)
    which = np.repeat(np.arange(len(value)), width)
    bits[spread] = value[which] >> (np.repeat(end, width) - 1 - np.arange(int(width.sum()))) & 1
    return np.packbits(bits), size


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A progressive JPEG for each payload of bytes; payloads are padded with zeros to whole blocks."""
    documents = len(offsets) - 1
    n_bytes = np.diff(offsets)
    n_blocks = np.maximum(1, -(-n_bytes // UNIT))
    shape = np.array([grid(int(n)) for n in n_blocks], np.int64).reshape(-1, 2)
    units = shape[:, 0] * shape[:, 1]
    first = np.concatenate(([0], np.cumsum(6 * units)))
    payload = np.zeros((int(first[-1]), UNIT), np.uint8)
    flat = payload.ravel()
    for at, a, b in zip((first[:-1] * UNIT).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[at : at + b - a] = data[a:b]

    parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []  # head, bytes, end of each document's

    def add(head: bytes, raw: np.ndarray, size: np.ndarray, ordinal: np.ndarray, last: np.ndarray, n: np.ndarray) -> None:
        out, ends = _lay(raw, size, ordinal, last)
        parts.append((head, out, ends[np.cumsum(n) - 1]))

    # DC: six blocks of a unit after another.
    unit = np.arange(int(units.sum()))
    doc = np.repeat(np.arange(documents), units)
    at = unit - (np.cumsum(units) - units)[doc]
    cols = shape[doc, 0]
    top = first[doc] + at // cols * (4 * cols) + at % cols * 2
    chroma = first[doc] + 4 * units[doc] + at
    order = np.stack((top, top + 1, top + 2 * cols, top + 2 * cols + 1, chroma, chroma + units[doc]), axis=1)
    count, ordinal, last, n = _segments(units)
    owner = np.repeat(np.arange(len(count)), count)
    first_ones = _COEFFICIENT[payload[order, 0]]
    upper = first_ones >> 1
    start = np.zeros(len(unit), bool)
    start[np.cumsum(count) - count] = True
    before = np.empty_like(upper)
    before[:, 1:4], before[1:, 0] = upper[:, :3], upper[:-1, 3]
    before[1:, 4:] = upper[:-1, 4:]
    before[np.ix_(start, [0, 4, 5])] = 0
    gap = (upper - before).ravel()
    size = np.ceil(np.log2(np.abs(gap) + 1)).astype(np.int64)
    raw = np.where(gap < 0, gap + (1 << size) - 1, gap)
    packed, bytes_of = _pack_bits(size << size | raw, _DC_BITS + size, np.repeat(owner, 6), len(count))
    add(_scan_head([0, 1, 2], 0x00, 0, 0, 0, 1), packed, bytes_of, ordinal, last, n)
    low_dc = (first_ones & 1).ravel()
    dc_refine = _pack_bits(low_dc, np.ones(len(low_dc), np.int64), np.repeat(owner, 6), len(count)), (ordinal, last, n)

    planes = []
    for c in range(3):
        mine = (4 if c == 0 else 1) * units
        planes.append((c, B.ranges(first[:-1] + (0, 4, 5)[c] * units, mine), *_segments(mine)))
    for ss, se in BANDS:
        for c, blocks, count, ordinal, last, n in planes:
            add(_scan_head([c], 0x00, ss, se, 0, 1), _SEVEN[payload[blocks, ss : se + 1]].ravel(), count * (se - ss + 1), ordinal, last, n)
    (packed, bytes_of), (ordinal, last, n) = dc_refine
    add(_scan_head([0, 1, 2], 0x00, 0, 0, 1, 0), packed, bytes_of, ordinal, last, n)
    for c, blocks, count, ordinal, last, n in planes:
        rows = np.ones((len(count), 8 + 63 * RESTART), np.uint8)
        # The code of a run of 2**k to 2**(k + 1) - 1 blocks has 8 - k bits; k bits of the run follow.
        power = np.floor(np.log2(count)).astype(np.int64)
        code = np.array([0b00001110, 0b0000110, 0b000010, 0b00000])[power] << power | count - (1 << power)
        rows[:, :8] = code[:, None] >> np.arange(7, -1, -1) & 1
        inside = np.arange(RESTART)[None, :] < count[:, None]
        rows[:, 8:].reshape(len(count), RESTART, 63)[inside] = _LOW[payload[blocks, 1:]]
        packed = np.packbits(rows, axis=1)
        bytes_of = 1 + -(-63 * count // 8)
        add(_scan_head([c], 0x01, 1, 63, 1, 0), packed[np.arange(packed.shape[1])[None, :] < bytes_of[:, None]], bytes_of, ordinal, last, n)

    out = []
    views = [(head, memoryview(raw.tobytes()), [0, *ends.tolist()]) for head, raw, ends in parts]
    for d in range(documents):
        pieces = [_head(int(shape[d, 0]) * 16, int(shape[d, 1]) * 16, int(n_bytes[d]), int(n_blocks[d]))]
        for head, view, ends in views:
            pieces += (head, view[ends[d] : ends[d + 1]])
        out.append(b"".join([*pieces, b"\xff\xd9"]))
    return out


def payloads_of(coefs: np.ndarray) -> np.ndarray:
    """The payload bytes that coefficients stand for."""
    out = np.empty(coefs.shape, np.uint8)
    for at in range(0, len(coefs), STRIPE_BLOCKS):
        some = coefs[at : at + STRIPE_BLOCKS]
        out[at : at + STRIPE_BLOCKS] = np.where(some > 0, some - 128, -some)
    return out


def _note(media: bytes) -> tuple[int, int] | None:
    """Payload bytes and blocks that the comment of a stored payload states."""
    if media[2:4] == b"\xff\xfe" and media[6:13] == b"payload":
        return int.from_bytes(media[13:21], "big"), int.from_bytes(media[21:29], "big")
    return None


def store_payloads(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the column ``media``: each text's UTF-8 bytes as a progressive JPEG.

    A null text counts as empty; an empty payload is one block of zeros. Equal texts
    give equal media. Repeated rows and null ids pass through; other columns are
    dropped; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            for a, b, part, off in B.chunks(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encode_payloads(part, off), pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def _feature(rgb: np.ndarray) -> str:
    """Size, sums of the channels and a checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def read_media(stored: DataFrame, tensors: bool = True, keep_media: bool = False) -> DataFrame:
    """Decode progressive JPEGs: doc_id, height, width, rgb, feature, n_bytes, payload.

    rgb holds height * width * 3 bytes, row by row. n_bytes and payload are those of
    ``store_payloads`` and null for other images. Null or damaged media give nulls in
    all columns but doc_id. With ``tensors`` false the rgb column is left out after its
    feature is taken; with ``keep_media`` the media column passes too.
    """
    bounded_batches(stored.sparkSession)
    names = ["doc_id", "height", "width", *["rgb"] * tensors, "feature", "n_bytes", "payload"]
    passed = ["media"] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            data, offsets = B.text_buffers(column.fill_null(b"") if column.null_count else column)
            for a, b, part, off in B.chunks(data, offsets):
                images, coefs, first = decode_coefficients(part, off)
                rows: list[list] = [[] for _ in names[1:]]
                for k, (image, rgb) in enumerate(zip(images, render(images, coefs, first), strict=True)):
                    note = _note(part[off[k] : off[k] + 29].tobytes()) if image else None
                    found = {"height": image and image.height, "width": image and image.width, "rgb": rgb.tobytes() if tensors and image else None, "feature": _feature(rgb) if image else None, "n_bytes": None, "payload": None}
                    if note:
                        found |= {"n_bytes": note[0], "payload": payloads_of(coefs[first[k] : first[k] + note[1]]).tobytes()}
                    for row, name in zip(rows, names[1:], strict=True):
                        row.append(found[name])
                kinds = {"height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "feature": pa.string(), "n_bytes": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(r, kinds[n]) for r, n in zip(rows, names[1:], strict=True)), *[column.slice(a, b - a)] * keep_media], names=names + passed)

    schema = "doc_id long, height int, width int, " + "rgb binary, " * tensors + "feature string, n_bytes long, payload binary" + ", media binary" * keep_media
    media = stored.select("doc_id", "media")
    return media.mapInArrow(run, schema)

