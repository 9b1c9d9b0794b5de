"""Media columns: payloads stored in baseline JPEG files, and read back.

Writer: a payload is cut into units of 64 bytes; a unit is one 8 x 8 block, its byte i the coefficient at zigzag place i,
as byte + 1, quantised by 1. Reader: parses the markers, Huffman-decodes the scan, gives the coefficients of each block
and, from the DC terms alone, a thumbnail of one luminance sample a block.

Restart intervals (INTERVAL blocks) are independent of each other, so the reader decodes those of a whole batch of
files side by side: a numpy step reads the next symbol of every interval at once.

Cases: a null or empty text is one unit of zeros; texts of any length are stored whole, long ones piece by piece in memory
that is a small multiple of the text's own (over 4 GB a file would pass
65,535 samples a side; a Spark string can't be so long); equal texts give equal files; a file that isn't baseline JPEG
with its components in one scan gives nulls (read_media); repeated rows are stored each; an empty table gives an empty table; other
columns stay, except those named as a result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_text

UNIT = 64
INTERVAL = 4
#: Bytes of payload that one step of writing and reading handles; a longer payload takes several steps. A multiple of 8 intervals.
STEP = 1 << 20
#: Code lengths of the symbols (zero run << 4 | size) that the writer uses; fixed, so equal payloads give equal files.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 3, 0x04: 5, 0x05: 6, 0x01: 6, 0x02: 7, 0x03: 7, 0x09: 8, 0x00: 8, 0xF0: 9}


def huffman_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of the canonical code with counts[i] codes of i + 1 bits."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _spec(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits that can come next: length << 8 | symbol of the code they begin with; 0 where none does."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, length) in huffman_codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
    return table


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude of v."""
    return np.frexp(np.abs(v).astype(np.float64))[1]


def _code_table(lengths: dict[int, int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value from low to high: its code with the value's bits, and how many bits these are."""
    codes = huffman_codes(*_spec(lengths))
    v = np.arange(low, high + 1)
    size = _size(v)
    code = np.array([codes.get(int(s), (0, 0)) for s in size])
    bits = np.where(v < 0, v + (1 << size) - 1, v)
    return ((code[:, 0] << size) | bits).astype(np.uint64), (code[:, 1] + size).astype(np.int64)


_DC = _code_table(DC_LENGTHS, -256, 256)
_AC = _code_table(AC_LENGTHS, 0, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = b"".join(
    [
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        *(_segment(0xC4, bytes([c << 4, *_spec(lengths)[0], *_spec(lengths)[1]])) for c, lengths in ((0, DC_LENGTHS), (1, AC_LENGTHS))),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
    ]
)


def _header(units: int, wide: int, high: int) -> bytes:
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _segment(0xFE, b"units %d" % units) + _TABLES + frame + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def shape(units: int) -> tuple[int, int]:
    """Blocks across and down that hold so many units."""
    wide = math.isqrt(units - 1) + 1
    return wide, -(-units // wide)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def write(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, whose length is a positive multiple of 64."""
    sides = [shape(len(p) // UNIT) for p in payloads]
    scans = _scans(payloads, [w * h for w, h in sides])
    return [_header(len(p) // UNIT, w, h) + scan for p, (w, h), scan in zip(payloads, sides, scans, strict=True)]


def write_long(payload: bytes) -> bytes:
    """The same for one payload, STEP bytes at a time."""
    wide, high = shape(len(payload) // UNIT)
    out, step = bytearray(_header(len(payload) // UNIT, wide, high)), STEP // UNIT
    for start in range(0, wide * high, step):
        n = min(step, wide * high - start)
        (scan,) = _scans([payload[start * UNIT : (start + n) * UNIT]], [n])
        out += scan
        if start + n < wide * high:
            out[-1] = 0xD7  # a piece ends with every eighth interval, the file with its last
    return bytes(out)


def _scans(payloads: list[bytes], in_scan: list[int]) -> list[bytes]:
    """The scans of payloads in so many blocks each; what a payload doesn't fill are zeros."""
    blocks = np.array(in_scan)
    raw = np.frombuffer(b"".join(p + bytes(n * UNIT - len(p)) for p, n in zip(payloads, in_scan, strict=True)), np.uint8)
    values = raw.reshape(-1, UNIT).astype(np.int32) + 1
    lanes_of = -(-blocks // INTERVAL)
    first = np.cumsum(blocks) - blocks
    in_image = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.flatnonzero(in_image % INTERVAL == 0)  # first block of each restart interval
    dc = values[:, 0].copy()
    diff = np.diff(dc, prepend=0)
    diff[starts] = dc[starts]
    code, length = _AC[0][values], _AC[1][values]
    code[:, 0], length[:, 0] = _DC[0][diff + 256], _DC[1][diff + 256]
    code, length = code.ravel(), length.ravel()
    ends = np.cumsum(length)
    lane_bits = np.diff(np.append(ends[starts * UNIT] - length[starts * UNIT], ends[-1]))
    lane_bytes = -(-lane_bits // 8)
    lane_at = np.cumsum(lane_bytes) - lane_bytes
    lane_codes = np.diff(np.append(starts, len(values))) * UNIT
    shift = 8 * lane_at - (np.cumsum(lane_bits) - lane_bits)
    at = ends - length + np.repeat(shift, lane_codes)
    fill = 8 * lane_bytes - lane_bits  # ones up to the next whole byte
    at = np.concatenate([at, 8 * lane_at + lane_bits])
    code = np.concatenate([code, (1 << fill) - 1]).astype(np.uint64)
    length = np.concatenate([length, fill])
    word, place = at >> 5, at & 31
    both = code << (64 - place - length).astype(np.uint64)
    both[length == 0] = 0
    total = int(lane_bytes.sum())
    words = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), total // 4 + 2)
    words += np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), total // 4 + 2)[: len(words)]
    data = words.astype(">u4").view(np.uint8)[:total]
    # a zero after each 255, and a marker after each interval
    stuffed = data == 255
    lane = np.repeat(np.arange(len(lane_at)), lane_bytes)
    to = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * lane
    out = np.zeros(total + int(stuffed.sum()) + 2 * len(lane_at), np.uint8)
    out[to] = data
    marks = np.append(to[lane_at[1:]] - 2, len(out) - 2)
    number = (np.arange(len(lane_at)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)) % 8
    last = np.cumsum(lanes_of) - 1
    out[marks], out[marks + 1] = 255, 0xD0 + number
    out[marks[last] + 1] = 0xD9
    cuts = np.concatenate([[0], marks[last] + 2])
    scan = out.tobytes()
    return [scan[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Image:
    """A parsed file. A scan holds one minimum coded unit (mcu) after another; units names the component of each block of an mcu."""

    width: int
    height: int
    quant: np.ndarray  # of the luminance
    tables: tuple[bytes, ...]  # raw code tables: DC, AC of each component
    units: tuple[int, ...]
    sampling: tuple[int, int, int, int]  # of the luminance across and down, and the most of any component
    interval: int  # mcus
    comment: bytes
    scan: bytes
    coded: np.ndarray = field(default=None)  # blocks x 64 coefficients in zigzag order as they come, once decoded

    @property
    def mcus(self) -> tuple[int, int]:
        """Mcus across and down."""
        _, _, wide, high = self.sampling
        return -(-self.width // (8 * wide)), -(-self.height // (8 * high))

    @property
    def across(self) -> int:
        return -(-self.width * self.sampling[0] // (8 * self.sampling[2]))

    @property
    def down(self) -> int:
        return -(-self.height * self.sampling[1] // (8 * self.sampling[3]))

    @property
    def blocks(self) -> np.ndarray | None:
        """The luminance's blocks, row by row."""
        if self.coded is None or len(self.units) == 1:
            return self.coded
        (wide, high), (h, v) = self.mcus, self.sampling[:2]
        mine = self.coded.reshape(-1, len(self.units), UNIT)[:, [u == 0 for u in self.units]]
        return mine.reshape(high, wide, v, h, UNIT).transpose(0, 2, 1, 3, 4).reshape(high * v, wide * h, UNIT)[: self.down, : self.across].reshape(-1, UNIT)


def parse(data: bytes | None) -> Image | None:
    """The markers of a baseline JPEG file whose components share one scan; None if it is something else."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at, quants, huffman, frame, interval, comment = 2, {}, {}, None, 0, b""
    try:
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            lead, marker, length = struct.unpack_from(">BBH", data, at)
            if lead != 0xFF:
                return None
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                frame = struct.unpack(">BHHB", body[:6]), [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            elif marker == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                comment = body
            elif marker == 0xDA:
                (precision, height, width, n), components = frame
                if body[0] != n or precision != 8 or not width or not height or [c[0] for c in components] != list(body[1 : 1 + 2 * n : 2]):
                    return None
                chosen = body[2 : 2 + 2 * n : 2]
                tables = tuple(huffman[k] for c in chosen for k in (c >> 4, 16 | c & 15))
                sides = [(c[1] >> 4, c[1] & 15) for c in components] if n > 1 else [(1, 1)]  # a lone component's blocks aren't grouped
                units = tuple(i for i, (h, v) in enumerate(sides) for _ in range(h * v))
                most = max(h for h, _ in sides), max(v for _, v in sides)
                return Image(width, height, quants[components[0][2]], tables, units, (*sides[0], *most), interval, comment, data[at:])
            elif 0xC1 <= marker <= 0xCF or marker == 0xD9:
                return None
    except (struct.error, IndexError, KeyError, TypeError, ValueError):
        return None


_lookups: dict[tuple[bytes, ...], np.ndarray] = {}


def _tables(raw: tuple[bytes, ...]) -> np.ndarray:
    """The lookups of the code tables, one after the other."""
    if raw not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[raw] = np.concatenate([lookup(list(t[:16]), list(t[16:])) for t in raw])
    return _lookups[raw]


def decode(images: list[Image]) -> None:
    """Sets coded of images that share their code tables and units; None stays where the scan is broken."""
    if not images:
        return
    table, units = _tables(images[0].tables), np.array(images[0].units)
    joined = np.frombuffer(b"".join(i.scan for i in images), np.uint8)
    sizes = np.array([len(i.scan) for i in images])
    image_at = np.cumsum(sizes) - sizes
    ff = np.flatnonzero(joined[:-1] == 255)
    after = joined[ff + 1]
    ends = ff[(after >= 0xD0) & (after <= 0xD9)]  # markers end an interval; zeros after 255 are dropped
    of = np.searchsorted(image_at, ends, "right") - 1
    begins = np.where(np.diff(of, prepend=-1) > 0, image_at[of], np.append(0, ends[:-1] + 2))
    gone = np.zeros(len(joined), bool)
    gone[ff[after == 0] + 1] = True
    data = joined[~gone]
    begins = begins - np.concatenate([[0], np.cumsum(gone)])[begins]
    counts = np.array([i.mcus[0] * i.mcus[1] * len(units) for i in images])
    step = np.array([i.interval * len(units) or n for i, n in zip(images, counts, strict=True)])
    good = np.bincount(of, minlength=len(images)) == -(-counts // step)
    keep = good[of]
    of, begins = of[keep], begins[keep]
    first = np.cumsum(counts) - counts
    number = np.arange(len(of)) - np.searchsorted(of, of, "left")
    block0 = first[of] + number * step[of]
    todo = np.minimum(step[of], counts[of] - number * step[of])
    out = np.zeros((int(counts.sum()), UNIT), np.int32)
    flat = out.reshape(-1)
    # the next 64 bits from each byte on
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        window |= wide[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i)
    at, k = begins.astype(np.int64) * 8, np.zeros(len(of), np.int64)
    base, left, lane = block0 * UNIT, todo.copy(), np.arange(len(of))
    limit = 8 * len(data) + 56
    broken = np.zeros(len(of), bool)
    while len(lane):
        bits = window[np.minimum(at, limit - 1) >> 3] << (at & 7).astype(np.uint64)
        ac = k > 0
        which = ac.astype(np.int64)
        if len(units) > 1:
            which += 2 * units[(todo[lane] - left) % len(units)]
        found = table[(bits >> np.uint64(48)).astype(np.int64) + (which << 16)]
        length, run, size = found >> 8, (found >> 4) & 15, found & 15
        k += np.where(ac, run, 0)
        amount = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(amount >> np.maximum(size - 1, 0) > 0, amount, amount - (1 << size.astype(np.int64)) + 1)
        bad = (length == 0) | (at >= limit) | (k >= UNIT) & (size > 0)
        put = (size > 0) & ~bad
        flat[(base + k)[put]] = value[put]
        at += length + size
        k = np.where(ac & (size == 0) & (run < 15), UNIT, k + 1)
        over = k >= UNIT
        left -= over
        base += UNIT * over
        k[over] = 0
        if bad.any():
            broken[lane[bad]] = True
            left[bad] = 0
        stay = left > 0
        if not stay.all():
            at, k, base, left, lane = at[stay], k[stay], base[stay], left[stay], lane[stay]
    # a DC term is the difference from the component's last one in the interval
    order = np.repeat(np.arange(len(of)), todo)
    within = np.arange(len(order)) - np.repeat(np.cumsum(todo) - todo, todo)
    places = np.repeat(block0, todo) + within
    for c in range(int(units.max()) + 1):
        mine = units[within % len(units)] == c
        at_c, lane_c = places[mine], order[mine]
        dc = np.cumsum(out[at_c, 0].astype(np.int64))
        start = np.flatnonzero(np.diff(lane_c, prepend=-1) > 0)
        before = dc[start] - out[at_c[start], 0]
        out[at_c, 0] = dc - np.repeat(before, np.diff(np.append(start, len(lane_c))))
    good[of[broken]] = False
    for i, image in enumerate(images):
        if good[i]:
            image.coded = out[first[i] : first[i] + counts[i]]


def decode_long(image: Image, step: int) -> Iterator[np.ndarray | None]:
    """The blocks of a file of one component with restart intervals, about so many at a time; None, and an end, where the scan is broken."""
    data = np.frombuffer(image.scan, np.uint8)
    blocks = image.mcus[0] * image.mcus[1]
    start, done, at, marks = 0, 0, 0, []
    per_piece = max(1, step // image.interval)
    while done < blocks:
        while len(marks) < per_piece and at < len(data) - 1:
            window = data[at : at + STEP + 1]
            ff = np.flatnonzero(window[:-1] == 255)
            marks += (at + ff[(window[ff + 1] >= 0xD0) & (window[ff + 1] <= 0xD9)]).tolist()
            at += len(window) - 1
        if not marks:
            yield None
            return
        take = marks[:per_piece]
        n = min(len(take) * image.interval, blocks - done)
        piece = replace(image, width=8 * n, height=8, scan=image.scan[start : take[-1] + 2], coded=None)
        decode([piece])
        yield piece.coded
        if piece.coded is None:
            return
        start, done, marks = take[-1] + 2, done + n, marks[per_piece:]


def thumbnail(image: Image) -> np.ndarray:
    """One luminance sample (0 to 255) for each block, from its DC term alone."""
    return _samples(image.blocks, image).reshape(image.down, image.across)


def _samples(blocks: np.ndarray, image: Image) -> np.ndarray:
    return np.clip((blocks[:, 0] * int(image.quant[0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 samples of the thumbnail lie above their mean."""
    small = thumb[np.arange(8) * thumb.shape[0] // 8][:, np.arange(8) * thumb.shape[1] // 8].astype(np.int64)
    return np.packbits(64 * small > small.sum()).tobytes().hex()


def read(files: list[bytes | None]) -> list[Image | None]:
    """The images, decoded, of baseline JPEG files; None where a file is something else or broken."""
    images = [parse(f) for f in files]
    by: dict[tuple, list[Image]] = {}
    for i in images:
        if i is not None:
            by.setdefault((i.tables, i.units), []).append(i)
    for same in by.values():
        decode(same)
    return [i if i is not None and i.coded is not None else None for i in images]


def feature(image: Image, thumb: np.ndarray | None = None) -> str:
    thumb = thumbnail(image) if thumb is None else thumb
    return f"{image.width}x{image.height}:{average_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"


def payload(image: Image) -> bytes:
    """What write() stored."""
    units = int(image.comment.split()[1])
    return (image.coded[:units] - 1).astype(np.uint8).tobytes()


FIELDS = [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]


def _store_long(raw: bytes) -> tuple:
    """A row of FIELDS, and the file, for a text over STEP bytes: stored and read back piece by piece."""
    data = write_long(padded(raw))
    image = parse(data)
    units = int(image.comment.split()[1])
    got, left, tail, thumb = hashlib.sha256(), units, b"", []
    for coded in decode_long(image, STEP // UNIT):
        thumb.append(_samples(coded, image))
        piece = (coded[:left] - 1).astype(np.uint8).tobytes()
        got.update(piece)
        left, tail = left - min(left, len(coded)), piece[-UNIT:] or tail
    shown = feature(image, np.concatenate(thumb).reshape(image.down, image.across))
    return len(raw), (units - left) * UNIT, got.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), shown, data


def _store(texts: list[str | None], media: bool) -> list[list]:
    rows: list[tuple] = []
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    start = 0
    while start < len(raws):
        if len(raws[start]) > STEP:
            rows.append(_store_long(raws[start])[: None if media else -1])
            start += 1
            continue
        end, total = start, 0
        while end < len(raws) and (end == start or total + len(raws[end]) <= STEP):
            total += len(raws[end])
            end += 1
        files = write([padded(r) for r in raws[start:end]])
        for raw, data, image in zip(raws[start:end], files, read(files), strict=True):
            got = payload(image)
            rows.append((len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(image)) + (data,) * media)
        start = end
    return [list(c) for c in zip(*rows, strict=True)]


def store_texts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, media: bool = False) -> DataFrame:
    """docs with each text stored as JPEG and read back: FIELDS and, if asked for, media (binary). No shuffle."""
    return per_text(docs, text, FIELDS + [T.StructField("media", T.BinaryType())] * media, lambda: lambda texts: _store(texts, media), keep)


def read_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows (binary column media) with width, height, feature and thumbnail (bytes, a sample a block); nulls where it is no baseline JPEG."""
    import pyarrow as pa

    fields = [("width", T.IntegerType(), pa.int32()), ("height", T.IntegerType(), pa.int32()), ("feature", T.StringType(), pa.string()), ("thumbnail", T.BinaryType(), pa.binary())]
    source = rows.select(*[c for c in rows.columns if c.lower() not in {f[0] for f in fields}])
    schema = T.StructType(list(source.schema) + [T.StructField(n, t) for n, t, _ in fields])
    place = source.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        for batch in batches:
            for part in slices(batch, media, STEP):
                made = [(i.width, i.height, feature(i), thumbnail(i).tobytes()) if i else (None,) * 4 for i in read(part.column(place).to_pylist())]
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, (_, _, k) in zip(columns, fields, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
