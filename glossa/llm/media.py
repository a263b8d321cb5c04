"""Media columns: progressive JPEG streams held as binary columns.

A stream is decoded scan by scan: every scan (spectral selection Ss..Se, successive approximation Ah/Al)
adds to integer coefficient arrays; the inverse transform, chroma upsampling and colour conversion run in numpy
and give a full-resolution RGB tensor (height, width, 3).

Payload packing is lossless: the unit is the quantised DCT coefficient. Each run of 64 bytes is one 8x8 block, byte b is
the coefficient b (b >= 128) or b - 255 (b < 128), so that every coefficient has category 8 and every Huffman code of
the stream has a known width. The blocks fill luma first, then the two chroma components, which have half the
resolution both ways. Such scans are packed and unpacked by whole arrays; any other progressive stream (EOB runs, zero
runs, newly non-zero coefficients in refinements, several components a scan) takes the sequential path.

Defined results: null bytes count as empty; an empty payload is one block of zeros; truncated or non-progressive
streams raise ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 64


def _zigzag() -> np.ndarray:
    """Natural (row-major) index of each zigzag position: diagonals, alternately upwards and downwards."""
    order = sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8))
    return np.array(order)


ZIGZAG = _zigzag()


def _idct_matrix() -> np.ndarray:
    """64 zigzag coefficients to 64 samples of a block, as one matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    full = np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)  # rows: natural coefficient u*8+v
    return full[ZIGZAG].astype(np.float32)


IDCT = _idct_matrix()


# ---------------------------------------------------------------- payload packing


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _dht(kind: int, slot: int, length: int, symbol: int) -> bytes:
    """A Huffman table with the one code 0...0 of that length."""
    counts = [0] * 16
    counts[length - 1] = 1
    return _marker(0xC4, bytes([kind << 4 | slot, *counts, symbol]))


def _sos(component: int, tables: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _marker(0xDA, bytes([1, component, tables, ss, se, ah << 4 | al]))


def _stuffed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _dc_segments(first: np.ndarray) -> bytes:
    """One restart interval a block: code 00000000 (category 8), the value's byte, RSTm between blocks."""
    n = len(first)
    cells = np.zeros((n, 5), np.uint8)
    cells[:, 1] = first
    cells[:, 3] = 0xFF
    cells[:, 4] = 0xD0 + np.arange(n) % 8
    keep = np.ones((n, 5), bool)
    keep[:, 2] = first == 0xFF  # the stuffed zero
    keep[-1, 3:] = False
    return cells[keep].tobytes()


def pack_payload(data: bytes) -> bytes:
    """A progressive YCbCr 4:2:0 JPEG whose coefficients are the bytes of data, zero-padded to whole 16x16 units of six blocks."""
    blocks = max(1, -(-len(data) // BLOCK))
    units = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(units)))
    n = across * -(-units // across)
    coded = np.zeros((6 * n, BLOCK), np.uint8)
    coded.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    width, height = 16 * across, 16 * (n // across)
    if width > 0xFFFF:
        raise ValueError("payload beyond one image")
    parts = list(enumerate((coded[: 4 * n], coded[4 * n : 5 * n], coded[5 * n :]), 1))
    out = [
        b"\xff\xd8",
        _marker(0xEF, b"PAYLOAD\0" + struct.pack(">QQ", len(data), blocks * BLOCK)),
        _marker(0xDB, bytes([0, *[1] * 64])),
        _marker(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _dht(0, 0, 8, 8) + _marker(0xDD, b"\0\1"),
    ]
    out += [_sos(c, 0x00, 0, 0, 0, 0) + _dc_segments(part[:, 0]) for c, part in parts]
    out.append(_marker(0xDD, b"\0\0") + _dht(1, 0, 1, 7))
    out += [_sos(c, 0x00, lo, hi, 0, 1) + (part[:, lo : hi + 1] >> 1).tobytes() for lo, hi in ((1, 5), (6, 63)) for c, part in parts]
    out.append(_dht(1, 1, 1, 0))
    for c, part in parts:
        bits = np.zeros((len(part), BLOCK), np.uint8)
        bits[:, 1:] = (part[:, 1:] & 1) ^ (part[:, 1:] < 128)
        out.append(_sos(c, 0x01, 1, 63, 1, 0) + _stuffed(np.packbits(bits, axis=1)))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- decoding


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (counts.index(1) + 1, symbols[0]) if sum(counts) == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("truncated scan")
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")


def _extend(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def _split_restarts(data: bytes) -> list[bytes]:
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[start:]]


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.coefficients = np.zeros((0, 64), np.int32)
        self.across = self.down = self.wide = 0


class Decoded:
    """Coefficient arrays (blocks in raster order, zigzag coefficients), sizes and the payload header, if any."""

    def __init__(self) -> None:
        self.width = self.height = 0
        self.components: list[_Component] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.payload: tuple[int, int] | None = None
        self.scans = 0


def _ac_first(bits: _Bits, block: np.ndarray, table: _Huffman, ss: int, se: int, al: int, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        r, s = divmod(bits.symbol(table), 16)
        if s:
            k += r
            block[k] = _extend(bits.take(s), s) * (1 << al)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + bits.take(r) - 1
    return 0


def _ac_refine(bits: _Bits, block: np.ndarray, table: _Huffman, ss: int, se: int, al: int, run: int) -> int:
    step, k = 1 << al, ss

    def correct(i: int) -> None:
        if bits.take(1):
            block[i] += step if block[i] > 0 else -step

    if not run:
        while k <= se:
            r, s = divmod(bits.symbol(table), 16)
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (step if bits.take(1) else -step) if s else 0
            while k <= se:
                if block[k]:
                    correct(k)
                elif r == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run:
        for i in range(k, se + 1):
            if block[i]:
                correct(i)
        return run - 1
    return 0


def _whole_arrays(c: _Component, data: bytes, dc: _Huffman | None, ac: _Huffman | None, ss: int, se: int, ah: int, al: int, interval: int) -> bool:
    """Scans whose codes all have one width, by arrays. False: not such a scan."""
    n, table = c.across * c.down, dc if ss == 0 else ac
    if c.wide != c.across or (ah and ss == 0) or not table or not table.only:
        return False
    length, symbol = table.only
    rows = c.coefficients[:n]
    if ss == 0 and interval == 1 and length == 8 and symbol == 8:
        # A value is never marker-like: after its code 00, FF is stuffed and the next FF begins RSTm.
        raw = np.frombuffer(data.replace(b"\x00\xff\x00", b"\x00\xff"), np.uint8)
        if len(raw) != 4 * n - 2:
            return False
        value = raw[1::4].astype(np.int32)
        rows[:, 0] = np.where(value >= 128, value, value - 255) * (1 << al)
        return True
    if ss and ah == 0 and length == 1 and symbol == 7 and len(data) == n * (se - ss + 1):
        value = np.frombuffer(data, np.uint8).reshape(n, -1).astype(np.int32)
        rows[:, ss : se + 1] = np.where(value >= 64, value, value - 127) * (1 << al)
        return True
    if ss == 1 and se == 63 and ah and length == 1 and symbol == 0 and rows[:, 1:].all():
        raw = data.replace(b"\xff\x00", b"\xff")
        if len(raw) != 8 * n:
            return False
        bit = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(n, 64)[:, 1:].astype(np.int32)
        rows[:, 1:] += np.sign(rows[:, 1:]) * bit * (1 << al)
        return True
    return False


def _scan(picture: Decoded, part: list[tuple[_Component, _Huffman | None, _Huffman | None]], data: bytes, ss: int, se: int, ah: int, al: int, interval: int) -> None:
    if len(part) == 1 and _whole_arrays(part[0][0], data, part[0][1], part[0][2], ss, se, ah, al, interval):
        return
    if len(part) == 1:
        c = part[0][0]
        units = [[(0, y * c.wide + x)] for y in range(c.down) for x in range(c.across)]
    else:
        hmax, vmax = (max(getattr(c, k) for c in picture.components) for k in "hv")
        mx, my = -(-picture.width // (8 * hmax)), -(-picture.height // (8 * vmax))
        units = [[(i, (y * c.v + dy) * c.wide + x * c.h + dx) for i, (c, _, _) in enumerate(part) for dy in range(c.v) for dx in range(c.h)] for y in range(my) for x in range(mx)]
    pieces = _split_restarts(data) if interval else [data]
    for piece, start in zip(pieces, range(0, len(units), interval or len(units)), strict=False):
        bits, run, last = _Bits(piece), 0, [0] * len(part)
        for unit in units[start : start + (interval or len(units))]:
            for i, at in unit:
                c, dc, ac = part[i]
                block = c.coefficients[at]
                if ss == 0 and ah:
                    block[0] |= bits.take(1) << al
                elif ss == 0:
                    size = bits.symbol(dc)
                    last[i] += _extend(bits.take(size), size)
                    block[0] = last[i] * (1 << al)
                elif ah:
                    run = _ac_refine(bits, block, ac, ss, se, al, run)
                else:
                    run = _ac_first(bits, block, ac, ss, se, al, run)


def _entropy_end(data: bytes, at: int) -> int:
    """Where the next marker other than RSTm begins."""
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2
    raise ValueError("truncated stream")


def decode(data: bytes) -> Decoded:
    """Accumulate all scans of a progressive stream into coefficient arrays. A broken stream raises ValueError."""
    try:
        return _decoded(data)
    except (IndexError, KeyError, StopIteration, AttributeError, struct.error) as e:
        raise ValueError("broken stream") from e


def _decoded(data: bytes) -> Decoded:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    out, tables, interval, at = Decoded(), {}, 0, 2
    while at + 4 <= len(data):
        code, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif code == 0xC2:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.components = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            hmax, vmax = (max(getattr(c, k) for c in out.components) for k in "hv")
            for c in out.components:
                c.across, c.down = -(-(-(-out.width * c.h // hmax)) // 8), -(-(-(-out.height * c.v // vmax)) // 8)
                full, deep = -(-out.width // (8 * hmax)) * c.h, -(-out.height // (8 * vmax)) * c.v
                c.wide = full
                c.coefficients = np.zeros((max(c.wide * c.down, full * deep), 64), np.int32)
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive stream")
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif code == 0xEF and body.startswith(b"PAYLOAD\0"):
            out.payload = struct.unpack_from(">QQ", body, 8)
        elif code == 0xDA:
            end, n = _entropy_end(data, at), body[0]
            part = [(next(c for c in out.components if c.ident == body[i]), tables.get(body[i + 1] >> 4), tables.get(0x10 | body[i + 1] & 15)) for i in range(1, 1 + 2 * n, 2)]
            _scan(out, part, data[at:end], body[-3], body[-2], body[-1] >> 4, body[-1] & 15, interval)
            out.scans += 1
            at = end
        if data[at : at + 2] == b"\xff\xd9":
            return out
    raise ValueError("truncated stream")


def unpack_payload(picture: Decoded) -> tuple[int, bytes]:
    """Unpadded length and the payload padded to whole blocks, read from the coefficients."""
    if picture.payload is None:
        raise ValueError("no payload in this stream")
    length, padded = picture.payload
    value = np.concatenate([c.coefficients.reshape(-1) for c in picture.components])[:padded]
    return length, np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()


def _plane(picture: Decoded, c: _Component) -> np.ndarray:
    """Samples of a component at its own resolution, before cropping."""
    quantiser = picture.quantisers.get(c.table)
    scaled = c.coefficients[: c.wide * c.down].astype(np.float32)
    if quantiser is not None and (quantiser != 1).any():
        scaled *= quantiser
    samples = scaled @ IDCT
    samples += 128
    return samples.reshape(c.down, c.wide, 8, 8).swapaxes(1, 2).reshape(c.down * 8, c.wide * 8)


def to_rgb(picture: Decoded) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3) of uint8; chroma is upsampled by repetition."""
    hmax, vmax = (max(getattr(c, k) for c in picture.components) for k in "hv")
    planes = []
    for c in picture.components:
        p = _plane(picture, c)
        for axis, times in ((0, vmax // c.v), (1, hmax // c.h)):
            if times > 1:
                p = np.repeat(p, times, axis)
        planes.append(p[: picture.height, : picture.width])
    y = planes[0]
    out = np.empty((picture.height, picture.width, 3), np.uint8)
    if len(planes) == 1:
        channels = [y, y, y]
    else:
        cb, cr = planes[1] - 128, planes[2] - 128
        channels = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    for i, x in enumerate(channels):
        out[..., i] = np.clip(np.rint(x), 0, 255)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths and an eight-bin histogram of green, as text."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])
    bins = np.bincount(rgb[..., 1].reshape(-1) >> 5, minlength=8)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(map(str, means)) + ";" + ",".join(map(str, bins))
