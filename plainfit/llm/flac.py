"""FLAC media columns: encode, decode, verify, and PCM blocks that can be sought.

``encode_flac`` stores 8-bit samples as a FLAC stream (mono, constant, fixed and LPC subframes, Rice residuals, a
seek table); ``decode_flac`` reads streams into PCM blocks with the offset of their first sample.  Many frames are
decoded side by side: frames are found by their sync code and header checksum, each is a lane, and all lanes take
one Rice code and one prediction per step.  What the lanes don't cover (escape codes, other subframes or channel
layouts, a damaged frame) goes to the frame-by-frame decoder, which follows the public format in full for up to
24-bit samples.

Null media give one block row with no samples and the error "empty"; a stream whose frame checksum is wrong gives its
error and no samples from the bad frame on.  Null and empty texts are 64 bytes of 0.  Repeated rows give repeated
results, further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

BLOCK, PRECISION, LPC_ORDER, RATE = 1024, 12, 4, 8000
#: The fixed predictors' coefficients of orders 0 to 4 (fixed values of the format).
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def crc_table(poly: int, width: int) -> np.ndarray:
    """What each value of the next 8 bits (width 8) or 16 bits (width 16) does to a checksum of that width."""
    top, out = 1 << (width - 1), np.arange(1 << width, dtype=np.int64)
    for _ in range(width):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Checksums of the rows of a byte matrix; zeros in front of a row change nothing."""
    if width == 16:
        if rows.shape[1] % 2:
            rows = np.pad(rows, ((0, 0), (1, 0)))
        words, table = np.ascontiguousarray(rows).view(">u2").T.astype(np.int64), CRC16
    else:
        words, table = rows.T.astype(np.int64), CRC8
    crc = np.zeros(rows.shape[0], dtype=np.int64)
    for column in words:
        crc = table[crc ^ column]
    return crc


def right_aligned(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte matrix of the slices data[start : start + size], zeros in front."""
    wide = int(size.max(initial=1))
    index = start[:, None] + size[:, None] - wide + np.arange(wide)[None, :]
    return np.where(index >= start[:, None], data[np.clip(index, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)


def utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of the format (up to 36 bits)."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i) & 63) for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size & 0xFF) | (n >> (6 * (size - 1)) & (0xFF >> (size + 1))), *tail])


def predict(samples: np.ndarray, coefs: np.ndarray, shift: int | np.ndarray) -> np.ndarray:
    """Residuals of rows of samples; the first columns, as many as there are coefficients, hold none."""
    order = coefs.shape[1]
    guess = np.zeros_like(samples[:, order:])
    for j in range(order):
        guess += coefs[:, j : j + 1] * samples[:, order - 1 - j : samples.shape[1] - 1 - j]
    return samples[:, order:] - (guess >> np.asarray(shift).reshape(-1, 1))


def rice_bits(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row of folded residuals, of the three about its mean's bits, and the bits it takes."""
    n = folded.shape[1]
    total = folded.sum(axis=1, dtype=np.int64)
    middle = np.clip(np.frexp(total / n)[1] - 1, 0, 14)
    ks = np.clip(middle + np.array([[-1], [0], [1]]), 0, 14)
    costs = np.stack([(folded >> k[:, None].astype(folded.dtype)).sum(axis=1, dtype=np.int64) + (k + 1) * n for k in ks])
    best = costs.argmin(axis=0)
    rows = np.arange(len(folded))
    return ks[best, rows], costs[best, rows]


def lpc(samples: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """Quantised predictor coefficients of rows of samples by the autocorrelation method."""
    x = samples.astype(np.float64)
    auto = np.stack([(x[:, lag:] * x[:, : x.shape[1] - lag]).sum(axis=1) for lag in range(order + 1)], axis=1)
    index = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
    left = auto[:, index] + np.eye(order) * (auto[:, :1, None] * 1e-6 + 1e-3)
    coefs = np.linalg.solve(left, auto[:, 1:, None])[:, :, 0]
    shift = PRECISION - 3
    return np.clip(np.round(coefs * (1 << shift)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32), shift


def encode_rows(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames for the rows of a matrix of 8-bit samples."""
    count, n = samples.shape
    heads = []
    for number in numbers:
        standard = n == BLOCK
        head = bytes([0xFF, 0xF8, (0xA0 if standard else 0x70) | 4, 0x02]) + utf8_number(number) + (b"" if standard else struct.pack(">H", n - 1))
        heads.append(head)
    size = np.array([len(h) for h in heads])
    flat = np.frombuffer(b"".join(heads), np.uint8)
    crc = crc_rows(right_aligned(flat, np.cumsum(size) - size, size), 8)
    heads = [h + bytes([c]) for h, c in zip(heads, crc.tolist(), strict=True)]

    # The predictor is chosen by its residuals' sum, then the parameter by exact cost; no gain over plain samples: verbatim.
    samples = samples.astype(np.int32)
    coefs, shift = lpc(samples, LPC_ORDER) if n > 2 * LPC_ORDER else (None, 0)
    residuals = {}
    for order in range(6 if coefs is not None else min(4, n - 1) + 1):
        fixed = np.tile(np.array(FIXED[order], dtype=np.int32), (count, 1)).reshape(count, order) if order < 5 else coefs
        r = predict(samples, fixed, shift if order == 5 else 0)
        residuals[order] = (r << 1) ^ (r >> 31)
    orders = list(residuals)
    kind = np.array(orders)[np.stack([residuals[o].sum(axis=1, dtype=np.int64) + 8 * o for o in orders]).argmin(axis=0)]
    folded_of, k_all = {}, np.zeros(count, dtype=np.int64)
    for order in orders:
        rows = np.flatnonzero(kind == order)
        if not len(rows):
            continue
        folded_of[order] = residuals[order][rows]
        k_all[rows], bits = rice_bits(folded_of[order])
        head = (8 + PRECISION) * LPC_ORDER + 19 if order == 5 else 8 * order + 10
        keep = bits + head < 8 * n
        folded_of[order] = folded_of[order][keep]
        kind[rows[~keep]] = -1
    same = (samples == samples[:, :1]).all(axis=1)
    for order in folded_of:
        folded_of[order] = folded_of[order][~same[kind == order]]
    kind[same] = 9

    frames: list[bytes] = [b""] * count
    for order in set(kind.tolist()):
        rows = np.flatnonzero(kind == order)
        if order in (-1, 9):
            for r in rows:
                body = (samples[r, :1] if order == 9 else samples[r]).astype(np.int8).tobytes()
                frames[r] = heads[r] + bytes([0x00 if order == 9 else 0x02]) + body
            continue
        used = LPC_ORDER if order == 5 else order
        sub = ((0x20 | used - 1) if order == 5 else 0x08 | order) << 1
        folded, k = folded_of[order], k_all[rows].astype(np.int32)
        quotient = folded >> k[:, None]
        length = quotient + 1 + k[:, None]
        prefix = [np.unpackbits(np.frombuffer(heads[r] + bytes([sub]) + samples[r, :used].astype(np.int8).tobytes(), np.uint8)) for r in rows]
        if order == 5:
            tail = np.concatenate([np.tile(np.array([PRECISION - 1 >> i & 1 for i in (3, 2, 1, 0)] + [shift >> i & 1 for i in (4, 3, 2, 1, 0)]), (len(rows), 1)), (coefs[rows][:, :, None] >> np.arange(PRECISION - 1, -1, -1) & 1).reshape(len(rows), -1)], axis=1)
        else:
            tail = np.zeros((len(rows), 0), dtype=np.int64)
        tail = np.concatenate([tail, np.zeros((len(rows), 6), dtype=np.int64), k[:, None] >> np.array([3, 2, 1, 0]) & 1], axis=1).astype(np.uint8)
        lead = np.array([len(p) for p in prefix]) + tail.shape[1]
        total = -(-(lead + length.sum(axis=1)) // 8)
        begin = np.cumsum(total) - total
        # A code's one bit and remainder are at most 16 bits, which three bytes hold wherever they begin; the zeros before are there.
        at = (8 * begin + lead)[:, None] + np.cumsum(length, axis=1) - 1 - k[:, None]
        value = ((folded & ((1 << k[:, None]) - 1)) | (1 << k[:, None])) << (23 - (at & 7) - k[:, None])
        at >>= 3
        size = int(total.sum())
        packed = sum(np.bincount((at + j).ravel(), ((value >> (16 - 8 * j)) & 255).ravel(), size + 3) for j in range(3))[:size].astype(np.uint8)
        for p, t, b, e in zip(prefix, tail, begin.tolist(), (begin + total).tolist(), strict=True):
            first = np.packbits(np.concatenate([p, t]))
            packed[b : b + len(first)] |= first
        packed = packed.tobytes()
        for r, b, t in zip(rows, begin.tolist(), total.tolist(), strict=True):
            frames[r] = packed[b : b + t]
    size = np.array([len(f) for f in frames])
    flat = np.frombuffer(b"".join(frames), np.uint8)
    crc = crc_rows(right_aligned(flat, np.cumsum(size) - size, size), 16)
    return [f + struct.pack(">H", c) for f, c in zip(frames, crc.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads of at least 16 bytes; byte b is the sample b - 128."""
    by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, payload in enumerate(payloads):
        samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        for f, at in enumerate(range(0, len(samples), BLOCK)):
            by_size.setdefault(min(BLOCK, len(samples) - at), []).append((i, f, samples[at : at + BLOCK]))
    frames: dict[int, dict[int, bytes]] = {}
    for group in by_size.values():
        for at in range(0, len(group), 512):
            part = group[at : at + 512]
            for (i, f, _), frame in zip(part, encode_rows(np.stack([s for _, _, s in part]), [f for _, f, _ in part]), strict=True):
                frames.setdefault(i, {})[f] = frame
    out = []
    for i, payload in enumerate(payloads):
        own = [frames[i][f] for f in range(len(frames.get(i, {})))]
        sizes = [len(f) for f in own]
        points = range(0, len(own), 16)
        table = b"".join(struct.pack(">QQH", p * BLOCK, sum(sizes[:p]), min(BLOCK, len(payload) - p * BLOCK)) for p in points)
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8) + md5
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(table).to_bytes(3) + table + b"".join(own))
    return out


class Bits:
    """A reader of single values for the frame-by-frame decoder."""

    def __init__(self, data: bytes, byte: int):
        self.data, self.pos = data, 8 * byte

    def take(self, n: int) -> int:
        if self.pos + n > 8 * len(self.data):
            raise ValueError("truncated")
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        value = int.from_bytes(self.data[a:b]) >> (8 * b - self.pos - n)
        self.pos += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def crc_bytes(data: bytes, width: int) -> int:
    return int(crc_rows(np.frombuffer(data, np.uint8)[None, :], width)[0])


def frame_header(data: bytes, at: int, depth: int) -> tuple[int, int, int, int, int] | None:
    """(number, samples, channel assignment, bits, first byte after) if a header with a right checksum starts at ``at``."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    code, rate, channels, bits = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    lead, p = data[at + 4], at + 5
    more = 0 if lead < 128 else 8 - (~lead & 0xFF).bit_length() - 1
    number = lead if not more else lead & ((1 << (6 - more)) - 1) if more < 6 else 0
    if not code or rate == 15 or channels > 10 or bits == 3 or lead >> 6 == 2 or len(data) < p + more + 5:
        return None
    for byte in data[p : p + more]:
        number = number << 6 | byte & 63
    p += more
    n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << max(0, code - 8)
    if code in (6, 7):
        n, p = int.from_bytes(data[p : p + code - 5]) + 1, p + code - 5
    p += (0, 1, 2, 2)[max(0, rate - 11)] if rate in (12, 13, 14) else 0
    if crc_bytes(data[at:p], 8) != data[p]:
        return None
    return number, n, channels, (depth, 8, 12, 0, 16, 20, 24, 32)[bits], p + 1


def decode_frame(data: bytes, at: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples (channels, n) of the frame at ``at`` and the byte after it; errors are ValueError."""
    if (head := frame_header(data, at, depth)) is None:
        raise ValueError("bad frame header")
    _, n, layout, depth, p = head
    bits, channels = Bits(data, p), []
    for c in range(layout + 1 if layout < 8 else 2):
        width = depth + ((layout, c) in ((8, 1), (9, 0), (10, 1)))
        kind = bits.take(8)
        wasted = bits.unary() + 1 if kind & 1 else 0
        width, kind = width - wasted, kind >> 1
        if kind == 0:
            x = [bits.signed(width)] * n
        elif kind == 1:
            x = [bits.signed(width) for _ in range(n)]
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            x = [bits.signed(width) for _ in range(order)]
            coefs, shift = FIXED[order] if kind < 32 else [], 0
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                coefs = [bits.signed(precision) for _ in range(order)]
            method, parts = bits.take(2), bits.take(4)
            if method > 1 or n % (1 << parts):
                raise ValueError("bad residual")
            for part in range(1 << parts):
                k = bits.take(4 + method)
                raw = bits.take(5) if k == 15 + 16 * method else -1
                for _ in range((n >> parts) - order * (part == 0)):
                    if raw >= 0:
                        r = bits.signed(raw)
                    else:
                        u = bits.unary() << k | bits.take(k)
                        r = u >> 1 ^ -(u & 1)
                    guess = sum(a * b for a, b in zip(coefs, reversed(x), strict=False))
                    x.append(r + (guess >> shift if shift >= 0 else guess << -shift))
        else:
            raise ValueError("reserved subframe")
        channels.append(np.array(x, dtype=np.int64) << wasted)
    end = (bits.pos + 7) // 8
    if len(data) < end + 2 or crc_bytes(data[at:end], 16) != int.from_bytes(data[end : end + 2]):
        raise ValueError("frame checksum")
    if layout == 8:
        channels[1] = channels[0] - channels[1]
    elif layout == 9:
        channels[0] = channels[0] + channels[1]
    elif layout == 10:
        mid, side = channels
        mid = mid << 1 | side & 1
        channels = [(mid + side) >> 1, (mid - side) >> 1]
    return np.stack(channels), end + 2


def stream_info(data: bytes) -> tuple[int, int, int, bytes, int]:
    """(channels, bits, samples, md5, first byte of the frames)."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 127:
        raise ValueError("not FLAC")
    packed, at, last = int.from_bytes(data[18:26]), 4, False
    while not last:
        if at + 4 > len(data):
            raise ValueError("truncated")
        last, at = bool(data[at] & 128), at + 4 + int.from_bytes(data[at + 1 : at + 4])
    return (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), data[26:42], at


CLZ = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)


def decode_lanes(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Samples of many mono 8-bit subframes, None where a lane needs the other decoder; and the byte after each."""
    raw = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
    words = np.zeros(len(raw) - 8, dtype=np.uint64)
    for k in range(8):
        words |= raw[k : len(raw) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    top = len(words) - 1

    def look(pos):
        return words.take(pos >> 3, mode="clip") << (pos & 7).view(np.uint64)

    def bits(pos, count):
        return (look(pos) >> np.uint64(64 - count)).astype(np.int64)

    def signed(pos, count):
        value = bits(pos, count)
        return value - (value >> (count - 1) << count)

    out: list[np.ndarray | None] = [None] * len(start)
    end = np.zeros(len(start), dtype=np.int64)
    kind = raw[start]
    for code in np.unique(kind).tolist():
        lanes = np.flatnonzero(kind == code)
        lanes = lanes[np.argsort(-n[lanes], kind="stable")]
        pos, count = 8 * (start[lanes] + 1), n[lanes]
        if code in (0, 2):
            for i, p, m in zip(lanes, pos >> 3, count, strict=True):
                x = raw[p : p + (m if code else 1)].view(np.int8).astype(np.int64)
                out[i], end[i] = (x if code else np.repeat(x, m)), p + (m if code else 1)
            continue
        is_lpc, order = code >= 64, (code >> 1) - 31 if code >= 64 else (code >> 1) - 8
        if code & 1 or not is_lpc and not 0 <= order <= 4:
            continue
        ok = count > order
        x = np.zeros((int(count.max()), len(lanes)), dtype=np.int64)
        for i in range(order):
            x[i], pos = signed(pos, 8), pos + 8
        if is_lpc:
            precision, shift, pos = bits(pos, 4) + 1, signed(pos + 4, 5), pos + 9
            ok &= (shift >= 0) & (precision < 16)
            coefs = []
            for _ in range(order):
                value = (look(pos) >> (64 - precision).astype(np.uint64)).astype(np.int64)
                coefs.append(value - (value >> (precision - 1) << precision))
                pos = pos + precision
            shift = np.maximum(shift, 0)
        else:
            shift, coefs = np.zeros(len(lanes), dtype=np.int64), [np.full(len(lanes), c) for c in FIXED[order]]
        parts = np.int64(1) << bits(pos + 2, 4)
        ok &= (bits(pos, 2) == 0) & (count % parts == 0) & (count // parts > order)
        pos, each = pos + 6, count // np.where(ok, parts, 1)
        k, turn = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
        turn[:] = order
        steps = len(lanes) - np.cumsum(np.bincount(count, minlength=int(count.max()) + 1))
        one = np.uint64(1)
        for i in range(order, len(x)):
            m = int(steps[i])
            p, kk = pos[:m], k[:m]
            if len(new := np.flatnonzero(turn[:m] == i)):
                kk[new] = bits(p[new], 4)
                ok[new] &= kk[new] < 15
                p[new] += 4
                turn[new] = np.where(i == order, each[new], i + each[new])
            w = look(p)
            q = CLZ.take((w >> np.uint64(48)).view(np.int64))
            if (q == 16).any() or (q + kk).max() > 55:
                long = np.flatnonzero(q == 16)
                while len(long):
                    more = CLZ[bits(p[long] + q[long], 16)]
                    q[long] += more
                    long = long[(more == 16) & (p[long] + q[long] < 8 * top)]
                p += q + 1
                w = look(p)
            else:
                q1 = q + 1
                w <<= q1.view(np.uint64)
                p += q1
            w >>= one
            w >>= (63 - kk).view(np.uint64)
            u = (q << kk) | w.view(np.int64)
            p += kk
            guess = np.zeros(m, dtype=np.int64)
            for j, c in enumerate(coefs):
                guess += c[:m] * x[i - 1 - j, :m]
            x[i, :m] = ((u >> 1) ^ -(u & 1)) + (guess >> shift[:m])
        end[lanes] = (pos + 7) >> 3
        columns = x.T
        for j, (i, m, good) in enumerate(zip(lanes.tolist(), count.tolist(), ok.tolist(), strict=True)):
            out[i] = columns[j, :m].copy() if good else None
    return out, end


def decode(streams: list[bytes]) -> list[tuple[list[tuple[int, np.ndarray]], str]]:
    """For each stream its blocks (first sample, samples by channel) and "" or what is wrong with it."""
    found: list[tuple[int, int, int, int, int]] = []  # stream, frame's byte, samples, byte of the subframe, next frame
    info, offset, at = [], [], 0
    for s, data in enumerate(streams):
        offset.append(at)
        at += len(data)
        try:
            info.append(stream_info(data))
        except ValueError as e:
            info.append(str(e))
            continue
        channels, depth, _, _, begin = info[s]
        if channels > 1 or depth != 8:
            continue
        body, expected, own = np.frombuffer(data, np.uint8), 0, []
        for p in (np.flatnonzero((body[begin:-1] == 0xFF) & (body[begin + 1 :] == 0xF8)) + begin).tolist():
            if (own or p == begin) and (head := frame_header(data, p, depth)) and head[0] == expected and head[2:4] == (0, 8):
                own.append((p, head[1], head[4]))
                expected += 1
        ends = [p for p, _, _ in own[1:]] + [len(data)]
        found += [(s, p, n, q, e) for (p, n, q), e in zip(own, ends, strict=True)]
    lanes: dict[int, list[tuple[int, int, np.ndarray | None]]] = {}
    if found:
        raw = np.frombuffer(b"".join(streams), np.uint8)
        s, p, n, q, e = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        base = np.array(offset, dtype=np.int64)[s]
        samples, end = decode_lanes(raw, base + q, n)
        stored = raw[base + e - 2].astype(np.int64) << 8 | raw[base + e - 1]
        good = (crc_rows(right_aligned(raw, base + p, e - 2 - p), 16) == stored) & (end == base + e - 2)
        for i, x in enumerate(samples):
            lanes.setdefault(int(s[i]), []).append((int(n[i]), int(e[i]), x if good[i] else None))
    out = []
    for s, data in enumerate(streams):
        if isinstance(info[s], str):
            out.append(([], info[s]))
            continue
        _, depth, total, md5, begin = info[s]
        blocks, first, error, own = [], 0, "", lanes.get(s, [])
        if own and all(x is not None for _, _, x in own) and sum(n for n, _, _ in own) == total:
            for n, _, x in own:
                blocks.append((first, x[None, :]))
                first += n
        else:
            p = begin
            while p < len(data):
                try:
                    x, p = decode_frame(data, p, depth)
                except ValueError as e:
                    error = str(e)
                    break
                blocks.append((first, x))
                first += x.shape[1]
        if not error and first != total:
            error = "samples missing"
        if not error and any(md5):
            width = (depth + 7) // 8
            pcm = np.concatenate([x for _, x in blocks], axis=1).T.astype("<i8") if blocks else np.empty((0, 1), "<i8")
            if hashlib.md5(np.ascontiguousarray(pcm).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest() != md5:
                error = "md5"
        out.append((blocks, error))
    return out


def padded(text: str | None) -> bytes:
    """UTF-8 of a text, filled with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def batches_by_bytes(batch: pa.RecordBatch, column: int, limit: int = 3 << 20):
    """Slices of a batch with about ``limit`` bytes in a column, a row at least."""
    sizes = [len(x) if (x := v.as_py()) is not None else 0 for v in batch.column(column)]
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode_flac(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_bytes, media): each text's padded bytes as a FLAC stream."""

    def run(batches):
        for big in batches:
            for batch in batches_by_bytes(big, 1):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                media = encode([padded(x) for x in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def pcm_of(x: np.ndarray, depth: int) -> bytes:
    """Interleaved little-endian signed samples of the least whole bytes."""
    return np.ascontiguousarray(x.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : (depth + 7) // 8].tobytes()


def decode_flac(df: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """PCM blocks (id, block, first_sample, n_samples, channels, bits, pcm, error), to be written as a table that seeks by (id, first_sample)."""
    schema = "id long, block int, first_sample long, n_samples long, channels int, bits int, pcm binary, error string"

    def run(batches):
        for big in batches:
            for batch in batches_by_bytes(big, 1):
                rows = []
                media = [x or b"" for x in batch.column(1).to_pylist()]
                for key, data, (blocks, error) in zip(batch.column(0).to_pylist(), media, decode(media), strict=True):
                    depth = stream_info(data)[1] if blocks else None
                    rows += [(key, i, first, x.shape[1], x.shape[0], depth, pcm_of(x, depth), error) for i, (first, x) in enumerate(blocks)] or [(key, 0, 0, 0, None, None, b"", error if data else "empty")]
                cols = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(run, schema)


def media_features(df: DataFrame, digest, schema: str) -> DataFrame:
    """Rows that ``digest(id, n_bytes, media, blocks, error)`` makes of ``encode_flac``'s rows by decoding the stored bytes."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        for big in batches:
            for batch in batches_by_bytes(big, 2):
                media = batch.column(2).to_pylist()
                rows = [digest(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), media, *zip(*decode(media), strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    return df.mapInArrow(run, schema)
