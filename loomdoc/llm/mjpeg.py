"""Motion-JPEG in AVI files as media columns: store payloads losslessly, parse RIFF, decode intra frames, find shots.

*Writing.* A payload is stored in the quantised coefficients of baseline JPEG frames, 64 bytes to an 8 x 8 block. The one
Huffman code of each table stands for "no zeros, eight magnitude bits", so the magnitude bits of a coefficient are a payload
byte as it is; a restart marker follows every block, which keeps the DC prediction at zero. The frames are ordinary
baseline JPEG (grey, quantisation 1) and the file an ordinary AVI with an idx1 index.

*Reading.* Frames are found through the idx1 index, or by walking the movi list where there is none. All restart intervals
of a batch of frames are decoded in step by numpy: one Huffman symbol of each interval at a time. Any baseline grey or
colour JPEG with Huffman coding is read; of colour frames the histograms take the first component.

*Shots.* The grey histograms of following frames differ by some amount; a cut is where that reaches a threshold that adapts
to the mean and deviation of the differences around it.

Cases: null text counts as empty (a payload of 64 zero bytes); files that are not AVI, or hold damaged frames, give a row
with ``error``. Equal texts give equal files and features. Repeated rows stay apart. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Zigzag scan: place in the 8 x 8 block (row * 8 + column) of the k-th coefficient. By its rule: along the antidiagonals, by turns up and down.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
BLOCK_BYTES = 64
#: Blocks in a row of a frame, and rows of blocks in a full frame.
ACROSS, DOWN = 8, 8
FRAME_BLOCKS = ACROSS * DOWN
MICROSECONDS = 40_000
#: Huffman symbol "no zeros before, eight magnitude bits".
EIGHT_BITS = 8


class MediaError(ValueError):
    pass


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head(rows: int) -> bytes:
    table = bytes([1] + [0] * 15 + [EIGHT_BITS])  # one code of one bit
    return (
        b"\xff\xd8"
        + segment(0xDB, bytes([0]) + bytes([1] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
        + segment(0xC4, bytes([0x00]) + table)
        + segment(0xC4, bytes([0x10]) + table)
        + segment(0xDD, struct.pack(">H", 1))
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def coded_blocks(payload: bytes) -> list[bytes]:
    """Entropy-coded bytes of each block of 64 bytes: per coefficient the code ``0`` and the byte's eight bits."""
    a = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 8, 8).astype(np.uint64)
    # eight times nine bits are nine bytes
    out = np.zeros((a.shape[0], 8, 9), dtype=np.uint8)
    for j in range(8):
        at = 9 * j + 1  # the byte's first bit
        value = a[:, :, j] << np.uint64(8 - at % 8)
        out[:, :, at // 8] |= (value >> np.uint64(8)).astype(np.uint8)
        if at % 8:
            out[:, :, at // 8 + 1] |= (value & np.uint64(255)).astype(np.uint8)
    flat = out.reshape(a.shape[0], -1).tobytes()
    step = out.shape[1] * out.shape[2]
    blocks = [flat[i : i + step] for i in range(0, len(flat), step)]
    return [b.replace(b"\xff", b"\xff\x00") if b"\xff" in b else b for b in blocks]


RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def frame_rows(size: int) -> int:
    """Rows of blocks in each frame of a payload of ``size`` bytes."""
    blocks = size // BLOCK_BYTES
    frames = -(-blocks // FRAME_BLOCKS)
    return -(-blocks // (frames * ACROSS))


def filled(data: bytes) -> tuple[bytes, bytes]:
    """``data`` zero-padded to a positive multiple of 64 bytes, and the zero bytes that fill its last frame."""
    padded = data + bytes(-len(data) % BLOCK_BYTES or (0 if data else BLOCK_BYTES))
    return padded, bytes(-len(padded) % (frame_rows(len(padded)) * ACROSS * BLOCK_BYTES))


def jpeg_frames(blocks: list[bytes], rows: int) -> list[bytes]:
    """Frames of 64 samples across and ``rows`` blocks down."""
    head, out, step = frame_head(rows), [], rows * ACROSS
    marks = (RESTARTS * (-(-step // 8)))[: step - 1] + [b"\xff\xd9"]
    for start in range(0, len(blocks), step):
        parts = [b""] * (2 * step)
        parts[::2], parts[1::2] = blocks[start : start + step], marks
        out.append(head + b"".join(parts))
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(frames: list[bytes], width: int, height: int, comment: bytes = b"") -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", MICROSECONDS, largest * 25, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", comment + b"\0")) if comment else b""
    index, place = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, place, len(f)))
        place += 8 + len(f) + len(f) % 2
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + head + info + movi + chunk(b"idx1", b"".join(index)))


def payload_files(payloads: list[bytes]) -> list[bytes]:
    """Each payload, zero-padded to a positive multiple of 64 bytes, as an AVI file; its own length is in the comment."""
    padded = [filled(d) for d in payloads]
    blocks = coded_blocks(b"".join(x for pair in padded for x in pair))
    out, start = [], 0
    for data, (own, rest) in zip(payloads, padded):
        rows, stop = frame_rows(len(own)), start + (len(own) + len(rest)) // BLOCK_BYTES
        out.append(avi_file(jpeg_frames(blocks[start:stop], rows), ACROSS * 8, rows * 8, b"payload %d %d" % (len(data), len(own))))
        start = stop
    return out


# ---------------------------------------------------------------- reading


def riff_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and length of each chunk's body."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise MediaError(f"chunk {name!r} runs past its list")
        yield name, start + 8, size
        start += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """``frames`` (start, length), ``microseconds`` a frame, ``comment``."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("not an AVI file")
    out = {"frames": [], "microseconds": MICROSECONDS, "comment": b""}
    movi, index = None, None
    for name, at, size in riff_chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, i, n in riff_chunks(data, at + 4, at + size):
                if inner == b"avih" and n >= 4:
                    out["microseconds"] = struct.unpack_from("<I", data, i)[0]
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for inner, i, n in riff_chunks(data, at + 4, at + size):
                if inner == b"ICMT":
                    out["comment"] = data[i : i + n].rstrip(b"\0")
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise MediaError("no movi list")
    if index is not None:
        entries = [struct.unpack_from("<4sIII", data, i) for i in range(index[0], index[0] + index[1] - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        # offsets count from the list's type word, or from the start of the file
        base = movi[0] if not entries or data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        out["frames"] = [(base + place + 8, size) for _, _, place, size in entries]
    else:
        out["frames"] = [(i, n) for name, i, n in riff_chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]
    return out


_tables: dict[bytes, np.ndarray] = {}


def huffman_lookup(table: bytes) -> np.ndarray:
    """For each 16 coming bits: code length * 256 + symbol; 0 where no code fits."""
    if (found := _tables.get(table)) is None:
        found = np.zeros(1 << 16, dtype=np.int32)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                found[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_tables) > 64:
            _tables.clear()
        _tables[table] = found
    return found


def parse_jpeg(data: bytes) -> dict:
    """Tables, size, components, restart distance and the entropy-coded intervals of a baseline frame."""
    out = {"quant": {}, "dc": {}, "ac": {}, "restart": 0}
    if data[:2] != b"\xff\xd8":
        raise MediaError("not a JPEG frame")
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise MediaError("damaged JPEG frame")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = bytes(body[1:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise MediaError("only baseline frames are read")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            at += 2 + size
            break
        at += 2 + size
    if "parts" not in out:
        raise MediaError("no frame header")
    end = data.rfind(b"\xff\xd9")
    coded = data[at : end if end >= at else len(data)]
    out["coded"] = RESTART.split(coded) if out["restart"] else [coded]
    if b"\xff\x00" in coded:
        out["coded"] = [c.replace(b"\xff\x00", b"\xff") for c in out["coded"]]
    return out


def decode_frames(frames: list[dict]) -> list[list[np.ndarray]]:
    """Quantised coefficients, in scan order, of each frame: an array (blocks, 64) a component.

    Frames with equal tables and sampling are decoded together, all their restart intervals in step."""
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        if len(f["parts"]) == 1:
            f["parts"] = [(f["parts"][0][0], 1, 1, f["parts"][0][3])]
        order = tuple(k for k, (_, h, v, _) in enumerate(f["parts"]) for _ in range(h * v))
        tables = tuple((f["dc"][f["scan"][c][0]], f["ac"][f["scan"][c][1]]) for c, *_ in f["parts"])
        groups.setdefault((order, tables), []).append(i)
    out: list = [None] * len(frames)
    for (order, tables), members in groups.items():
        lanes, units, first = [], [], []
        for i in members:
            f = frames[i]
            top = max(p[1] for p in f["parts"]), max(p[2] for p in f["parts"])
            f["units"] = -(-f["width"] // (8 * top[0])) * -(-f["height"] // (8 * top[1]))
            step = f["restart"] or f["units"]
            if len(f["coded"]) != -(-f["units"] // step):
                raise MediaError("damaged JPEG frame: intervals are missing")
            first.append(len(lanes))
            lanes += f["coded"]
            units += [min(step, f["units"] - k * step) for k in range(len(f["coded"]))]
        values = decode_lanes(lanes, np.array(units), order, [(huffman_lookup(d), huffman_lookup(a)) for d, a in tables])
        for i, start in zip(members, first):
            stop = start + len(frames[i]["coded"])
            rows = values[start:stop].reshape(-1, len(order), 64)
            if values.shape[1] * (stop - start) != frames[i]["units"]:
                keep = np.concatenate([np.arange(u) + k * values.shape[1] for k, u in enumerate(units[start:stop])])
                rows = rows[keep]
            out[i] = [rows[:, [j for j, c in enumerate(order) if c == k]].reshape(-1, 64) for k in range(len(frames[i]["parts"]))]
    return out


def decode_lanes(lanes: list[bytes], units: np.ndarray, order: tuple[int, ...], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients (interval, unit, block of the unit, 64)."""
    data = np.frombuffer(b"\0\0\0\0".join([*lanes, b""]), dtype=np.uint8)
    sizes = np.array(list(map(len, lanes)), dtype=np.int64) + 4
    ends = np.cumsum(sizes)
    places, limits = (ends - sizes) * 8, (ends - 4) * 8
    # the coming 24 bits at each byte
    words = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]
    most = int(units.max())
    out = np.zeros((len(lanes), most, len(order), 64), dtype=np.int16)

    def peek(at: np.ndarray) -> np.ndarray:
        return words[at >> 3] >> (8 - (at & 7)).astype(np.int32) & 0xFFFF

    def magnitude(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = peek(at) >> (16 - n)
        return np.where(v < (1 << n) >> 1, v - (1 << n) + 1, v)

    before = np.zeros((len(lanes), len(tables)), dtype=np.int32)
    for u in range(most):
        alive = np.flatnonzero(units > u)
        for j, part in enumerate(order):
            dc, ac = tables[part]
            at = places[alive]
            found = dc[peek(at)]
            n = found & 255
            if (found == 0).any() or (n > 11).any():
                raise MediaError("damaged JPEG frame: no such code")
            at += found >> 8
            before[alive, part] += magnitude(at, n)
            at += n
            out[alive, u, j, 0] = before[alive, part]
            rows, k = alive, np.ones(len(alive), dtype=np.int64)
            done_at = np.zeros(len(lanes), dtype=np.int64)
            for _ in range(63):
                found = ac[peek(at)]
                if not found.all():
                    raise MediaError("damaged JPEG frame: no such code")
                symbol = found & 255
                at = at + (found >> 8)
                n, run = symbol & 15, symbol >> 4
                k = k + run
                if (n == 0).any():
                    long = (n == 0) & (run == 15)
                    over = (n == 0) & (run != 15)
                else:
                    long = over = None
                if (k[n > 0] > 63).any() if long is not None else (k > 63).any():
                    raise MediaError("damaged JPEG frame: a block is too long")
                value = magnitude(at, n)
                at = at + n
                if long is None:
                    out[rows, u, j, k] = value
                else:
                    has = n > 0
                    out[rows[has], u, j, k[has]] = value[has]
                k = k + 1
                ended = k > 63 if over is None else over | (k > 63)
                if ended.any():
                    done_at[rows[ended]] = at[ended]
                    rows, at, k = rows[~ended], at[~ended], k[~ended]
                    if not len(rows):
                        break
            else:
                if len(rows):
                    raise MediaError("damaged JPEG frame: a block does not end")
            places[alive] = done_at[alive]
            if (places[alive] > limits[alive]).any():
                raise MediaError("damaged JPEG frame: it ends early")
    return out


def _cosines() -> np.ndarray:
    """Matrix (64 coefficients in scan order, 64 samples) of the inverse transform."""
    x = np.arange(8)
    c = np.array([np.sqrt(1 / 8) if u == 0 else 0.5 for u in range(8)])
    one = c[:, None] * np.cos((2 * x[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


COSINES = _cosines()
BINS = 16


def frame_histograms(frames: list[dict], coefficients: list[list[np.ndarray]]) -> np.ndarray:
    """Share of samples in each of 16 grey ranges, a row a frame."""
    out = np.zeros((len(frames), BINS))
    start, chunk_blocks = 0, 16384
    while start < len(frames):
        stop, n = start, 0
        while stop < len(frames) and (stop == start or n + len(coefficients[stop][0]) <= chunk_blocks):
            n += len(coefficients[stop][0])
            stop += 1
        scaled = np.concatenate([coefficients[i][0] * frames[i]["quant"][frames[i]["parts"][0][3]] for i in range(start, stop)]).astype(np.float32)
        samples = np.clip(scaled @ COSINES + 128.0, 0, 255).astype(np.uint8) >> 4
        owner = np.repeat(np.arange(stop - start), [len(coefficients[i][0]) for i in range(start, stop)])
        flat = np.bincount((owner[:, None] * BINS + samples).ravel(), minlength=(stop - start) * BINS).reshape(-1, BINS)
        out[start:stop] = flat / np.maximum(1, flat.sum(axis=1, keepdims=True))
        start = stop
    return out


def shots(histograms: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int, float]]:
    """``(first frame, frames, difference at the cut)`` of each shot. A cut is where the difference reaches ``least`` and the
    mean of the differences around it (without itself) plus ``factor`` deviations."""
    n = len(histograms)
    if not n:
        return []
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts = [(0, 0.0)]
    for i, d in enumerate(change):
        if d < least:
            continue
        around = np.concatenate([change[max(0, i - window) : i], change[i + 1 : i + 1 + window]])
        if not len(around) or d >= around.mean() + factor * around.std():
            cuts.append((i + 1, float(d)))
    return [(a, (cuts[k + 1][0] if k + 1 < len(cuts) else n) - a, d) for k, (a, d) in enumerate(cuts)]


def stored_bytes(coefficients: list[list[np.ndarray]], size: int) -> bytes:
    """The payload bytes of decoded frames written by ``payload_files``."""
    joined = np.concatenate([c[0] for c in coefficients]).ravel()
    return np.where(joined < 0, joined + 255, joined).astype(np.uint8).tobytes()[:size]


# ---------------------------------------------------------------- DataFrames


def store_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each whole text (null: empty), in UTF-8, as an AVI file. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            files = payload_files([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], schema=schema)

    return documents.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, media binary")


def _decoded(files: list[bytes | None]) -> list[tuple[dict, list, np.ndarray, str | None, list]]:
    """AVI header, frames, histograms and error of each file; frames of all files are decoded together."""
    heads: list = []
    frames: list[dict] = []
    for f in files:
        try:
            head = parse_avi(f or b"")
            own = [parse_jpeg(f[i : i + n]) for i, n in head["frames"]]
            heads.append((head, len(frames), len(frames) + len(own), None))
            frames += own
        except (MediaError, struct.error, IndexError) as e:
            heads.append(({"frames": [], "microseconds": MICROSECONDS, "comment": b""}, len(frames), len(frames), str(e)))
    try:
        values = decode_frames(frames)
    except (MediaError, IndexError, KeyError) as e:
        if len(files) > 1:
            return [x for f in files for x in _decoded([f])]
        return [(heads[0][0], [], np.zeros((0, BINS)), heads[0][3] or str(e), [])]
    tables = frame_histograms(frames, values)
    return [(h, frames[a:b], tables[a:b], error, values[a:b]) for h, a, b, error in heads]


def clips(media: DataFrame, id_col: str = "doc_id", column: str = "media", window: int = 12, factor: float = 3.0) -> DataFrame:
    """Timed clip rows of AVI motion-JPEG files: ``doc_id, clip, start_ms, end_ms, frames, change, error``."""
    fields = [("doc_id", pa.int64()), ("clip", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int64()), ("change", pa.float64()), ("error", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000, "media"):
            rows = []
            for doc_id, (head, _, tables, error, _) in zip(b.column(0).to_pylist(), _decoded(b.column(1).to_pylist())):
                ms = head["microseconds"] / 1000
                rows += [(doc_id, k, a * ms, (a + n) * ms, n, d, None) for k, (a, n, d) in enumerate(shots(tables, window, factor))] or [(doc_id, 0, 0.0, 0.0, 0, 0.0, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)], schema=schema)

    return media.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{column}` media").mapInArrow(run, "doc_id bigint, clip bigint, start_ms double, end_ms double, frames bigint, change double, error string")


def feature(head: dict, tables: np.ndarray) -> str:
    """Frames, shots, the longest shot and the mean histogram in hex."""
    found = shots(tables)
    mean = np.round(255 * tables.mean(axis=0)).astype(int) if len(tables) else []
    return f"{len(tables)}:{len(found)}:{max((n for _, n, _ in found), default=0)}:{''.join(f'{v:02x}' for v in mean)}"


def read_back(media: DataFrame) -> DataFrame:
    """Stored payloads read back from ``doc_id, media``, with digests and a feature of the frames."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000, "media"):
            files, rows = b.column(1).to_pylist(), []
            for doc_id, f, (head, _, tables, error, values) in zip(b.column(0).to_pylist(), files, _decoded(files)):
                if error:
                    raise MediaError(error)
                _, own, size = head["comment"].split()
                payload = stored_bytes(values, int(size))
                rows.append((doc_id, int(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(head, tables)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
