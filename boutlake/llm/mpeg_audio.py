"""MPEG audio columns: write, parse, verify and index MPEG-1/2/2.5 audio streams.

``parse_stream`` resynchronises on frame headers, reads ID3v2, ID3v1 and APEv2
tags and the Xing/Info and VBRI tables, verifies the frame checksums, the
info-tag checksum and the music checksum, and returns the exact number of
samples together with the byte offset of every audio frame.

``wrap_payload`` stores bytes losslessly in a valid variable-bitrate Layer III
stream: silent granules (part2_3_length 0) leave the rest of a frame as
ancillary bytes, which is where the payload goes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlake.llm.common import id_and_text, quoted

UNIT = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1..14.
BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
LAYERS = {1: 3, 2: 2, 3: 1}
# Bits of a Layer II bit allocation, as (subbands, bits) from the lowest subband on, for each allocation table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}
# End of fixed values.


@lru_cache(maxsize=4096)
def frame_header(word: int) -> dict | None:
    """Fields of a 32-bit frame header, or None where the bits can't be one."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = VERSIONS.get(word >> 19 & 3), LAYERS.get(word >> 17 & 3)
    rate_index, bitrate_index = word >> 10 & 3, word >> 12 & 15
    if version is None or layer is None or rate_index == 3 or bitrate_index in (0, 15) or word & 3 == 2:
        return None
    rate = RATES[version][rate_index]
    bitrate = BITRATES[(version[0], layer)][bitrate_index - 1] * 1000
    padding, mono = word >> 9 & 1, word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    if layer == 1:
        length = (12 * bitrate // rate + padding) * 4
    else:
        length = samples // 8 * bitrate // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    return {
        "version": version, "layer": layer, "rate": rate, "bitrate": bitrate, "length": length, "samples": samples,
        "bound": 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32, "side": side, "mono": mono, "crc": not word >> 16 & 1, "family": (version, layer, rate),
    }


@lru_cache(maxsize=65536)
def frame_checksum(covered: bytes) -> int:
    """The 16-bit frame check (x^16+x^15+x^2+1, all ones at first, high bit first)."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def allocation_bits(h: dict) -> list[int]:
    """The bits of the allocation of each subband of a Layer I or II frame."""
    if h["layer"] == 1:
        return [4] * 32
    if h["version"] != "1":
        table = "lsf"
    else:
        each = h["bitrate"] // (1000 if h["mono"] else 2000)
        if each <= 48:
            table = "d" if h["rate"] == 32000 else "c"
        else:
            table = "a" if h["rate"] == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def covered_bits(frame: bytes, h: dict) -> int:
    """How many bits behind header and check a frame's check covers: side information, or bit allocation and (Layer II) scale factor selection."""
    if h["layer"] == 3:
        return 8 * h["side"]
    value, at, selected = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0
    channels = 1 if h["mono"] else 2
    start = at
    for subband, bits in enumerate(allocation_bits(h)):
        shared = subband >= h["bound"]
        for _ in range(1 if shared else channels):
            at -= bits
            if at < 0:
                return 8 * (len(frame) - 6)
            if value >> at & (1 << bits) - 1:
                selected += channels if shared else 1
    return min(start, start - at + (2 * selected if h["layer"] == 2 else 0))


def checksum_ok(frame: bytes, h: dict) -> bool:
    """Whether the stored check of a protected frame is that of its header and the bits it covers."""
    n = covered_bits(frame, h)
    whole, rest = divmod(n, 8)
    crc = frame_checksum(frame[2:4] + frame[6 : 6 + whole])
    for k in range(rest):
        bit = frame[6 + whole] >> 7 - k & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) != bit else 0)) & 0xFFFF
    return crc == int.from_bytes(frame[4:6], "big")


BLOCK = 256


@lru_cache(maxsize=1)
def _reflected_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the reflected CRC-16 by its place in a block, and what a block does to each earlier state."""
    step = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ 0xA001, step >> 1).astype(np.uint16)
    places = np.empty((BLOCK, 256), np.uint16)
    places[-1] = step
    for k in range(BLOCK - 2, -1, -1):
        places[k] = step[places[k + 1] & 0xFF] ^ places[k + 1] >> 8
    states = np.arange(65536, dtype=np.uint32)
    for _ in range(BLOCK):
        states = step[states & 0xFF].astype(np.uint32) ^ states >> 8
    return places.ravel(), states.astype(np.uint16)


def music_checksum(data: bytes | memoryview) -> int:
    """Reflected CRC-16 from state 0, by whole blocks: the check that info tags hold of the music."""
    places, after = _reflected_tables()
    a = np.frombuffer(data, np.uint8)
    offsets = np.arange(BLOCK, dtype=np.uint32) * 256
    crc = 0
    head = len(a) % BLOCK
    if head:  # zeros before the data don't change a zero state
        crc = int(np.bitwise_xor.reduce(places[a[:head] + offsets[BLOCK - head :]]))
    for at in range(head, len(a), BLOCK * 4096):
        part = a[at : at + BLOCK * 4096].reshape(-1, BLOCK)
        for x in np.bitwise_xor.reduce(places.take(part + offsets), axis=1).tolist():
            crc = int(after[crc]) ^ x
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _from_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _user_text(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


#: payload units per frame -> kbit/s of the smallest 48 kHz mono Layer III frame that holds them beside header, check and side information
UNITS_RATE = {1: 80, 2: 160, 3: 224, 4: 320}
HEAD = 4 + 2 + 17


def _header_bytes(kbits: int, checked: bool) -> bytes:
    index = BITRATES[("1", 3)].index(kbits) + 1
    return bytes((0xFF, 0xFA | (not checked), index << 4 | 1 << 2, 0xC4))


@lru_cache(maxsize=8)
def _frame_prefix(units: int) -> bytes:
    head, side = _header_bytes(UNITS_RATE[units], True), bytes(17)
    return head + struct.pack(">H", frame_checksum(head[2:] + side)) + side


def _frames(payload: bytes, units: int) -> bytes:
    size = UNITS_RATE[units] * 3
    out = np.zeros((len(payload) // (UNIT * units), size), np.uint8)
    out[:, :HEAD] = np.frombuffer(_frame_prefix(units), np.uint8)
    out[:, HEAD : HEAD + UNIT * units] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT * units)
    return out.tobytes()


def wrap_payload(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` (a positive multiple of 192 bytes) as a tagged variable-bitrate Layer III stream."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    whole = len(payload) // (4 * UNIT) * 4 * UNIT
    music = _frames(payload[:whole], 4) if whole else b""
    if whole < len(payload):
        music += _frames(payload[whole:], (len(payload) - whole) // UNIT)
    count = -(-len(payload) // (4 * UNIT))
    head = _header_bytes(80, False)
    size = 240
    total = size + len(music)
    toc = bytes(min(255, 256 * (size + count * p // 100 * 960) // total) for p in range(100))
    info = head + bytes(17) + b"Xing" + struct.pack(">III", 15, count, total) + toc + struct.pack(">I", 0)
    info += b"Boutlake1" + bytes((4, 0)) + bytes(8) + bytes((0, 80)) + bytes(3) + bytes(4)
    info += struct.pack(">IH", total, music_checksum(music))
    info += struct.pack(">H", music_checksum(info))
    tags = _user_text("payload_bytes", str(n_bytes)) + _user_text("payload_crc32", str(zlib.crc32(payload)))
    id3 = b"ID3\x04\0\0" + _syncsafe(len(tags)) + tags
    return id3 + info.ljust(size, b"\0") + music + b"TAG".ljust(127, b"\0") + b"\xff"


def _read_id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads the tag at ``at`` into ``tags``; where it ends. A size that reaches behind the data is damage: only the tag's head is passed over then."""
    version, flags, size = data[at + 3], data[at + 5], _from_syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    body = data[at + 10 : end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and len(body) >= 4:
        p = _from_syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 4 if version > 2 else 3
    while p + 2 * wide + (2 if wide == 4 else 0) <= len(body) and body[p]:
        name, raw = body[p : p + wide].decode("latin-1"), body[p + wide : p + 2 * wide]
        if not (name.isascii() and name.isalnum() and name == name.upper()):
            break
        length = _from_syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        p += 2 * wide + (2 if wide == 4 else 0)
        text = body[p : p + length]
        p += length
        if name[0] == "T" and text:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8")
            parts = text[1:].decode(code, "replace").split("\0")
            tags[f"{name}:{parts[0]}" if name[:2] == "TX" else name] = parts[1] if name[:2] == "TX" and len(parts) > 1 else parts[0]
    whole = at + 10 + size + (10 if flags & 0x10 else 0)
    return whole if whole <= len(data) else at + 10


def _read_ape(data: bytes, begin: int, end: int, tags: dict) -> int:
    """Reads an APEv2 tag that ends at ``end``; where the tag begins. A size that doesn't lie between ``begin`` and ``end`` is damage: only the footer is passed over then."""
    size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
    p, start = end - size, end - size - (32 if flags >> 31 else 0)
    if size < 32 or start < begin:
        return end - 32
    for _ in range(count):
        if p < 0 or p + 8 > end:
            break
        length = int.from_bytes(data[p : p + 4], "little")
        stop = data.find(b"\0", p + 8, end)
        if stop < 0:
            break
        tags["APE:" + data[p + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + length].decode("utf-8", "replace")
        p = stop + 1 + length
    return start


def _read_table(frame: bytes, h: dict) -> dict | None:
    """The variable-bitrate table of a first frame (Xing/Info or VBRI), if it has one."""
    at = 4 + h["side"]
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out: dict = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0, "music_crc": None, "tag_ok": None}
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
            at += 100
        at += 4 if flags & 8 else 0
        if len(frame) >= at + 36 and frame[at : at + 9].strip(b"\0"):
            delays = int.from_bytes(frame[at + 21 : at + 24], "big")
            out["delay"], out["padding"] = delays >> 12, delays & 0xFFF
            out["music_crc"] = int.from_bytes(frame[at + 32 : at + 34], "big")
            out["tag_ok"] = int.from_bytes(frame[at + 34 : at + 36], "big") == music_checksum(frame[: at + 34])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": steps, "per_entry": per, "delay": 0, "padding": 0, "music_crc": None, "tag_ok": None}
    return None


def main_family(data: bytes, at: int, end: int) -> tuple | None:
    """(version, layer, rate) of the longest run of frames on frames, by bytes; the first of equals.

    A lone frame is a run only where the data ends behind it. The search stops at
    a run that holds half of what there is.
    """
    best, most, half = None, 0, (end - at) / 2
    while at + 4 <= end:
        start, frames, family = at, 0, None
        while at + 4 <= end:
            h = frame_header(int.from_bytes(data[at : at + 4], "big"))
            if h is None or at + h["length"] > end or family not in (None, h["family"]):
                break
            family = h["family"]
            frames += 1
            at += h["length"]
        if at - start > most and (frames > 1 or at + 4 > end):
            best, most = family, at - start
            if most >= half:
                break
        to = data.find(b"\xff", start + 1 if frames < 2 else at, end)  # a lone header may be part of another frame
        at = end if to < 0 else to
    return best


def parse_stream(data: bytes) -> dict:
    """Everything that a stream of MPEG audio tells.

    Frames are those of the family with the longest run of them; headers of another
    family are passed over, as are tags whose size can't be right.

    Keys: tags, table, frames, offsets (byte offset of each audio frame), sizes,
    samples (exact, less encoder delay and padding), rate, duration_us, bitrates
    (count by bit/s), crc_ok, crc_bad, music_ok (None: no check in
    the stream), skipped (bytes passed over to find a header), version, layer.
    Bytes that hold no frame give zero frames, no rate and duration 0.
    """
    tags: dict = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _read_id3v2(data, at, tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + lo : end + hi].rstrip(b"\0 ").decode("latin-1"):
                tags[f"ID3v1:{name}"] = value
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        end = _read_ape(data, at, end, tags)
    offsets: list[int] = []
    sizes: list[int] = []
    bitrates: dict[int, int] = {}
    first = table = None
    family = main_family(data, at, end)
    samples = skipped = ok = bad = 0
    music_from = at
    while at + 4 <= end:
        word = int.from_bytes(data[at : at + 4], "big")
        h = frame_header(word)
        good = h is not None and at + h["length"] <= end and h["family"] == family
        if good and (first is None or skipped_now):
            after = at + h["length"]  # a new start counts only with a second header, or the end, behind it
            then = frame_header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else h
            good = then is not None and then["family"] == h["family"]
        if not good:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            skipped += to - at
            at, skipped_now = to, True
            continue
        skipped_now = False
        size = h["length"]
        if first is None:
            first = h
            table = _read_table(data[at : at + size], h)
            if table:
                at += size
                music_from = at
                continue
            music_from = at
        if h["crc"]:
            if checksum_ok(data[at : at + size], h):
                ok += 1
            else:
                bad += 1
        offsets.append(at)
        sizes.append(size)
        samples += h["samples"]
        bitrates[h["bitrate"]] = bitrates.get(h["bitrate"], 0) + 1
        at += size
    skipped += max(0, end - at)
    music_ok = None
    if table and table["music_crc"] is not None:
        music_ok = music_checksum(memoryview(data)[music_from:end]) == table["music_crc"]
        samples = max(0, samples - table["delay"] - table["padding"])
    rate = first["rate"] if first else None
    return {
        "tags": tags, "table": table, "frames": len(offsets), "offsets": offsets, "sizes": sizes, "samples": samples, "rate": rate,
        "duration_us": samples * 1_000_000 // rate if rate else 0, "bitrates": bitrates, "crc_ok": ok, "crc_bad": bad,
        "music_ok": music_ok, "skipped": skipped, "version": first["version"] if first else None, "layer": first["layer"] if first else None,
    }


PAYLOAD_OF = {rate * 3: units * UNIT for units, rate in UNITS_RATE.items()}


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The ancillary bytes that ``wrap_payload`` stored."""
    return b"".join([data[o + HEAD : o + HEAD + PAYLOAD_OF[s]] for o, s in zip(parsed["offsets"], parsed["sizes"])])


def describe(parsed: dict) -> str:
    """The features of a parsed stream as one line."""
    seek = hashlib.sha256(np.asarray(parsed["offsets"], "<i8").tobytes()).hexdigest()[:16]
    t = parsed["table"]
    return (
        f"mpeg{parsed['version']}-layer{parsed['layer']};rate={parsed['rate']};frames={parsed['frames']};samples={parsed['samples']};"
        f"duration_us={parsed['duration_us']};table={t['kind'] if t else None};table_frames={t['frames'] if t else None};"
        f"crc={parsed['crc_ok']}/{parsed['crc_bad']};music={parsed['music_ok']};skipped={parsed['skipped']};seek={seek}"
    )


STREAM_FIELDS = "frames int, samples long, sample_rate int, duration_us long, crc_ok int, crc_bad int, music_ok boolean, skipped_bytes long, vbr_table string, tags map<string,string>, frame_offsets array<long>"


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with a struct ``audio`` of parsed features of a binary column.

    The struct holds exact duration, seek offsets, checks and tags. A null stream
    gives a null struct; bytes without any frame give zero frames. Other columns,
    whatever their names, pass through.
    """

    @F.pandas_udf(STREAM_FIELDS)
    def parsed(s):
        import pandas as pd

        rows = []
        for data in s:
            if data is None:
                rows.append(None)
                continue
            p = parse_stream(bytes(data))
            rows.append((p["frames"], p["samples"], p["rate"], p["duration_us"], p["crc_ok"], p["crc_bad"], p["music_ok"], p["skipped"], p["table"]["kind"] if p["table"] else None, p["tags"], p["offsets"]))
        names = [x.split()[0] for x in STREAM_FIELDS.split(", ")]
        return pd.DataFrame([dict.fromkeys(names) if r is None else dict(zip(names, r)) for r in rows], columns=names)

    return df.withColumn("audio", F.when(F.col(quoted(column)).isNotNull(), parsed(F.col(quoted(column)))))


def text_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0), len(raw)


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frame_offsets array<long>"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an MPEG audio stream, read back and described, with its exact duration and the byte offset of every frame to seek to.

    One output row per input row (repeated and null ids too); a null text counts
    as empty and still fills one 192-byte unit. Only the two named columns are
    read. Nothing is shuffled; a task holds one Arrow batch and one stream.
    """

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in batch.column(1):
                payload, n = text_payload(text.as_py())
                stream = wrap_payload(payload, n)
                parsed = parse_stream(stream)
                back = read_payload(stream, parsed)
                row = (int(parsed["tags"]["TXXX:payload_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(parsed), parsed["duration_us"], np.asarray(parsed["offsets"], np.int64))
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols[:-1]), pa.array(cols[-1], pa.list_(pa.int64()))], names=["id", *(x.split()[0] for x in MEDIA_SCHEMA.split(", "))])

    plain, id_type = id_and_text(docs, id_col, text_col)
    return plain.mapInArrow(run, f"id {id_type}, {MEDIA_SCHEMA}").withColumnRenamed("id", id_col)
