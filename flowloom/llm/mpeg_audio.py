"""MPEG audio columns: frames, tags, seek tables, checksums and exact durations of binary media.

``index`` reads any MPEG-1/2/2.5 audio of layers I to III. ``store`` writes bytes losslessly as the ancillary data of
MPEG-1 layer III frames with checksums, behind a tag and a variable-bitrate table; ``read`` gets them back.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches, whole_texts

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


# Fixed values of layer II: by table, how many subbands have 4, 3 and 2 bits of allocation.
ALLOCATION = {"a": (11, 12, 4), "b": (11, 12, 7), "c": (2, 6, 0), "d": (2, 10, 0), "2": (4, 7, 19)}


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005 and all bits set at the start, as frames carry it; of the first ``bits`` bits, or all."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(min(8, left)):
            crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ byte >> 7 - k) & 1 else crc << 1) & 0xFFFF
        left -= 8
        if left <= 0:
            break
    return crc


@dataclass(frozen=True)
class Header:
    """What four header bytes say; None from ``header`` if they are no frame's (free format is not supported)."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes that the checksum covers after the header and itself; -1 where they depend on the content (layer II)
    table: str  # of layer II's allocation
    bound: int  # the first subband that both channels share


_HEADERS: dict[bytes, Header | None] = {}
_CRCS: dict[bytes, int] = {}


def header(four: bytes) -> Header | None:
    if four not in _HEADERS:
        if len(_HEADERS) > 100_000:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3)
    rate_at, rate_index = h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or rate_at in (0, 15) or rate_index == 3 or h[3] & 3 == 2:
        return None
    one = version == 3
    bitrate, rate, pad = BITRATES[one, layer][rate_at], RATES[version][rate_index], h[2] >> 1 & 1
    mono = h[3] >> 6 == 3
    bound, table = 4 * (h[3] >> 4 & 3) + 4 if h[3] >> 6 == 1 else 32, ""
    if layer == 1:
        size, samples, side = (12000 * bitrate // rate + pad) * 4, 384, 16 if mono else (bound + 32) // 2
    elif layer == 2:
        size, samples, side = 144000 * bitrate // rate + pad, 1152, -1
        each = bitrate if mono else bitrate // 2
        table = "2" if not one else ("d" if rate == 32000 else "c") if each <= 48 else "a" if each <= 80 or rate == 48000 else "b"
    else:
        size, samples, side = (144000 if one else 72000) * bitrate // rate + pad, 1152 if one else 576, (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not h[1] & 1, bitrate, rate, 1 if mono else 2, size, samples, side, table, bound)


def covered_bits(h: Header, body: bytes) -> int:
    """The bits of a layer II frame's content that its checksum covers: allocations, and two for each one that isn't 0."""
    widths = [w for w, n in zip((4, 3, 2), ALLOCATION[h.table], strict=True) for _ in range(n)]
    value, at, used = int.from_bytes(body[:64], "big"), 0, 0
    size = 8 * min(64, len(body))
    for band, width in enumerate(widths):
        channels = h.channels if band < h.bound else 1
        for _ in range(channels):
            allocated = value >> max(0, size - at - width) & (1 << width) - 1
            at += width
            used += (allocated > 0) * (h.channels if band >= h.bound else 1)
    return at + 2 * used


@dataclass
class Index:
    """All that ``index`` finds in one medium."""

    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    bitrates: set[int] = field(default_factory=set)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    table_at: int = 0
    stretches: list[int] = field(default_factory=list)
    stretch: int = 0


def synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


# Names of ID3v2.2 text frames and of APE items, and the ID3v2.3/2.4 frames that mean the same.
SHORT_NAMES = {"TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCO": "TCON", "TRK": "TRCK", "TYE": "TYER", "TXX": "TXXX"}
APE_NAMES = {"Title": "TIT2", "Artist": "TPE1", "Album": "TALB", "Genre": "TCON", "Track": "TRCK", "Year": "TYER"}


def keep_text(name: str, body: bytes, out: Index) -> None:
    """A text frame's content: its encoding, then the text; TXXX has a name of its own first. The first of a name stays."""
    text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace").rstrip("\0")
    if name == "TXXX":
        name, _, text = text.partition("\0")
    out.tags.setdefault(name, text.removeprefix("\ufeff"))


def id3v2(data: bytes, at: int, out: Index) -> int:
    """Where the ID3v2 tag at ``at`` ends; ``at`` if none is there. Text frames of versions 2.2 to 2.4 go to out.tags.

    Unsynchronised tags and frames are restored, extended headers passed over; compressed and encrypted frames are left
    out. A tag that claims to go beyond the file is read as far as its frames fit, and ends after its header, so that
    the search for audio goes on there.
    """
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return at
    major, flags, size = data[at + 3], data[at + 5], synchsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    here = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:
        here = synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if major == 2 else 10
    while 2 <= major <= 4 and here + head <= len(body) and body[here : here + (3 if major == 2 else 4)].isalnum():
        if major == 2:
            name, n, form = body[here : here + 3].decode("latin-1"), int.from_bytes(body[here + 3 : here + 6], "big"), 0
        else:
            four = body[here + 4 : here + 8]
            name, n, form = body[here : here + 4].decode("latin-1"), synchsafe(four) if major == 4 else int.from_bytes(four, "big"), body[here + 9]
        content = body[here + head : here + head + n]
        here += head + n
        if here > len(body):
            break
        secret, grouped, length = (0x0C, 0x40, form & 1) if major == 4 else (0xC0, 0x20, 0)
        content = content[(1 if form & grouped else 0) + 4 * length :]
        if major == 4 and (form & 2 or flags & 0x80):
            content = content.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and content and not form & secret:
            keep_text(SHORT_NAMES.get(name, name), content, out)
    after = at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    return after if after <= len(data) else at + 10


def ape(data: bytes, at: int, out: Index) -> int:
    """Where the APE tag whose header is at ``at`` ends; ``at`` if none is there or it goes beyond the file. Its text items go to out.tags."""
    if data[at : at + 8] != b"APETAGEX" or len(data) < at + 32:
        return at
    after = at + 32 + int.from_bytes(data[at + 12 : at + 16], "little")
    if after > len(data):
        return at
    here = at + 32
    for _ in range(int.from_bytes(data[at + 16 : at + 20], "little")):
        stop = data.find(b"\0", here + 8, after)
        size, kind = int.from_bytes(data[here : here + 4], "little"), data[here + 4 : here + 5]
        if stop < 0 or stop + 1 + size > after:
            break
        name, here = data[here + 8 : stop].decode("latin-1"), stop + 1 + size
        if not kind[0] & 6:
            out.tags.setdefault(APE_NAMES.get(name, name), data[stop + 1 : here].decode("utf-8", "replace"))
    return after


def id3v1(data: bytes, out: Index) -> int:
    """Where the audio ends: before an ID3v1 tag, whose fields go to out.tags, or at the file's end."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[end + a : end + b].decode("latin-1").rstrip("\0 "):
                out.tags.setdefault(name, text)
    return end


def index(data: bytes) -> Index:
    """Frames of a medium. A frame counts if another of its kind, or the audio's end, follows it.

    After bytes that are no frame, the search goes on at the next sync byte; those bytes are counted in ``skipped``. ID3v2
    and APE tags are read where no frame is: at the start, after frames, after other tags. Of one name the first text
    stays, ID3v1's last.
    """
    out, last = Index(), Index()
    at, end = 0, id3v1(data, last)
    begun = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h and after <= end:
            n = header(data[after : after + 4]) if after + 4 <= end else None
            if not (after == end or n and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)):
                h = None if not begun or after + 4 <= end and header(data[after : after + 4]) else h
        else:
            h = None
        if h is None:
            nxt = max(id3v2(data, at, out), ape(data, at, out))
            if nxt > at:
                at = nxt
                continue
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        if not begun:
            begun, out.first = True, h
            if read_table(data[at:after], h, out):
                out.table_at, at = at, after
                continue
        if not h.protected:
            pass
        else:
            bits = 8 * h.side if h.side >= 0 else covered_bits(h, data[at + 6 : min(after, at + 70)])
            covered = data[at + 2 : at + 4] + data[at + 6 : min(after, at + 6 + (bits + 7) // 8)]
            if covered not in _CRCS:
                if len(_CRCS) > 100_000:
                    _CRCS.clear()
                _CRCS[covered] = crc16(covered, 16 + bits)
            if _CRCS[covered] == int.from_bytes(data[at + 4 : at + 6], "big"):
                out.crc_ok += 1
            else:
                out.crc_bad += 1
        out.offsets.append(at)
        out.samples += h.samples
        out.bitrates.add(h.bitrate)
        at = after
    out.skipped += max(0, end - at)
    out.tags = last.tags | out.tags
    return out


def seek_table(x: Index) -> tuple[list[int], int] | None:
    """The places that a medium's own seek table gives, in the file, and the most bytes that one is off the frame it stands for.

    Entry k of a Xing table is where k % of the frames have passed, in 256ths of the table's bytes; one of a VBRI table is
    the bytes of a stretch of frames. Both count from the table's own frame; no place is before the first frame.
    """
    if not x.offsets:
        return None
    if len(x.toc) == 100 and x.table_bytes:
        places = [x.table_at + v * x.table_bytes // 256 for v in x.toc]
        frames = [k * len(x.offsets) // 100 for k in range(100)]
    elif x.stretches and x.stretch:
        places = [x.table_at + sum(x.stretches[:k]) for k in range(len(x.stretches))]
        frames = [min(k * x.stretch, len(x.offsets) - 1) for k in range(len(x.stretches))]
    else:
        return None
    places = [max(p, x.offsets[0]) for p in places]
    return places, max(abs(p - x.offsets[f]) for p, f in zip(places, frames, strict=True))


def read_table(frame: bytes, h: Header, out: Index) -> bool:
    """Whether a first frame is a Xing, Info or VBRI table, which carries no sound; its fields go to out."""
    for lead in (4, 6):
        side = lead + ((17 if h.channels == 1 else 32) if h.version == 3 else (9 if h.channels == 1 else 17))
        if frame[side : side + 4] in (b"Xing", b"Info"):
            out.table, flags, at = frame[side : side + 4].decode(), int.from_bytes(frame[side + 4 : side + 8], "big"), side + 8
            if flags & 1:
                out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 2:
                out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out.toc = frame[at : at + 100]
            return True
    if frame[36:40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        n, scale, width, out.stretch = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58, 60))
        if 62 + n * width <= len(frame):
            out.stretches = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(n)]
        return True
    return False


INDEX = "version string, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration_s double, variable boolean, crc_ok long, crc_bad long, skipped_bytes long, vbr_table string, vbr_frames long, seek_offsets array<long>, tags map<string,string>, seek_table array<long>, seek_table_off long"


def index_columns(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per medium: the id and INDEX. The exact duration is n_samples / sample_rate.

    A null, empty or broken medium has no frames: counts 0, version, layer and rates null. seek_table and seek_table_off
    (null without a table) are ``seek_table``'s places and their largest error. Other columns are left out.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                x = index(data or b"")
                h, (places, off) = x.first, seek_table(x) or (None, None)
                rows.append({"seek_table": places, "seek_table_off": off, "version": VERSIONS[h.version] if h else None, "layer": h.layer if h else None, "sample_rate": h.rate if h else None, "channels": h.channels if h else None, "n_frames": len(x.offsets), "n_samples": x.samples, "duration_s": x.samples / h.rate if h else 0.0, "variable": len(x.bitrates) > 1, "crc_ok": x.crc_ok, "crc_bad": x.crc_bad, "skipped_bytes": x.skipped, "vbr_table": x.table or None, "vbr_frames": x.table_frames, "seek_offsets": x.offsets, "tags": list(x.tags.items())})
            types = {"version": pa.string(), "layer": pa.int32(), "sample_rate": pa.int32(), "channels": pa.int32(), "duration_s": pa.float64(), "variable": pa.bool_(), "vbr_table": pa.string(), "seek_offsets": pa.list_(pa.int64()), "tags": pa.map_(pa.string(), pa.string()), "seek_table": pa.list_(pa.int64())}
            names = [f.split(" ")[0] for f in INDEX.replace("map<string,string>", "map").split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in names)], names=["id", *names])

    return map_batches(media.select(F.col(id_col).cast("long").alias("id"), media_col), run, f"id long, {INDEX}").withColumnRenamed("id", id_col)


# --- bytes as audio ---
RATE, LEAD = 32000, 23  # a mono frame's header, checksum and side information
SIZES = {144000 * b // RATE: b for b in BITRATES[True, 3][1:]}
LARGEST = max(SIZES)


def frame_head(size: int, protected: bool = True) -> bytes:
    """Header, checksum and empty side information of a frame without sound."""
    h = bytes((0xFF, 0xFA if protected else 0xFB, BITRATES[True, 3].index(SIZES[size]) << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    return h + crc16(h[2:4] + side).to_bytes(2, "big") + side if protected else h + side


HEADS = {size: frame_head(size) for size in SIZES}


def store(payload: bytes) -> bytes:
    """A file of MPEG-1 layer III, 32 kHz mono: tag with the payload's size, Xing table, frames with the payload, ID3v1 tag.

    The tag at the end is there so that no payload can stand where such a tag is looked for.
    """
    room, parts = LARGEST - LEAD, []
    for k in range(0, len(payload), room):
        body = payload[k : k + room]
        size = min(s for s in SIZES if s >= len(body) + LEAD)
        parts.append((HEADS[size] + body).ljust(size, b"\0"))
    audio = b"".join(parts)
    lead = min(SIZES)
    toc = bytes(min(255, 256 * (sum(map(len, parts[: k * len(parts) // 100])) if len(parts) < 100 else LARGEST * (k * len(parts) // 100)) // max(1, len(audio))) for k in range(100))
    xing = (frame_head(lead, False) + b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + (lead + len(audio)).to_bytes(4, "big") + toc).ljust(lead, b"\0")
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes((0, 0, 0, len(text))) + b"\0\0" + text
    return b"ID3\4\0\0" + bytes((0, 0, 0, len(tag))) + tag + xing + audio + b"TAG".ljust(127, b"\0") + b"\xff"


def read(media: bytes, x: Index) -> bytes:
    """The payload of a medium that ``store`` made; of any other nothing."""
    left, out = int(x.tags["payload_bytes"]) if x.tags.get("payload_bytes", "").isdigit() else 0, []
    for at in x.offsets:
        h = header(media[at : at + 4])
        out.append(media[at + LEAD : at + min(h.size, LEAD + left)])
        left -= len(out[-1])
    return b"".join(out)


def padded(text: Column, unit: int = 192) -> Column:
    """The UTF-8 bytes of a text, filled up with bytes 32 to a positive multiple of ``unit``."""
    size = F.octet_length(text)
    want = F.greatest(F.lit(1), F.ceil(size / unit)).cast("int") * unit
    return F.concat(text.cast("binary"), F.repeat(F.lit(" "), want - size).cast("binary"))


def store_texts(docs: DataFrame, unit: int = 192) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media of every whole text, padded to a positive multiple of ``unit`` bytes.

    A null text counts as empty, and an empty one is stored as ``unit`` blanks. Equal texts have equal media.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(store, batch.column(2).to_pylist()), pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts = whole_texts(docs)
    return map_batches(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), padded(F.col("text"), unit).alias("payload")), run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek_offsets array<long>"


def digests(stored: DataFrame) -> DataFrame:
    """Sizes and digests of stored media and of the payload read back from them, with the features of the frames.

    duration_s is exact (samples by rate), seek_offsets has each frame's place. A null medium counts as empty; an empty,
    broken or foreign one has no payload (0 bytes and their digests), and without frames no offsets and the feature "".
    """

    def feature(x: Index) -> str:
        if not x.offsets:
            return ""
        seek = hashlib.sha256(",".join(map(str, x.offsets)).encode()).hexdigest()[:16]
        return f"mpeg{VERSIONS[x.first.version]}-l{x.first.layer} {x.first.rate}Hz x{x.first.channels} frames={len(x.offsets)}/{x.table_frames} samples={x.samples} kbps={min(x.bitrates)}-{max(x.bitrates)} crc={x.crc_ok}/{x.crc_ok + x.crc_bad} skipped={x.skipped} seek={seek}"

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                media = media or b""
                x = index(media)
                payload = read(media, x)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(x), x.samples / x.first.rate if x.first else 0.0, x.offsets))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[f.split(" ")[0] for f in DIGEST.split(", ")])

    return map_batches(stored.select("doc_id", "n_bytes", "media"), run, DIGEST)
