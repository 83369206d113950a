"""MPEG audio as a media column: a writer that carries a payload, and a frame parser.

The parser resynchronises on frame headers (a header counts if it agrees in version, layer
and sample rate with the frame that ends there, or with the header where its own frame ends,
or if that is where a tag begins or the stream ends), parses ID3v2 and ID3v1 tags and the variable-bitrate tables (Xing, Info, VBRI), verifies the
CRC-16 of protected frames of all three layers, and gives the exact duration as a fraction
and the byte offset of every frame for seeking.

The writer makes a valid variable-bitrate MPEG-1 Layer III stream of silent mono frames at
48 kHz, with an ID3v2 tag, a Xing frame with its seek table, and a CRC in every frame. The
payload rides in the ancillary bytes behind each frame's side information, which decoders
skip; the tag holds its length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame

from quern.llm.common import doc_columns, staged

# Fixed values of the MPEG audio standard: kbit/s by (is MPEG-1, layer) and index, Hz by version and index.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Layer II: bits of the allocation of each subband, by table.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
_OWNER = b"payload-length"


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    size: int
    samples: int
    bound: int  # subbands from here on share their allocation between the channels

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def allocation(self) -> tuple[int, ...]:
        """Layer II: bits of the allocation of each subband."""
        each = self.kbps // (1 if self.mono else 2)
        if self.version != 3:
            return _ALLOCATION["low"]
        if each < 56:
            return _ALLOCATION["d" if self.hertz == 32000 else "c"]
        return _ALLOCATION["a" if self.hertz == 48000 or each <= 80 else "b"]

    def agrees(self, other: Header | None) -> bool:
        return other is not None and (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames are not supported."""
    if four not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[four] = _header(four)
    return _headers[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, speed, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or speed == 3:
        return None
    kbps, hertz = _RATES[version == 3, layer][rate], _HERTZ[version][speed]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, size, samples, bound)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_TABLE = _crc_table()
_checked: dict[bytes, int] = {}


def crc16(data: bytes, bits: int | None = None) -> int:
    """The standard's CRC (polynomial 0x8005, from 0xFFFF) of the first bits, or all, of data."""
    found = _checked.get((data, bits))
    if found is None:
        found = 0xFFFF
        whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
        for byte in data[:whole]:
            found = (found << 8 ^ _TABLE[found >> 8 ^ byte]) & 0xFFFF
        for k in range(rest):
            high = found >> 15 ^ data[whole] >> 7 - k & 1
            found = (found << 1 ^ 0x8005 * high) & 0xFFFF
        if len(_checked) > 10_000:
            _checked.clear()
        _checked[data, bits] = found
    return found


def _protected(data: bytes, at: int, h: Header) -> tuple[bytes, int]:
    """What the CRC of the frame at ``at`` covers, and its number of bits: half the header, then the
    side information (Layer III), the bit allocation (I), or that and the scale factor selection (II)."""
    body = at + 6
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (32 if h.mono else 32 + h.bound)
    else:
        word, bits, chosen = int.from_bytes(data[body: body + 64].ljust(64, b"\0"), "big"), 0, 0
        for band, width in enumerate(h.allocation):
            shared = band >= h.bound
            for _ in range(1 if h.mono or shared else 2):
                bits += width
                if word >> 512 - bits & (1 << width) - 1:
                    chosen += 2 if shared and not h.mono else 1
        bits += 2 * chosen
    return data[at + 2: at + 4] + data[body: body + -(-bits // 8)], 16 + bits


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of each audio frame
    samples: int = 0
    seconds: Fraction = Fraction(0)
    skipped: int = 0  # bytes that belong to no frame and no tag
    checked: int = 0
    bad: int = 0
    rates: set[int] = field(default_factory=set)
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict | None = None  # of the Xing, Info or VBRI frame
    ancillary: list[tuple[int, int]] = field(default_factory=list)  # begin and end behind the side information

    @property
    def microseconds(self) -> int:
        return int(self.seconds * 1_000_000)


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _tag(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Reads an ID3v2 tag at ``at`` and returns where it ends."""
    end = min(len(data), at + 10 + _syncsafe(data[at + 6: at + 10]))
    place, version = at + 10, data[at + 3]
    while version in (3, 4) and place + 10 <= end and data[place: place + 4].isalnum():
        name = data[place: place + 4].decode("latin-1")
        size = _syncsafe(data[place + 4: place + 8]) if version == 4 else int.from_bytes(data[place + 4: place + 8], "big")
        tags[name] = data[place + 10: min(end, place + 10 + size)]
        place += 10 + size
    return end


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of the frame at ``at``, if it is one."""
    if h.layer != 3:
        return None
    place, end = at + 36, at + h.size
    if data[place: place + 4] == b"VBRI" and place + 26 <= end:
        _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", data[place + 4: place + 26])
        body = data[place + 26: min(end, place + 26 + entries * width)]
        steps = [scale * int.from_bytes(body[k: k + width], "big") for k in range(0, len(body), width or 1)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "seek": steps, "frames_per_entry": each}
    place = at + 4 + h.side
    if data[place: place + 4] not in (b"Xing", b"Info"):
        return None
    flags = int.from_bytes(data[place + 4: place + 8], "big")
    out: dict = {"kind": data[place: place + 4].decode()}
    place += 8
    for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
        if flags & bit:
            out[name] = data[place: place + size] if name == "seek" else int.from_bytes(data[place: place + size], "big")
            place += size
    return out


def parse(data: bytes) -> Stream:
    """All frames of a stream, whatever stands between them. "TAG" at 128 bytes before the end
    begins an ID3v1 tag only where no frame holds these bytes."""
    out, at, end, ticks = Stream(), 0, len(data), {}
    last = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else -1
    first, before = True, None  # before: the header of a frame that ends here
    while at < end:
        if at == last:
            out.tags["ID3v1"] = data[at:]
            break
        if data[at: at + 3] == b"ID3" and at + 10 <= end:
            at = _tag(data, at, out.tags)
            continue
        h = header(data[at: at + 4])
        ok = h is not None and at + h.size <= end and (at + h.size in (end, last) or h.agrees(before)
                                                        or h.agrees(header(data[at + h.size: at + h.size + 4]))
                                                        or data[at + h.size: at + h.size + 3] == b"ID3")
        if not ok:
            following = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end)
            following = min([x for x in (following, tag, last) if x > at], default=end)
            out.skipped += following - at
            at, before = following, None
            continue
        table = _vbr(data, at, h) if first else None
        first = False
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += h.samples
            ticks[h.hertz] = ticks.get(h.hertz, 0) + h.samples
            out.rates.add(h.kbps)
            behind = at + 4 + 2 * h.protected
            if h.protected:
                out.checked += 1
                out.bad += crc16(*_protected(data, at, h)) != int.from_bytes(data[at + 4: at + 6], "big")
            behind += h.side * (h.layer == 3)
            out.ancillary.append((behind, at + h.size))
        at, before = at + h.size, h
    out.seconds = sum((Fraction(n, hertz) for hertz, n in ticks.items()), Fraction(0))
    return out


def _frames() -> list[tuple[int, bytes]]:
    """(room for payload, header with CRC and side information) of each bit rate of the writer."""
    out = []
    for index in range(1, 15):
        four = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
        h = header(four)
        side = bytes(h.side)
        out.append((h.size - 6 - h.side, four + crc16(four[2:] + side).to_bytes(2, "big") + side))
    return out


_FRAMES = _frames()


def pack(payload: bytes) -> bytes:
    """A stream that carries payload."""
    most = _FRAMES[-1][0]
    parts, sizes = [], []
    for at in range(0, len(payload), most):
        part = payload[at: at + most]
        room, head = next(f for f in _FRAMES if f[0] >= len(part))
        parts += [head, part, bytes(room - len(part))]
        sizes.append(len(head) + room)
    four = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0))
    h = header(four)
    total = h.size + sum(sizes)
    ends, done = [], h.size
    for s in sizes:
        ends.append(done)
        done += s
    seek = bytes(min(255, 256 * ends[min(len(ends) - 1, p * len(ends) // 100)] // total) if ends else 0 for p in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(sizes), total) + seek + struct.pack(">I", 0)
    lead = four + bytes(h.side) + table
    private = _OWNER + b"\0" + struct.pack(">Q", len(payload))
    frame = b"PRIV" + len(private).to_bytes(4, "big") + b"\0\0" + private
    size = len(frame)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    return b"".join([tag, lead, bytes(h.size - len(lead)), *parts])


def unpack(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream of pack, from its frames."""
    stream = stream or parse(data)
    owner, _, size = stream.tags.get("PRIV", b"").partition(b"\0")
    if owner != _OWNER or len(size) != 8:
        raise ValueError("the stream carries no payload")
    found = b"".join([data[b:e] for b, e in stream.ancillary])[: int.from_bytes(size, "big")]
    if len(found) != int.from_bytes(size, "big"):
        raise ValueError("frames are missing")
    return found


def stored(docs: DataFrame, block: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, with zeros up to a positive multiple of
    ``block`` bytes, as an MPEG audio stream.

    A null text is an empty one. Long texts are stored whole. Rows that repeat get equal
    streams; a null doc_id stays null. Extra columns are ignored; an empty table gives an
    empty result."""

    def run(batches):
        for pdf in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(r) for r in raw],
                                "media": [pack(r + bytes(-len(r) % block if r else block)) for r in raw]})

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def written(docs: DataFrame) -> DataFrame:
    """The streams of ``stored`` as a table in the shared folder, read back from there."""
    return staged(stored(docs), "media", "zstd")


def describe(stream: Stream) -> str:
    """The features of a stream as one line."""
    t = stream.table or {}
    seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in stream.offsets))
    return (f"frames={len(stream.offsets)};seconds={stream.seconds};kbps={','.join(map(str, sorted(stream.rates)))};"
            f"table={t.get('kind', '-')}:{t.get('frames', '-')}:{t.get('bytes', '-')};crc={stream.checked - stream.bad}/{stream.checked};"
            f"skipped={stream.skipped};seeks={seeks:08x}")


def probed(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, frame_offsets) of each stream of ``stored``, from its bytes alone; media: doc_id,
    n_bytes, media. A null stream gives nulls."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, n, data in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"]):
                if data is None:
                    rows.append((doc, n) + (None,) * 7)
                    continue
                stream = parse(data)
                payload = unpack(data, stream)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data),
                             hashlib.sha256(data).hexdigest(), describe(stream), stream.offsets))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frame_offsets"]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({k: "Int64" for k in ("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})

    return doc_columns(media, "doc_id", "n_bytes", "media").mapInPandas(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string, frame_offsets array<long>")
