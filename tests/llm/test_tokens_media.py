import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quern.llm import bitplane, mixing, mpeg_audio, packing
from quern.llm.tokens import encoder
from tests.llm.fixtures import documents, empty, prose, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return np.array(encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_chunked_ids_are_the_tokenizers(text):
    assert encoder(PATH)(text) == whole(text).tobytes()


def test_chunked_ids_of_words_and_specials():
    for text in [prose(1, 500), "It's DON'T. x, y.. <|endoftext|> <|ENDOFTEXT|> Éa éA naïve é a.b. ß ŉ", *[r[1] for r in rows()]]:
        assert encoder(PATH)(text) == whole(text).tobytes()
    assert not encoder(public_tokenizers.path("byte_bpe_50k.json")).chunked


def test_ids_of_every_letter_and_what_follows_it():
    encode = encoder(PATH)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for tail in ("", ".", "-)"):
        texts = [p + tail for p in points]
        for text, real in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert encode(text) == np.array(real.ids, "<u4").tobytes(), text
        encode.memory.clear()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZéİßŉΣσ\u0958\u09dc\u0a33\ufb1d\ufb4e\u0301\u0307\u093c漢ª.,'-_ \u00a0\n0٣", max_size=8), max_size=8))
def test_chunked_ids_of_mixed_scripts(parts):
    text = " ".join(parts)
    assert encoder(PATH)(text) == whole(text).tobytes()


def check_packing(got, data, length):
    ids = Counter()
    for r in data:
        full = np.append(whole(r[1]), 0).astype("<u4")
        for n, at in enumerate(range(0, len(full), length)):
            part = full[at: at + length]
            ids[(r[0], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by), -(-sum(r["length"] for r in got) // length)


def test_packing_places_every_piece(spark):
    for length in (2048, 64):
        used, least = check_packing(packing.packed(documents(spark), PATH, length).collect(), rows(), length)
        assert used <= least * 1.05 + 1
    assert packing.packed(empty(spark), PATH).count() == 0
    held = packing.packed(documents(spark), PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in held)


def least_bins(lengths, size):
    """The exact optimum, by search: each item into each different free space."""
    best = len(lengths)

    def put(k, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if k == len(lengths):
            best = len(spaces)
            return
        for space in {s for s in spaces if s >= lengths[k]}:
            rest = list(spaces)
            rest.remove(space)
            put(k + 1, [*rest, space - lengths[k]])
        put(k + 1, [*spaces, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_near_the_optimum_of_small_cases(lengths):
    used = sum(n for _, n in packing.plan(Counter(lengths), 20))
    assert least_bins(lengths, 20) <= used <= least_bins(lengths, 20) + 1


def test_plan_of_cases_with_a_known_optimum():
    assert least_bins([14, 14, 27, 27], 40) == 3
    # 27 + 14 is more than 40: ten sequences for the 27s, and 14s go in pairs.
    assert sum(n for _, n in packing.plan({14: 9, 27: 10}, 40)) == 15
    # No exact fill: 1100 + 700 wastes 248, 500s go in fours.
    assert sum(n for _, n in packing.plan({1100: 300, 700: 300, 500: 400}, 2048)) == 400
    assert sum(n for _, n in packing.plan({1024: 7, 512: 5, 1: 2047}, 2048)) == 6


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
@example({14: 9, 27: 10})
def test_plan_uses_the_histogram_exactly(histogram):
    used, total = Counter(), 0
    for pattern, n in packing.plan(histogram, 40):
        assert sum(k * t for k, t in pattern) <= 40 and n > 0
        for k, t in pattern:
            used[k] += n * t
        total += n
    assert used == Counter(histogram)
    # What is longer than half a sequence shares none; no two sequences are at most half full.
    volume = sum(k * n for k, n in histogram.items())
    long = sum(n for k, n in histogram.items() if k > 20)
    assert max(-(-volume // 40), long) <= total <= max(long, 2 * volume // 40 + 1)
    places = packing._Places(packing.plan(histogram, 40))
    seen = set()
    for k, n in histogram.items():
        sequence, offset = places.of(k, np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            cells = {(s, o + i) for i in range(k)}
            assert not cells & seen
            seen |= cells


def test_patterns_of_bounded_waste_by_hand():
    found = packing.patterns(np.array([3, 4]), 10, 2)
    assert sorted(map(tuple, found.tolist())) == [(3, 3, 3), (4, 3, 3), (4, 4, 0)]
    assert packing.patterns(np.array([1100, 700, 500]), 2048).shape == (0, 3)


def test_patterns_and_fit():
    found = packing.patterns(np.array([1, 2, 3, 5]), 6)
    assert sorted(map(tuple, found.tolist())) == [(2, 2, 2), (3, 2, 1), (3, 3, 0), (5, 1, 0)]
    counts = np.array([0, 4, 2, 2, 0, 2, 0])
    x = packing.repeats(found, counts)
    made = np.zeros(7)
    for p, v in zip(found, x):
        for k in p:
            made[k] += v * (k > 0)
    assert (x >= 0).all() and np.abs(made - counts).max() < 0.2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.integers(1, 17))
def test_shard_round_trip(ids, chunk):
    data = [np.array(x, "<u4").tobytes() for x in ids]
    names = [None if i % 5 == 4 else i * 3 for i in range(len(ids))]
    shard = bitplane.Shard(bitplane.write_shard(names, data, chunk))
    assert [(d, x.astype("<u4").tobytes()) for d, _, x in shard.documents()] == list(zip(names, data))
    flat = [v for x in ids for v in x]
    assert shard.read(1, max(1, len(flat) - 1)).tolist() == flat[1: max(1, len(flat) - 1)]


def test_damaged_shard_is_refused():
    with pytest.raises(ValueError):
        bitplane.Shard(b"QBP1 but cut off")


def test_bitplane_files(spark):
    for shard_ids in (1 << 20, 1000):
        files = bitplane.write(documents(spark), PATH, end=2, shard_ids=shard_ids, chunk=256)
        got = bitplane.read(files).collect()
        want, at = [], 0
        for r in sorted((r for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = np.append(whole(r[1]), 2).astype("<u4")
            want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        named = sorted(tuple(r) for r in got if r["doc_id"] is not None)
        assert named == sorted(w for w in want if w[0] is not None)
        assert sorted(tuple(r)[2:] for r in got if r["doc_id"] is None) == sorted(w[2:] for w in want if w[0] is None)
    assert bitplane.read(bitplane.write(empty(spark), PATH)).count() == 0


def test_bitplane_files_of_one_hot_document_id(spark):
    docs = spark.createDataFrame([(7, prose(k % 5, 30)) for k in range(400)] + [(1, "a"), (9, "b")], "doc_id long, text string").repartition(4)
    files = bitplane.write(docs, PATH, shard_ids=500, chunk=64)
    assert files.agg({"ids": "max"}).first()[0] < 700 and files.where("part > 5").count() > 0
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in bitplane.read(files).collect())
    assert [d for _, d, _ in got] == [1] + [7] * 400 + [9]
    assert [s for s, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, _, n in got])[:-1]]).tolist()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000))
def test_audio_round_trip(payload):
    media = mpeg_audio.pack(payload)
    stream = mpeg_audio.parse(media)
    assert mpeg_audio.unpack(media, stream) == payload
    assert stream.skipped == 0 and stream.bad == 0 and stream.checked == len(stream.offsets) == stream.table["frames"]
    assert stream.samples == 1152 * len(stream.offsets) and stream.microseconds == 24_000 * len(stream.offsets)
    assert all(media[o: o + 2] == b"\xff\xfa" for o in stream.offsets)


def test_audio_resynchronises_and_sees_damage():
    payload = random.Random(3).randbytes(8000)
    media = mpeg_audio.pack(payload)
    clean = mpeg_audio.parse(media)
    at = clean.offsets[3]
    dirty = media[:at] + b"\xff\xfb\x90garbage\xff" + media[at:] + b"TAG" + bytes(125)
    stream = mpeg_audio.parse(dirty)
    assert stream.skipped == 11 and len(stream.offsets) == len(clean.offsets) - 1 or mpeg_audio.unpack(dirty, stream) == payload
    assert "ID3v1" in stream.tags
    broken = bytearray(media)
    broken[at + 8] ^= 1
    assert mpeg_audio.parse(bytes(broken)).bad == 1


def test_payload_may_hold_the_letters_of_an_id3v1_tag():
    rng, places = random.Random(4), 0
    for size in range(64, 4096, 64):
        payload = rng.randbytes(size)
        at = payload.find(mpeg_audio.pack(payload)[-128:-125])
        if at >= 0:
            places += 1
            payload = payload[:at] + b"TAG" + payload[at + 3:]
            media = mpeg_audio.pack(payload)
            assert media[-128:-125] == b"TAG" and mpeg_audio.unpack(media) == payload
            tagged = mpeg_audio.parse(media + b"TAG" + bytes(125))
            assert "ID3v1" in tagged.tags and tagged.skipped == 0 and mpeg_audio.unpack(media + b"TAG" + bytes(125)) == payload
    assert places > 10


def test_audio_headers_of_the_standard():
    # Sizes of well-known frames: 128 kbit/s at 44.1 kHz, with and without padding; Layer II; MPEG-2.
    assert mpeg_audio.header(bytes((0xFF, 0xFB, 0x90, 0x00))).size == 417
    assert mpeg_audio.header(bytes((0xFF, 0xFB, 0x92, 0x00))).size == 418
    assert mpeg_audio.header(bytes((0xFF, 0xFD, 0xA4, 0x00))).size == 576
    h = mpeg_audio.header(bytes((0xFF, 0xF3, 0x84, 0xC0)))
    assert (h.samples, h.hertz, h.kbps, h.size, h.side) == (576, 24000, 64, 192, 9)
    assert mpeg_audio.header(b"\xff\xff\xf0\x00") is None and mpeg_audio.header(b"\x00\x00\x00\x00") is None


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        high = crc >> 15 ^ int(b)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return crc


def frame(four, covered, seed):
    """A protected frame whose CRC covers the given number of bits of its body."""
    h = mpeg_audio.header(four)
    body = random.Random(seed).randbytes(h.size - 6)
    return four + slow_crc(bits_of(four[2:]) + bits_of(body)[:covered(bits_of(body))]).to_bytes(2, "big") + body


def layer_two(bands, channels, bound=32):
    def covered(bits):
        at, chosen = 0, 0
        for band, width in enumerate(bands):
            for _ in range(channels if band < bound else 1):
                if "1" in bits[at: at + width]:
                    chosen += 1 if band < bound else channels
                at += width
        return at + 2 * chosen

    return covered


def test_audio_checksums_of_all_layers():
    cases = [
        (bytes((0xFF, 0xFE, 0x64, 0x00)), lambda bits: 256),  # Layer I, stereo, 48 kHz
        (bytes((0xFF, 0xFE, 0x64, 0x50)), lambda bits: 4 * (32 + 8)),  # joint stereo from subband 8 on
        (bytes((0xFF, 0xFE, 0x64, 0xC0)), lambda bits: 128),
        (bytes((0xFF, 0xFC, 0xA4, 0x00)), layer_two([4] * 11 + [3] * 12 + [2] * 4, 2)),  # Layer II, 192 kbit/s, 48 kHz
        (bytes((0xFF, 0xFC, 0xA0, 0x40)), layer_two([4] * 11 + [3] * 12 + [2] * 7, 2, 4)),  # 44.1 kHz, joint stereo
        (bytes((0xFF, 0xFC, 0x28, 0xC0)), layer_two([4] * 2 + [3] * 10, 1)),  # 48 kbit/s mono, 32 kHz
        (bytes((0xFF, 0xF4, 0x84, 0xC0)), layer_two([4] * 4 + [3] * 7 + [2] * 19, 1)),  # MPEG-2
        (bytes((0xFF, 0xFA, 0x94, 0xC0)), lambda bits: 8 * 17),
    ]
    for four, covered in cases:
        frames = [frame(four, covered, k) for k in range(3)]
        stream = mpeg_audio.parse(b"".join(frames))
        assert (len(stream.offsets), stream.checked, stream.bad) == (3, 3, 0), four.hex()
        broken = bytearray(b"".join(frames))
        broken[6] ^= 0x80
        assert mpeg_audio.parse(bytes(broken)).bad >= 1


def test_audio_durations_are_fractions():
    h = mpeg_audio.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    one = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(h.size - 4)
    stream = mpeg_audio.parse(one * 7)
    assert stream.seconds == Fraction(7 * 1152, 44100) and stream.microseconds == 182857
    assert "seconds=64/350" not in mpeg_audio.describe(stream) and "seconds=32/175" in mpeg_audio.describe(stream)


def test_audio_vbri_table():
    four = bytes((0xFF, 0xFB, 0x90, 0x00))
    h = mpeg_audio.header(four)
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 10, 20, 30)
    lead = (four + bytes(32) + table).ljust(h.size, b"\0")
    stream = mpeg_audio.parse(lead + (four + bytes(h.size - 4)) * 2)
    assert stream.table == {"kind": "VBRI", "frames": 12, "bytes": 5000, "quality": 75, "seek": [20, 40, 60], "frames_per_entry": 4}
    assert len(stream.offsets) == 2


def test_audio_false_header_is_passed_over():
    # A header of another rate follows where the false frame ends, which does not count.
    four, other = bytes((0xFF, 0xFB, 0x90, 0x00)), bytes((0xFF, 0xFB, 0x94, 0x00))
    size = mpeg_audio.header(four).size
    real = (four + bytes(size - 4)) * 3
    false = other + bytes(mpeg_audio.header(other).size - 4)
    stream = mpeg_audio.parse(false + real)
    assert stream.skipped == len(false) and stream.offsets == [len(false) + k * size for k in range(3)]


def test_audio_table(spark):
    got = mpeg_audio.probed(mpeg_audio.written(documents(spark))).collect()
    assert all(r["frame_offsets"] and r["feature"].startswith(f"frames={len(r['frame_offsets'])};") for r in got)
    assert len(got) == len(rows())
    want = Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert mpeg_audio.stored(empty(spark)).count() == 0


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    data = [(i, prose(i, rng.choice([5, 20, 60, 61, 150])), f"s{min(3, i % 7)}") for i in range(900)]
    data += [(2000 + i, prose(7, 50), "s0") for i in range(600)] + [(9000, None, None), (9001, "", "s1"), (None, "a b c", None), (9002, "a b", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mixture(df).collect()
    assert len(got) == len(data)
    again = mixing.mixture(df.repartition(7)).collect()
    show = lambda rows_: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows_)
    assert show(got) == show(again)
    source = {r[0]: r[2] for r in data}
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((d[0], d[1]) for d in data[-4:]).get(r["doc_id"]) or "")) or r["doc_id"] is None or r["doc_id"] < 9000
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        size[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
    want = water(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5
    assert mixing.mixture(empty(spark)).count() == 0


def water(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * size[s]]
        if not over:
            return {s: full.get(s, level * weight[s]) for s in names}
        full |= {s: 3 * size[s] for s in over}


def test_rates_are_the_dual_optimum(spark):
    """The tilt of each source by plain bisection, and the copies' rates from it."""
    rng = random.Random(12)
    data = [(i, prose(i, rng.choice([3, 8, 30, 31, 90, 200])), f"s{min(4, i % 9)}") for i in range(500)] + [(1000, prose(1, 3000), "s1")]
    got = mixing.mixture(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in data}
    for s in sorted(set(source.values())):
        rows_ = [r for r in got if source[r["doc_id"]] == s]
        goal, mean = rows_[0]["target"], sum(r["size"] for r in rows_) / len(rows_)
        rate = lambda t, size: min(3.0, math.exp(min(50.0, t * size / mean)))
        if goal >= 3 * sum(r["size"] for r in rows_) * (1 - 1e-12):
            assert all(r["rate"] == 3 for r in rows_)
            continue
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(r["size"] * rate(mid, r["size"]) for r in rows_) < goal else (lo, mid)
        assert all(abs(r["rate"] - rate(lo, r["size"])) < 1e-5 * max(1, r["rate"]) for r in rows_)
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.floor(r["rate"]) + 1 for r in rows_)


def test_fold_of_many_sizes_is_the_same_in_short_lists(spark, monkeypatch):
    data = [(i, prose(1, 1).split()[0] + " w" * (i % 90), f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    show = lambda: sorted((r["doc_id"], r["taken"]) for r in mixing.mixture(docs).collect())
    whole = show()
    monkeypatch.setattr(mixing, "CHUNK", 7)
    assert show() == whole


def test_mixed_repeats_rows(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = Counter(r["doc_id"] for r in out.collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).where("doc_id is not null and doc_id <> 7").collect()}
    assert {k: taken[k] for k in copies} == copies


def test_mixing_is_native(spark):
    df = documents(spark).limit(5)
    plan = mixing.mixture(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
