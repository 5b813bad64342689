"""Hand-made file contents against a plain byte-by-byte reading."""

import random
import struct

from pyspark.sql import functions as F

from loudframe.functions import headers as H
from loudframe.operators import frames as FR
from loudframe.sources import files as FS

KBPS = {True: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
        False: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def header(version=3, crc=False, kbps=9, rate=0, padding=0, mode=0):
    return bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | (0 if crc else 1), kbps << 4 | rate << 2 | padding << 1, mode << 6])


def size_of(h):
    """Frame size, or None when the four bytes are no layer III header."""
    if h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, kbps, rate = h[1] >> 3 & 3, h[1] >> 1 & 3, h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer != 1 or kbps in (0, 15) or rate == 3:
        return None
    samples = 1152 if version == 3 else 576
    return samples * KBPS[version == 3][kbps] * 125 // RATES[version][rate] + (h[2] >> 1 & 1)


def gain_bits(h):
    version, mono = h[1] >> 3 & 3, h[3] >> 6 == 3
    channels, granules = (1 if mono else 2), (2 if version == 3 else 1)
    lead = ({True: 18, False: 20} if version == 3 else {True: 9, False: 10})[mono]
    return [lead + i * (59 if version == 3 else 63) + 21 for i in range(granules * channels)]


def frame(gains, fill=0, **fields):
    h = header(**fields)
    body = bytearray([fill]) * size_of(h)
    body[:4] = h
    start = 8 * (6 if fields.get("crc") else 4)
    number = int.from_bytes(body, "big")
    total = 8 * len(body)
    for bit, gain in zip(gain_bits(h), gains, strict=True):
        shift = total - start - bit - 8
        number = number & ~(255 << shift) | gain << shift
    return number.to_bytes(len(body), "big")


def info_frame(marker=b"Xing", **fields):
    h = header(**fields)
    body = bytearray(size_of(h))
    body[:4] = h
    version, mono = h[1] >> 3 & 3, h[3] >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    at = (6 if fields.get("crc") else 4) + side
    body[at:at + 4] = marker
    return bytes(body)


def id3v2(size):
    parts = [size >> s & 127 for s in (21, 14, 7, 0)]
    return b"ID3\4\0\0" + bytes(parts) + bytes(size)


def ape(items, head=True, version=2000, flags=0x80000000):
    body = b"".join(struct.pack("<II", len(v), 0) + k + b"\0" + v for k, v in items)
    tail = struct.pack("<IIII", version, len(body) + 32, len(items), flags) + bytes(8)
    top = b"APETAGEX" + struct.pack("<IIII", version, len(body) + 32, len(items), 0xA0000000) + bytes(8) if head else b""
    return top + body + b"APETAGEX" + tail


def id3v1():
    return b"TAG" + bytes(125)


def plain_walk(data):
    """Frame offsets by a byte-by-byte walk."""
    end = len(data)
    if end >= 128 and data[end - 128:end - 125] == b"TAG":
        end -= 128
    if end >= 32 and data[end - 32:end - 24] == b"APETAGEX":
        size, _, flags = struct.unpack_from("<III", data, end - 20)
        whole = size + (32 if flags >= 1 << 31 else 0)
        end = end - whole if end >= whole else end
    at = 10 + sum((data[6 + i] & 127) << 7 * (3 - i) for i in range(4)) if data[:3] == b"ID3" and len(data) >= 10 else 0
    found = []
    while at + 4 <= end:
        size = size_of(data[at:at + 4])
        nxt = at + (size or 0)
        ok = size is not None and (
            data[nxt] == 0xFF and data[nxt + 1] & 0xE0 == 0xE0 if nxt + 2 <= end else nxt <= end
        )
        if not ok:
            at += 1
            continue
        h = data[at:at + 4]
        side = ((17 if h[3] >> 6 == 3 else 32) if h[1] >> 3 & 3 == 3 else (9 if h[3] >> 6 == 3 else 17))
        spot = at + (4 if h[1] & 1 else 6) + side
        if data[spot:spot + 4] not in (b"Xing", b"Info"):
            found.append(at)
        at = nxt
    return found


def files(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def samples():
    rng = random.Random(4)
    g = lambda n: [rng.randrange(256) for _ in range(n)]
    stereo = b"".join(frame(g(4)) for _ in range(5))
    mixed = b"".join(
        frame(g((2 if v == 3 else 1) * (1 if m == 3 else 2)), version=v, crc=c, rate=r, mode=m, kbps=k, padding=p)
        for v in (3, 2, 0) for m in (0, 1, 2, 3) for c in (False, True) for r, k, p in ((0, 9, 0), (1, 3, 1), (2, 14, 0))
    )
    made = {
        "stereo": stereo,
        "mixed": mixed,
        "tags": id3v2(300) + stereo + ape([(b"KEY", b"value")]) + id3v1(),
        "ape_without_header": stereo + ape([(b"KEY", b"value")], head=False, flags=0),
        "info": info_frame() + stereo,
        "info_mono": info_frame(b"Info", mode=3) + frame(g(2), mode=3) * 2,
        "info_mpeg2": info_frame(b"Xing", version=2) + frame(g(2), version=2) * 2,
        "junk": b"\xff\xfb\x90junk" + stereo + b"\xff\xe3zz\xff" + stereo,
        "cut": stereo[:-100],
        "cut_side_info": frame(g(1), version=0, kbps=1, rate=0, mode=3),
        "empty": b"",
        "text": b"no audio here",
        "id3_too_long": id3v2(10)[:8] + b"\x7f\x7f" + stereo,
        "bad_ape_size": stereo + ape([])[:-20] + struct.pack("<I", 10**6) + ape([])[-16:],
    }
    for i in range(40):
        noise = bytes(rng.choice((0xFF, 0xFB, 0xF3, 0xE3, 0x90, 0x14, 0, 64)) for _ in range(3000))
        made[f"noise{i}"] = noise + stereo[: rng.randrange(len(stereo))] + noise
    return made


def test_frames_of_hand_made_files(spark):
    made = samples()
    rows = FS.frame_rows(files(spark, made).repartition(3)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.frame_no)):
        got.setdefault(r.path, []).append(r)
    for name, data in made.items():
        want = plain_walk(data)
        have = got.get(name, [])
        assert [r.frame_offset for r in have] == want, name
        assert [r.frame_no for r in have] == list(range(len(want))), name
        for r in have:
            at = r.frame_offset
            assert r.header_word == int.from_bytes(data[at:at + 4], "big")
            start = at + (4 if data[at + 1] & 1 else 6)
            assert bytes(r.side_info) == data[start:start + 32]
    assert len(got["mixed"]) == 72 and len(got["info"]) == 5 and "text" not in got


def test_gains_and_statistics(spark):
    made = {"a": frame([10, 20, 30, 40]) + frame([200, 1, 2, 3]), "m": frame([7, 9], mode=3) * 2,
            "c": frame([5, 6, 7, 8], crc=True) * 2, "v2": frame([50, 60], version=2) * 2}
    frames = FS.frame_rows(files(spark, made))
    gains = FR.gain_rows(frames)
    got = {(r.path, r.frame_no): [] for r in gains.collect()}
    for r in gains.orderBy("path", "frame_no", "gr", "ch").collect():
        got[r.path, r.frame_no].append(r.gain)
    assert got == {("a", 0): [10, 20, 30, 40], ("a", 1): [200, 1, 2, 3], ("m", 0): [7, 9], ("m", 1): [7, 9],
                   ("c", 0): [5, 6, 7, 8], ("c", 1): [5, 6, 7, 8], ("v2", 0): [50, 60], ("v2", 1): [50, 60]}
    stats = {r.path: r for r in FR.frame_stats(frames).collect()}
    a = stats["a"]
    assert (a.frames, a.mpeg_version, a.channel_mode, a.min_gain, a.max_gain) == (2, "MPEG1", "Stereo", 1, 200)
    assert a.avg_gain == sum([10, 20, 30, 40, 200, 1, 2, 3]) / 8 and a.headroom_steps == 55 and a.headroom_db == 82.5
    assert stats["m"].channel_mode == "Mono" and stats["v2"].mpeg_version == "MPEG2"
    for r in stats.values():
        assert r.min_gain <= r.avg_gain <= r.max_gain
    both = FR.stats_or_error(files(spark, {**made, "none": b"x"}).select("path"), FR.frame_stats(frames))
    assert {r.path: r.error for r in both.collect()}["none"] == "No valid MP3 frames found"


def test_header_examples(spark):
    rows = spark.createDataFrame([(0xFFFB9000,), (0,), (0xFFFF9000,)], "w bigint")
    got = rows.select(H.is_valid_header(F.col("w")).alias("ok"), H.decode_header(F.col("w")).alias("h")).collect()
    assert [r.ok for r in got] == [True, False, False]
    assert (got[0].h.mpeg_version, got[0].h.bitrate_kbps, got[0].h.sample_rate, got[0].h.frame_size) == ("MPEG1", 128, 44100, 417)


def test_unaligned_reads(spark):
    data = F.unhex(F.lit("ABCDEF1234"))
    cols = [H.read_gain(data, bit) for bit in (8, 12, 36, 40, 400)]
    assert tuple(spark.range(1).select(*cols).first()) == (0xCD, 0xDE, 0x40, 0, 0)


def test_ape_tags(spark):
    items = [(b"Key", b"one"), (b"KEY", b"two"), ("Ü".encode(), "é".encode()), (b"bad", b"\xff")]
    made = {
        "end": b"audio" + ape(items),
        "v1": ape(items) + id3v1(),
        "old": ape(items, version=1000),
        "none": b"x" * 500,
        "empty": ape([]),
        "short": b"APETAGEX",
        "cut": b"z" + ape(items)[32 + 15:],
        "too_big": ape([])[-32:-20] + struct.pack("<I", 5000) + ape([])[-16:],
    }
    lists = {r.path: r.items for r in FS.ape_tag_lists(files(spark, made)).collect()}
    want = [("Key", "one"), ("KEY", "two"), ("Ü", "é"), ("bad", "�")]
    assert [tuple(i) for i in lists["end"]] == want and [tuple(i) for i in lists["v1"]] == want
    assert lists["old"] is None and lists["none"] is None and lists["short"] is None and lists["too_big"] is None
    assert lists["empty"] == []
    rows = FS.ape_tag_rows(files(spark, made)).where("path = 'end'").orderBy("pos").collect()
    assert [(r.pos, r.key, r.value) for r in rows] == [(i, k, v) for i, (k, v) in enumerate(want)]


def box(kind, body, wide=False):
    if wide:
        return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body
    return struct.pack(">I", len(body) + 8) + kind + body


def free(space, name, value):
    return box(b"----", box(b"mean", bytes(4) + space) + box(b"name", bytes(4) + name) + box(b"data", bytes(8) + value))


def test_mp4_tags_and_kind(spark):
    apple = b"com.apple.iTunes"
    tags = free(apple, b"ReplayGain_Track_Gain", b"+3.50 dB") + free(b"other", b"replaygain_track_peak", b"1")
    tags += free(apple, b"replaygain_album_peak", b"0.9") + free(apple, b"replaygain_album_peak", b"0.8") + box(b"free", b"")
    tree = lambda wide: box(b"moov", box(b"mvhd", bytes(9)) + box(b"udta", box(b"meta", bytes(4) + box(b"ilst", tags)), wide), wide)
    ftyp = box(b"ftyp", b"M4A \0\0\0\0isom")
    made = {
        "plain": ftyp + tree(False),
        "wide": ftyp + box(b"mdat", bytes(100)) + tree(True),
        "no_moov": ftyp + box(b"mdat", bytes(100)),
        "to_end": ftyp + struct.pack(">I", 0) + b"mdat" + tree(False),
        "broken": ftyp + tree(False)[:60],
        "mp3": frame([1, 2, 3, 4]) * 2,
    }
    lists = {r.path: [tuple(i) for i in r.items] for r in FS.mp4_tag_lists(files(spark, made)).collect()}
    want = [("replaygain_track_gain", "+3.50 dB"), ("replaygain_album_peak", "0.8")]
    assert lists["plain"] == want and lists["wide"] == want
    assert lists["no_moov"] == lists["to_end"] == lists["mp3"] == []
    kinds = files(spark, {**made, "qt": box(b"ftyp", b"qt  \0\0\0\0"), "tiny": b"ab"}).select(
        "path", H.sniff_kind(F.col("content")).alias("kind")
    )
    assert {r.path for r in kinds.collect() if r.kind == "mp4"} == {"plain", "wide", "no_moov", "to_end", "broken"}
