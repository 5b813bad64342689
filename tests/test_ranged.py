"""Tags read in ranges against tags read from whole contents."""

import struct

import pytest
from pyspark.sql import functions as F

from loudframe.contracts.roles import ROWS_PER_TASK, spread
from loudframe.sources import files as FS
from loudframe.sources import ranged as RA


def box(kind, *inner, size=None, wide=False):
    data = b"".join(inner)
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data
    return struct.pack(">I4s", len(data) + 8 if size is None else size, kind) + data


def free(key, value, space=b"com.apple.iTunes"):
    return box(b"----", box(b"mean", b"\0" * 4, space), box(b"name", b"\0" * 4, key), box(b"data", b"\0" * 8, value))


ITEMS = box(b"ilst", free(b"replaygain_track_gain", b"-1.00 dB"), free(b"REPLAYGAIN_ALBUM_PEAK", b"0.5"), free(b"x", b"y"))
MOOV = box(b"moov", box(b"trak", b"t" * 5000), box(b"udta", box(b"meta", b"\0" * 4, box(b"hdlr", b"h" * 30), ITEMS)))


def ape(size_of=None, version=2000, after=b""):
    items = b"".join(struct.pack("<II", len(v), 0) + k + b"\0" + v for k, v in ((b"Artist", b"A" * 300), (b"MP3GAIN_UNDO", b"+001,+001,N")))
    return items + b"APETAGEX" + struct.pack("<IIII", version, len(items) + 32 if size_of is None else size_of, 2, 0) + b"\0" * 8 + after


FILES = {
    "mp4": {"plain": box(b"ftyp", b"M4A ") + box(b"mdat", b"d" * 100_000) + MOOV, "first": MOOV + box(b"mdat", b"d" * 50_000),
            "wide": box(b"mdat", b"d" * 90_000, wide=True) + MOOV, "none": box(b"ftyp", b"M4A ") + box(b"mdat", b"d" * 10), "empty": b"", "short": b"abc",
            "broken": box(b"mdat", b"", size=3) + MOOV, "zero": struct.pack(">I4s", 0, b"mdat") + MOOV, "cut": (box(b"ftyp", b"M4A ") + MOOV)[:-60],
            "twice": box(b"moov", b"") + MOOV, "lies": box(b"mdat", b"d" * 20, size=1 << 31) + MOOV},
    "ape": {"end": b"f" * 100_000 + ape(), "before": b"f" * 70_000 + ape(after=b"TAG" + bytes(125)), "old": b"f" * 999 + ape(version=1000), "empty": b"",
            "small": ape()[-40:], "tiny": b"APETAGEX", "huge": b"f" * 500 + ape(size_of=1 << 30), "zero": b"f" * 500 + ape(size_of=32), "none": b"f" * 5000,
            "other": b"f" * 300 + ape(after=b"XYZ" + bytes(125)), "only": ape()},
}


@pytest.mark.parametrize("kind", ["mp4", "ape"])
def test_the_same_tags_from_few_bytes(spark, tmp_path, kind):
    rows = spark.createDataFrame([(f"sub/{n}.{kind}", bytearray(d)) for n, d in FILES[kind].items()] + [("note.txt", bytearray(b"x"))], "path string, content binary")
    for _ in range(2):  # a task that runs again writes the same files
        assert RA.write_files(rows.repartition(3), str(tmp_path / "f")).count() == len(FILES[kind]) + 1
    found = RA.read_regions(spark, str(tmp_path / "f"), kind, (kind,), files_per_task=4)
    assert found.rdd.getNumPartitions() == 3
    read = {r.path.rsplit("/", 1)[1].split(".")[0]: r for r in found.collect()}
    assert set(read) == set(FILES[kind]) and all(r.error is None and r.length == len(FILES[kind][n]) for n, r in read.items())
    assert all(r.bytes_read < 1500 for r in read.values())
    tags = FS.mp4_tag_rows if kind == "mp4" else FS.ape_tag_rows
    name = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    got, want = (sorted(tags(d).select(name.alias("n"), "namespace", "pos", "key", "value").collect()) for d in (found, rows.where("path <> 'note.txt'")))
    assert got == want and len(got) >= 6


def test_a_file_beyond_two_gib(spark, tmp_path):
    (tmp_path / "f").mkdir()
    with open(tmp_path / "f" / "big.m4a", "wb") as out:  # a hole of 3 GiB takes no disk
        out.write(struct.pack(">I4sQ", 1, b"mdat", 3 * 2**30 + 16))
        out.seek(3 * 2**30 + 16)
        out.write(MOOV)
    found = RA.read_regions(spark, str(tmp_path / "f"), "mp4")
    row = found.first()
    assert row.length > 3 * 2**30 and row.bytes_read < 1500
    assert {r.key for r in FS.mp4_tag_rows(found).collect()} == {"replaygain_track_gain", "replaygain_album_peak"}


def test_a_folder_without_files_and_a_wrong_kind(spark, tmp_path):
    (tmp_path / "f").mkdir()
    assert RA.read_regions(spark, str(tmp_path / "f"), "ape").count() == 0
    with pytest.raises(Exception, match="kind must be"):
        RA.read_regions(spark, str(tmp_path / "f"), "mp5").count()


def test_tasks_of_spread_rows_grow_with_the_table(spark):
    dealt = spread(spark.range(20 * ROWS_PER_TASK, numPartitions=2))
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 20 * ROWS_PER_TASK
