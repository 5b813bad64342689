"""Frame header decoding on integer header words and binary side information."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions.levels import int_div

_MPEG1, _MPEG2, _MPEG25 = "MPEG1", "MPEG2", "MPEG2.5"


def _bits(word: Column, low: int, width: int) -> Column:
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _pick(values, index: Column) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.get(table, index)


def version(word: Column) -> Column:
    bits = _bits(word, 19, 2)
    return F.when(bits == 3, _MPEG1).when(bits == 2, _MPEG2).when(bits == 0, _MPEG25)


def layer(word: Column) -> Column:
    """1, 2 or 3; NULL for the reserved value."""
    bits = _bits(word, 17, 2)
    return F.when(bits > 0, F.lit(4) - bits)


def has_crc(word: Column) -> Column:
    return _bits(word, 16, 1) == 0


def bitrate_kbps(word: Column) -> Column:
    index = _bits(word, 12, 4)
    return F.when(version(word) == _MPEG1, _pick(C.BITRATES_V1, index)).otherwise(_pick(C.BITRATES_V2, index))


def sample_rate(word: Column) -> Column:
    index, ver = _bits(word, 10, 2), version(word)
    chain = F
    for name in (_MPEG1, _MPEG2, _MPEG25):
        chain = chain.when(ver == name, _pick(C.FRAME_RATES[name], index))
    return chain


def has_padding(word: Column) -> Column:
    return _bits(word, 9, 1) == 1


def channel_mode(word: Column) -> Column:
    return _pick(C.CHANNEL_MODES, _bits(word, 6, 2))


def channel_count(mode: Column) -> Column:
    return F.when(mode == "Mono", 1).otherwise(2)


def granule_count(ver: Column) -> Column:
    return F.when(ver == _MPEG1, 2).otherwise(1)


def is_valid_header(word: Column) -> Column:
    """Sync bits set, version known, layer III, bitrate and rate indexes usable."""
    rate_index = _bits(word, 12, 4)
    return (
        (_bits(word, 21, 11) == 0x7FF)
        & (_bits(word, 19, 2) != 1)
        & (_bits(word, 17, 2) == 1)
        & (rate_index != 0)
        & (rate_index != 15)
        & (_bits(word, 10, 2) != 3)
    )


def frame_size(ver: Column, kbps: Column, rate: Column, padding: Column) -> Column:
    per_frame = F.when(ver == _MPEG1, 1152).otherwise(576)
    whole = int_div(per_frame * kbps * F.lit(125), rate)
    return (whole + F.when(padding, 1).otherwise(0)).cast("int")


def decode_header(word: Column) -> Column:
    """All header fields of a 32-bit word as one struct (fields NULL where undefined)."""
    ver, kbps, rate, pad = version(word), bitrate_kbps(word), sample_rate(word), has_padding(word)
    return F.struct(
        ver.alias("mpeg_version"),
        layer(word).alias("layer"),
        has_crc(word).alias("has_crc"),
        kbps.alias("bitrate_kbps"),
        rate.alias("sample_rate"),
        pad.alias("padding"),
        channel_mode(word).alias("channel_mode"),
        frame_size(ver, kbps, rate, pad).alias("frame_size"),
    )


def side_info_start(crc: Column) -> Column:
    return F.when(crc, 6).otherwise(4)


def gain_fields(full: bool, mono: bool) -> list[tuple[int, int, int]]:
    """(granule, channel, bit in the side information) of a frame layout.

    ``full`` frames (MPEG1) have two granules, the others one.
    """
    channels = 1 if mono else 2
    lead, stride = ((18 if mono else 20), 59) if full else ((9 if mono else 10), 63)
    return [
        (i // channels, i % channels, lead + i * stride + 21) for i in range(channels * (2 if full else 1))
    ]


def by_layout(ver: Column, mode: Column, make) -> Column:
    """``make(full, mono)`` for the layout of each row.

    Only four layouts exist, so every field position is a literal and the whole expression
    compiles; a loop over positions inside the expression would be interpreted per frame.
    """
    full, mono = ver == _MPEG1, mode == "Mono"
    return (
        F.when(full & ~mono, make(True, False))
        .when(full, make(True, True))
        .when(~mono, make(False, False))
        .otherwise(make(False, True))
    )


def _place(start: Column, gr: int, ch: int, bit: int) -> list[Column]:
    return [
        F.lit(gr).alias("gr"),
        F.lit(ch).alias("ch"),
        (start + F.lit(bit // 8)).cast("bigint").alias("byte_offset"),
        F.lit(bit % 8).alias("bit_offset"),
    ]


def gain_locations(ver: Column, mode: Column, crc: Column, frame_offset: Column) -> Column:
    """Positions of the gain fields of a frame in its file, granule by granule, channel by channel."""
    start = frame_offset + side_info_start(crc)

    def make(full: bool, mono: bool) -> Column:
        return F.array(*[F.struct(*_place(start, *field)) for field in gain_fields(full, mono)])

    return by_layout(ver, mode, make)


def read_gain_hex(digits: Column, bit: int) -> Column:
    """Eight bits at a bit position of data given as hex digits; bits past the end read as zero."""
    pair = F.rpad(F.substring(digits, bit // 8 * 2 + 1, 4), 4, "0")
    return F.shiftright(F.conv(pair, 16, 10).cast("int"), 8 - bit % 8).bitwiseAND(F.lit(255))


def read_gain(data: Column, bit: int) -> Column:
    """Eight bits at any bit position of binary data."""
    return read_gain_hex(F.hex(data), bit)


def gain_column(ver: Column, mode: Column, digits: Column, index: int) -> Column:
    """The gain field number ``index`` of a frame, NULL where the layout has fewer fields."""

    def make(full: bool, mono: bool) -> Column:
        fields = gain_fields(full, mono)
        return read_gain_hex(digits, fields[index][2]) if index < len(fields) else F.lit(None).cast("int")

    return by_layout(ver, mode, make)


def frame_gains(word: Column, side_info: Column, frame_offset: Column) -> Column:
    """Array of (gr, ch, byte_offset, bit_offset, gain) for one frame."""
    ver, mode = version(word), channel_mode(word)
    start = frame_offset + side_info_start(has_crc(word))
    digits = F.hex(side_info)

    def make(full: bool, mono: bool) -> Column:
        return F.array(*[
            F.struct(*_place(start, *field), read_gain_hex(digits, field[2]).alias("gain"))
            for field in gain_fields(full, mono)
        ])

    return by_layout(ver, mode, make)


def uint_be(data: Column) -> Column:
    """Big-endian unsigned integer of up to seven bytes."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def uint32_le(data: Column) -> Column:
    """Little-endian unsigned integer of four bytes."""
    swapped = F.regexp_replace(F.hex(data), "^(..)(..)(..)(..)$", "$4$3$2$1")
    return F.conv(swapped, 16, 10).cast("bigint")


def synchsafe(data: Column) -> Column:
    """28-bit integer stored seven bits per byte in four bytes."""
    b = lambda i: uint_be(F.substring(data, i, 1)).bitwiseAND(F.lit(127))
    return b(1) * 2097152 + b(2) * 16384 + b(3) * 128 + b(4)


def sniff_kind(content: Column) -> Column:
    """'mp4' when the content starts with a known file-type box, else 'mp3'."""
    is_box = F.substring(content, 5, 4) == F.lit(b"ftyp")
    size_ok = uint_be(F.substring(content, 1, 4)) >= 12
    brand = F.substring(content, 9, 4).isin([F.lit(b.encode()) for b in C.MP4_BRANDS])
    return F.when(F.coalesce((F.length(content) >= 12) & is_box & size_ok & brand, F.lit(False)), "mp4").otherwise("mp3")
