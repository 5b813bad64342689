"""Schemas of the library's tables. Nothing is inferred."""

PACKETS = (
    "album string, track string, packet_no bigint, sample_rate int, format string, "
    "left array<double>, right array<double>"
)
SAMPLES = "album string, track string, n bigint, left double, right double"
COEFFS = "sample_rate int, ya array<double>, yb array<double>, ba array<double>, bb array<double>"
FRAMES = "path string, frame_no bigint, frame_offset bigint, header_word bigint, side_info binary"
GAINS = "path string, frame_no bigint, gr int, ch int, byte_offset bigint, bit_offset int, gain int"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
TAGS = "path string, namespace string, pos int, key string, value string"
LEDGER = (
    "path string, ts timestamp, id bigint, channel int, steps int, wrap boolean, min_gain int, max_gain int"
)
REPORT = (
    "file string, status string, frames bigint, mpeg_version string, channel_mode string, min_gain int, "
    "max_gain int, avg_gain double, headroom_steps int, headroom_db double, gain_applied_steps int, "
    "gain_applied_db double, loudness_db double, peak double, max_amplitude double, error string, "
    "warning string, dry_run boolean"
)
