"""Column expressions: time, text, severity, entropy terms, ids and message bodies."""

from eventlens.functions.entropy import entropy_basic, entropy_smoothed
from eventlens.functions.ids import content_id, experiment_content_id, json_sorted_text
from eventlens.functions.severity import rule_severity, severity_of
from eventlens.functions.text import file_extension, path_depth, special_char_ratio
from eventlens.functions.time import floor_time, iso_text, micros, parse_time, time_parts

__all__ = [
    "content_id",
    "entropy_basic",
    "entropy_smoothed",
    "experiment_content_id",
    "file_extension",
    "floor_time",
    "iso_text",
    "json_sorted_text",
    "parse_time",
    "path_depth",
    "rule_severity",
    "severity_of",
    "special_char_ratio",
    "time_parts",
    "micros",
]
