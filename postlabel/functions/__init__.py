from .labels import decode_label, encode_label, parse_response
from .scores import argmax, score_struct, softmax
from .text import (
    collapse_ws,
    compose_text,
    contains_any,
    count_char,
    count_matches,
    ends_with_question,
    head_segment,
    is_match_thread,
    java_regex,
    keyword_hits,
    matches_any,
    not_tombstone,
    prefix,
    preview,
    starts_with_any,
    strip_ws,
)

__all__ = [
    "argmax", "collapse_ws", "compose_text", "contains_any", "count_char", "count_matches",
    "decode_label", "encode_label", "ends_with_question", "head_segment", "is_match_thread",
    "java_regex", "keyword_hits", "matches_any", "not_tombstone", "parse_response", "prefix",
    "preview", "score_struct", "softmax", "starts_with_any", "strip_ws",
]
