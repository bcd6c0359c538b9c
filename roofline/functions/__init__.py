"""Column -> Column expressions."""

from .ids import content_signature, missing_attrs, stable_id
from .numbers import (parse_number, retry_delay_seconds, to_bool_cell, to_bool_setting,
                      to_double_cell, to_double_setting)
from .predicates import excludes_keywords, matches_criteria, requires_keywords, within
from .text import (bounded_text, format_attrs, format_g, haystack, html_escape, is_removed_text,
                   keyword_window, keywords_cell, node_text, normalize_location, strip_text)
from .urls import infer_source_type, join_origin, page_url, resolve_url, url_origin, with_radius

__all__ = [n for n in dir() if not n.startswith("_")]
