"""Column helpers that clean message text. All stay native Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from replyloom.constants import MAX_FOREIGN_RATIO, MIN_TEXT_CHARS

# Java's \w and \s are ASCII-only by default; these classes give the Unicode meaning.
_HANDLE = r"@[\p{L}\p{N}_]+"
_SPACE = r"[\s\x1c-\x1f]"
_URL = r"(?U)https?://[^\s\x1c-\x1f]+"
_SIGNATURE = r"(?U)" + _SPACE + r"*\^[A-Za-z]{1,3}" + _SPACE + r"*$"
_SPACES = r"(?U)" + _SPACE + r"+"
_NOT_FOREIGN = r"[^\x{300}-\x{10FFFF}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_handles(c: Column | str) -> Column:
    """Remove ``@name`` mentions."""
    return F.regexp_replace(_col(c), _HANDLE, "")


def strip_urls(c: Column | str) -> Column:
    """Remove lower-case ``http://`` and ``https://`` links."""
    return F.regexp_replace(_col(c), _URL, "")


def strip_signature(c: Column | str) -> Column:
    """Remove a closing agent sign-off such as ``^AB``."""
    return F.regexp_replace(_col(c), _SIGNATURE, "")


def squeeze_ws(c: Column | str) -> Column:
    """Turn every run of Unicode white space into one space and trim."""
    return F.trim(F.regexp_replace(_col(c), _SPACES, " "))


def clean_text(c: Column | str, is_reply: bool = False) -> Column:
    """Handles, links, (for replies) the sign-off, then white space. Null stays null."""
    out = strip_urls(strip_handles(c))
    if is_reply:
        out = strip_signature(out)
    return squeeze_ws(out)


def non_latin_ratio(c: Column | str) -> Column:
    """Share of code points above U+02FF; 0 for empty text."""
    c = _col(c)
    n = F.length(c)
    foreign = F.length(F.regexp_replace(c, _NOT_FOREIGN, ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(foreign / n)


def is_latin_script(c: Column | str, max_ratio: float = MAX_FOREIGN_RATIO) -> Column:
    """True when at most ``max_ratio`` of the text lies outside the Latin blocks."""
    return non_latin_ratio(c) <= F.lit(float(max_ratio))


def long_enough(c: Column | str, min_chars: int = MIN_TEXT_CHARS) -> Column:
    """True when the text has ``min_chars`` code points or more; null text is too short."""
    return F.coalesce(F.length(_col(c)) >= min_chars, F.lit(False))


def fmt2(c: Column | str) -> Column:
    """Two decimals, rounding half to even on the binary value (not ``format_string``)."""
    return F.call_function("format_number", _col(c), F.lit("0.00"))
