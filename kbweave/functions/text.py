"""String helpers: fingerprints, hash buckets, tokens, strip, number format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by Python's str.strip() (str.isspace), as a regex class.
PY_SPACE_CLASS = (r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Token rule for hashed term frequencies: runs of letters and digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fingerprint(col, n: int = 8) -> Column:
    """First ``n`` hex digits of md5 over the UTF-8 bytes."""
    return F.substring(F.md5(F.encode(_c(col), "UTF-8")), 1, n)


def md5_u32(col) -> Column:
    """First 32 bits of md5 as a non-negative LONG (portable to DuckDB)."""
    return F.conv(F.substring(F.md5(F.encode(_c(col), "UTF-8")), 1, 8), 16, 10).cast("long")


def md5_bucket(col, n: int) -> Column:
    return F.pmod(md5_u32(col), F.lit(n))


def py_strip(col) -> Column:
    """``str.strip()`` semantics (Unicode spaces such as U+3000 included)."""
    cls = PY_SPACE_CLASS
    return F.regexp_replace(_c(col), f"^{cls}+|{cls}+$", "")


def tokens(col) -> Column:
    """Lower-cased letter/digit runs, empty pieces removed."""
    return F.array_remove(F.split(F.lower(_c(col)), TOKEN_SPLIT), "")


def py_tokens(text: str) -> list[str]:
    """``tokens`` of one text in Python."""
    import regex
    return [t for t in regex.split(TOKEN_SPLIT, text.lower()) if t]


def token_lists(texts) -> Column:
    """``tokens`` of every text of an array."""
    return F.transform(_c(texts), tokens)


def fmt2(col) -> Column:
    """Python ``f"{x:.2f}"`` for |x| <= 1: round half-even on the binary value."""
    return F.format_number(_c(col), 2)
