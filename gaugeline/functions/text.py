"""String helpers with the whitespace and quoting rules of the source format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the Unicode White_Space characters (what the source trims; Spark's
# one-argument trim() removes only ASCII spaces).
UNICODE_WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                       "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space at both ends (a character-set trim, no regex)."""
    return F.trim(_c(c), F.lit(UNICODE_WHITE_SPACE))


def strip_quotes(c) -> Column:
    """Remove one pair of surrounding double quotes (only when length >= 2)."""
    c = _c(c)
    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    return F.when(quoted, F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)

