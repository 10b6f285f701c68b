"""Text expressions. All are Catalyst columns; none leaves the JVM."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as
# whitespace (29 of them). Spark's trim() alone removes only the space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Strings without these characters have no whitespace but spaces.
NOT_PRINTABLE_ASCII = "[^ -~]"
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_WS_CLASS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
TERM = r"[\p{L}\p{N}]+"


def strip(col) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_short(col) -> Column:
    """As `strip`, and faster for names in ASCII, as Spark's trim of spaces is; the pattern reads the whole string."""
    return F.when(F.rlike(col, F.lit(NOT_PRINTABLE_ASCII)), strip(col)).otherwise(F.trim(col))


def collapse(col) -> Column:
    """Each run of whitespace becomes one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col, WS_CLASS + "+", " "))


def blank_to_null(col) -> Column:
    """Strip a name, then null for the empty string."""
    return F.nullif(strip_short(col), F.lit(""))


def word_count(col) -> Column:
    return F.regexp_count(col, F.lit(NON_WS_CLASS + "+"))


def terms(col) -> Column:
    """Lower-cased runs of letters and digits, in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(TERM), F.lit(0))


def any_of(conditions, empty=False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def fixed(value, digits) -> Column:
    """A number with fixed decimals, rounded half to even on its exact binary value.

    `format_string` rounds the shortest decimal form half up, which differs for
    ties such as 0.125 and for values beside them. The product with a power of
    ten is split into its rounded value and the exact error (Dekker, 1971), which
    tells on which side of a tie the number is. There are no ties beyond 2^52 steps.
    """
    signed = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale, limit = float(10**digits), float(2**52 // 10**digits)
    small = F.abs(signed) < F.lit(limit)
    x = F.when(small, F.abs(signed)).otherwise(F.lit(0.0))
    product = x * F.lit(scale)

    def halves(v):
        wide = v * F.lit(134217729.0)
        high = wide - (wide - v)
        return high, v - high

    (a, b), (c, d) = halves(x), halves(F.lit(scale))
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product).cast("long")
    past = product - whole.cast("double") - F.lit(0.5)
    odd = whole % 2 == 1
    steps = whole + ((past > 0) | ((past == 0) & ((error > 0) | ((error == 0) & odd)))).cast("long")
    rest = steps % (10**digits)
    text = ((steps - rest) / F.lit(10**digits)).cast("long").cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    text = F.concat(F.when(F.startswith(signed.cast("string"), F.lit("-")), "-").otherwise(""), text)
    return (
        F.when(F.isnan(signed), "nan").when(small, text)
        .when(signed.isNotNull(), F.lower(F.regexp_replace(F.format_string(f"%.{digits}f", signed), "inity$", "")))
    )


def session_label(lok="lok_no", session="session_no") -> Column:
    return F.format_string("Lok %d Session %d", F.col(lok), F.col(session))


def size_label(kilobytes) -> Column:
    """KB, MB or GB with steps of 1024, one decimal from MB on."""
    kb = F.col(kilobytes) if isinstance(kilobytes, str) else kilobytes
    return (
        F.when(kb >= 1024 * 1024, F.concat(fixed(kb / (1024.0 * 1024.0), 1), F.lit(" GB")))
        .when(kb >= 1024, F.concat(fixed(kb / 1024.0, 1), F.lit(" MB")))
        .otherwise(F.format_string("%d KB", kb))
    )
