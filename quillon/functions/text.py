"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores of any script; Spark's own \w is ASCII.
TOKEN = r"[\p{L}\p{N}_]+"
#: White space of any script, as a class that Spark and DuckDB read alike.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Accented Latin letters and their plain forms (fixed values).
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def clean_text(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, BLANK, " "))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), BLANK), lambda w: w != "")).cast("bigint")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def snippet(x: Column, limit: int = 300) -> Column:
    flat = clean_text(x)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("..."))).otherwise(flat)


def preview(x: Column, limit: int = 60) -> Column:
    """A table cell: cut with an ellipsis, line ends to spaces, bars escaped."""
    cut = F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)
    return F.replace(F.replace(cut, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def derive_title(x: Column, limit: int = 42, share: float = 0.4) -> Column:
    """A title from a query: short ones as they are, long ones cut at the last space beyond ``share`` of the limit."""
    flat = F.trim(x)
    head = F.substring(flat, 1, limit)
    upto = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    cut = F.when(head.contains(" ") & (upto > limit * share), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start).otherwise(F.concat(start, F.lit("-"), end))


def count_of(x: Column, *signs: str) -> Column:
    """How often the one-character ``signs`` occur in ``x``."""
    total = F.lit(0)
    for s in signs:
        total = total + F.length(x) - F.length(F.replace(x, F.lit(s)))
    return total.cast("bigint")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of ``name`` in a namespace given as 32 hexadecimal digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, ``nan`` for NaN: the exact binary value is rounded, a tie between two to the even digit.

    So 0.5005, whose binary value is a little less, gives 0.500, and 0.0625 with three digits gives 0.062.  The value is split
    in two halves whose products with the power of ten are exact.  It holds for numbers below 2^53 / 10^digits.
    """
    power = float(10**digits)
    a = F.abs(x.cast("double"))
    big = a * F.lit(134217729.0)  # 2^27 + 1: the upper half of the digits stays
    hi = big - (big - a)
    s, t = hi * power, (a - hi) * power
    down = F.floor(s + t)
    # twice the rest, less one: its sign is exact, since each sum of two doubles has the right sign
    over = ((s - down) - 0.5) + t
    units = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    whole, rest = F.floor(units / int(power)).cast("bigint"), (units % int(power)).cast("bigint")
    shown = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return F.when(F.isnan(x), F.lit("nan")).otherwise(shown)


def three_decimals(x: Column) -> Column:
    return fixed(x, 3)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def share_text(part: Column, total: Column) -> Column:
    """One decimal and a percent sign, ``n/a`` on a zero total."""
    return F.when(total == 0, F.lit("n/a")).otherwise(F.concat(fixed(F.lit(100.0) * part / F.when(total != 0, total), 1), F.lit("%")))


def rank_text(rank: Column, limit: int) -> Column:
    return F.coalesce(rank.cast("string"), F.lit(f">{limit}"))


def rank_change(before: Column, after: Column, limit: int) -> Column:
    """``=``, ``+n`` for an improvement, ``-n`` for a loss; a missing rank counts as one past the limit."""
    gain = F.coalesce(before, F.lit(limit + 1)) - F.coalesce(after, F.lit(limit + 1))
    return F.when(gain == 0, F.lit("=")).when(gain > 0, F.concat(F.lit("+"), gain.cast("string"))).otherwise(gain.cast("string"))
