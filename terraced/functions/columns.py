"""Column expressions shared by the models. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the source platform's for equal results.
LOAD_BATCH_PREFIX = "postgres-seed"
ENVIRONMENT_PREFIX = "PRD"


def instant(as_of: datetime) -> Column:
    """A fixed UTC instant as a literal, so audit columns are set once per run."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def band(value: Column, steps: Sequence[tuple[object, str]], otherwise: str) -> Column:
    """Label of the first threshold that ``value`` reaches; NULL gets ``otherwise``."""
    (first, label), *rest = steps
    chosen = F.when(value >= F.lit(first), label)
    for threshold, label in rest:
        chosen = chosen.when(value >= F.lit(threshold), label)
    return chosen.otherwise(otherwise)


def clean_code(value: Column) -> Column:
    return F.upper(F.trim(value.cast("string")))


def surrogate_key(value: Column) -> Column:
    return F.md5(value)


def padded(value: Column, width: int) -> Column:
    """Zero-pad a non-negative number to ``width`` digits; longer numbers keep all their digits.

    Adding the next power of ten and cutting its leading 1 costs one conversion
    to text, less than measuring and padding the text.
    """
    above = 10**width
    short = F.substring((value.cast("bigint") + F.lit(above)).cast("string"), 2, width)
    return F.when(value < above, short).otherwise(value.cast("string"))


def load_batch(moment: Column, prefix: str = LOAD_BATCH_PREFIX) -> Column:
    """Batch stamp whose text order is its time order."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"))


def iso_text(moment: Column) -> Column:
    """ISO-8601 text with offset; microseconds only when there are any."""
    whole = F.date_trunc("second", moment) == moment
    return F.when(whole, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )


def slug(value: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    squeezed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.trim(squeezed, F.lit("_"))


def prefixed(value: Column, prefix: str = ENVIRONMENT_PREFIX) -> Column:
    """Put ``PREFIX_`` in front unless it is already there."""
    return F.when(F.startswith(value, F.lit(f"{prefix}_")), value).otherwise(
        F.concat(F.lit(f"{prefix}_"), value)
    )


def _turned(number: int, bits: int) -> int:
    return int(f"{number:0{bits}b}"[::-1], 2)


# Bytes as characters, and hexadecimal digits, with their bits turned round. A zero byte stays as it is.
_OCTETS = "".join(chr(n) for n in range(1, 256))
_TURNED_OCTETS = "".join(chr(_turned(n, 8)) for n in range(1, 256))
_DIGITS = "0123456789ABCDEF"
_TURNED_DIGITS = "".join(_DIGITS[_turned(n, 4)] for n in range(16))


def posix_cksum(value: Column) -> Column:
    """The POSIX ``cksum`` number of the text followed by a newline, as a long.

    CRC-32 with polynomial 0x04C11DB7, most significant bit first, fed with the
    bytes and then the byte count (low byte first), complemented at the end.

    ``crc32`` has the same polynomial but the least significant bit first, so it gets
    every byte with its bits turned round and its result is turned back. Four bytes
    of ones in front bring its start value, all ones, to zero.
    """
    fed = F.concat(F.encode(value, "UTF-8"), F.encode(F.lit("\n"), "UTF-8"))
    turned = F.encode(F.translate(F.decode(fed, "ISO-8859-1"), _OCTETS, _TURNED_OCTETS), "ISO-8859-1")
    count = F.hex(F.length(fed).cast("long"))
    paired = F.when(F.length(count) % 2 == 1, F.concat(F.lit("0"), count)).otherwise(count)
    turned_count = F.unhex(F.translate(F.reverse(paired), _DIGITS, _TURNED_DIGITS))
    crc = F.crc32(F.concat(F.unhex(F.lit("FFFFFFFF")), turned, turned_count))
    return F.conv(F.reverse(F.lpad(F.bin(crc), 32, "0")), 2, 10).cast("long")
