"""Scalar column functions (all built-in expressions, inside whole-stage codegen).

F1-F6 (flags, search, display), G1 / G8 / G9 (coordinate arithmetic) and the
epoch-nanosecond conversion every time column goes through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Regional indicator symbols U+1F1E6 .. U+1F1FF, one per letter A..Z.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REGIONAL_INDICATORS = "".join(chr(0x1F1E6 + i) for i in range(26))

# The display cut of country names and the default tile total.
NAME_DISPLAY_MAX = 18
DEFAULT_TILE_TOTAL = 120000


def epoch_ns(df: DataFrame, name: str) -> Column:
    """Nanoseconds since epoch of a timestamp column, independent of the session zone.

    ``timestamp_ntz`` columns (how Parquet timestamps without zone load) are
    measured against the zone-free epoch; ``timestamp`` columns are instants.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        # Wall-clock fields of a zone-less timestamp: no session zone enters.
        c = F.col(name)
        us = (F.unix_date(F.to_date(c)).cast("bigint") * F.lit(86_400_000_000)
              + F.hour(c).cast("bigint") * F.lit(3_600_000_000) + F.minute(c).cast("bigint") * F.lit(60_000_000)
              + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint"))
    elif isinstance(dtype, T.TimestampType):
        us = F.unix_micros(F.col(name))
    else:
        raise TypeError(f"{name} is {dtype}, not a timestamp")
    return us.cast("bigint") * F.lit(1000)


# --- G1 / G8 / G9: coordinates ---------------------------------------------------

def uv_to_lon(u: Column) -> Column:
    return (u - F.lit(0.5)) * F.lit(360.0)


def uv_to_lat(v: Column) -> Column:
    return (v - F.lit(0.5)) * F.lit(180.0)


def xyz_to_u(x: Column, z: Column, convention: str = "data") -> Column:
    """u of a unit-sphere point.  ``data``: the convention of the shipped coordinate
    file (agrees with G1's latitude sign); ``code``: the point script's formula."""
    turn = F.atan2(z, x) / F.lit(2.0 * math.pi)
    if convention == "data":
        return F.lit(1.0) - turn
    if convention == "code":
        return F.lit(0.5) + turn
    raise ValueError(convention)


def xyz_to_v(y: Column, convention: str = "data") -> Column:
    half = F.asin(y) / F.lit(math.pi)
    if convention == "data":
        return F.lit(0.5) + half
    if convention == "code":
        return F.lit(0.5) - half
    raise ValueError(convention)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


# --- F1-F6: country display ------------------------------------------------------

def flag_emoji(code: Column) -> Column:
    """letters A-Z become regional indicator symbols after upper-casing;
    other characters (digits, '-') are kept."""
    return F.translate(F.upper(code), LETTERS, REGIONAL_INDICATORS)


def name_matches(name: Column, query: str) -> Column:
    """case-insensitive substring match."""
    return F.lower(name).contains(query.lower())


def display_name(name: Column, max_len: int = NAME_DISPLAY_MAX) -> Column:
    """names longer than ``max_len`` characters are cut and trimmed."""
    return F.when(F.length(name) > max_len, F.trim(F.substring(name, 1, max_len))).otherwise(name)


def percent_of(score: Column, total: Column | int = DEFAULT_TILE_TOTAL) -> Column:
    """share of a total in percent, two decimals."""
    total_col = total if isinstance(total, Column) else F.lit(float(total))
    return F.round(score.cast("double") / total_col * F.lit(100.0), 2)


def lower_code(code: Column) -> Column:
    """F5."""
    return F.lower(code)


def display_label(code: Column, name: Column) -> Column:
    """"<flag>  <name>" (two spaces)."""
    return F.concat(flag_emoji(code), F.lit("  "), name)
