"""Flags, angles, times, ids, ratios and strings as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags: a set of bits in a long.


def set_flags(flags: Column, bits: int, where: Column | None = None) -> Column:
    new = flags.bitwiseOR(F.lit(bits).cast("long"))
    return new if where is None else F.when(where, new).otherwise(flags)


def has_any(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits).cast("long")) != 0


def has_none(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits).cast("long")) == 0


# Angles in degrees.


def pmod_deg(x: Column) -> Column:
    """x modulo 360 in [0, 360)."""
    return x - F.floor(x / F.lit(360.0)) * F.lit(360.0)


def turn(a: Column, b: Column) -> Column:
    """The signed angle from b to a, in [-180, 180)."""
    return pmod_deg(a - b + F.lit(180.0)) - F.lit(180.0)


def apart(a: Column, b: Column) -> Column:
    return F.abs(turn(a, b))


# Ratios.


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


# Times. Seconds are whole seconds since 1970 in UTC.


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000)


def round_to(t: Column, step_s: int) -> Column:
    """The nearest multiple of a step, halves up."""
    return F.timestamp_seconds(F.floor((F.unix_seconds(t.cast("timestamp")) + F.lit(step_s // 2)) / F.lit(step_s)) * F.lit(step_s))


def truncate_to(t: Column, step_s: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(t.cast("timestamp")) / F.lit(step_s)) * F.lit(step_s))


def next_minute(t: Column) -> Column:
    """The first whole minute that is not before t."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(t.cast("timestamp")) / F.lit(60_000_000)) * F.lit(60))


def age_s(now: Column, t: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / F.lit(1_000_000.0))


def parse_utc(text: Column) -> Column:
    """A time from text that names its offset; null for naive or odd text."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))


def iso(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Ids.


def digest(*cols: Column) -> Column:
    """SHA-256 of a canonical JSON array of the columns; nulls count."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])), 256)


def uuid5_like(namespace: str, name: Column) -> Column:
    """A name-based UUID of version 5: SHA-1 of namespace bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cycle_id(grid: Column, time: Column) -> Column:
    """URL-safe base64, without padding, of grid and time."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat(grid, F.lit("|"), iso(time)), "UTF-8")), "+/", "-_"), F.lit("="))


def cycle_parts(cycle: Column) -> Column:
    """struct(grid, time) of a cycle id."""
    padded = F.rpad(F.translate(cycle, "-_", "+/"), (F.ceil(F.length(cycle) / 4) * 4).cast("int"), F.lit("="))
    text = F.decode(F.unbase64(padded), "UTF-8")
    return F.struct(F.substring_index(text, "|", 1).alias("grid"), parse_utc(F.substring_index(text, "|", -1)).alias("time"))


# Strings.

# What is secret in a text, and what stands for it.
SECRET_URL = r"(https?://|postgres(?:ql)?://)[^\s/@:]+:[^\s/@]+@"
SECRET_BEARER = r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+"
SECRET_FIELD = r"""(?i)(password|passwd|secret|access_key|api_key|token|authorization)(["']?\s*[:=]\s*["']?)([^\s,"'}]+)"""
HIDDEN = "[REDACTED]"
LONGEST_TEXT = 8192


def redact(text: Column) -> Column:
    """Credentials in addresses, bearer tokens and secret fields are hidden;
    what is over the longest text is cut with a mark."""
    for pattern, instead in ((SECRET_URL, f"$1{HIDDEN}@"), (SECRET_BEARER, f"Bearer {HIDDEN}"), (SECRET_FIELD, f"$1$2{HIDDEN}")):
        text = F.regexp_replace(text, pattern, instead)
    return F.when(F.length(text) > LONGEST_TEXT, F.concat(F.substring(text, 1, LONGEST_TEXT), F.lit(" [truncated]"))).otherwise(text)


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis if any are lost."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def contains(query: str, *cols: Column) -> Column:
    """Whether the columns, joined by spaces, have the text in any case."""
    return F.instr(F.lower(F.concat_ws(" ", *cols)), query.lower()) > 0


def in_windows(t: Column, windows: list[tuple[Column, Column]]) -> Column:
    """Whether t is in one of the half-open windows."""
    return reduce(lambda a, b: a | b, [(t >= s) & (t < e) for s, e in windows], F.lit(False))


def bucket(value: Column, stops: list[float]) -> Column:
    """How many stops are at most the value, less one; -1 under the first."""
    return F.size(F.filter(F.lit(stops), lambda s: s <= value)) - F.lit(1)


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise linear through ``knots``, an array of struct(x, y) by x; the
    ends go on level. Null x or no knots: null."""
    below = F.filter(knots, lambda k: k["x"] <= x)
    above = F.filter(knots, lambda k: k["x"] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
    return F.when(x.isNull(), None).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(between)
