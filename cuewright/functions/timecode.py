"""Time codes and frame rates. Times are BIGINT milliseconds; columns in, columns out."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)^\s+|\s+$"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(col(x), SPACES, "")


TIME = r"(?U)^\s*(?:([+-]?[0-9]+)\s*:)?\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*(?:[.,]([0-9]*))?\s*$"


def parse_timestamp(x) -> Column:
    """[H:]M:S with a fraction after `.` or `,`: milliseconds, or null where the text is no time. Only seconds are held
    to 0-59; of a fraction the first three digits count."""
    part = lambda k: F.regexp_extract(strip(x), TIME, k)
    parts = F.array(*(part(k) for k in (1, 2, 3, 4)))
    long = lambda v: F.lit(v).cast("bigint")

    def value(p: Column) -> Column:
        hours = F.when(p[0] == "", long(0)).otherwise(p[0].try_cast("bigint"))
        minutes, seconds, ms = p[1].try_cast("bigint"), p[2].try_cast("bigint"), F.rpad(F.substring(p[3], 1, 3), 3, "0").cast("bigint")
        total = F.try_add(F.try_multiply(F.try_add(F.try_multiply(hours, long(60)), minutes), long(60)), seconds)
        return F.when((hours >= 0) & (minutes >= 0) & seconds.between(0, 59), F.try_add(F.try_multiply(total, long(1000)), ms))

    # A one-element array computes the parts once; a text that doesn't match has no minutes.
    return F.get(F.transform(F.array(parts), value), F.lit(0))


def _parts(ms: Column):
    ms = F.greatest(ms, F.lit(0).cast("bigint"))
    div = lambda a, b: _div(a, F.lit(b).cast("bigint"))
    return div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000


def format_srt_time(x) -> Column:
    """HH:MM:SS,mmm; negative times are 0."""
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(col(x)))


def duration_text(x) -> Column:
    """HH:MM:SS.mmm"""
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(col(x)))


def format_vtt_time(x) -> Column:
    """MM:SS.mmm, with hours where there are any."""
    h, m, s, ms = _parts(col(x))
    return F.when(h == 0, F.format_string("%02d:%02d.%03d", m, s, ms)).otherwise(F.format_string("%02d:%02d:%02d.%03d", h, m, s, ms))


def format_ass_time(x) -> Column:
    """H:MM:SS.cc, rounded half up to hundredths."""
    div = lambda a, b: _div(a, F.lit(b).cast("bigint"))
    cs = div(F.greatest(col(x), F.lit(0).cast("bigint")) + 5, 10)
    return F.format_string("%d:%02d:%02d.%02d", div(cs, 360_000), div(cs, 6000) % 60, div(cs, 100) % 60, cs % 100)


def fps_fraction(rate: float) -> tuple[int, int]:
    """A decimal frame rate as a fraction: n * 1000 / 1001 if that is within 0.002, else hundredths, else rounded."""
    if not 1.0 <= rate <= 1000.0:
        raise ValueError(f"frame rate must be from 1 to 1000, not {rate}")
    near = int(rate * 1001 / 1000.0 + 0.5)
    hundredths = int(rate * 100.0 + 0.5)
    if near >= 1 and abs(rate - near * 1000.0 / 1001) < 0.002:
        num, den = near * 1000, 1001
    elif abs(rate * 100.0 - hundredths) < 1e-6:
        num, den = hundredths, 100
    else:
        num, den = int(rate + 0.5), 1
    return num // gcd(num, den), den // gcd(num, den)


def fps_columns(rate) -> tuple[Column, Column]:
    """The same for a column of rates: numerator and denominator, reduced; null out of range."""
    rate = col(rate)
    near, hundredths = F.floor(rate * 1001 / F.lit(1000.0) + 0.5), F.floor(rate * 100.0 + 0.5)
    ntsc = (near >= 1) & (F.abs(rate - near * F.lit(1000.0) / 1001) < 0.002)
    exact = F.abs(rate * 100.0 - hundredths) < 1e-6
    num = F.when(ntsc, near * 1000).when(exact, hundredths).otherwise(F.floor(rate + 0.5)).cast("bigint")
    den = F.when(ntsc, 1001).when(exact, 100).otherwise(1).cast("bigint")
    ok, by = rate.between(1.0, 1000.0), common_divisor(num, den)
    return F.when(ok, _div(num, by)), F.when(ok, _div(den, by))


def common_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two positive BIGINT columns, by Euclid's steps: 90 are enough for any 64-bit numbers,
    as each two at least halve the smaller one."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.when(s["b"] != 0, s["b"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), pair(a.cast("bigint"), b.cast("bigint")), step, lambda s: s["a"])


def _div(num: Column, den: Column) -> Column:
    """Integer division of BIGINT columns, without a detour over doubles."""
    return F.call_function("div", num, den)


def frame_number(ms, num, den) -> Column:
    """The frame nearest to ms (half up)."""
    num, den = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (num, den))
    return _div(2 * col(ms) * num + 1000 * den, 2000 * den)


def frame_to_ms(frame, num, den) -> Column:
    num, den = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (num, den))
    return _div(2 * col(frame) * 1000 * den + num, 2 * num)


def snap_to_frame(ms, num, den) -> Column:
    return frame_to_ms(frame_number(ms, num, den), num, den)


def frame_ms(num: int, den: int) -> int:
    """The length of the first frame in whole milliseconds."""
    return (2 * 1000 * den + num) // (2 * num)


def shift_amount(ms: int | None = None, seconds: float | None = None, percent: float | None = None) -> tuple[str, float]:
    """Exactly one of the three: ("ms", whole milliseconds) or ("percent", share)."""
    given = [x for x in (ms, seconds, percent) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of ms, seconds and percent")
    if percent is not None:
        return "percent", float(percent)
    if ms is not None:
        return "ms", int(ms)
    scaled = seconds * 1000
    return "ms", int(abs(scaled) + 0.5) * (1 if scaled >= 0 else -1)
