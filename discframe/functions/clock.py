"""Durations, timecodes and timestamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTSC_60 = (60_000, 1001)
TICKS = 90_000


def parse_duration(text: Column) -> Column:
    """Seconds from ``[[H:]M:]S`` text; NULL for blanks, bad numbers or more parts."""
    parts = F.split(text, ":", -1)
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(parts) <= 3) & F.forall(numbers, lambda n: n.isNotNull())
    seconds = F.aggregate(numbers, F.lit(0.0), lambda total, n: total * 60 + n)
    return F.when(good & (text != ""), seconds)


def fmt_duration(seconds: Column) -> Column:
    """``H:MM:SS`` of the half-even rounded seconds, never negative."""
    whole = F.greatest(F.bround(seconds).cast("long"), F.lit(0).cast("long"))
    return F.format_string(
        "%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    )


def timecode_seconds(text: Column, fps: tuple[int, int] = NTSC_60) -> Column:
    """Seconds of an ``HH:MM:SS:FF`` timecode counting nominal frames at the real rate.

    Text of another form, and none, give 0.
    """
    num, den = fps
    nominal = round(num / den)
    pattern = r"^\s*(\d+):(\d+):(\d+):(\d+)\s*$"
    part = [F.regexp_extract(text, pattern, i).try_cast("long") for i in range(1, 5)]
    frames = ((part[0] * 3600 + part[1] * 60 + part[2]) * nominal + part[3]) * den
    return F.coalesce(frames / num, F.lit(0.0))


def _bcd(byte: Column) -> Column:
    return F.shiftright(byte, 4) * 10 + byte.bitwiseAND(F.lit(15))


def bcd_seconds(packed: Column) -> Column:
    """Seconds of a 4-byte BCD playback time held in a big-endian integer.

    The top two bits of the last byte pick 25 fps or 30000/1001 fps, where the whole
    time is a 30-frame timecode.  Implausible times give 0.
    """

    def byte(i: int) -> Column:
        return F.shiftright(packed.cast("long"), 24 - 8 * i).bitwiseAND(F.lit(255))

    hours, minutes, seconds = _bcd(byte(0)), _bcd(byte(1)), _bcd(byte(2))
    rate = F.shiftright(byte(3), 6)
    frames = _bcd(byte(3).bitwiseAND(F.lit(63)))
    whole = hours * 3600 + minutes * 60 + seconds
    value = (
        F.when(rate == 3, (whole * 30 + frames) * 1001 / 30_000)
        .when(rate == 1, (whole * 25 + frames) / 25)
        .otherwise(whole.cast("double"))
    )
    sane = (hours <= 23) & (minutes <= 59) & (seconds <= 59)
    return F.when(sane, value).otherwise(0.0)


def _milliseconds(ticks: Column) -> Column:
    return F.bround(F.greatest(ticks.cast("long"), F.lit(0)) * 1000 / TICKS).cast("long")


def fmt_srt(ticks: Column, separator: str = ",") -> Column:
    ms = _milliseconds(ticks)
    return F.format_string(
        "%02d:%02d:%02d" + separator + "%03d",
        F.floor(ms / 3_600_000),
        F.floor(ms % 3_600_000 / 60_000),
        F.floor(ms % 60_000 / 1000),
        ms % 1000,
    )


def fmt_idx(ticks: Column) -> Column:
    return fmt_srt(ticks, ":")


def fmt_ass(ticks: Column) -> Column:
    cs = F.bround(ticks / 900).cast("long")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360_000),
        F.floor(cs % 360_000 / 6000),
        F.floor(cs % 6000 / 100),
        cs % 100,
    )


def fmt_ns(seconds: Column) -> Column:
    """``HH:MM:SS.nnnnnnnnn`` from seconds."""
    ns = F.bround(seconds * 1_000_000_000).cast("long")
    whole = F.floor(ns / 1_000_000_000)
    return F.format_string(
        "%02d:%02d:%02d.%09d",
        F.floor(whole / 3600),
        F.floor(whole % 3600 / 60),
        whole % 60,
        ns % 1_000_000_000,
    )


def parse_ts(text: Column) -> Column:
    """Seconds of an ``HH:MM:SS.fraction`` text."""
    part = F.split(F.trim(text), ":")
    return F.get(part, F.lit(0)).cast("long") * 3600 + F.get(part, F.lit(1)).cast("long") * 60 + F.get(
        part, F.lit(2)
    ).cast("double")


def tick_diff(a: Column, b: Column) -> Column:
    """``a - b`` on the 33-bit clock."""
    return F.pmod(a - b, F.lit(1 << 33))
