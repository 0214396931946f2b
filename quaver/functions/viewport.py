"""The waveform's window: zoom, scroll, pan, pixels and times; and the player's position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zoom steps of the wheel, the narrowest views in milliseconds (whole song, fine view),
#: the widest fine view, and the share of a view that a scroll step moves.
ZOOM_IN, ZOOM_OUT, NARROW, FINE, FINE_WIDE, SCROLL = 1.08, 0.92, 2000.0, 1000.0, 10_000.0, 5.0
#: Where a beat lands in the view that is moved to it, and the margin before its end.
LAND, MARGIN, NUDGE, RESTART_MS = 0.3, 0.15, 800.0, 50


def _double(x: Column) -> Column:
    return x.cast("double")


def visible_ms(duration: Column, zoom: Column) -> Column:
    return _double(duration) / zoom


def zoomed(zoom: Column, duration: Column, inward: Column, fine: bool = False) -> Column:
    """The zoom after a wheel step, within the bounds of the view."""
    least = F.greatest(F.lit(1.0), _double(duration) / FINE_WIDE) if fine else F.lit(1.0)
    most = F.greatest(F.lit(1.0), _double(duration) / (FINE if fine else NARROW))
    return F.greatest(least, F.least(most, zoom * F.when(inward, ZOOM_IN).otherwise(ZOOM_OUT)))


def scrolled(offset: Column, duration: Column, zoom: Column, forward: Column) -> Column:
    """The offset after a scroll step, within the song."""
    seen = F.greatest(F.lit(1.0), visible_ms(duration, zoom))
    most = F.greatest(F.lit(0.0), _double(duration) - seen)
    return F.greatest(F.lit(0.0), F.least(most, offset + F.when(forward, seen).otherwise(-seen) / SCROLL))


def panned(offset: Column, t: Column, duration: Column, zoom: Column) -> Column:
    """The offset that shows a beat: unchanged if it is seen well, or unset."""
    seen = visible_ms(duration, zoom)
    out = (t < offset) | (t > offset + seen - seen * MARGIN)
    return F.when(out, F.greatest(F.lit(0.0), t - seen * LAND)).otherwise(_double(offset))


def time_at(x: Column, width: Column, offset: Column, duration: Column, zoom: Column) -> Column:
    """Milliseconds under a pixel, within the song."""
    return F.greatest(F.lit(0.0), F.least(_double(duration), offset + x / width * visible_ms(duration, zoom)))


def pixel_of(t: Column, width: Column, offset: Column, duration: Column, zoom: Column) -> Column:
    return (t - offset) / visible_ms(duration, zoom) * width


def label_fits(t: Column, end: Column, label_width: Column, width: Column, seen: Column) -> Column:
    """Whether a label of some pixels has room in its interval, less eight pixels."""
    room = (end - t) / seen * width - 8
    return (room > 0) & (label_width <= room)


def sought(t: Column, duration: Column) -> Column:
    """A wanted position within the song."""
    return F.greatest(F.lit(0), F.least(t, duration))


def play_from(t: Column, duration: Column) -> Column:
    """Where playing starts: anew if less than RESTART_MS are left."""
    return F.when(t >= duration - RESTART_MS, F.lit(0)).otherwise(t)


def nudged(t: Column, duration: Column, zoom: Column, forward: Column) -> Column:
    """A fine step of the position."""
    step = _double(duration) / zoom / NUDGE
    return sought(t + F.when(forward, step).otherwise(-step), _double(duration))


def climbing(n: Column) -> Column:
    """The share that a progress bar shows after n ticks without news: closed form of the climb."""
    return F.lit(0.15) * (1 - F.pow(F.lit(0.96), n))


def shown_progress(share: Column) -> Column:
    """A reported share on what the climb has left."""
    return F.lit(0.15) + share * F.lit(0.85)


def playing_speed(typed: Column) -> Column:
    """A speed that was typed: to a decimal, within 0.1 and 1."""
    return F.least(F.greatest(F.floor(typed * 10 + 0.5) / 10, F.lit(0.1)), F.lit(1.0))


def compensation(typed: Column) -> Column:
    """Whole milliseconds that a tap is moved by, of a text that was typed; 0 if it begins with no number."""
    return F.coalesce(F.regexp_extract(F.trim(typed), r"^([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
