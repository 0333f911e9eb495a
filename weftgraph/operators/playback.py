"""Playing frames: timers, ranges, what sounds live, the camera, and settings of an export."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the camera and of exports.
FIELD_OF_VIEW, PICK_REACH = 45.0, 20.0
CODECS = ("libx264", "libx265", "libvpx-vp9", "prores_ks", "libaom-av1", "h264_nvenc", "hevc_nvenc")
MOST_CRF = 63


def frame_ticks(ticks: DataFrame, session: str, order: str, seconds: str, fps: int | None = None, speed: float = 1.0) -> DataFrame:
    """`ticks` with advance_slices: whole slices that each tick moves on by, fractions being carried to the next.

    Without `fps` each tick is worth `speed` slices, with it the seconds since the last tick times both.
    """
    worth = F.lit(max(speed, 0.0)) if fps is None else F.col(seconds) * fps * max(speed, 0.0)
    along = Window.partitionBy(session).orderBy(order)
    upto = F.floor(F.sum(worth).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.floor(F.coalesce(F.sum(worth).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return ticks.withColumn("advance_slices", (upto - before).cast("long"))


def frame_range(frames: DataFrame, first: int, last: int, total: int) -> DataFrame:
    """Frames first..last, both included; a range that begins behind the last frame is an error."""
    if total <= 0:
        raise ValueError("there are no frames")
    end = min(last, total - 1)
    if first > end:
        raise ValueError(f"frame {first} is out of range: there are {total}")
    return frames.where(F.col("slice_index").between(first, end))


def live_gate(ticks: DataFrame, session: str, order: str, slice_: str, active: Column) -> DataFrame:
    """`ticks` with fires (a new slice sounds) and silences (all notes end): sound is on while `active`, once for each slice; going back or turning off ends it."""
    along = Window.partitionBy(session).orderBy(order)
    on = F.coalesce(active, F.lit(False))
    was_on, last = F.coalesce(F.lag(on).over(along), F.lit(False)), F.lag(slice_).over(along)
    fires = on & (~was_on | (F.col(slice_) != last))
    return ticks.withColumns({"fires": fires, "silences": was_on & (~on | (F.col(slice_) < last))})


def live_velocity(volume: Column) -> Column:
    """MIDI velocity of a volume, whose full scale is 2."""
    return F.floor(F.least(F.greatest(volume, F.lit(0.0)), F.lit(2.0)) / 2 * 127 + 0.5).cast("int")


@dataclass
class Camera:
    """Looks at `target` from a distance, turned by yaw and pitch in degrees."""

    distance: float = 800.0
    yaw: float = 0.0
    pitch: float = 20.0
    target: tuple[float, float, float] = (0.0, 0.0, 0.0)
    field_of_view: float = FIELD_OF_VIEW

    def eye(self) -> tuple[float, float, float]:
        yaw, pitch = math.radians(self.yaw), math.radians(self.pitch)
        away = (math.cos(pitch) * math.sin(yaw), math.sin(pitch), math.cos(pitch) * math.cos(yaw))
        return tuple(t + self.distance * a for t, a in zip(self.target, away, strict=True))


def project(positions: DataFrame, camera: Camera, width: int, height: int) -> DataFrame:
    """`positions` (x, y, z) with px, py: their pixels on a screen; those behind the camera are left out."""
    eye = camera.eye()
    ahead = [(t - e) / camera.distance for t, e in zip(camera.target, eye, strict=True)]
    flat = math.hypot(ahead[0], ahead[2])
    right = (-ahead[2] / flat, 0.0, ahead[0] / flat)
    up = (right[1] * ahead[2] - right[2] * ahead[1], right[2] * ahead[0] - right[0] * ahead[2], right[0] * ahead[1] - right[1] * ahead[0])
    along = lambda axis: sum((F.col(c) - e) * float(a) for c, e, a in zip("xyz", eye, axis, strict=True))
    depth, half = along(ahead), math.tan(math.radians(camera.field_of_view) / 2)
    aspect = width / max(height, 1)
    placed = positions.withColumns({"_depth": depth, "_right": along(right), "_up": along(up)}).where("_depth > 0")
    across, upward = F.col("_right") / (F.col("_depth") * half * aspect), F.col("_up") / (F.col("_depth") * half)
    return placed.withColumns({"px": (across + 1) * (width / 2), "py": (1 - upward) * (height / 2)}).drop("_depth", "_right", "_up")


def validate_export(configs: DataFrame) -> DataFrame:
    """`configs` (codec, crf, fps) with `message`: the first rule that each breaks, null for none."""
    return configs.withColumn("message", F.when(~F.col("codec").isin(*CODECS), "codec is not supported").when(F.col("crf") > MOST_CRF, "crf is above 63").when(F.col("fps") <= 0, "fps is not above 0"))
