"""Interpolated frames between the sheets of a dataset, ego views of them, and what they sound like."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.dataset import canonical_labels, last_rows, shape_id

FRAME_BYTES = 64


def ease(t: Column, mode: str) -> Column:
    back = -2 * t + 2
    return {
        "linear": t,
        "ease_in": t * t,
        "ease_out": 1 - (1 - t) * (1 - t),
        "ease_in_out": F.when(t < 0.5, 4 * t * t * t).otherwise(1 - back * back * back / 2),
        "spring": 1 - F.exp(-6 * t) * F.cos(6 * math.pi * t),
    }[mode]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    """Between degrees the short way round."""
    turn = (b - a) % 360
    return a + F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn) * t


def frames(nodes: DataFrame, steps: int, mode: str = "ease_in_out", at: int | None = None) -> DataFrame:
    """Every frame of `steps` slices between neighbouring sheets, or only that of slice `at`.

    An object in one of two sheets fades by its size; one in both moves, turns and takes on colour,
    with the shape it comes from. Frames list objects by shape, then as labels first stand. A single
    sheet gives still frames; the last sheet itself is never a frame where there are several.
    """
    rows = last_rows(nodes)
    last = nodes.agg(F.max("sheet_index").alias("last"))
    moving = ("x", "y", "z", "size", "size_alpha", "color_r", "color_g", "color_b")
    turning = ("spin_x", "spin_y", "spin_z")
    side = lambda name: F.struct(*(F.col(c).cast("double").alias(c) for c in (*moving, *turning)), shape_id(F.col("shape")).alias("shape_id")).alias(name)
    start = rows.crossJoin(F.broadcast(last)).where("sheet_index < last or last = 0").select(F.col("sheet_index").alias("transition"), "label", side("a"))
    end = rows.where("sheet_index > 0").select((F.col("sheet_index") - 1).alias("transition"), "label", side("b"))
    still = rows.crossJoin(F.broadcast(last)).where("last = 0").select(F.lit(0).alias("transition"), "label", side("b"))
    pairs = start.join(end.union(still), ["transition", "label"], "full_outer").join(canonical_labels(nodes), "label")
    if at is not None:
        pairs = pairs.crossJoin(F.broadcast(last)).where(F.col("transition") == F.least(F.lit(at // steps), F.greatest(F.col("last") - 1, F.lit(0)))).drop("last")
        sliced = pairs.withColumn("local_slice", F.lit(at % steps))
    else:
        sliced = pairs.withColumn("local_slice", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    t = ease(F.col("local_slice") / float(steps), mode)
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()

    def value(c: str) -> Column:
        if c == "size":
            return lerp(F.coalesce(a[c], F.lit(0.0)), F.coalesce(b[c], F.lit(0.0)), t)
        return F.when(both, (lerp_angle if c in turning else lerp)(a[c], b[c], t)).otherwise(F.coalesce(a[c], b[c]))

    out = sliced.select(
        (F.col("transition") * steps + F.col("local_slice")).alias("slice_index"), F.col("transition").alias("transition_index"), "local_slice", "label", "label_ord",
        F.coalesce(a["shape_id"], b["shape_id"]).alias("shape_id"), *(value(c).cast("float").alias(c) for c in (*moving, *turning)), F.lit(1.0).cast("float").alias("color_a"),
    )
    place = F.row_number().over(Window.partitionBy("slice_index").orderBy("shape_id", "label_ord")) - 1
    return out.withColumn("ord", place).drop("label_ord")


def frame_estimate(nodes: DataFrame, steps: int) -> DataFrame:
    """(time_points, n_labels, n_frames, bytes) of all frames."""
    counted = nodes.agg(F.countDistinct("sheet_index").alias("time_points"), F.countDistinct("label").alias("n_labels"))
    n = F.greatest(F.col("time_points") - 1, F.lit(1)) * steps
    return counted.select("time_points", "n_labels", n.alias("n_frames"), (n * F.col("n_labels") * FRAME_BYTES).alias("bytes"))


def advance_slice(current: Column, total: Column, state: Column, looping: Column, by: Column) -> Column:
    """The next slice: playing wraps or stops at the end, paused stays inside, stopped is 0."""
    playing = F.when(looping, (current + by) % F.greatest(total, F.lit(1))).otherwise(F.least(current + by, total - 1))
    return F.when(total == 0, 0).when(state == "playing", playing).when(state == "paused", F.least(current, total - 1)).otherwise(0)


# -- ego views -----------------------------------------------------------------------------------

def matching(edges: DataFrame, picked: DataFrame, direction: str) -> DataFrame:
    """Edges of the picked objects (sheet_index, label) in the direction: incoming, outgoing or both."""
    ends = {"outgoing": F.array("from"), "incoming": F.array("to"), "both": F.array_distinct(F.array("from", "to"))}[direction]
    return edges.withColumn("label", F.explode(ends)).join(picked, ["sheet_index", "label"]).select(*edges.columns, "label")


def neighbours(edges: DataFrame, picked: DataFrame, direction: str, among: DataFrame) -> DataFrame:
    """(sheet_index, owner, label): neighbours of the picked objects that are `among` (sheet_index, label); loops lead nowhere."""
    found = matching(edges.where("from <> to"), picked, direction)
    other = F.when(F.col("from") == F.col("label"), F.col("to")).otherwise(F.col("from"))
    return found.select("sheet_index", F.col("label").alias("owner"), other.alias("_o")).distinct().join(among.select("sheet_index", F.col("label").alias("_o")), ["sheet_index", "_o"]).select("sheet_index", "owner", F.col("_o").alias("label"))


def ego_visible(nodes: DataFrame, edges: DataFrame, selected: str | None, direction: str = "both", secondary: bool = False, shared: bool = False, least: float = -math.inf, most: float = math.inf) -> DataFrame:
    """(sheet_index, label): what stays visible in each sheet around the selected object, which itself always does."""
    among = nodes.where(F.col("cluster_value").between(least, most)).select("sheet_index", "label").distinct()
    if selected is None:
        return among
    own = nodes.select("sheet_index").distinct().select("sheet_index", F.lit(selected).alias("label"))
    direct = neighbours(edges, own, direction, among).select("sheet_index", "label").distinct()
    seen = own.union(direct)
    if secondary:
        seen = seen.union(neighbours(edges, direct, direction, among).select("sheet_index", "label"))
    seen = seen.distinct()
    if shared:
        owners = neighbours(edges, among, direction, among).where("owner <> label").groupBy("sheet_index", "label").agg(F.countDistinct("owner").alias("n")).where("n >= 2")
        seen = seen.where(F.col("label") != selected).join(owners, ["sheet_index", "label"], "left_semi").union(own)
    return seen


def ego_edges(nodes: DataFrame, edges: DataFrame, selected: str, direction: str = "both", secondary: bool = False) -> DataFrame:
    """Edges of the selected object, loops included, and with `secondary` those of its neighbours that don't touch it; edges between two neighbours stand twice in both directions."""
    own = nodes.select("sheet_index").distinct().select("sheet_index", F.lit(selected).alias("label"))
    first = matching(edges, own, direction).drop("label").withColumn("tier", F.lit("primary"))
    if not secondary:
        return first
    direct = neighbours(edges, own, direction, nodes.select("sheet_index", "label").distinct()).select("sheet_index", "label").distinct()
    away = edges.where((F.col("from") != selected) & (F.col("to") != selected))
    return first.unionByName(matching(away, direct, direction).drop("label").withColumn("tier", F.lit("secondary")))


def placed_edges(edges: DataFrame, positions: DataFrame, selected: str, secondary: bool) -> DataFrame:
    """Edges with their ends' positions (sheet_index, label, x, y, z) and colours: white at the selected object, else grey."""
    end = lambda key, p: positions.select("sheet_index", F.col("label").alias(key), *(F.col(c).cast("float").alias(f"{p}_{c}") for c in "xyz"))
    white = (F.col("from") == selected) | (F.col("to") == selected) | F.lit(not secondary)
    return edges.join(end("from", "from"), ["sheet_index", "from"]).join(end("to", "to"), ["sheet_index", "to"]).withColumns({"shade": F.when(white, 1.0).otherwise(0.7), "alpha": F.when(white, 1.0).otherwise(0.5)})


def ego_style(nodes: DataFrame, visible: DataFrame, selected: str | None) -> DataFrame:
    """size and alpha of each object: the selected one 5 % larger, others dim; without a selection hidden ones vanish."""
    marked = nodes.join(visible.withColumn("_v", F.lit(True)), ["sheet_index", "label"], "left")
    chosen = (F.col("label") == selected) if selected is not None else F.lit(False)
    alpha = F.when(F.col("_v"), 1.0).otherwise(0.15 if selected is not None else 0.0)
    return marked.select("sheet_index", "label", F.when(chosen & F.col("_v"), F.col("size") * 1.05).otherwise(F.col("size")).alias("size"), alpha.alias("alpha"), (chosen & F.coalesce("_v", F.lit(False))).alias("white"))


def pick_object(projected: DataFrame, x: float, y: float, reach: float = 20.0) -> DataFrame:
    """In each sheet the object (sheet_index, label, px, py) nearest to a point of the screen, if any lies within reach."""
    far = F.sqrt((F.col("px") - x) ** 2 + (F.col("py") - y) ** 2)
    near = projected.withColumn("distance", far).where(F.col("distance") < reach)
    return near.groupBy("sheet_index").agg(F.min(F.struct("distance", "label")).alias("p")).select("sheet_index", "p.label", "p.distance")


# -- sonification --------------------------------------------------------------------------------

def beat_interval(beats: Column, steps: Column) -> Column:
    """Slices between two beats, null for none: at most a beat every other slice."""
    effective = F.least(beats, F.greatest(F.floor(steps / 2), F.lit(1)))
    return F.when(effective > 0, F.greatest(F.floor(steps / F.when(effective > 0, effective)), F.lit(1)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def graduated_note(base: Column, magnitude: Column, low: float = 0.0, high: float = 1.0, semitones: int = 12) -> Column:
    t = F.least(F.greatest((magnitude - low) / max(high - low, 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(base + half_up(t * semitones), F.lit(0)), F.lit(127))


def midi_events(nodes: DataFrame, steps: int, beats: int, mapping: str = "centrality_to_pitch", graduated: bool = True, velocity: int = 127, hold: int = 1) -> DataFrame:
    """(slice_index, kind, label, channel, note, velocity, instrument): note-ons at every beat for all objects of the sheet, and their note-offs."""
    every = max(steps // min(beats, max(steps // 2, 1)), 1) if min(beats, max(steps // 2, 1)) else None
    if every is None:
        return nodes.sparkSession.createDataFrame([], "slice_index int, kind string, label string, channel int, note int, velocity int, instrument int")
    last = nodes.agg(F.max("sheet_index").alias("last"))
    sheets = nodes.crossJoin(F.broadcast(last)).where("sheet_index < last or last = 0")
    unit = lambda c: half_up(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 127)
    pitch = graduated_note(F.col("note"), F.col("size")) if graduated else F.col("note")
    capped = F.least(F.col("velocity"), F.lit(velocity))
    channel, note, strength = {
        "centrality_to_pitch": (F.col("channel"), pitch, capped),
        "degree_to_velocity": (F.col("channel"), F.col("note"), unit("size")),
        "betweenness_pitch_closeness_velocity": (F.col("channel"), pitch, unit("cluster_value")),
        "cluster_to_channel": ((F.floor(F.abs("cluster_value")) % 16).cast("int"), pitch, capped),
    }[mapping]
    beat = F.explode(F.sequence(F.lit(0), F.lit(steps - 1), F.lit(every)))
    on = sheets.withColumn("_k", beat).select((F.col("sheet_index") * steps + F.col("_k")).alias("slice_index"), F.lit("on").alias("kind"), "label", channel.alias("channel"), note.alias("note"), strength.alias("velocity"), "instrument")
    off = on.withColumns({"slice_index": F.col("slice_index") + max(hold, 1), "kind": F.lit("off"), "velocity": F.lit(0)})
    return on.unionByName(off)
