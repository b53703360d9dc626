"""Trajectories: properties, filters, mean squared displacement, and linking of particles from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tabular import q

#: The id of points that belong to no track.
UNLINKED = -1


def track_properties(df: DataFrame, track: str = "track_id", frame: str = "frame", x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """One row a track: length, first and last frame, path length, net displacement, straightness, mean and largest step."""
    by = Window.partitionBy(q(track)).orderBy(q(frame))
    step = F.sqrt((q(x) - F.lag(q(x)).over(by)) ** 2 + (q(y) - F.lag(q(y)).over(by)) ** 2)
    s = df.where(q(track).isNotNull() & (q(track) != UNLINKED)).withColumn("_step", step)
    s = s.groupBy(q(track).alias("track_id")).agg(
        F.count(F.lit(1)).alias("n_points"), F.min(q(frame)).alias("first_frame"), F.max(q(frame)).alias("last_frame"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length"),
        F.avg("_step").alias("mean_speed"), F.max("_step").alias("max_speed"), F.min_by(F.struct(q(x).alias("x"), q(y).alias("y")), q(frame)).alias("a"), F.max_by(F.struct(q(x).alias("x"), q(y).alias("y")), q(frame)).alias("b"),
    )
    net = F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2)
    return s.withColumn("displacement", net).withColumn("straightness", F.try_divide("displacement", "path_length")).drop("a", "b")


def filter_tracks(df: DataFrame, min_length: int = 0, max_length: int = 0, min_displacement: float = 0, max_displacement: float = 0, min_speed: float = 0, max_speed: float = 0, drop_unlinked: bool = False, track: str = "track_id", **columns: str) -> DataFrame:
    """Points of the tracks within the limits (0: none); points of no track stay unless dropped."""
    p = track_properties(df, track, **columns)
    keep = F.lit(True)
    for c, low, high in (("n_points", min_length, max_length), ("displacement", min_displacement, max_displacement), ("mean_speed", min_speed, max_speed)):
        if low:
            keep = keep & F.coalesce(F.col(c) >= low, F.lit(False))
        if high:
            keep = keep & F.coalesce(F.col(c) <= high, F.lit(True))
    kept = df.join(p.where(keep).select(F.col("track_id").alias("_kept")), q(track) == F.col("_kept"), "left_semi")
    return kept if drop_unlinked else kept.unionByName(df.where(q(track).isNull() | (q(track) == UNLINKED)))


def mean_squared_displacement(df: DataFrame, max_lag: int = 0, per_track: bool = False, track: str = "track_id", frame: str = "frame", x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """([track_id,] lag, msd, n): squared displacements of points `lag` points apart in a track, for lags up to max_lag.

    max_lag 0 is half the median length of a track, two at least. Points of a frame that is missing are not waited for.
    Places are dealt into blocks of max_lag, and each point is sent to its own block and the next: there it meets all
    points up to max_lag later. The pairs are averaged where they meet, and only sums are moved.
    """
    p = df.where(q(track).isNotNull() & (q(track) != UNLINKED)).select(q(track).alias("track_id"), q(frame).alias("f"), q(x).alias("x"), q(y).alias("y"))
    if not max_lag:
        median = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).agg(F.median("n")).first()[0]
        max_lag = max(2, int((median or 0) // 2))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("f", "x", "y"))).drop("f")
    block = F.floor(F.col("place") / max_lag).cast("int")
    later = p.select("track_id", block.alias("block"), F.col("place").alias("place2"), F.col("x").alias("x2"), F.col("y").alias("y2")).hint("merge")
    sent = p.withColumn("block", F.explode(F.array(block, block + 1)))
    lag = F.col("place2") - F.col("place")
    d = sent.join(later, ["track_id", "block"]).where(lag.between(1, max_lag)).withColumn("lag", lag)
    square = (F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2
    return d.groupBy(*(["track_id"] if per_track else []), "lag").agg(F.avg(square).alias("msd"), F.count(F.lit(1)).alias("n"))


def trajectories(df: DataFrame, color_by: str = "track_id", tail_frames: int = 0, track: str = "track_id", frame: str = "frame", x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """The segments that a plot of paths draws: (track_id, frame, x, y, to_x, to_y, color), one row a point but for the last of a track.

    color is the track's id, or with "speed" the segment's length over the frames it spans. tail_frames > 0 keeps the
    segments that end within so many frames of the last frame of all.
    """
    by = Window.partitionBy("track_id").orderBy("frame", "x", "y")
    p = df.where(q(track).isNotNull() & (q(track) != UNLINKED)).select(q(track).alias("track_id"), q(frame).alias("frame"), q(x).cast("double").alias("x"), q(y).cast("double").alias("y"))
    s = p.withColumns({"to_x": F.lead("x").over(by), "to_y": F.lead("y").over(by), "_to": F.lead("frame").over(by)}).where("_to is not null")
    if tail_frames:
        s = s.crossJoin(F.broadcast(p.agg(F.max("frame").alias("_last")))).where(F.col("_to") > F.col("_last") - tail_frames).drop("_last")  # one row
    length = F.sqrt((F.col("to_x") - F.col("x")) ** 2 + (F.col("to_y") - F.col("y")) ** 2)
    color = F.try_divide(length, (F.col("_to") - F.col("frame")).cast("double")) if color_by == "speed" else F.col("track_id")
    return s.withColumn("color", color).drop("_to")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; infinite costs are never paired. Shortest augmenting paths."""
    n, m = cost.shape
    if not n or not m:
        return []
    finite = cost[np.isfinite(cost)]
    large = (finite.max() + 1) * (min(n, m) + 1) if len(finite) else 1.0
    c = np.where(np.isfinite(cost), cost, large)
    flip = n > m
    c = c.T if flip else c
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            gap = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], way[1:][better] = gap[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    pairs = [(b, a) for a, b in pairs] if flip else pairs
    return [(a, b) for a, b in pairs if np.isfinite(cost[a, b])]


def link_particles(df: DataFrame, video: str, max_displacement: float = 30.0, max_gap: int = 2, min_length: int = 3, frame: str = "frame", x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """df with track_id: particles of following frames (up to max_gap missing) are paired at least total distance.

    Frames are linked in order, so a video is one task's work; videos run in parallel, and a task holds the points of
    one video. Tracks of fewer than min_length points become UNLINKED.
    """
    schema = df.drop("track_id").schema.add("track_id", "long")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="track_id", errors="ignore").sort_values([frame, y, x], kind="stable").reset_index(drop=True)
        ids, open_, following = np.full(len(pdf), UNLINKED), {}, 0
        place = pdf[[y, x]].to_numpy(float)
        for f, at in pdf.groupby(frame, sort=True).indices.items():
            open_ = {t: (g, k) for t, (g, k) in open_.items() if f - g <= max_gap + 1}
            tracks = sorted(open_)
            if tracks:
                last = place[[open_[t][1] for t in tracks]]
                d = np.sqrt(((last[:, None] - place[at][None]) ** 2).sum(2))
                for a, b in assignment(np.where(d <= max_displacement, d, np.inf)):
                    ids[at[b]] = tracks[a]
            for k in at:
                if ids[k] == UNLINKED:
                    ids[k], following = following, following + 1
                open_[int(ids[k])] = (f, k)
        sizes = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, int)
        ids = np.where(sizes[ids] >= min_length, ids, UNLINKED)
        return pdf.assign(track_id=ids)

    return df.groupBy(q(video)).applyInPandas(link, schema)

