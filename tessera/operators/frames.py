"""Which frames to take: plans around anchors, round robin over sequences, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.numbering import numbered


def round_robin(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """One row per group and pass, groups in order, until `most` rows; `pick` numbers them from 1."""
    passes = df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    few = passes.orderBy("turn", group).limit(most)
    return few.withColumn("pick", F.row_number().over(W.orderBy("turn", group)))


def tiered_round_robin(df: DataFrame, tiers: list[Column], key: str, group: str, order: list, most: int) -> DataFrame:
    """Round robin over tiers, best first: a later tier only gives rows that no earlier one gave, up to `most` in all."""
    best = F.coalesce(*(F.when(t, n) for n, t in enumerate(tiers)))
    once = df.withColumn("tier", best).where(F.col("tier").isNotNull())
    once = once.withColumn("copy", F.row_number().over(W.partitionBy(key).orderBy("tier", group, *order))).where("copy = 1").drop("copy")
    turns = once.withColumn("turn", F.row_number().over(W.partitionBy("tier", group).orderBy(*order)))
    return turns.orderBy("tier", "turn", group).limit(most)


def pair_reasons(crops: DataFrame, source: Column, frame: Column, near: int) -> DataFrame:
    """How many pairs of crops of one source are within `near` frames (near_frame) and how many are not (kept), by reason and n.

    No pair is listed: rows are counted by source and frame first, and a window over the frames before gives each count's
    partners. Crops without a frame are near to none.
    """
    counts = crops.groupBy(source.alias("source"), frame.alias("frame")).agg(F.count("*").alias("c")).where(F.col("source").isNotNull())
    before = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("frame").rangeBetween(-near, -1)), F.lit(0))
    partners = F.col("c") * before + F.expr("c * (c - 1) div 2")
    close = counts.where(F.col("frame").isNotNull()).select(partners.alias("near"), F.lit(0).cast("long").alias("all"))
    whole = counts.groupBy("source").agg(F.sum("c").alias("c")).select(F.lit(0).cast("long").alias("near"), F.expr("c * (c - 1) div 2").alias("all"))
    sums = close.union(whole).agg(F.coalesce(F.sum("near"), F.lit(0)).alias("near_frame"), F.coalesce(F.sum("all") - F.sum("near"), F.lit(0)).alias("kept"))
    return sums.select(F.expr("stack(2, 'near_frame', near_frame, 'kept', kept) AS (reason, n)")).where("n > 0")


def even_places(count: Column, wanted: int) -> Column:
    """`wanted` places spread over 0 to count - 1, first and last included, halves to even; all places if there are fewer."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (count - 1) / F.lit(float(max(1, wanted - 1)))).cast("long"))
    return F.when(count > wanted, F.array_distinct(spread)).when(count > 0, F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def frame_plan(videos: DataFrame, step: float, offsets: tuple[float, ...], fps: float, most: int) -> DataFrame:
    """Frames around anchors every `step` seconds of videos (video, seconds), each frame once (the earliest anchor's), `most` per video."""
    anchors = videos.select("video", "seconds", F.posexplode(F.expr(f"transform(sequence(0, cast(floor(seconds / {step}) as int)), i -> i * {step}D)")).alias("anchor", "at"))
    bursts = anchors.select("video", "seconds", "anchor", "at", F.posexplode(F.array(*map(F.lit, offsets))).alias("shot", "offset"))
    last = F.greatest(F.floor(F.col("seconds") * fps) - 1, F.lit(0))
    frame = F.least(F.greatest(F.bround((F.col("at") + F.col("offset")) * fps).cast("long"), F.lit(0)), last)
    planned = bursts.withColumn("frame", frame)
    first = F.row_number().over(W.partitionBy("video", "frame").orderBy("anchor", "shot"))
    place = F.row_number().over(W.partitionBy("video").orderBy("anchor", "shot"))
    return planned.withColumn("n", first).where("n = 1").withColumn("place", place).where(F.col("place") <= most).select("video", "place", "anchor", "shot", "frame")


def anchor_windows(anchors: DataFrame, before: int, after: int, stride: int) -> DataFrame:
    """Frames from `before` to `after` an anchor, inside the video; df: video, frames, anchor. Windows may overlap."""
    low, high = F.greatest(F.col("anchor") - before, F.lit(0)), F.least(F.col("anchor") + after, F.col("frames") - 1)
    return anchors.select("video", "anchor", F.explode(F.sequence(low, high, F.lit(stride))).alias("frame"))


def within_budget(df: DataFrame, order: list[str], size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Rows in order while what came before them is below both budgets."""
    first = df.orderBy(*order).limit(most_rows)  # no later row can be taken, so one task sees most_rows at most
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(size).over(before), F.lit(0))
    return first.withColumns({"spent": spent, "place": F.row_number().over(W.orderBy(*order))}).where(F.col("spent") < most_bytes)


def positions(df: DataFrame, group: str, order: list) -> DataFrame:
    whole = W.partitionBy(group)
    return df.withColumns({"place": F.row_number().over(whole.orderBy(*order)) - 1, "neighbours": F.count("*").over(whole)})


def evidence_bucket(df: DataFrame, score: str, tie: str, best: int, weak: int) -> DataFrame:
    """The best by score, the weakest at the other end, the rest between; a row in both is among the best."""
    ranked = numbered(df, [F.col(score).desc(), tie], "rank")
    total = df.count()
    return ranked.withColumn("bucket", F.when(F.col("rank") <= best, "best").when(F.col("rank") > total - weak, "weak").otherwise("middle"))


def burst_frames(videos: DataFrame, stride: int, step: int, radius: int, most: int) -> DataFrame:
    """Frames around every `stride`-th one of videos (video, frames), at most `most` of these; a frame of several bursts is the last one's."""
    bases = videos.where(F.col("frames") > 0).select("video", "frames", F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(stride).cast("long")).alias("all"))
    n = F.size("all")
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(F.col("all"), F.floor(i * (n / F.lit(float(most)))).cast("int")))
    few = F.when(n > most, even).otherwise(F.col("all")) if most > 0 else F.col("all")
    bursts = bases.select("video", "frames", F.posexplode(few).alias("burst", "base"))
    shots = bursts.select("video", "frames", "burst", "base", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("shot"))
    frame = F.col("base") + F.col("shot") * step
    inside = shots.withColumn("frame", frame).where((F.col("frame") >= 0) & (F.col("frame") < F.col("frames")))
    last = inside.groupBy("video", "frame").agg(F.max(F.struct("burst", "shot")).alias("x"))
    return last.select("video", "frame", "x.burst", F.when(F.col("x.shot") == 0, "base").otherwise("burst").alias("role"))


def preview(frames: DataFrame, group: str, frame: str, anchor: str, most: int) -> DataFrame:
    """Frames to show of each group: its first, its anchor, its last, with more than three its middle, then the earliest others."""
    whole = W.partitionBy(group)
    placed = frames.withColumns({"__place": F.row_number().over(whole.orderBy(frame)) - 1, "__n": F.count("*").over(whole)})
    at = F.col("__place")
    rank = F.when(at == 0, 0).when(F.col(frame) == F.col(anchor), 1).when(at == F.col("__n") - 1, 2)
    if most > 3:
        rank = rank.when(at == F.floor(F.col("__n") / 2), 3)
    turn = F.row_number().over(whole.orderBy(rank.otherwise(4), frame))
    return placed.withColumn("__turn", turn).where(F.col("__turn") <= most).drop("__place", "__n", "__turn")


def anchor_times(videos: DataFrame, step: float, most: int) -> DataFrame:
    """Times every `step` seconds of videos (video, seconds), the end too if it is half a step away; `most` of them, evenly spread.

    A video without length has its start alone.
    """
    seconds = F.col("seconds")
    count = F.ceil(seconds / step).cast("int")
    raw = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i * F.lit(step))
    end = F.greatest(F.lit(0.0), seconds - 0.001)
    times = F.when(seconds <= 0, F.array(F.lit(0.0))).when(end - F.element_at(raw, -1) >= 0.5 * step, F.concat(raw, F.array(end))).otherwise(raw)
    listed = videos.select("video", times.alias("t"))
    n = F.size("t")
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(F.col("t"), F.bround(i * (n - 1) / F.lit(float(max(1, most - 1)))).cast("int")))
    return listed.select("video", F.posexplode(F.when(n > most, spread).otherwise(F.col("t"))).alias("anchor", "seconds"))
