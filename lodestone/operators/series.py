"""Bursts: accepted frames of an entity in shooting order, cut into series, and the best frame of each.

frames: entity_id, path, dir, name, capture_time, time_is_metadata, seq decimal(38,0), prefix
and the metrics that selection needs. Sequence numbers are comparable within dir and prefix.

A frame's predecessor is needed, and how many breaks came before it. Both are computed in
two levels - within stretches of the order, then over one row for each stretch - so an
entity with very many frames is spread over many tasks. No row is dealt by its entity alone:
what is known of entities and of stretches is written first, so that its size is known and
the frames stay where they are when it is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.boxes import finite
from lodestone.storage import written

#: Columns of frames that their series follow from.
ORDERING = ("entity_id", "path", "dir", "name", "capture_time", "time_is_metadata", "seq", "prefix")
#: Stands for no sequence number in an order.
LAST = 10**15
#: Stands for no time in an order.
NO_TIME = -(2**62)
#: Numbers of this size and beyond stand at the ends of an order of longs, there by their own value.
FAR = 2**62
#: Characters of a path that name a stretch.
PATH_HEAD = 48
#: Microseconds, or sequence numbers, of a stretch of an entity's order.
STRETCH_MICROS, STRETCH_NUMBERS = 3_600_000_000, 500
#: Buckets that the times between two frames span at most.
REACH = 64
#: Widths of buckets; the widest spans all times.
LEVELS = 10


def order_modes(frames: DataFrame) -> DataFrame:
    """entity_id, frames, share (with numbers), sources, span and by_number: whether the numbers order the entity's frames better than their times."""
    number = F.col("seq")
    source = F.when(number.isNotNull(), F.struct(F.lower("dir"), "prefix"))
    modes = frames.groupBy("entity_id").agg(
        F.count("*").alias("frames"), F.avg(number.isNotNull().cast("double")).alias("share"), F.count_distinct(source).alias("sources"), (F.max(number) - F.min(number)).alias("span")
    )
    return modes.withColumn("by_number", F.coalesce((F.col("frames") > 1) & (F.col("share") >= 0.80) & (F.col("sources") == 1) & (F.col("span") <= 5000), F.lit(False)))


def _micros(t: Column) -> Column:
    """Microseconds of a time; a missing one comes before all others."""
    return F.coalesce(F.unix_micros(t.cast("timestamp")), F.lit(NO_TIME))


def ordered(frames: DataFrame) -> DataFrame:
    """frames with k1, far1, k2, far2, k3 (with path their order within an entity) and stretch.

    Sorts compare keys very often, and decimals of that size are made anew for each comparison: keys are longs, and numbers beyond them come beside.
    """
    modes = written(order_modes(frames).select("entity_id", "by_number"), "modes", narrow=True)
    exact = F.coalesce("seq", F.lit(LAST)).cast("decimal(38,0)")
    number, time = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), exact)).cast("long"), _micros(F.col("capture_time"))
    far = F.when(F.abs(exact) >= FAR, exact)
    both = frames.join(modes, "entity_id")
    by = F.col("by_number")
    keys = {"k1": F.when(by, number).otherwise(time), "far1": F.when(by, far), "k2": F.when(by, time).otherwise(number), "far2": F.when(~by, far), "k3": F.when(by, F.lower("name")).otherwise(F.lower("path"))}
    keyed = both.withColumns(keys)
    # frames without what orders their entity stand in stretches of the next key, and at last of their paths
    missing = F.col("k1") == F.when(by, LAST).otherwise(NO_TIME)
    second = F.when(missing, F.floor(F.col("k2") / F.when(by, STRETCH_MICROS).otherwise(STRETCH_NUMBERS)))
    third = F.when(missing & (F.col("k2") == F.when(by, NO_TIME).otherwise(LAST)), F.substring("k3", 1, PATH_HEAD))
    # a thousand far numbers are one stretch where numbers order
    beyond = F.coalesce("far1", F.when(missing, F.col("far2")))
    beyond = F.when(beyond > 0, F.substring(F.lpad(beyond.cast("string"), 38, "0"), 1, 35))
    first = F.floor(F.col("k1") / F.when(by, STRETCH_NUMBERS).otherwise(STRETCH_MICROS))
    return keyed.withColumn("stretch", F.struct(first.alias("first"), second.alias("second"), beyond.alias("beyond"), third.alias("third")))


_ORDER = ("k1", "far1", "k2", "far2", "k3", "path")


def with_previous(rows: DataFrame, *columns: str, keys: tuple[str, ...] = ("entity_id",), order: tuple[str, ...] = _ORDER) -> DataFrame:
    """rows with previous, a struct of the columns of the row before in the order within keys; null for the first. stretch: a part of that order.

    Rows are dealt once and written; only the first of each stretch are joined with the last of the one before.
    """
    own = F.struct(*columns)
    # sorts tell most rows apart by the first eight bytes of their first key, which a hash fills
    within = Window.partitionBy("_at", *keys, "stretch").orderBy(*order)
    near = written(rows.withColumn("_at", F.xxhash64(*keys, "stretch")).withColumns({"previous": F.lag(own).over(within), "_last": F.lead(F.lit(True)).over(within).isNull()}).drop("_at"), "near")
    # one row for each stretch
    lasts = near.where("_last").select(*keys, "stretch", own.alias("own"))
    before = written(lasts.select(*keys, "stretch", F.lag("own").over(Window.partitionBy(*keys).orderBy("stretch")).alias("previous")), "stretches", narrow=True)
    firsts = near.where("previous IS NULL").drop("previous").join(before, [*keys, "stretch"])
    return near.where("previous IS NOT NULL").unionByName(firsts).drop("_last")


def _hours(micros: str) -> Column:
    return F.floor(F.col(micros) / STRETCH_MICROS)


def shortest_runs(paths: DataFrame, n: int) -> DataFrame:
    """dir, first and best: for each n frames of one entity in a row, their folder, the time at which they begin, and (until, who); who are all entities on its frames."""
    seen = paths.select("dir", "path", "micros", F.explode("targets").alias("entity"), F.col("micros").alias("first"), F.col("targets").alias("who"), _hours("micros").alias("stretch"))
    for _ in range(n - 1):
        longer = with_previous(seen, "first", "who", keys=("dir", "entity"), order=("micros", "path")).where("previous IS NOT NULL")
        seen = longer.select("dir", "path", "micros", "entity", F.col("previous.first").alias("first"), F.array_union("who", "previous.who").alias("who"), "stretch")
    return seen.select("dir", "first", F.struct(F.col("micros").alias("until"), F.sort_array("who").alias("who")).alias("best"))


def next_runs(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """asked (dir, low and other columns) with best: of the runs in the folder that begin after low the one that ends first.

    A running minimum from the last time to the first, within stretches and then over one row for each stretch.
    """
    own = [c for c in asked.columns if c != "dir"]
    points = asked.select("dir", F.col("low").alias("at"), F.struct(*own).alias("own"), F.lit(None).cast(runs.schema["best"].dataType).alias("best"))
    points = points.unionByName(runs.select("dir", F.col("first").alias("at"), F.lit(None).cast(points.schema["own"].dataType).alias("own"), "best")).withColumn("stretch", _hours("at"))
    # what is asked at a time comes before the runs that begin then
    back = Window.partitionBy("dir", "stretch").orderBy(F.desc("at"), F.col("own").isNull())
    later = back.rowsBetween(Window.unboundedPreceding, 0)
    near = written(points.withColumns({"near": F.min("best").over(later), "_last": F.lead(F.lit(True)).over(back).isNull()}).where("own IS NOT NULL OR _last").drop("best"), "near-runs")
    stretches = near.where("_last").select("dir", "stretch", "near")
    far = written(stretches.select("dir", "stretch", F.min("near").over(Window.partitionBy("dir").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)).alias("far")), "far-runs", narrow=True)
    return near.where("own IS NOT NULL").join(far, ["dir", "stretch"]).select("dir", "own.*", F.least("near", "far").alias("best"))


def foreign_in_time(asked: DataFrame, paths: DataFrame, s: Settings) -> DataFrame:
    """asked: entity_id, path, dir, low and high. Those with a foreign entity on foreign_frames paths of the folder between the times, counted path by path.

    An interval meets paths by buckets of time, at most REACH + 1 of a width that its length asks for; paths go into the widths that are asked for.
    """
    width = max(1, int(s.series_gap_seconds * 1_000_000))
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(float(REACH), (F.col("high") - F.col("low")) / F.lit(float(width * REACH)))))).cast("int")
    bucket = lambda c, k: F.floor(F.col(c) / (F.pow(F.lit(float(REACH)), k) * width))
    asked = asked.withColumn("level", level)
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # LEVELS at most
    spread = asked.withColumn("at", F.explode(F.sequence(bucket("low", F.col("level")), bucket("high", F.col("level")))))
    held = paths.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("at", bucket("micros", F.col("level")))
    inside = (F.col("f.micros") > F.col("p.low")) & (F.col("f.micros") < F.col("p.high")) & (F.col("p.dir") == F.col("f.dir")) & ~F.array_contains("f.targets", F.col("p.entity_id"))
    between = spread.alias("p").join(held.alias("f"), (F.col("p.level") == F.col("f.level")) & (F.col("p.at") == F.col("f.at")) & inside)
    counts = between.select("p.entity_id", "p.path", F.col("f.path").alias("between"), F.explode("f.targets").alias("target")).groupBy("entity_id", "path", "target").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= s.foreign_frames).select("entity_id", "path").distinct()


def foreign_between(pairs: DataFrame, frames: DataFrame, s: Settings) -> DataFrame | None:
    """pairs: entity_id, path, dir, prefix, seq, micros and previous of those. entity_id, path of pairs with a foreign entity on foreign_frames paths between them; None where nothing lies between any pair.

    Paths that also show the entity itself do not count. Where both frames have numbers of one
    prefix, the few numbers between are looked up. Else times between decide: if any entity has
    so many frames there, then some run of just as many that follow one another lies there,
    and of the runs that begin after the first time the one that ends first. It shows the
    entity itself only where frames ordered by numbers go back in time; those pairs are counted path by path.
    """
    p = pairs.select("entity_id", "path", "dir", "prefix", "seq", "micros", "previous")
    by_number = F.coalesce(F.col("seq").isNotNull() & F.col("previous.seq").isNotNull() & (F.col("prefix") == F.col("previous.prefix")) & (F.col("previous.seq") < F.col("seq")), F.lit(False))
    low, high = F.least("micros", "previous.micros"), F.greatest("micros", "previous.micros")
    numbered = p.where(by_number & (F.col("seq") - F.col("previous.seq") > 1))
    timed = p.where(~by_number & (high > low)).select("entity_id", "path", "dir", low.alias("low"), high.alias("high"))
    numbers, times = not numbered.isEmpty(), not timed.isEmpty()
    if not (numbers or times):
        return None
    paths = written(frames.groupBy("path", "dir", "prefix", "seq", _micros(F.col("capture_time")).alias("micros")).agg(F.collect_set("entity_id").alias("targets")), "paths")
    found = []
    if numbers:
        asked = numbered.withColumn("at", F.explode(F.sequence(F.lit(1), (F.col("seq") - F.col("previous.seq") - 1).cast("int")))).withColumn("at", (F.col("previous.seq") + F.col("at")).cast("decimal(38,0)")).alias("p")
        there = (F.lower("p.dir") == F.lower("f.dir")) & (F.col("p.prefix") == F.col("f.prefix")) & (F.col("p.at") == F.col("f.seq"))
        between = asked.join(paths.where("seq IS NOT NULL").alias("f"), there & ~F.array_contains("f.targets", F.col("p.entity_id")))
        counts = between.select("p.entity_id", "p.path", F.explode("f.targets").alias("target")).groupBy("entity_id", "path", "target").agg(F.count("*").alias("n"))
        found.append(counts.where(F.col("n") >= s.foreign_frames).select("entity_id", "path"))
    if times:
        met = next_runs(timed, shortest_runs(paths, s.foreign_frames)).where("best.until < high")
        met = written(met.select("entity_id", "path", "dir", "low", "high", F.array_contains("best.who", F.col("entity_id")).alias("own")), "runs-between", narrow=True)
        found.append(met.where("NOT own").select("entity_id", "path"))
        if not met.where("own").isEmpty():
            found.append(foreign_in_time(met.where("own").drop("own"), paths, s))
    return reduce(DataFrame.unionByName, found).distinct()


def split(frames: DataFrame, s: Settings) -> DataFrame:
    """frames with series_index, from 1 in an entity's order, and series_size."""
    keyed = with_previous(ordered(frames).withColumn("micros", _micros(F.col("capture_time"))), "dir", "prefix", "seq", "micros", "time_is_metadata")
    prev = F.col("previous")
    numbers = F.col("seq").isNotNull() & prev["seq"].isNotNull()
    delta = F.col("seq") - prev["seq"]
    same_dir = F.col("dir") == prev["dir"]
    number_ok = F.when(numbers, (F.lower("dir") == F.lower(prev["dir"])) & (F.col("prefix") == prev["prefix"]) & (delta > 0) & (delta <= s.series_gap_numbers)).otherwise(same_dir)
    close = F.greatest(F.lit(0), F.col("micros") - prev["micros"]) <= int(s.series_gap_seconds * 1_000_000)
    time_ok = F.when((F.col("time_is_metadata") & prev["time_is_metadata"]) | ~numbers, close).otherwise(True)
    linked = keyed.withColumn("joins", F.coalesce(same_dir & number_ok & time_ok, F.lit(False)))
    # only frames that would join need the guard
    guard = foreign_between(linked.where("joins"), frames, s) if s.foreign_frames > 0 else None
    if guard is None:
        marked = linked.withColumn("foreign", F.lit(None).cast("boolean"))
    else:
        marked = linked.join(written(guard, "guard").withColumn("foreign", F.lit(True)), ["entity_id", "path"], "left")
    cut = marked.withColumn("breaks", (~(F.col("joins") & F.col("foreign").isNull())).cast("long")).drop("previous", "micros", "joins", "foreign")
    return _numbered(cut).select(*frames.columns, "series_index", "series_size")


def _numbered(cut: DataFrame) -> DataFrame:
    """cut: ordered frames with breaks, 1 where a series begins. Those with series_index and series_size.

    Both are counted within stretches and then corrected by one row for each stretch: by
    the series begun before it, and by the whole sizes of its first and last series, which others may share.
    """
    order = Window.partitionBy("_at", "entity_id", "stretch").orderBy(*_ORDER)
    numbered = cut.withColumn("_at", F.xxhash64("entity_id", "stretch")).withColumns({"_k": F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.lag(F.lit(True)).over(order).isNull(), "_last": F.lead(F.lit(True)).over(order).isNull()})
    here = written(numbered.withColumn("_size", F.count("*").over(Window.partitionBy("_at", "entity_id", "stretch", "_k"))).drop("_at"), "breaks")
    earlier = Window.partitionBy("entity_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    lasts = here.where("_last").select("entity_id", "stretch", F.col("_k").alias("_most"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    # the first and the last series of each stretch, once where they are one
    ends = here.where("_first OR _last").select("entity_id", "stretch", "_k", "_size").distinct().join(lasts, ["entity_id", "stretch"])
    whole = ends.withColumn("_whole", F.sum("_size").over(Window.partitionBy("entity_id", F.col("_before") + F.col("_k"))))
    sizes = whole.groupBy("entity_id", "stretch", "_most", "_before").agg(F.max(F.when(F.col("_k") == 0, F.col("_whole"))).alias("_head"), F.max(F.when(F.col("_k") == F.col("_most"), F.col("_whole"))).alias("_tail"))
    sized = here.join(written(sizes, "sizes", narrow=True), ["entity_id", "stretch"])
    size = F.when(F.col("_k") == F.col("_most"), F.col("_tail")).when(F.col("_k") == 0, F.col("_head")).otherwise(F.col("_size"))
    return sized.withColumns({"series_index": F.col("_k") + F.col("_before"), "series_size": size})


def eye_value(left: Column, right: Column) -> Column:
    return F.when(finite(left) & finite(right), F.least(left, right))


def pose_score(pose: Column) -> Column:
    """1 when facing the camera; the limits are fixed values of the score."""
    worst = F.greatest(F.abs(pose["yaw"]) / 45.0, F.abs(pose["pitch"]) / 35.0, F.abs(pose["roll"]) / 35.0)
    return F.when(pose.isNull(), 0.65).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - worst)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def average_rank(value: str, *partition: str) -> Column:
    """The place of a column's value among those of its partition, from 0 to 1; values within 1e-9 share their mean place; 0.5 if all do."""
    whole = Window.partitionBy(*partition)
    v = F.col(value)
    n, spread = F.count(v).over(whole), F.max(v).over(whole) - F.min(v).over(whole)
    # frames of fractions are for SQL only; the order is that of the rank, so that both take one sort
    equal = F.expr(f"count({value}) OVER (PARTITION BY {', '.join(partition)} ORDER BY {value} NULLS LAST RANGE BETWEEN 1e-9D PRECEDING AND 1e-9D FOLLOWING)")
    place = (F.rank().over(whole.orderBy(v.asc_nulls_last())) - 1 + F.greatest(F.lit(0), equal - 1) / 2.0) / F.greatest(F.lit(1), n - 1)
    return F.when((n <= 1) | (spread <= 1e-9), 0.5).otherwise(place)


#: A series; its number comes first, by which sorts tell most rows apart.
_SERIES = ("series_index", "entity_id")


def scored(series: DataFrame, s: Settings, alone: bool = False) -> DataFrame:
    """Rows in the running for the best of their series, with eye, blur_rank, eye_part, pose_part and score.

    If any frame's eyes are reliably open, only such frames are in the running. alone: each
    row is a series of its own, which needs no other rows, so all stay where they are.
    """
    rows = series.withColumns({"eye": eye_value(F.col("eye_left"), F.col("eye_right")), "_log": F.when(finite(F.col("blur_score")), F.log1p(F.greatest(F.lit(0.0), F.col("blur_score"))))})
    if alone:
        one = lambda c: F.col(c).isNotNull().cast("long")
        ranked = rows.withColumns({"_eyes": one("eye"), "_blurs": one("_log"), "_eye_rank": F.lit(0.5), "_blur_rank": F.lit(0.5)})
    else:
        whole = Window.partitionBy(*_SERIES)
        opened = F.coalesce(F.col("eye") >= s.eye_ratio_min, F.lit(False))
        pool = rows.withColumn("_open", opened).withColumn("_any", F.max("_open").over(whole)).where(F.col("_open") | ~F.col("_any")).drop("_open", "_any")
        ranked = pool.withColumns({"_eyes": F.count("eye").over(whole), "_blurs": F.count("_log").over(whole), "_eye_rank": average_rank("eye", *_SERIES), "_blur_rank": average_rank("_log", *_SERIES)})
    eye_part = F.when(F.col("eye").isNull(), F.when(F.col("_eyes") > 0, 0.35).otherwise(0.50)).when(F.col("_eyes") > 1, F.col("_eye_rank")).otherwise(0.75)
    blur_part = F.when(F.col("_log").isNull(), F.when(F.col("_blurs") > 0, 0.35).otherwise(0.50)).otherwise(F.col("_blur_rank"))
    identity = clamp(1.0 - F.col("distance") / max(1e-6, s.match_threshold))
    parts = ranked.withColumns({"eye_part": eye_part, "blur_rank": blur_part, "pose_part": pose_score(F.col("pose"))})
    score = 0.40 * F.col("blur_rank") + 0.32 * F.col("eye_part") + 0.13 * identity + 0.10 * F.col("pose_part") + 0.05 * clamp(F.col("det_score"))
    return parts.withColumn("score", score).drop("_log", "_eyes", "_blurs", "_eye_rank", "_blur_rank")


def best_of_series(series: DataFrame, s: Settings) -> DataFrame:
    """One row of each series: the highest score, then the smallest distance, the sharpest, the first path; differences below 1e-12 do not count."""
    blur = F.coalesce(F.when(finite(F.col("blur_score")), F.col("blur_score")), F.lit(-1.0))
    order = Window.partitionBy(*_SERIES).orderBy(F.desc(F.round("score", 12)), F.round("distance", 12), F.desc(F.round(blur, 12)), F.lower("path"), "path")
    several = scored(series.where("series_size > 1"), s).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return several.unionByName(scored(series.where("series_size = 1"), s, alone=True))


def best_frames(frames: DataFrame, s: Settings) -> DataFrame:
    return best_of_series(split(frames, s), s)
