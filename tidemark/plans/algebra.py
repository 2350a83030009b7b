"""Queries of interval algebra and timeline joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import joins
from tidemark.plans.inputs import HI, HOUR, LO, SPANS, marks, merged, minus, points, side, spans, table

A = lambda s, d: side(s, d, True)
B = lambda s, d: side(s, d, False)
SCOPE = f"scope as (select distinct key, {LO} as t0, {HI} as t1 from spans)"
FRAME = 40_000_000


def scope(s, d):
    return spans(s, d).select("key").distinct().select("key", F.lit(LO).alias("t0"), F.lit(HI).alias("t1"))


def clips(s, d):
    """Spans cut to clips with a track: key, id, t0, t1, track."""
    return A(s, d).select("key", "id", "t0", "t1", (F.col("v") % 4).alias("track"))


def sql(body: str, *more: str) -> str:
    return f"with {', '.join([SPANS, *more])} {body}"


def frames_sql(start: str, end: str) -> str:
    return sql(f"select * from {merged('f')}", f"f as (select key, cast({start} as bigint) as t0, cast({end} as bigint) as t1 from spans where t0 < t1)")


PADDED = f"p as (select key, greatest(t0 - {HOUR}, {LO}) as t0, least(t1 + {2 * HOUR}, {HI}) as t1 from spans where t0 < t1)"
IA, IB = f"ia as {merged('sa')}", f"ib as {merged('sb')}"
CLIP_SQL = "clips as (select key, id, t0, t1, v % 4 as track from sa where t0 < t1)"
W = "(select key, id, t0, t1 from sb where t0 < t1)"

ALL = {
    "interval_merge": (lambda s, d: iv.islands(spans(s, d)), sql(f"select * from {merged('spans')}")),
    "interval_merge_gaps": (lambda s, d: iv.islands(spans(s, d), HOUR), sql(f"select * from {merged('spans', f'e is null or (t0 > e and t0 - e >= {HOUR})')}")),
    "interval_union": (lambda s, d: iv.union(A(s, d), B(s, d)), sql(f"select * from {merged('spans')}")),
    "interval_intersect": (
        lambda s, d: iv.intersect(A(s, d), B(s, d)),
        sql("select ia.key, greatest(ia.t0, ib.t0) as t0, least(ia.t1, ib.t1) as t1 from ia join ib on ia.key = ib.key and ia.t0 < ib.t1 and ib.t0 < ia.t1", IA, IB),
    ),
    "interval_subtract": (lambda s, d: iv.subtract(A(s, d), B(s, d)), sql(f"select * from {minus('ia', 'ib')}", IA, IB)),
    "interval_invert": (lambda s, d: iv.invert(A(s, d), scope(s, d)), sql(f"select * from {minus('scope', 'ia')}", IA, SCOPE)),
    "interval_clamp": (
        lambda s, d: iv.clamp(spans(s, d), LO, HI),
        sql(f"select * from {merged('c')}", f"c as (select key, greatest(t0, {LO}) as t0, least(t1, {HI}) as t1 from spans)"),
    ),
    "interval_pad": (lambda s, d: iv.pad(spans(s, d), HOUR, 2 * HOUR, LO, HI), sql(f"select * from {merged('p')}", PADDED)),
    "interval_drop_short": (lambda s, d: iv.drop_short(spans(s, d), 2 * HOUR), sql(f"select * from {merged('spans')} where t1 - t0 >= {2 * HOUR}")),
    "interval_total": (lambda s, d: iv.total(spans(s, d)), sql(f"select key, count(*) as n, cast(sum(t1 - t0) as bigint) as covered from {merged('spans')} group by key")),
    "interval_contains": (
        lambda s, d: iv.shares(points(s, d), A(s, d)),
        sql("select * from points p where exists (select 1 from sa where sa.key = p.key and sa.t0 <= p.t and p.t < sa.t1)"),
    ),
    "frame_snap_inner": (lambda s, d: iv.frames(spans(s, d), FRAME, "inner"), frames_sql(f"ceil(t0 / {FRAME})", f"t1 // {FRAME}")),
    "frame_snap_outer": (lambda s, d: iv.frames(spans(s, d), FRAME, "outer"), frames_sql(f"t0 // {FRAME}", f"ceil(t1 / {FRAME})")),
    "frame_snap_nearest": (
        lambda s, d: iv.frames(spans(s, d), FRAME, "nearest"), frames_sql(f"(2 * t0 + {FRAME}) // {2 * FRAME}", f"(2 * t1 + {FRAME}) // {2 * FRAME}"),
    ),
    "ripple_map": (
        lambda s, d: iv.ripple(points(s, d), A(s, d)),
        sql(
            "select p.key, p.id, p.t, cast(p.t - coalesce(sum(least(ia.t1, p.t) - ia.t0), 0) as bigint) as t_new from points p left join ia on ia.key = p.key and ia.t0 <= p.t group by p.key, p.id, p.t", IA,
        ),
    ),
    "butt_layout": (
        lambda s, d: iv.butt_layout(A(s, d)),
        sql("select key, cast(coalesce(sum(t1 - t0) over (partition by key order by t0 rows between unbounded preceding and 1 preceding), 0) as bigint) as start, t0 as src_in, t1 as src_out from ia", IA),
    ),
    "word_clip_midpoint": (
        lambda s, d: joins.midpoint_join(B(s, d), clips(s, d), 6 * HOUR),
        sql(
            f"select w.key, w.id, c.id as clip, greatest(w.t0, c.t0) as t0, least(w.t1, c.t1) as t1 from {W} w join clips c on w.key = c.key and 2 * c.t0 <= w.t0 + w.t1 and w.t0 + w.t1 < 2 * c.t1", CLIP_SQL,
        ),
    ),
    "word_clip_overlap": (
        lambda s, d: joins.overlap_join(B(s, d), clips(s, d), 6 * HOUR),
        sql(
            f"select w.key, w.id, c.id as clip, greatest(w.t0, c.t0) as t0, least(w.t1, c.t1) as t1, 2 * c.t0 <= w.t0 + w.t1 and w.t0 + w.t1 < 2 * c.t1 as mid from {W} w join clips c on w.key = c.key and w.t0 < c.t1 and c.t0 < w.t1", CLIP_SQL,
        ),
    ),
    "stab_top_track": (
        lambda s, d: joins.stab_top(points(s, d), clips(s, d), 6 * HOUR),
        sql("select p.key, p.id, c.id as clip, c.track from points p join clips c on p.key = c.key and c.t0 <= p.t and p.t < c.t1 qualify row_number() over (partition by p.key, p.id order by c.track desc, c.id) = 1", CLIP_SQL),
    ),
    "stab_lowest_track": (
        lambda s, d: joins.stab_top(points(s, d), clips(s, d), 6 * HOUR, highest=False),
        sql("select p.key, p.id, c.id as clip, c.track from points p join clips c on p.key = c.key and c.t0 <= p.t and p.t < c.t1 qualify row_number() over (partition by p.key, p.id order by c.track, c.id) = 1", CLIP_SQL),
    ),
    "asof_last": (
        lambda s, d: joins.asof_last(points(s, d), marks(s, d)),
        sql("select p.key, p.id, p.t, m.t as mark_t, m.id as mark_id from points p left join marks m on p.key = m.key and m.t <= p.t qualify row_number() over (partition by p.key, p.id order by m.t desc, m.id desc) = 1"),
    ),
    "snap_nearest": (
        lambda s, d: joins.snap_nearest(points(s, d), marks(s, d), HOUR, 2 * HOUR, 6 * HOUR),
        sql(f"select p.key, p.id, p.t, coalesce(m.t, p.t) as t_new from points p left join marks m on p.key = m.key and m.t between p.t - {HOUR} and p.t + {2 * HOUR} qualify row_number() over (partition by p.key, p.id order by abs(m.t - p.t), m.t) = 1"),
    ),
    "frame_overlay_max": (
        lambda s, d: table(s, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (6 * HOUR)).alias("frame")).agg(F.max("value").alias("peak")),
        f"select epoch_us(ts) // {6 * HOUR} as frame, max(value) as peak from events group by 1",
    ),
}
