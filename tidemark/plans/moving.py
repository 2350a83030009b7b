"""Queries over boxes, centres and page changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import motion as mo
from tidemark.operators import sounds as so
from tidemark.plans import spoken, topics
from tidemark.plans.inputs import HOUR, SPANS, side, spans

STEP = 500


def samples(s, d):
    """Half a second's samples of a screen for every conversation: page changes, and the mass and moments of small changes."""
    ends = topics.scope(s, d)
    t = F.explode(F.sequence("t0", "t1", F.lit(STEP).cast("long")))
    rows = ends.select("key", t.alias("t"))
    i = F.floor(F.col("t") / STEP) + F.col("key") * 3
    m = F.when(i % 17 < 9, (i * 31) % 23)
    m = F.coalesce(m, F.lit(0))
    return rows.select("key", "t", ((i % 41 < 2) | (i % 29 == 4)).alias("page"), m.cast("long").alias("m"), (m * (i % 50)).cast("long").alias("mx"), (m * (i * 7 % 30)).cast("long").alias("my"))


SAMPLES = f"""samples as (select key, t, i % 41 < 2 or i % 29 = 4 as page, m, m * (i % 50) as mx, m * (i * 7 % 30) as my from (
  select *, case when i % 17 < 9 then i * 31 % 23 else 0 end as m from (select key, t, cast(floor(t / {STEP}.0) as bigint) + key * 3 as i from (select key, unnest(range(t0, t1 + 1, {STEP})) as t from scopes))))"""
SHOTS = f"""edges as (select key, t, row_number() over (partition by key order by t) as r from (select *, lag(page) over (partition by key order by t) as p from samples) where page and not coalesce(p, false)),
  w as (select key, r, t as last, true as kept, t from edges where r = 1 union all select e.key, e.r, case when e.t - w.last >= 1000 then e.t else w.last end, e.t - w.last >= 1000, e.t from w join edges e on e.key = w.key and e.r = w.r + 1),
  lim as (select key, min(t) - {STEP // 2} as a, max(t) + {STEP // 2} as b from samples group by key),
  cut as (select s.*, sum(case when w.kept and s.t - {STEP // 2} > a + 300 and s.t - {STEP // 2} < b - 300 then 1 else 0 end) over (partition by s.key order by s.t) as shot from samples s join lim using (key) left join w on w.key = s.key and w.t = s.t),
  near as (select *, """ + ", ".join(f"sum(case when page then 0 else {c} end) over (partition by key, shot order by t rows between 2 preceding and 2 following) as s{c}" for c in ("m", "mx", "my")) + f""",
    min(t) over (partition by key, shot) - {STEP // 2} as s0, max(t) over (partition by key, shot) + {STEP // 2} as s1, max(shot) over (partition by key) as top from cut),
  seen as (select *, sm >= 20 as ok, (shot < top and t > s1 - 800) or (shot > 0 and t < s0 + 300) as tr from near),
  inn as (select *, bool_or(ok and not tr) over (partition by key, shot) as whole from seen)
  select key, t, cast(shot as int) as shot, case when ok and not (tr and whole) then smx / sm end as x, case when ok and not (tr and whole) then smy / sm end as y from inn"""


def boxes(s, d):
    """Events as boxes: up to a few at one time for every user, near where their kind lives."""
    rows = spans(s, d).withColumn("t", F.floor(F.col("t0") / 7_200_000_000).cast("long") * 400)
    place = F.row_number().over(Window.partitionBy("key", "t").orderBy("id")) - 1
    base = F.crc32("kind") % 7 / 8
    return rows.select("key", "t", place.cast("long").alias("f"), (base + F.col("v") % 10 / 200).alias("x"), (1 - base + F.col("v") % 7 / 150).alias("y"), F.lit(0.12).alias("w"), (F.lit(0.1) + F.col("v") % 5 / 100).alias("h"))


def points(s, d):
    return spans(s, d).select("key", F.floor(F.col("t0") / 6_000_000).cast("long").alias("t"), F.when(F.col("v") % 9 > 0, (F.col("v") % 100) / 100).alias("x"))


def cursor(s, d):
    """A cursor on the samples of a screen: moves at some, in places with more or less around them."""
    i = F.floor(F.col("t") / STEP) + F.col("key") * 3
    moved = (i % 7 == 3) | (i % 19 < 2)
    return samples(s, d).select(
        "key", "t", "page", F.when(moved, i * 37 % 100 / 100).alias("x"), F.when(moved, i * 53 % 90 / 100).alias("y"), (i % 11 / 100).cast("double").alias("detail"), (i % 23 == 3).alias("zone")
    )


CURSOR = f"""moves as (select key, t, page, i % 7 = 3 or i % 19 < 2 as moved, i * 37 % 100 / 100 as x, i * 53 % 90 / 100 as y, i % 11 >= 4 and i % 23 <> 3 as good from (
  select *, cast(floor(t / {STEP}.0) as bigint) + key * 3 as i from samples)),
  ev as (select *, last_value(case when page or moved then t end ignore nulls) over w as et, last_value(case when page or moved then not page and good end ignore nulls) over w as eg,
    last_value(case when page or moved then x end ignore nulls) over w as ex, last_value(case when page or moved then y end ignore nulls) over w as ey from moves window w as (partition by key order by t rows unbounded preceding))
  select key, t, ex as x, ey as y from ev where not page and not moved and eg and t - et between 600 and 2000"""


def detections(s, d):
    rows = spans(s, d).where("t0 < t1")
    place = F.array_position(F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), F.col("kind"))
    return rows.select("key", "id", "t0", "t1", F.col("kind").alias("sub"), place.cast("int").alias("rank"), (F.col("v") % 90).cast("int").alias("conf"))


def heard(s, d):
    """Every ninth word again, half a second later: as it was, without its last letter, or another word."""
    w = spoken.spoken(s, d).where("n % 9 = 4")
    text = F.when(F.col("n") % 27 == 4, F.col("text")).when(F.col("n") % 27 == 13, F.expr("left(text, length(text) - 1)")).otherwise("zzz")
    return w.select("key", F.col("n").alias("id"), text.alias("text"), (F.col("t0") + 500).alias("t0"), (F.col("t1") + 500).alias("t1"))


def flicker(s, d):
    """Events as changes of a screen's cells, some cells of which change nearly always."""
    rows = spans(s, d).select((F.col("key") % 3).alias("key"), (F.col("id") % 12).alias("cell"), F.floor(F.col("t0") / 1_800_000_000).cast("long").alias("k"), "v")
    more = rows.where("cell < 3").withColumn("k", F.explode(F.sequence("k", F.col("k") + F.col("v") % 30)))
    return rows.select("key", "cell", "k").union(more.select("key", "cell", "k"))


FLICKER = """ch as (select distinct key, cell, k from (select key % 3 as key, id % 12 as cell, t0 // 1800000000 as k from spans union all select key % 3, id % 12, unnest(range(t0 // 1800000000, t0 // 1800000000 + v % 30 + 1)) from spans where id % 12 < 3))"""


ALL = {
    "animated_cells": (
        lambda s, d: mo.animated_cells(flicker(s, d), 0.02).withColumn("level", F.round("level", 9)),
        f"with {SPANS}, {FLICKER} select key, cell, k, round(level, 9) as level, level > 0.5 as masked from (select a.key, a.cell, a.k, sum(0.02 * 0.98 ** (a.k - b.k)) as level from ch a join ch b on b.key = a.key and b.cell = a.cell and b.k <= a.k group by all)",
    ),
    "cursor_rests": (lambda s, d: so.cursor_rests(cursor(s, d)), f"with {topics.SENTENCES}, {topics.SCOPE}, {SAMPLES}, {CURSOR}"),
    "merged_by_rank": (lambda s, d: so.merged_by_rank(detections(s, d), 6 * HOUR), None),
    "claimed_islands": (
        lambda s, d: so.claimed(side(s, d, True).where("t0 < t1").withColumn("need", (F.col("v") * 4_000_000).cast("long")), side(s, d, False).where("t0 < t1").withColumn("held", F.col("v") % 3 == 0), 6 * HOUR, 20_000_000, 60, 120_000_000),
        None,
    ),
    "heard_again": (lambda s, d: so.heard_again(heard(s, d), spoken.spoken(s, d)).select("key", "id", "again"), None),
    "page_shots": (lambda s, d: mo.page_shots(samples(s, d), STEP, 2, 20), f"with recursive {topics.SENTENCES}, {topics.SCOPE}, {SAMPLES}, {SHOTS}"),
    "box_tracks": (lambda s, d: mo.box_tracks(boxes(s, d)), None),
    "smoothed_paths": (lambda s, d: mo.smoothed_paths(points(s, d)).select("key", "t", F.round("x", 6).alias("x"), "moving"), None),
}
