"""Queries over zooms, camera keys and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import camera as cm
from tidemark.plans import spoken, timeline, topics
from tidemark.plans.inputs import HOUR, SPANS, SPOKEN, side, spans

EASES = ("smooth", "out", "in", "back", "even")
S = lambda body, *more: f"with {', '.join([SPANS, *more])} {body}"


def boxes(s, d):
    e, i = spans(s, d), F.col("id")
    return e.select(
        "key", F.floor(F.col("t0") / (48 * HOUR)).cast("long").alias("t"), (i * 37 % 300).alias("x"), (i * 53 % 250).alias("y"), (i % 120 + 5).alias("w"), (i % 70 + 5).alias("h"),
        (F.col("v") % 160).alias("px"), (i % 5 == 0).alias("cursor"), (i % 7 == 0).alias("ignored"),
    )


def cuts(s, d, every):
    return spoken.spoken(s, d).where(F.col("n") % every == 0).select("key", F.col("t0").alias("t"))


def keys(s, d):
    i = F.col("id")
    rows = side(s, d, True).select("key", i.alias("n"), F.col("t0").alias("t"), (i % 5 / 4 + 0.75).alias("s"), (i % 7 / 7).alias("cx"), (i % 9 / 9).alias("cy"), F.element_at(F.array(*map(F.lit, EASES)), (i % 5 + 1).cast("int")).alias("ease"))
    return rows


KEYS = f"keys as (select key, id as n, t0 as t, id % 5 / 4 + 0.75::double as s, id % 7 / 7 as cx, id % 9 / 9 as cy, ({list(EASES)})[id % 5 + 1] as ease from sa)"


def crops(s, d):
    i, v = F.col("id"), F.col("v")
    on = lambda n, c: F.when(v % n == 0, c)
    return spans(s, d).select(
        "key", i.alias("n"), (i * 13 % 1500).alias("s0"), F.when(i % 11 != 0, F.concat(F.lit("m"), (i % 5).cast("string"))).alias("media"),
        on(3, i % 8 / 8).alias("face_x"), on(3, i % 16 / 16).alias("face_y"), on(3, i % 4 / 4).alias("face_h"), on(4, i % 10 / 10).alias("focus_x"), on(4, i % 6 / 6).alias("focus_y"),
    )


CROPS = """crops as (select key, id as n, id * 13 % 1500 as s0, case when id % 11 <> 0 then 'm' || (id % 5) end as media, case when v % 3 = 0 then id % 8 / 8 end as face_x, case when v % 3 = 0 then id % 16 / 16 end as face_y,
  case when v % 3 = 0 then id % 4 / 4 end as face_h, case when v % 4 = 0 then id % 10 / 10 end as focus_x, case when v % 4 = 0 then id % 6 / 6 end as focus_y from spans)"""
EASED = "case ease when 'smooth' then u * u * (3.0::double - 2.0::double * u) when 'out' then 1.0::double + (u - 1) * (u - 1) * (u - 1) when 'in' then u * u * u when 'back' then 1.0::double + 2.2::double * (u - 1) * (u - 1) * (u - 1) + 1.2::double * (u - 1) * (u - 1) else u end"
OFFSET = "((0.5::double - x.{0}) * x.s + ((0.5::double - b_{0}) * b_s - (0.5::double - x.{0}) * x.s) * e)"
MIDDLE = f"case when z >= 1 then least(greatest(0.5::double - {OFFSET} / z, 0.5::double / z), 1 - 0.5::double / z) else 0.5::double - {OFFSET} / z end"
MOVED = lambda c, moving: f"case when f.t is null then null when p.t <= f.t then f.{c} when b_t is null then x.{c} else {moving} end as {c}"

ALL = {
    "activity_weight": (
        lambda s, d: cm.activity_weight(boxes(s, d)),
        S("""select key, t, sqrt(coalesce(sum(px) filter (kept and not cursor), 0)) + 0.3::double * sqrt(coalesce(sum(px) filter (kept and cursor), 0)) as weight,
          min(x) filter (kept) as x0, min(y) filter (kept) as y0, max(x + w) filter (kept) as x1, max(y + h) filter (kept) as y1 from (
          select *, coalesce(counts and 100 * px >= 10 * max(px) filter (counts) over (partition by key, t) and not ignored, false) as kept from (select *, px >= 10 or cursor as counts from boxes)) group by key, t""",
          f"boxes as (select key, t0 // {48 * HOUR} as t, id * 37 % 300 as x, id * 53 % 250 as y, id % 120 + 5 as w, id % 70 + 5 as h, v % 160 as px, id % 5 = 0 as cursor, id % 7 = 0 as ignored from spans)"),
    ),
    "visible_cuts": (
        lambda s, d: cm.visible_cuts(timeline.clips(s, d).where("track = 1 or track = 2"), 6),
        f"""with {timeline.CLIPS} select distinct key, t0 as t from (select *, lag(t1) over w as e, lag(media) over w as m, lag(src_out) over w as o from clips where track in (1, 2) window w as (partition by key order by t0, id))
          where media <> m or abs(src_in - o) > 24 or t0 - e > 18""",
    ),
    "rhythm_zooms": (
        lambda s, d: cm.rhythm(topics.sentences(s, d), cuts(s, d, 4), cuts(s, d, 23), jump=False),
        f"""with {SPOKEN}, {topics.SENTENCES}, r as (select * from (select key, n, t0, t1, lag(t1) over w as p, coalesce(lead(t0) over w, t1 + 300) as nxt from sents window w as (partition by key order by n)) where n % 2 = 1),
          c as (select key, t0 as t from spoken where n % 4 = 0), h as (select key, t0 as t from spoken where n % 23 = 0),
          sn as (select r.*, coalesce((select t from c where c.key = r.key and t between t0 - 300 and t0 + 50 order by abs(t - t0), t limit 1), t0) as a, coalesce((select t from c where c.key = r.key and t between nxt - 300 and nxt + 50 order by abs(t - nxt), t limit 1), nxt) as b from r),
          z as (select key, n, case when a = t0 and t0 - p > 80 then t0 - 40 else a end as a, case when b = nxt and nxt - t1 > 80 then (t1 + nxt) // 2 else b end as b from sn),
          hz as (select z.*, (select min(t) from h where h.key = z.key and t > a + 500 and t < b) as hard from z)
          select key, n, a as t0, coalesce(hard, b) as t1, case when hard is not null then 'cut' else 'ease' end as ending from hz where coalesce(hard, b) - a >= 800""",
    ),
    "camera_states": (
        lambda s, d: cm.camera_states(side(s, d, False).select("key", "id", F.col("t0").alias("t")), keys(s, d)),
        S(f"""select p.key, p.id, p.t, {MOVED("s", "z")}, {MOVED("cx", MIDDLE.format("cx"))}, {MOVED("cy", MIDDLE.format("cy"))} from points p left join first_key f on f.key = p.key left join x on x.key = p.key and x.id = p.id""",
          KEYS, "first_key as (select * from keys qualify row_number() over (partition by key order by t, n) = 1)",
          "pairs as (select *, lead(t) over w as b_t, lead(s) over w as b_s, lead(cx) over w as b_cx, lead(cy) over w as b_cy, lead(ease) over w as b_ease, case when lead(t) over w = t then false else true end as last from keys window w as (partition by key order by t, n))",
          f"""x as (select *, s + (b_s - s) * e as z from (select *, {EASED} as e from (select p.id, q.key, q.s, q.cx, q.cy, q.b_t, q.b_s, q.b_cx, q.b_cy, q.b_ease as ease, (p.t - q.t) / (q.b_t - q.t) as u
            from points p asof join (select * from pairs where last) q on q.key = p.key and p.t >= q.t)))"""),
    ),
    "crop_anchors": (
        lambda s, d: cm.anchors(crops(s, d), 200),
        S("""select key, n, case when fx is not null then fx when near then (o).x else 0.5::double end as x, case when fx is not null then fy when near then (o).y else 0.5::double end as y, case when fx is not null then src when near then 'hold' else 'center' end as anchor from (
          select *, media is not null and coalesce(abs(s0 - (o).s0) < 200, false) as near from (select *, last_value(f ignore nulls) over (partition by key, media order by n rows between unbounded preceding and 1 preceding) as o from (
          select *, case when fx is not null then {'s0': s0, 'x': fx, 'y': fy} end as f from (select *, case when media is null then null when face_x is not null then face_x else focus_x end as fx,
          case when media is null then null when face_x is not null then least(1, face_y + 0.25::double * face_h) else focus_y end as fy, case when face_x is not null then 'face' else 'activity' end as src from crops))))""", CROPS),
    ),
    "shot_stats": (
        lambda s, d: cm.shot_stats(spans(s, d).withColumnRenamed("id", "n"), "kind", 24 * HOUR),
        S(f"""select key, kind, count(*) as n, cast(sum(t1 - t0) as bigint) as time, count(*) filter (again) as repeats from (
          select *, coalesce(lag(kind) over w = kind and abs(lag(t1) over w - t0) < {24 * HOUR}, false) as again from spans window w as (partition by key order by t0, t1, id)) group by key, kind"""),
    ),
}
