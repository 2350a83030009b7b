"""Queries over clips: an order is a sequence, its lines are clips of parts' recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clips as cl
from tidemark.operators import intervals as iv
from tidemark.plans.inputs import SPANS, merged, minus, side, spans, table

#: Fixed presets and limits of the settings query.
PRESETS = (("natural", 600, 150), ("fast", 300, 60), ("tight", 150, 20))
LIMITS = {"pause": (100, 2000), "pad": (0, 500)}
DAY = 86_400_000_000


def clips(s, d):
    line = table(s, d, "lineitem")
    start = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 3_600_000_000).cast("long")
    rows = line.select(
        F.col("l_orderkey").alias("key"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("id"), F.col("l_returnflag").alias("kind"),
        F.col("l_linenumber").cast("long").alias("track"), F.concat(F.lit("m"), (F.col("l_partkey") % 2000).cast("string"), F.element_at(F.array(*map(F.lit, (".wav", ".png", ".mp4"))), (F.col("l_suppkey") % 3 + 1).cast("int"))).alias("media"),
        start.alias("t0"), (start + F.col("l_quantity").cast("long") * 24).alias("t1"), (F.col("l_partkey") * 7 % 900).alias("src_in"), (F.col("l_linenumber") == 3).alias("muted"),
        (F.col("l_suppkey") % 7 == 0).alias("disabled"), (F.col("l_linestatus") == "F").alias("selected"), (F.col("l_suppkey") % 3).alias("speed"),
    )
    return rows.withColumn("src_out", F.col("src_in") + (F.col("t1") - F.col("t0")) * F.greatest("speed", F.lit(1)))


CLIPS = """clips as (select *, src_in + (t1 - t0) * greatest(speed, 1) as src_out from (
  select l_orderkey as key, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as id, l_returnflag as kind, cast(l_linenumber as bigint) as track,
    'm' || cast(l_partkey % 2000 as varchar) || (['.wav', '.png', '.mp4'])[l_suppkey % 3 + 1] as media, epoch_us(l_shipdate) // 3600000000 as t0,
    epoch_us(l_shipdate) // 3600000000 + cast(l_quantity as bigint) * 24 as t1, l_partkey * 7 % 900 as src_in, l_linenumber = 3 as muted,
    l_suppkey % 7 = 0 as disabled, l_linestatus = 'F' as selected, l_suppkey % 3 as speed from lineitem))"""


def words(s, d):
    """Words in source time: an event is a word of one of the recordings."""
    e = table(s, d, "events")
    at = (F.col("event_id") * 13 % 1500).alias("s0")
    media = F.concat(F.lit("m"), (F.col("event_id") * 11 % 2000).cast("string"), F.lit(".wav"))
    return e.select(media.alias("media"), F.col("event_id").alias("idx"), at, (at + F.col("event_id") % 17).alias("s1"))


WORDS = "heard as (select 'm' || cast(event_id * 11 % 2000 as varchar) || '.wav' as media, event_id as idx, event_id * 13 % 1500 as s0, event_id * 13 % 1500 + event_id % 17 as s1 from events)"
SEQ = "(t0 + (greatest({0}, src_in) - src_in) // greatest(speed, 1))"
PAIRS = """pairs as (select c.key, w.media, w.idx, c.id as clip, c.track, c.t0 as c_t0, c.t0 + (greatest(w.s0, c.src_in) - c.src_in) // greatest(c.speed, 1) as t0,
  c.t0 + (least(w.s1, c.src_out) - c.src_in) // greatest(c.speed, 1) as e, w.s0, w.s1, c.src_in, c.src_out, c.speed
  from heard w join clips c on c.media = w.media and 2 * c.src_in <= w.s0 + w.s1 and w.s0 + w.s1 < 2 * c.src_out)"""


def sequences(s, d):
    o = table(s, d, "orders")
    pick = lambda n, c: F.when(F.col("o_custkey") % n != 0, c)
    scope = F.when(F.col("o_orderstatus") == "O", "inout").when(F.col("o_orderstatus") == "F", "selected").otherwise("all")
    return o.select(F.col("o_orderkey").alias("key"), scope.alias("scope"), pick(3, F.col("o_custkey") * 5 - 300).alias("in_point"), pick(5, F.col("o_custkey") * 11).alias("out_point"), F.lit(9000).cast("long").alias("duration"))


SEQUENCES = """sequences as (select o_orderkey as key, case o_orderstatus when 'O' then 'inout' when 'F' then 'selected' else 'all' end as scope,
  case when o_custkey % 3 <> 0 then o_custkey * 5 - 300 end as in_point, case when o_custkey % 5 <> 0 then o_custkey * 11 end as out_point, 9000 as duration from orders)"""


def scope_of(s, d):
    """Two ranges of every sequence, around its clips."""
    c = clips(s, d).groupBy("key").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    return c.select("key", F.explode(F.array(F.struct(F.col("a").alias("t0"), (F.col("a") + 400).alias("t1")), F.struct((F.col("a") + 600).alias("t0"), F.col("b").alias("t1")))).alias("r")).select("key", "r.t0", "r.t1")


def switches(s, d):
    return spans(s, d).select("key", "t0", "t1", F.col("kind").alias("camera"), (F.col("v") % 3 != 0).alias("on"))


def layers(s, d):
    c = clips(s, d).withColumn("first", F.min("t0").over(cl.Window.partitionBy("key")))
    return c.select("key", "media", (F.col("t0") - F.col("first")).alias("t0"), (F.col("t0") - F.col("first") + F.col("id") % 7 * 10).alias("t1"), "src_in", F.greatest("speed", F.lit(1)).alias("speed"))


def envelopes(s, d):
    return words(s, d).groupBy("media", (F.col("s0")).alias("i")).agg(F.max("s1").alias("v"))


def lengths(s, d):
    return clips(s, d).select("key").distinct().select("key", F.lit(60).cast("long").alias("n"))


S = lambda body, *more: f"with {', '.join([SPANS, CLIPS, WORDS, *more])} {body}"
ORDER = "row_number() over (partition by key order by track, t0, id) - 1"

ALL = {
    "clip_filter": (
        lambda s, d: cl.filtered(clips(s, d), "A", [1, 2, 3, 4], muted=False).select("key", "id", "track", "t0", "place"),
        S(f"select key, id, track, t0, {ORDER} as place from clips where kind = 'A' and track in (1, 2, 3, 4) and not muted and not disabled"),
    ),
    "audible_clips": (lambda s, d: cl.audible(clips(s, d)).select("key", "id", "media"), S("select key, id, media from clips where not muted and not disabled and media not like '%.png'")),
    "distinct_media": (
        lambda s, d: cl.distinct_media(clips(s, d)),
        S("select key, row_number() over (partition by key order by f) - 1 as place, media from (select key, media, min(struct_pack(track := track, t0 := t0, id := id)) as f from clips group by key, media)"),
    ),
    "scope_ranges": (
        lambda s, d: cl.scope_ranges(sequences(s, d), clips(s, d)),
        S(
            f"""select key, a as t0, case when out_point > a then least(out_point, duration) else duration end as t1 from (select *, greatest(coalesce(in_point, 0), 0) as a from sequences) where scope = 'inout' and coalesce(in_point, out_point) is not null
            union all select s.key, coalesce(p.t0, 0), coalesce(p.t1, s.duration) from sequences s left join {merged('picked')} p on p.key = s.key and s.scope = 'selected' where not (s.scope = 'inout' and coalesce(in_point, out_point) is not null)""",
            SEQUENCES, "picked as (select key, t0, t1 from clips where selected)",
        ),
    ),
    "words_on_timeline": (
        lambda s, d: cl.words_on_timeline(words(s, d), cl.audible(clips(s, d)), 1),
        S(
            """select key, media, idx, clip, t0, greatest(e, t0 + 1) as t1, row_number() over (partition by key, clip order by idx desc, t0 desc) = 1 as clip_end from (
              select * from pairs qualify row_number() over (partition by key, media, idx, t0 order by track, c_t0, clip) = 1)""",
            PAIRS.replace("join clips c", "join (select * from clips where not muted and not disabled and media not like '%.png') c"),
        ),
    ),
    "detections_on_timeline": (
        lambda s, d: cl.detections_on_timeline(words(s, d).withColumns({"c0": F.col("s0") - 3, "c1": F.col("s1") + 2}), clips(s, d), scope_of(s, d), 2),
        S(
            """select key, media, idx, t0, min(t1) as t1 from (select q.key, media, idx, greatest(u0, s.t0) as t0, least(u1, s.t1) as t1 from (
              select key, media, idx, c_t0 + (greatest(s0 - 3, src_in) - src_in) // greatest(speed, 1) as u0, c_t0 + (least(s1 + 2, src_out) - src_in) // greatest(speed, 1) as u1, (t0 + e) // 2 as m
              from pairs where least(s1 + 2, src_out) - greatest(s0 - 3, src_in) >= 2) q join scopes s on s.key = q.key and s.t0 <= q.m and q.m < s.t1) where t1 - t0 >= 2 group by key, media, idx, t0""",
            PAIRS, "ends as (select key, min(t0) as a, max(t1) as b from clips group by key)", "scopes as (select key, a as t0, a + 400 as t1 from ends union all select key, a + 600, b from ends where a + 600 < b)",
        ),
    ),
    "frame_overlay": (
        lambda s, d: cl.overlay(layers(s, d), envelopes(s, d), lengths(s, d), -90),
        S(
            """select g.key, g.i, coalesce(max(e.v), -90) as v from (select distinct key, unnest(range(60)) as i from layers) g
            left join (select key, media, t0, src_in, speed, unnest(range(t0, t1)) as i from layers where t0 < t1) f on f.key = g.key and f.i = g.i
            left join (select media, s0 as i, max(s1) as v from heard group by 1, 2) e on e.media = f.media and e.i = f.src_in + (f.i - f.t0) * f.speed group by g.key, g.i""",
            "layers as (select key, media, t0 - f as t0, t0 - f + id % 7 * 10 as t1, src_in, greatest(speed, 1) as speed from (select *, min(t0) over (partition by key) as f from clips))",
        ),
    ),
    "contained_clips": (
        lambda s, d: cl.contained(side(s, d, True), side(s, d, False), 1000),
        S("select a.key, a.id, b.id as span from sa a join sb b on a.key = b.key and a.t0 < b.t1 and b.t0 < a.t1 and a.t0 >= b.t0 - 1000 and a.t1 <= b.t1 + 1000"),
    ),
    "main_track": (
        lambda s, d: cl.main_track(clips(s, d)),
        S("select key, track, cast(time as bigint) as time from (select key, track, sum(t1 - t0) as time from clips where not disabled group by 1, 2) qualify row_number() over (partition by key order by time desc, track) = 1"),
    ),
    "voice_track": (
        lambda s, d: cl.voice_track(cl.words_of_tracks(words(s, d), clips(s, d)), clips(s, d)),
        S(
            """select key, track, case when track = voice then 'voice' when s = max(case when track = voice then s end) over (partition by key) then 'twin' else 'music' end as role from (
              select key, track, string_agg(concat_ws('|', media, t0, t1, src_in), ',' order by concat_ws('|', media, t0, t1, src_in)) as s from clips group by 1, 2) left join (
              select key, track as voice from (select key, track, count(*) as n from (select * from pairs qualify row_number() over (partition by key, media, idx, t0 order by track, c_t0, clip) = 1) group by 1, 2)
              qualify row_number() over (partition by key order by n desc, track) = 1) using (key)""",
            PAIRS,
        ),
    ),
    "hard_cuts": (
        lambda s, d: cl.hard_cuts(clips(s, d).where("track = 1 or track = 2"), 6, 30),
        S("""select distinct key, unnest(list_filter([case when e is null and t0 > 12 then t0 end, case when t0 - e > 18 then e end,
              case when t0 - e > 18 or media <> m or src_in < o - 24 or src_in - o > 30 then t0 end, case when nxt is null then t1 end], lambda x: x is not null)) as t from (
              select *, lag(t1) over w as e, lag(media) over w as m, lag(src_out) over w as o, lead(t0) over w as nxt from clips where track in (1, 2) window w as (partition by key order by t0, id))"""),
    ),
    "cameras": (
        lambda s, d: cl.cameras(switches(s, d)),
        S("""select key, min(t0) as t0, max(t1) as t1, any_value(c) as camera from (select *, sum(n) over (partition by key order by t0, t1) as g from (
              select *, case when coalesce(lag(c) over (partition by key order by t0, t1) <> c, true) then 1 else 0 end as n from (
              select key, t0, t1, last_value(case when r = 1 or v % 3 <> 0 then kind end ignore nulls) over (partition by key order by t0, t1 rows unbounded preceding) as c from (
              select *, row_number() over (partition by key order by t0, t1) as r from spans)))) group by key, g"""),
    ),
    "settings_merge": (
        lambda s, d: cl.settings(
            table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.element_at(F.array(*(F.lit(p[0]) for p in PRESETS)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("preset"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") * 3).alias("pause"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_custkey") - 40).alias("pad")),
            s.createDataFrame(list(PRESETS), "preset string, pause long, pad long"), LIMITS,
        ),
        "with p(preset, pp, pd) as (values " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in PRESETS) + "), o as (select o_orderkey as key, (['natural', 'fast', 'tight'])[o_custkey % 3 + 1] as preset, case when o_orderkey % 4 = 0 then o_custkey * 3 end as a, case when o_orderkey % 6 = 0 then o_custkey - 40 end as b from orders) "
        "select key, preset, least(greatest(coalesce(a, pp), 100), 2000) as pause, least(greatest(coalesce(b, pd), 0), 500) as pad, least(greatest(coalesce(a, pp), 100), 2000) <> pp or least(greatest(coalesce(b, pd), 0), 500) <> pd as custom from o join p using (preset)",
    ),
    "sequence_source_map": (
        lambda s, d: clips(s, d).select("key", "id", cl.to_source(F.col("t0") + 5).alias("src"), cl.to_sequence(F.col("src_in") + 9, "").alias("seq")),
        S("select key, id, src_in + 5 * greatest(speed, 1) as src, t0 + 9 // greatest(speed, 1) as seq from clips"),
    ),
    "overlap_length": (
        lambda s, d: iv.overlap_length(side(s, d, True), side(s, d, False)),
        S(f"select k.key, cast(coalesce(sum(case when b.t0 is not null then least(a.t1, b.t1) - greatest(a.t0, b.t0) end), 0) as bigint) as covered from (select distinct key from spans where t0 < t1) k left join {merged('sa')} a on a.key = k.key left join {merged('sb')} b on b.key = k.key and a.t0 < b.t1 and b.t0 < a.t1 group by k.key"),
    ),
    "snap_edges": (
        lambda s, d: iv.snap_edges(spans(s, d), lambda t: F.floor(t / DAY).cast("long") * DAY),
        S(f"select * from {merged('f')}", f"f as (select distinct key, t0 // {DAY} * {DAY} as t0, t1 // {DAY} * {DAY} as t1 from spans where t0 < t1)"),
    ),
    "kept_and_removed": (
        lambda s, d: iv.kept_and_removed(side(s, d, True), side(s, d, False)),
        S(f"select a.key, greatest(a.t0, b.t0) as t0, least(a.t1, b.t1) as t1, true as kept from ia a join ib b on a.key = b.key and a.t0 < b.t1 and b.t0 < a.t1 union all select *, false from {minus('ib', 'ia')}", f"ia as {merged('sa')}", f"ib as {merged('sb')}"),
    ),
    "ripple_items": (
        lambda s, d: iv.split_items(side(s, d, False).select("key", "id", "t0", "t1", F.col("v").alias("src_in")), side(s, d, True)),
        S(
            """select key, id, row_number() over (partition by key, id order by a) - 1 as part, a - gone as t0, b - gone as t1, v + a - o as src_in, v + b - o as src_out from (
            select p.key, p.id, p.v, p.o, p.t0 as a, p.t1 as b, cast(coalesce((select sum(least(c.t1, p.t0) - c.t0) from ia c where c.key = p.key and c.t0 < p.t0), 0) as bigint) as gone from (
              select i.key, i.id, i.v, i.t0 as o, unnest(list_filter(list_zip(list_prepend(i.t0, list_sort(coalesce(h.e, []))), list_append(list_sort(coalesce(h.s, [])), i.t1)), lambda x: greatest(x[1], i.t0) < least(x[2], i.t1))) as x, greatest(x[1], i.t0) as t0, least(x[2], i.t1) as t1
              from sb i left join (select i.id, list(c.t0) as s, list(c.t1) as e from sb i join ia c on c.key = i.key and c.t0 < i.t1 and i.t0 < c.t1 group by i.id) h on h.id = i.id where i.t0 < i.t1) p)""",
            f"ia as {merged('sa')}",
        ),
    ),
}
