"""Queries over speakers' files, shots and habit words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import talks as ta
from tidemark.plans import cuts, signals, spoken
from tidemark.plans.inputs import table

HABITS = ta.Habits(
    searches=(("what", "is"), ("is", "it")), openers={"so": "so", "the": "the", "and": "and"}, closers={"page": "page", "then": "then", "now": "now"},
    opening_pairs=frozenset([("so", "the")]), closing_pairs=frozenset([("then", "then")]), never_after=frozenset(["close"]),
)


def supplied(s, d):
    """Nations as recordings, their suppliers as speakers on tracks, and the files that customers of the same number put there."""
    mics = table(s, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("speaker"), (F.col("s_suppkey") % 5).alias("track"))
    clips = table(s, d, "customer").select(F.col("c_nationkey").alias("key"), (F.col("c_custkey") % 5).alias("track"), (F.col("c_custkey") % 7).alias("media"))
    media = table(s, d, "customer").select((F.col("c_custkey") % 7).alias("media")).distinct().where("media <> 6").select("media", (F.col("media") % 4).alias("streams"), (F.col("media") % 3 * 2).alias("channels"))
    return ta.source_splits(mics, clips, media)


SPLITS = """with users as (select s_nationkey as key, s_suppkey as speaker, media, min(s_suppkey % 5) as track from supplier join (select distinct c_nationkey as k, c_custkey % 5 as t, c_custkey % 7 as media from customer) on k = s_nationkey and t = s_suppkey % 5 group by all),
  r as (select *, count(*) over (partition by key, media) as n, row_number() over (partition by key, media order by track, speaker) - 1 as part from users),
  m as (select key, media, speaker, part, case when media <> 6 and media % 4 >= n then 'stream' when media <> 6 and media % 3 * 2 >= n then 'channel' else 'shared' end as mode from r where n > 1)
  select key, media, speaker, mode, case when mode <> 'shared' then part end as part from m"""


def pieces(s, d):
    """Every recording in pieces of 37 frames, each with a camera and a reason."""
    rows = signals.owners(s, d).groupBy("key").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    rows = rows.select("key", F.explode(F.sequence("a", "b", F.lit(37).cast("long"))).alias("t0"))
    k = (F.col("t0") % 12).cast("int")
    camera = F.element_at(F.array(*map(F.lit, ("click", "view", "wide"))), k % 3 + 1)
    why = F.element_at(F.array(*map(F.lit, ("speech", "crosstalk", "silence", "reaction"))), k % 4 + 1)
    return rows.select("key", "t0", (F.col("t0") + 37).alias("t1"), camera.alias("camera"), why.alias("why"))


def frames_of(s, d):
    """Every known frame as a run of its own, since frames are missing between them."""
    return signals.owners(s, d).select("key", F.col("owner").alias("label"), F.col("i").alias("i0"), (F.col("i") + 1).alias("i1"))


EVIDENCE = """pc as (select key, t0, t0 + 37 as t1, (['click', 'view', 'wide'])[t0 % 12 % 3 + 1] as camera, (['speech', 'crosstalk', 'silence', 'reaction'])[t0 % 12 % 4 + 1] as why from (select key, unnest(range(min(i), max(i) + 1, 37)) as t0 from own group by key)),
  sm as (select pc.*, count(i) as al, count(i) filter (owner = camera) as o, count(i) filter (owner not in ('silent', 'unknown')) as tk, count(i) filter (owner = 'cross') as cr, count(i) filter (owner = 'silent') as si from pc left join own on own.key = pc.key and own.i >= t0 and own.i < t1 group by all)"""

ALL = {
    "source_splits": (supplied, SPLITS),
    "shot_evidence": (
        lambda s, d: ta.shot_evidence(pieces(s, d), frames_of(s, d)),
        signals.Q("""select key, t0, t1, camera, why, kind, cast(case when kind = 'speaker' and tk > 0 then (2000 * o + tk) // (2 * tk) when kind = 'wide' and why = 'crosstalk' and al > 0 then (2000 * cr + al) // (2 * al) when kind = 'wide' and why = 'silence' and al > 0 then (2000 * si + al) // (2 * al) end as int) as conf
          from (select *, case when camera = 'wide' then 'wide' when why in ('reaction', 'aside') then 'react' else 'speaker' end as kind from sm)""", signals.MICS, EVIDENCE),
    ),
    "habit_words": (lambda s, d: ta.habit_words(cuts.rehearsed(s, d), HABITS, frozenset(["so", "the", "and", "page", "then", "now", "what is", "is it"])), None),
    "shot_words": (lambda s, d: ta.first_words(spoken.spoken(s, d).groupBy("key", F.floor(F.col("n") / 40)).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).select("key", "t0", "t1"), spoken.spoken(s, d)),
        f"with {spoken.SPOKEN} select key, min(t0) as t0, max(t1) as t1, substr(string_agg(case when n % 40 < 10 then text end, ' ' order by n), 1, 80) as text from spoken group by key, n // 40"),
}
