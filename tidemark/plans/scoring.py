"""Queries that score spans and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scores
from tidemark.plans.inputs import HOUR, SERIES, SPANS, points, series, spans

ALL = {
    "weighted_percentile": (
        lambda s, d: scores.weighted_percentile(spans(s, d).select("key", (F.col("v") % 97).alias("v"), F.col("v").alias("w")), 90),
        f"with {SPANS} select key, min(v) as v from (select key, v, sum(w) over (partition by key order by v) as r, sum(w) over (partition by key) as t from (select key, v % 97 as v, sum(v) as w from spans group by all)) where 100 * r >= 90 * t group by key",
    ),
    "energy_score": (
        lambda s, d: scores.energy(series(s, d)),
        f"with {SERIES} select key, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.9) - quantile_cont(v, 0.5) as spread from series group by key",
    ),
    "dense_window": (
        lambda s, d: scores.densest(points(s, d), 24 * HOUR, 2 * HOUR),
        f"""with {SPANS}, w as (select distinct key, unnest(range(t // {2 * HOUR} - 12, t // {2 * HOUR} + 1)) * {2 * HOUR} as start from points)
        select key, start, n from (select w.key, w.start, count(*) as n from w join points p on p.key = w.key and p.t >= w.start and p.t < w.start + {24 * HOUR} group by all)
        qualify row_number() over (partition by key order by n desc, start) = 1""",
    ),
    "boundary_pauses": (
        lambda s, d: scores.pauses(points(s, d), 12 * HOUR),
        f"with {SPANS} select key, id, pause, least(pause, {12 * HOUR}) * 100 // {12 * HOUR} as strength from (select key, id, t - lag(t) over (partition by key order by t, id) as pause from points)",
    ),
}
