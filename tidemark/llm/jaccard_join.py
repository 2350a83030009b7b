"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, windows, recursion.

Jaccard distance d = 1 - J is a metric.  Two documents link when J reaches the threshold (0.75), that is
when d is at most the radius (0.25).  Documents are reduced to their distinct sets of word 5-gram hashes;
equal sets have distance 0 and are one point.

Regions.  The outer pivots are the one-element sets {s}.  A point's distance to {s} is 1 - 1/n if it holds
s and 1 otherwise, so its nearest pivots are its own shingles, ties going to the first in a fixed order: a
point lies in the Voronoi region of its first shingle.  A point within the radius of another shares all but
a quarter of its n shingles, so the first shared one is among the first n - ceil(0.75 n) + 1 of each; the
boundary windows replicate a point into exactly these regions, and every linked pair meets in one of them.
A point that is i places from the pivot of a region shares n - i shingles at most with any point that it first
meets there, so the window also limits the partner's size; pairs outside either's limit are never formed.
The order puts shingles that are frequent in some task last, then goes by hash; any fixed order is exact,
this one keeps widely shared passages from making large regions.

Inside regions the pivots are documents.  The point nearest to a region's outer pivot is its pivot; every point is
measured exactly against the pivot it shares most regions with and joins its cell when they link.  Two
cells P and Q with radii r(P), r(Q) can hold a linked pair only if d(P, Q) <= r(P) + r(Q) + 0.25: cells
beyond that are never joined.  Of the others, pairs x in P and y in Q are measured only inside the window
d(P, Q) - d(x, P) - d(y, Q) <= 0.25, and none where P and Q are already in one component.  Regions recurse:
in each round the first cells of a region serve as pivots for all the others, then leave it, until every
region lies in one component or is used up.  Before any exact measurement sizes and a parity sketch give a
lower bound of the distance (the sketches' Hamming distance never exceeds the sets' symmetric difference).

The result are connected components, so pairs inside a cell are never listed.

Hashes are 64 bits; sets are identified by 64 bits.  Null and empty texts have an empty set and link with
nothing; texts with fewer words than a shingle have their whole sequence as one.  A null id never is a
component's id unless all its members' are null.  Rows that repeat an id keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import Scratch, mixed, window_hashes, word_hashes, written
from tidemark.llm.components import components

#: Shingles a task counts together; one that so many of their points hold is frequent there, and so many frequent ones at most are put last.
COUNTED, FREQUENT_LEAST, MAX_FREQUENT = 2_000_000, 2, 262_144
#: Region rows a task hands over at a time.
HANDED = 250_000
#: Longs of the short sketch that join conditions compare.
LONGS = 8
#: Cells of a region that serve as pivots in one round.
PIVOTS = 128
#: Up to so many points, the ones whose texts are needed are broadcast (as ids); more are joined by shuffling.
BROADCAST_IDS = 20_000
EPS = 1e-9


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word k-grams, A-Z lower-cased."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(tokens), min(k, len(tokens))))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def sketch(s: np.ndarray, bits: int | None = None) -> bytes:
    """Parity of the set's elements in a power of two of bits; by default from 2 to 4 an element, 64 at least."""
    bits = bits or max(64, 1 << int(2 * len(s) - 1).bit_length())
    place = (mixed(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the sets' symmetric difference; the longer sketch is folded to the shorter one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(5), text, F.length(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    k1, k2 = _text_hashes(text)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))


def profile(keyed: DataFrame, k: int) -> DataFrame:
    """One row per document (id, k1, k2, n, sid, sketch, short), and rows (h, c) of locally frequent shingles."""

    def frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, c = np.unique(np.concatenate(sets), return_counts=True)
        often = c >= FREQUENT_LEAST
        return h[often].view(np.int64), c[often]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["id", "k1", "k2", "n", "sid", "sketch", "short", "h", "c"], None
        seen, held, size = set(), [], 0
        for b in batches:
            kinds = [b.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            ns, ids, sketches, shorts = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                sid = set_id(s) if len(s) else None
                ns.append(len(s))
                ids.append(sid)
                sketches.append(sketch(s) if len(s) else None)
                shorts.append(np.frombuffer(sketch(s, 64 * LONGS), "<i8") if len(s) else None)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
                if size >= COUNTED:
                    yield from counted(held, kinds, names)
                    held, size = [], 0
            own = [b.column("id"), b.column("k1"), b.column("k2"), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()), pa.array(shorts, pa.list_(pa.int64()))]
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*own, none, none], names=names)
        if held:
            yield from counted(held, kinds, names)

    def counted(held, kinds, names) -> Iterator[pa.RecordBatch]:
        h, c = frequent(held)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(h), t) for t in kinds), pa.array(h), pa.array(c, pa.int64())], names=names)

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, k1 long, k2 long, n long, sid long, sketch binary, short array<long>, h long, c long")


def region_rows(keyed: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(h, sid, i, often): each point in the regions of its own and its window's pivots; a task lists a point once.

    ``i`` is the pivot's place in the point's order.  ``often`` marks the pivots in ``frequent``, a sorted array of at most MAX_FREQUENT hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hs, ids, often, at, size = [], [], [], [], 0
            for t in b.column(0):
                s = shingles(t.as_py(), k)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                last = np.zeros(len(s), bool)
                if len(frequent):
                    last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                s, last = np.concatenate([s[~last], s[last]]), np.sort(last)
                m = prefix_length(len(s), percent)
                hs.append(s[:m])
                often.append(last[:m])
                ids.append(np.full(m, sid, np.int64))
                at.append(np.arange(m, dtype=np.int32))
                size += m
                if size >= HANDED:
                    yield rows(hs, ids, at, often)
                    hs, ids, often, at, size = [], [], [], [], 0
            if hs:
                yield rows(hs, ids, at, often)

    def rows(hs, *others) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in others)], names=["h", "sid", "i", "often"])

    return keyed.select("text").mapInArrow(run, "h long, sid long, i int, often boolean")


def region_members(spread: DataFrame, keep: Scratch) -> DataFrame:
    """(h, sid, i, pivot) of regions with several points; the pivot is the point with the smallest i.

    Regions of frequent pivots can be large: their own pivots are found by partial aggregation and, being
    MAX_FREQUENT rows at most, broadcast; all other regions are read in the order of their pivots' hashes.
    """
    large = keep.written(spread.where("often").select("h", "sid", "i"), "large")
    first = large.groupBy("h").agg(F.min(F.struct("i", "sid")).alias("_one"), F.min("sid").alias("_lo"), F.max("sid").alias("_hi"))
    first = first.where("_lo != _hi").select("h", F.col("_one.sid").alias("pivot"))
    inside = Window.partitionBy("h").orderBy("i", "sid")
    near = {"pivot": F.first("sid").over(inside), "_before": F.lag("sid").over(inside), "_after": F.lead("sid").over(inside)}
    small = spread.where("not often").select("h", "sid", "i").withColumns(near).where("_before != sid or _after != sid")
    return keep.written(large.join(F.broadcast(first), "h").unionByName(small.select("h", "sid", "i", "pivot")), "members")


def point_texts(keyed: DataFrame, inside: DataFrame, keep: Scratch) -> DataFrame:
    """(sid, z): one text, compressed, of every point in ``inside`` (sid, k1, k2)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress((t.as_py() or "").encode()) for t in b.column(2)], pa.binary())], names=["k1", "k2", "z"])

    packed = keyed.select("k1", "k2", "text").mapInArrow(pack, "k1 long, k2 long, z binary")
    return keep.written(packed.join(inside, ["k1", "k2"]).select("sid", "z").dropDuplicates(["sid"]), "texts")


def measured(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Exact sizes of the sets and of the intersection for written pairs (a, b): (a, b, na, nb, both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for ta, tb in zip(b.column("ta"), b.column("tb")):
                x, t = shingles(open_.decompress(ta.as_py()).decode(), k), tb.as_py()
                if t != last_text:
                    last_text, last_set = t, shingles(open_.decompress(t).decode(), k)
                rows.append((len(x), len(last_set), len(np.intersect1d(x, last_set, assume_unique=True))))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(c, pa.int64()) for c in columns)], names=["a", "b", "na", "nb", "both"])

    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    if needed.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(needed), "sid", "left_semi")
    side = lambda name: texts.select(F.col("sid").alias(name), F.col("z").alias(f"t{name}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long, na long, nb long, both long")


def distance() -> Column:
    return 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))


def linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def can_reach(na: Column, nb: Column, reach: Column, apart: Column | None = None) -> Column:
    """Whether sizes (and a lower bound of the symmetric difference) leave a distance of at most ``reach`` possible."""
    apart = F.abs(na - nb) if apart is None else apart
    return 2 * apart <= (reach + EPS) * (na + nb + apart)


def short_distance(a: str, b: str) -> Column:
    """A lower bound of the sets' symmetric difference from their short sketches in the columns ``a`` and ``b``."""
    out = F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0]))
    for j in range(1, LONGS):
        out = out + F.bit_count(F.col(a)[j].bitwiseXOR(F.col(b)[j]))
    return out


def near_enough(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of pairs (a, b, reach) the ones whose sizes and sketches leave a distance of at most ``reach`` possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb", "reach")]
            keep = []
            for na, nb, sa, sb, reach in zip(*cols):
                apart = sketch_distance(sa, sb)
                keep.append(2 * apart <= (reach + EPS) * (na + nb + apart))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: points.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(can_reach(F.col("na"), F.col("nb"), F.col("reach")))
    return rows.select("a", "b", "na", "nb", "sa", "sb", "reach").mapInArrow(run, "a long, b long")


def most_frequent(found: DataFrame) -> np.ndarray:
    """The sorted hashes with the highest counts in ``found`` (h, c): as many whole counts as MAX_FREQUENT holds."""
    level = F.least("c", F.lit(10_000)).cast("long")
    total, least = 0, None
    for r in found.groupBy(level.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect():  # 10,000 rows at most
        total += r.n
        if total > MAX_FREQUENT:
            break
        least = r.c
    rows = found.where(level >= least).select("h").toPandas()["h"] if least is not None else []
    return np.sort(np.array(rows, np.int64).view(np.uint64))


def point_components(keyed: DataFrame, rows: DataFrame, k: int, percent: int, keep: Scratch) -> DataFrame:
    """(node, root) of all points that link with another."""
    radius = 1 - percent / 100
    frequent = most_frequent(keep.written(rows.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("c").alias("c")), "frequent"))

    one = F.min(F.struct("k1", "k2", "n", "sketch", "short")).alias("one")
    points = keep.written(rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(one).select("sid", "one.*"), "points")
    members = region_members(region_rows(keyed, k, percent, frequent), keep)

    inside = members.select("sid").distinct().join(points.select("sid", "k1", "k2"), "sid")
    texts = point_texts(keyed, keep.written(inside, "inside"), keep)

    # every point against the pivot it shares most regions with
    shared = members.where("sid != pivot").groupBy("sid", "pivot").agg(F.count(F.lit(1)).alias("c"))
    first = shared.groupBy("sid").agg(F.max(F.struct("c", "pivot")).alias("m"))
    first = first.select(F.col("sid").alias("a"), F.col("m.pivot").alias("b"), F.lit(radius).alias("reach"))
    met = keep.written(measured(keep.written(near_enough(first, points), "first"), texts, k), "first-measured")
    done, hit = met.select("a", "b"), met.where(linked(percent))
    links = [hit.select("a", "b")]
    pivots = hit.select(F.col("b").alias("_pivot")).distinct()
    joined = hit.join(pivots, F.col("a") == F.col("_pivot"), "left_anti").select("a", F.col("b").alias("cell"), distance().alias("d"))
    cells = points.select("sid", "n", "short").join(joined, F.col("sid") == F.col("a"), "left")
    cells = keep.written(cells.select("sid", "n", "short", F.coalesce("cell", "sid").alias("cell"), F.coalesce("d", F.lit(0.0)).alias("d")), "cells")
    radii = cells.groupBy("cell").agg(F.max("d").alias("r"), F.max(F.when(F.col("sid") == F.col("cell"), F.col("n"))).alias("n"))
    radii = keep.written(radii, "radii")

    # (h, cell, lo, hi): the cell's smallest member in the region, and the largest partner of any member there
    share = F.lit(100 + percent) * (F.col("n") - F.col("i"))
    largest = F.floor(share / percent + EPS).cast("long") - F.col("n")
    active = members.select("h", "sid", "i").join(cells.select("sid", "cell", "n"), "sid")
    active = active.groupBy("h", "cell").agg(F.min("n").alias("lo"), F.max(largest).alias("hi"))
    active, roots = keep.written(active, "active"), None
    while True:
        active = unresolved(active, roots, keep)
        ranked = active.join(radii, "cell").withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("cell")))
        ranked = keep.written(ranked, "ranked")
        lead = ranked.where(F.col("rank") <= PIVOTS).select(
            "h", F.col("cell").alias("b"), *(F.col(c).alias(f"_{c}") for c in ("rank", "root", "n", "r", "lo", "hi"))
        )
        reach = F.col("r") + F.col("_r") + radius
        pairs = ranked.join(lead, "h").where("rank > _rank and root != _root and lo <= _hi and _lo <= hi").where(can_reach(F.col("n"), F.col("_n"), reach))
        pairs = ordered(pairs.select(F.col("cell").alias("a"), "b", reach.alias("reach"))).distinct()
        near = keep.written(near_enough(pairs.join(ordered(done), ["a", "b"], "left_anti"), points), "near")
        new = keep.written(measured(near, texts, k), "cells-measured")
        links.append(new.where(linked(percent)).select("a", "b"))
        done = done.unionByName(new.select("a", "b"))

        # pairs of cells whose windows meet, measured now or in the first step: their members inside the window
        r = lambda x: radii.select(F.col("cell").alias(x), F.col("r").alias(f"r{x}"))
        close = (new if roots is not None else new.unionByName(met)).where(~linked(percent)).withColumn("d", distance()).join(r("a"), "a").join(r("b"), "b")
        close = keep.written(close.where(F.col("ra") + F.col("rb") > 0).where(F.col("d") <= F.col("ra") + F.col("rb") + radius + EPS), "close")
        if not close.isEmpty():
            roots = components(_all(links))
            own = lambda x, c: cells.select(F.col("sid").alias(x), F.col("cell").alias(c), *(F.col(k).alias(f"{k}{x}") for k in ("d", "n", "short")))
            pivot = points.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("short").alias("shortb"))
            window = apart(close.drop("nb"), "a", "b", roots).join(pivot, "b").join(own("x", "a"), "a")
            window = window.where(F.col("dx") >= F.col("d") - F.col("rb") - radius - EPS)
            window = window.where(can_reach(F.col("nx"), F.col("nb"), F.col("rb") + radius, short_distance("shortx", "shortb")))
            window = window.join(own("y", "b"), "b").where(F.col("dy") >= F.col("d") - F.col("dx") - radius - EPS)
            window = window.where(can_reach(F.col("nx"), F.col("ny"), F.lit(radius), short_distance("shortx", "shorty"))).where("x != a or y != b")
            window = ordered(window.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct().withColumn("reach", F.lit(radius))
            inner = keep.written(measured(keep.written(near_enough(window, points), "window"), texts, k), "window-measured")
            links.append(inner.where(linked(percent)).select("a", "b"))
        active = ranked.where(F.col("rank") > PIVOTS).select("h", "cell", "lo", "hi")
        if active.isEmpty():
            return components(_all(links))
        roots = components(_all(links))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def rooted(rows: DataFrame, column: str, roots: DataFrame, out: str) -> DataFrame:
    """``rows`` with the component of the point in ``column``; points without links are their own."""
    names = roots.select(F.col("node").alias("_node"), F.col("root").alias(out))
    return rows.join(names, F.col(column) == F.col("_node"), "left").drop("_node").withColumn(out, F.coalesce(out, column))


def apart(pairs: DataFrame, a: str, b: str, roots: DataFrame) -> DataFrame:
    """Pairs whose points are in different components."""
    both = rooted(rooted(pairs, a, roots, "_ra"), b, roots, "_rb")
    return both.where("_ra != _rb").drop("_ra", "_rb")


def unresolved(active: DataFrame, roots: DataFrame | None, keep: Scratch) -> DataFrame:
    """(h, cell, lo, hi, root) of regions where several components may meet; without ``roots`` a cell is its own."""
    rows = active.withColumn("root", F.col("cell")) if roots is None else keep.written(rooted(active, "cell", roots, "root"), "rooted")
    several = F.min("root") != F.max("root")
    open_ = rows.groupBy("h").agg(several.alias("_open"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_open")
    open_ = keep.written(open_.select("h", "_lo", "_hi"), "open")
    # a cell that is too large for all the others' limits, or whose limit is below all the others, meets nobody here
    return rows.join(open_, "h").where("lo <= _hi and _lo <= hi").drop("_lo", "_hi")


def _own_roots(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per document: id, k1, k2, n, root (of its component; null without words)."""
    keyed = _keyed(docs, id_col, text_col)
    rows = written(profile(keyed, k), "op5-profile")
    with Scratch(docs.sparkSession, "op5") as keep:
        roots = point_components(keyed, rows, k, percent, keep)
    own = rows.where(F.col("n").isNotNull()).select("id", "k1", "k2", "n", "sid")
    return written(rooted(own, "sid", roots, "root"), "op5-own")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    own = _own_roots(docs, id_col, text_col, k, percent)
    lowest = written(own.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("low")), "op5-lowest")
    named = own.where(F.col("root").isNotNull()).join(lowest, "root").select("id", "n", "low")
    empty = own.where(F.col("root").isNull()).select("id", "n", F.col("id").alias("low"))
    return named.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Of each component's rows one, with all its columns: the smallest id (null last), then the smaller text hashes.

    Rows without words are components of their own and all stay.  Rows are found by id and text hashes; of rows
    that repeat both, one.
    """
    own = _own_roots(docs, id_col, text_col, k, percent).where(F.col("root").isNotNull())
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    best = own.groupBy("root").agg(F.min(row).alias("r"))
    best = best.select(F.col("r.id").alias("_id"), F.col("r.k1").alias("_k1"), F.col("r.k2").alias("_k2"))
    same = (F.col("id").eqNullSafe(F.col("_id"))) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    copies = own.join(best, same).groupBy("_id", "_k1", "_k2").agg(F.count(F.lit(1)).alias("copies"))
    kept = written(copies, "op5-kept")

    text = F.col(text_col).cast("string")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = docs.where(~blank).withColumns(dict(zip(("_a", "_b"), _text_hashes(text))))

    def rows(which: str) -> DataFrame:
        some = kept.where(which).hint("merge")
        return hashed.join(some, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")

    single, several = rows("copies = 1"), rows("copies > 1").dropDuplicates([id_col, "_a", "_b"])
    return single.unionByName(several).drop("_a", "_b").unionByName(docs.where(blank))
