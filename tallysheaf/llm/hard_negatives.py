"""Hard negatives by lists shared within clusters of anchors, each walked until no better candidate can follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from .shared import stored

#: What a float64 holds exactly; sums beyond it are taken in whole numbers of any length.
_EXACT = 2.0**53


def _numbered(vectors: DataFrame, vec_id: str, embedding: str, label: str, relabel: Column | None, scale: int) -> DataFrame:
    """id, label and vec (components floor(scale * x)) of the rows that take part, one row per id."""
    raw = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.when(fine, raw).alias("raw"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL")
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long"))
    # Whole numbers as doubles: Spark's floor gives bigints, which would cut large ones off.
    scaled = F.transform("raw", lambda x: x * float(scale))
    rows = rows.select("id", "label", F.transform(scaled, lambda y: F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)).alias("vec"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("one")).select("id", "one.label", "one.vec")


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of k clusters of the sample's rows, by spherical k-means."""
    size = np.linalg.norm(sample, axis=1)
    unit = sample[size > 0] / size[size > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centres = unit[np.random.default_rng(7).permutation(len(unit))[:k]]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def _clustered(anchors: DataFrame, sample: int, members: int) -> DataFrame:
    """The anchors with their cluster, and the part of it that a task walks together: about ``members`` of them.

    The centres are fitted on the ``sample`` anchors of the lowest hashes of each length; every anchor is dealt to one.
    """
    drawn = anchors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    by_length: dict[int, list] = {}
    for r in drawn:
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    n = max(1, anchors.count())
    k = int(np.clip(np.ceil(n / members), 1, 64))
    sent = anchors.sparkSession.sparkContext.broadcast({d: _centres(np.array(v), k) for d, v in by_length.items() if d})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                x = v.values.to_numpy()
                centres = sent.value.get(len(x))
                out.append(0 if centres is None else int(np.argmax(centres @ x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["id", "label", "vec", "cluster"])

    rows = stored(anchors.select("id", "label", "vec").mapInArrow(nearest, "id long, label long, vec array<double>, cluster int"), "anchors")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / members).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return rows.join(sizes, "cluster").select("id", "label", "vec", "cluster", part.alias("part"))


class _List:
    """One task's candidates of one length, sorted for one part of a cluster by an upper bound of their products with
    any unit vector in its cone; walked in steps."""

    def __init__(self, x: np.ndarray, size: np.ndarray, members: np.ndarray):
        length = np.linalg.norm(members, axis=1)
        unit = members / np.where(length > 0, length, 1)[:, None]
        centre = unit.sum(0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        cone = np.arccos(np.clip((unit @ centre)[length > 0].min(initial=1.0), -1, 1))
        angle = np.arccos(np.clip(x @ centre / np.where(size > 0, size, 1), -1, 1))
        bound = size * np.cos(np.maximum(0, angle - cone))
        self.order = np.argsort(-bound, kind="stable")
        # An angle is known to about 1e-8; the margin is far above that. The best of all that follow still falls.
        self.bound = np.maximum.accumulate((bound + 1e-6 * size)[self.order][::-1])[::-1]
        self.length = length

    def best_left(self, at: int) -> np.ndarray:
        """No candidate from ``at`` on scores more than this, for each member; nothing is left at the end."""
        if at >= len(self.order):
            return np.full(len(self.length), -np.inf)
        return self.length * (self.bound[at] + 1e-6 * abs(self.bound[at]))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as floats where these hold every partial sum, else as Python's integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < _EXACT:
        return q @ x.T
    big = np.vectorize(int, otypes=[object])
    return big(q).dot(big(x).T) if q.size and x.size else np.zeros((len(q), len(x)))


def _merge(best: list, found: list, most: int) -> list:
    return sorted(best + found, key=lambda s: (-s[0], s[1]))[:most]


def _walk_positives(shard: dict, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, want: int, step: int) -> list[list]:
    """For each member the best ``want`` of its label in the shard, but itself: lists of (score, id)."""
    best: list[list] = [[] for _ in ids]
    walk = _List(shard["x"], shard["size"], q)
    live, at = np.arange(len(ids)), 0
    while len(live) and at < len(walk.order):
        rows = walk.order[at : at + step]
        s = _scores(q[live], shard["x"][rows])
        names, kinds = shard["ids"][rows], shard["labels"][rows]
        mine = (kinds[None, :] == labels[live][:, None]) & (names[None, :] != ids[live][:, None])
        floor = np.array([best[m][-1][0] if len(best[m]) == want else -np.inf for m in live], s.dtype)
        for r, m in enumerate(live):
            hit = np.nonzero(mine[r] & (s[r] >= floor[r]))[0]
            if len(hit):
                best[m] = _merge(best[m], [(int(s[r, j]), int(names[j])) for j in hit], want)
        at += step
        left = walk.best_left(at)
        # Certified: what follows is below the last of the best; equal scores could still win by their id.
        live = np.array([m for m in live if len(best[m]) < want or left[m] >= best[m][-1][0]], np.int64)
    return best


def _walk_negatives(shard: dict, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, windows: list[list], want: int, step: int) -> list[list[list]]:
    """For each member and each of its windows (least, most) the best ``want`` of other labels with a score inside."""
    best: list[list[list]] = [[[] for _ in w] for w in windows]
    walk = _List(shard["x"], shard["size"], q)

    def asks(m: int) -> float:
        """The least score that would still change a window's list."""
        return min((max(lo, b[-1][0]) if len(b) == want else lo for (lo, hi), b in zip(windows[m], best[m], strict=True) if lo <= hi), default=np.inf)

    live, at = np.array([m for m in range(len(ids)) if asks(m) < np.inf], np.int64), 0
    while len(live) and at < len(walk.order):
        rows = walk.order[at : at + step]
        s = _scores(q[live], shard["x"][rows])
        names, kinds = shard["ids"][rows], shard["labels"][rows]
        for r, m in enumerate(live):
            other = np.nonzero((kinds != labels[m]) & (s[r] >= asks(m)))[0]
            if not len(other):
                continue
            score = s[r][other]
            for w, (lo, hi) in enumerate(windows[m]):
                least = max(lo, best[m][w][-1][0]) if len(best[m][w]) == want else lo
                hit = other[(score >= least) & (score <= hi)]
                if len(hit):
                    best[m][w] = _merge(best[m][w], [(int(s[r, j]), int(names[j])) for j in hit], want)
        at += step
        left = walk.best_left(at)
        live = np.array([m for m in live if left[m] >= asks(m)], np.int64)
    return best


def _dealt(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """All candidates by shard, and after them in every shard the parts of the anchor clusters, in order.

    A shard is of bounded size. Anchors, a stated set of queries, go to every shard once; candidates are never copied.
    """
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    none = [F.lit(-1).alias("cluster"), F.lit(0).alias("part")]
    windows = "array<struct<positive:long,score:long,lo:long,hi:long>>"
    asked = anchors if "windows" in anchors.columns else anchors.withColumn("windows", F.lit(None).cast(windows))
    there = rows.select(shard.alias("shard"), *none, "id", "label", "vec", F.lit(None).cast(windows).alias("windows"))
    here = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "cluster", "part", "id", "label", "vec", "windows")
    return there.unionByName(here).repartition("shard").sortWithinPartitions("shard", "cluster", "part", "id")


def _walks(walk, members: int):
    """A function of batches that gathers a shard's candidates, then calls ``walk`` for each part of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists, key, held = None, {}, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if key[1] < 0:
                lists.clear()
                lengths = {len(h[2]) for h in held}
                for d in lengths:
                    of = [h for h in held if len(h[2]) == d]
                    x = np.stack([h[2] for h in of])
                    lists[d] = {"ids": np.array([h[0] for h in of], np.int64), "labels": np.array([h[1] for h in of], np.int64), "x": x, "size": np.linalg.norm(x, axis=1)}
                return
            for d in {len(h[2]) for h in held}:
                of = [h for h in held if len(h[2]) == d]
                for at in range(0, len(of), members if d in lists else len(of)):
                    part = of[at : at + members]
                    if d in lists:
                        yield walk(lists[d], np.stack([h[2] for h in part]), np.array([h[0] for h in part], np.int64),
                                   np.array([h[1] for h in part], np.int64), [h[3] for h in part])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], batch.column(5), batch.column(6).to_pylist(), strict=True):
                if row[:3] != key:
                    if key is not None:
                        yield from flush()
                    if shard != row[0]:
                        shard = row[0]
                        lists.clear()
                    key, held = row[:3], []
                held.append((row[3], row[4], row[5].values.to_numpy(), row[6]))
        if key is not None:
            yield from flush()

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
                   label: str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256,
                   members: int = 256, sample: int = 4096, shard_bytes: int = 16 << 20, step: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of components floor(scale * x), as whole numbers; higher scores come first, then smaller
    ids. For each row that ``is_anchor`` (a condition on ``id``) its best ``positives`` others of its label are taken,
    and for each of them the best ``negatives`` of other labels with least * positive <= 100 * negative <= most *
    positive (all there are, if fewer; none gives no row). ``relabel`` is a condition on ``id`` and ``label``.

    Rows with a null id, label or vector, or a null or non-finite component take no part; an empty or zero vector does.
    Vectors of other lengths don't meet. Of rows that share an id the one with the smallest label, then vector, counts.
    Scores beyond 64 bits raise. Other columns are ignored. Empty tables give no rows.

    Anchors are clustered by direction (centres fitted on ``sample`` anchors, every anchor dealt to one). For each part
    of a cluster, ``members`` anchors, a shard of the candidates sorts its rows once by length times the cosine of their
    angle to the part's centre less the part's own spread: no member's product can be larger for its length. Every
    member walks that list in steps until this bound is below the last score it holds, in each of its windows, or below
    all of them. Exact, whatever the clusters are: they only decide how early walks end.
    """
    ship(vectors.sparkSession)
    rows = stored(_numbered(vectors, vec_id, embedding, label, relabel, scale), "numbered")
    n, longest = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    shards = max(1, -(-8 * n * (longest or 1) // shard_bytes))
    anchors = stored(_clustered(rows.where(is_anchor), sample, members), "clustered-anchors")
    pair = pa.schema([("anchor", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def best(shard: dict, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, _) -> pa.RecordBatch:
        found = _walk_positives(shard, q, ids, labels, positives, step)
        out = [(a, o, s) for a, f in zip(ids.tolist(), found, strict=True) for s, o in f]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=pair)

    first = W.partitionBy("anchor").orderBy(F.desc("score"), "other")
    near = _dealt(rows, anchors, shards).mapInArrow(_walks(best, members), "anchor long, other long, score long")
    near = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives)
    # 50 * p <= 100 * n <= 95 * p, in whole numbers: n from the ceiling of least * p / 100 to the floor of most * p / 100.
    p = F.col("score").cast("decimal(20,0)")
    low = F.ceil(p * least / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(p * most / F.lit(100).cast("decimal(3,0)")).cast("long")
    near = near.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list(
        F.struct(F.col("other").alias("positive"), "score", low.alias("lo"), high.alias("hi")))).alias("windows"))
    asked = stored(anchors.join(near, "id"), "windows")
    triple = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("positive_score", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def inside(shard: dict, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, windows: list) -> pa.RecordBatch:
        found = _walk_negatives(shard, q, ids, labels, [[(w["lo"], w["hi"]) for w in m] for m in windows], negatives, step)
        out = [(a, w["positive"], w["score"], o, s) for a, m, f in zip(ids.tolist(), windows, found, strict=True) for w, b in zip(m, f, strict=True) for s, o in b]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=triple)

    order = W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    hard = _dealt(rows, asked, shards).mapInArrow(_walks(inside, members), "anchor long, positive long, positive_score long, other long, score long")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
