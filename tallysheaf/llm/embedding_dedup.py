"""Embedding near-dedup by NN-descent: a neighbour graph refined by joins, its edges above a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from .shared import components, stored

_EDGE = "src long, dst long, cos double"


def _edges(src: np.ndarray, dst: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(cos, pa.float64())], names=["src", "dst", "cos"])


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Every row's (id, key), key null where it can't link; and the distinct unit vectors (id: the key, vec, copies)."""
    raw = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.coalesce(F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.when(fine, raw).alias("raw"))
    rows = rows.withColumn("top", F.array_max(F.transform("raw", lambda x: F.abs(x))))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    rows = rows.withColumn("scaled", F.when(F.col("top") > 0, F.transform("raw", lambda x: x / F.col("top"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.withColumn("vec", F.transform("scaled", lambda x: x / F.col("norm")))
    rows = stored(rows.select("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("key"), "vec"), "vectors")
    distinct = rows.where("key IS NOT NULL").groupBy(F.col("key").alias("id")).agg(F.first("vec").alias("vec"), F.count("*").alias("copies"))
    return rows.select("id", "key"), stored(distinct, "distinct-vectors")


def _bits(n: int, leaf: int) -> int:
    """The signs in a tree's code: as many as give each code about ``leaf`` vectors."""
    return int(np.clip(np.ceil(np.log2(max(1, n / leaf))), 1, 40))


def _trees_for(n: int, leaf: int, threshold: float, least_recall: float) -> int:
    """Trees after which a pair at the threshold has shared a code with a probability of ``least_recall``."""
    one = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** _bits(n, leaf)
    return int(np.ceil(np.log(1 - least_recall) / np.log1p(-one))) if one < 1 and least_recall < 1 else 1


def _first_graph(vectors: DataFrame, n: int, k: int, trees: int, leaf: int, seed: int, reach: float) -> DataFrame:
    """Neighbours from random projections: vectors of like codes stand side by side, and blocks of them are compared.

    For each tree vectors are in the order of the signs of random projections, then of one projection's value. Blocks
    are of bounded size and overlap; what a block's edge parts, another tree or the descent brings together. Neighbours
    below ``reach`` are left out, as nothing passes them on.
    """
    bits = _bits(n, leaf)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), [v.values.to_numpy() for v in batch.column(1)]
            tree, codes, last, at = [], [], [], []
            for d in {len(v) for v in vecs}:
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, d)).standard_normal((d, trees, bits + 1))
                mine = [i for i, v in enumerate(vecs) if len(v) == d]
                p = np.tensordot(np.stack([vecs[i] for i in mine]), planes[d], 1)
                signs = (p[:, :, :-1] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(trees):
                    tree += [d * trees + t] * len(mine)
                    codes.append(signs[:, t])
                    last.append(p[:, t, -1])
                    at += mine
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(last)), pa.array([ids[i] for i in at], pa.int64()), batch.column(1).take(pa.array(at))],
                                                 names=["tree", "code", "last", "id", "vec"])

    def block(held: list) -> pa.RecordBatch:
        ids, x = np.array([i for i, _ in held], np.int64), np.stack([v for _, v in held])
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        kk = min(k, len(ids) - 1)
        near = np.argpartition(-cos, kk - 1, axis=1)[:, :kk] if kk > 0 else np.zeros((len(ids), 0), np.int64)
        best = np.take_along_axis(cos, near, 1).ravel()
        at = best >= reach
        return _edges(np.repeat(ids, kk)[at], ids[near].ravel()[at], best[at])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = [], None
        for batch in batches:
            for t, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (t != tree or len(held) >= 3 * leaf):
                    yield block(held)
                    held = held[-leaf:] if t == tree else []
                tree = t
                held.append((i, v.values.to_numpy()))
        if held:
            yield block(held)

    coded = vectors.select("id", "vec").mapInArrow(code, "tree long, code long, last double, id long, vec array<double>")
    placed = coded.repartitionByRange("tree", "code", "last").sortWithinPartitions("tree", "code", "last")
    return placed.select("tree", "id", "vec").mapInArrow(compare, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each vector."""
    best = W.partitionBy("src").orderBy(F.desc("cos"), "dst")  # tasks keep k of each before the shuffle
    ranked = edges.groupBy("src", "dst").agg(F.max("cos").alias("cos")).withColumn("at", F.row_number().over(best))
    return ranked.where(F.col("at") <= k).select("src", "dst", "cos")


def _met(graph: DataFrame, vectors: DataFrame, k: int, reach: float) -> DataFrame:
    """Neighbours of neighbours: the neighbours of each vector, both ways, are compared with one another."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, ids, vecs = None, [], []

        def compare() -> pa.RecordBatch:
            x, names = np.stack(vecs), np.array(ids, np.int64)
            cos = x @ x.T
            a, b = np.nonzero(np.triu(cos >= reach, 1))
            return _edges(np.r_[names[a], names[b]], np.r_[names[b], names[a]], np.r_[cos[a, b], cos[a, b]])

        for batch in batches:
            for m, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if m != mid:
                    if len(ids) > 1:
                        yield compare()
                    mid, ids, vecs = m, [], []
                ids.append(i)
                vecs.append(v.values.to_numpy())
        if len(ids) > 1:
            yield compare()

    both = graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cos")).where(F.col("cos") >= reach)
    hops = _best(both, 2 * k).select(F.col("src").alias("mid"), "dst").join(vectors.select(F.col("id").alias("dst"), "vec"), "dst")
    return hops.select("mid", "dst", "vec").repartition("mid").sortWithinPartitions("mid").mapInArrow(local, _EDGE)


def _completed(members: DataFrame, threshold: float, rows: int = 256) -> DataFrame:
    """The links of vectors whose lists are too short for them: all of their group (group, id, vec, copies), in blocks.

    A group is cut into blocks of about ``rows`` vectors by hash; each pair of blocks is compared by one call wherever
    it lands, and only counts leave it, so a large group is many independent pieces and never a list of pairs.
    """
    sizes = members.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).cast("int").alias("blocks"))
    cut = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))))
    dealt = cut.withColumn("pair", other).select("group", "pair.a", "pair.b", "block", "id", "copies", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, b = key[1], key[2]
            x = [r for r in held if r[0] == a]
            y = [r for r in held if r[0] == b]
            s = np.stack([r[3] for r in x]) @ np.stack([r[3] for r in y]).T if x and y else np.zeros((0, 0))
            hit = s >= threshold
            if a == b:
                np.fill_diagonal(hit, False)
            weight = [np.array([r[2] for r in side], np.int64) for side in (x, y)]
            ids, n = [r[1] for r in x], hit @ weight[1] if len(hit) else np.zeros(len(x), np.int64)
            if a != b:
                ids, n = ids + [r[1] for r in y], np.r_[n, hit.T @ weight[0] if len(hit) else np.zeros(len(y), np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

        key, held = None, []
        for batch in batches:
            for *k, block, i, c, v in zip(*[batch.column(j).to_pylist() for j in range(6)], batch.column(6), strict=True):
                if k != key:
                    if held:
                        yield out()
                    key, held = k, []
                held.append((block, i, c, v.values.to_numpy()))
        if held:
            yield out()

    placed = dealt.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "block", "id")
    return placed.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def true_links(vectors: DataFrame, threshold: float, n: int, enough: int = 256, queries: int = 256, most: int = 4096) -> tuple[DataFrame, int]:
    """All links (src, dst) of the vectors of the lowest ids, by brute force, and how many of those have any.

    Ids are hashes, so these are a random draw. It grows until ``enough`` vectors with links are in it, or all ``n``
    vectors, or ``most``: where links are rarer, the caller has to do without.
    """
    while True:
        asked = vectors.orderBy("id").limit(queries).select("id", "vec").collect()
        by_length = {d: [r for r in asked if len(r["vec"]) == d] for d in {len(r["vec"]) for r in asked}}
        packed = {d: (np.array([r["id"] for r in of], np.int64), np.array([r["vec"] for r in of])) for d, of in by_length.items()}
        sent = vectors.sparkSession.sparkContext.broadcast(packed)

        def true(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vecs = batch.column(0).to_numpy(), [v.values.to_numpy() for v in batch.column(1)]
                lengths = np.array([len(v) for v in vecs])
                for d, (names, x) in sent.value.items():
                    mine = np.nonzero(lengths == d)[0]
                    for at in range(0, len(mine), 1024):
                        part = mine[at : at + 1024]
                        q, i = np.nonzero(x @ np.stack([vecs[j] for j in part]).T >= threshold)
                        src, dst = names[q], ids[part][i]
                        if (src != dst).any():
                            yield _edges(src[src != dst], dst[src != dst], np.ones((src != dst).sum()))

        want = stored(vectors.select("id", "vec").mapInArrow(true, _EDGE).select("src", "dst"), "audit")
        linked = want.select("src").distinct().count()
        if linked >= enough or queries >= min(n, most):
            return want, linked
        queries = min(4 * queries, most)


def recall(want: DataFrame, links: DataFrame, whole: DataFrame, full: DataFrame) -> tuple[float, int]:
    """The share of the true links in ``want`` that are in the graph, or within a group (id, component) to be compared
    whole; and how many of those missed are of vectors whose lists are ``full``.

    The share is the lesser of that over all links and the mean over vectors, as a few large groups have most links
    but most vectors with links may have one each.
    """
    a, b = (whole.select(F.col("id").alias(side), F.col("component").alias(f"{side}_group")) for side in ("src", "dst"))
    found = want.join(links.select("src", "dst", F.lit(True).alias("linked")), ["src", "dst"], "left").join(a, "src", "left").join(b, "dst", "left")
    found = found.join(full.select(F.col("id").alias("src"), F.lit(True).alias("full")), "src", "left")
    hit = F.coalesce(F.col("linked"), F.col("src_group") == F.col("dst_group"), F.lit(False)).cast("int")
    each = found.select("src", hit.alias("hit"), F.coalesce("full", F.lit(False)).alias("full")).groupBy("src").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum(F.when(F.col("full"), 1 - F.col("hit")).otherwise(0)).alias("crowded"))
    r = each.agg(F.sum("hits") / F.sum("n"), F.avg(F.col("hits") / F.col("n")), F.sum("crowded")).first()
    return (1.0, 0) if r[0] is None else (min(r[0], r[1]), r[2])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, k: int = 12,
                 trees: int = 4, leaf: int = 96, most_rounds: int = 4, slack: float = 0.3, least_recall: float = 0.95, seed: int = 5,
                 most_trees: int = 256) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row; links have a cosine of at least ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, their own
    component. Equal directions are one vector in the graph and count as that many links. Vectors of other lengths
    don't meet. A null id is its own component unless the row's group has another id, and is not kept. Other columns
    are ignored.

    The first graph comes from random projections. Each round compares the neighbours of every vector with one another
    and keeps the ``k`` best, until no link is new; only neighbours with a cosine of ``threshold - slack`` or more are
    passed on. A list full of links is saturated: its group is then compared whole, in blocks, so lists have no cap.
    The descent can't meet a pair whose other neighbours are unlike: only trees can, and the share of such pairs that a
    number of trees finds falls as the table grows. So an audit against brute force, over as many vectors as it takes
    to see 256 with links, doubles the trees (with other projections, united with the graph) until it passes, and the
    lists where they were too short. Where 4,096 vectors show fewer with links, there are also as many trees as find
    pairs at the threshold by their probability. RuntimeError where ``most_trees`` trees don't pass.
    """
    ship(vectors.sparkSession)
    rows, distinct = _usable(vectors, vec_id, embedding)
    n = distinct.count()
    reach, graph, grown, more = threshold - slack, None, 0, trees
    want, linked = true_links(distinct, threshold, n, enough := 256)
    needed = 0 if linked >= enough or n <= 4096 else _trees_for(n, leaf, threshold, least_recall)
    while True:
        fresh = _first_graph(distinct, n, k, more, leaf, seed + grown, reach)
        graph = stored(_best(fresh if graph is None else graph.unionByName(fresh), k), "graph")
        has, grown = graph.where(F.col("cos") >= threshold).count(), grown + more
        for _ in range(most_rounds):
            after = stored(_best(graph.unionByName(_met(graph, distinct, k, reach)), k), "graph")
            was, has, graph = has, after.where(F.col("cos") >= threshold).count(), after
            if has == was:
                break
        one_way = graph.where(F.col("cos") >= threshold)
        links = stored(one_way.select("src", "dst").unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
        groups = components(links, "vector-components")
        # A full list of links, or one that others' lists name more often than it could hold itself.
        full = links.groupBy("src").count().where(F.col("count") >= k).select(F.col("src").alias("id"))
        large = groups.join(full, "id", "left_semi").select("component").distinct()
        got, crowded = recall(want, links, groups.join(large, "component", "left_semi"), full)
        if got >= least_recall and grown >= needed:
            break
        if grown >= most_trees:
            raise RuntimeError(f"{grown} trees find {got:.1%} of the audited links; {least_recall:.1%} are asked for, and {needed} trees")
        more, k = min(grown, most_trees - grown), max(k, min(2 * k, 96)) if crowded else k
    members = groups.join(large, "component", "left_semi").join(distinct, "id").select(F.col("component").alias("group"), "id", "vec", "copies")
    whole = stored(_completed(members, threshold), "whole-groups")
    rest = links.join(whole.select(F.col("id").alias("src")), "src", "left_anti")
    counted = rest.join(distinct.select(F.col("id").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("copies").alias("n"))
    counted = counted.unionByName(whole)
    known = rows.join(distinct.select(F.col("id").alias("key"), "copies"), "key", "left").join(counted.withColumnRenamed("id", "key"), "key", "left")
    known = known.join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn("class", F.coalesce("component", "key"))
    known = known.select("id", "class", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    smallest = known.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("smallest"))
    out = known.join(smallest, "class", "left").withColumn("component_id", F.coalesce("smallest", "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
