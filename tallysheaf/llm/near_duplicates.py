"""N-gram Jaccard join: documents whose shingle sets overlap enough, by prefixes under several global orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from .shared import components, stored

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers of 64-bit mixing (fixed values).
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TOKEN = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """word -> 64-bit hash, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_sets(texts: list[bytes | None], hashes: dict[bytes, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes, laid end to end, and their numbers."""
    said = [t.translate(_LOWER).split() if t else [] for t in texts]
    n_words = np.fromiter(map(len, said), np.int64, len(said))
    h = np.empty(int(n_words.sum()) + size, np.uint64)
    at = 0
    for w in said:
        h[at : at + len(w)] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
        at += len(w)
    h[at:] = 0
    # A window's hash, and that of shorter whole texts, end with the number of words in it.
    first = np.cumsum(n_words) - n_words
    takes = np.minimum(n_words, size)
    starts = np.where(n_words > 0, n_words - takes + 1, 0)
    begin = np.repeat(first, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    length = np.repeat(takes, starts)
    total = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = np.where(j < length, mix(total + h[begin + j]) * _M1, total)
        total = mix(total + length.astype(np.uint64))
    edges = np.r_[0, np.cumsum(starts)]
    for a, z in zip(edges[:-1], edges[1:]):
        total[a:z].sort()
    owner = np.repeat(np.arange(len(said)), starts)
    fresh = np.r_[True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])] if len(total) else np.zeros(0, bool)
    return total[fresh], np.bincount(owner[fresh], minlength=len(said))


def _entries(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one owner and key begin, cut after 255 so that a byte holds their lengths, and these lengths."""
    at = np.arange(len(owner))
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero((at - np.maximum.accumulate(np.where(fresh, at, 0))) % 255 == 0)
    return starts, np.diff(np.append(starts, len(owner))).astype(np.uint8)


def _blocks(docs: DataFrame, parts: int, size: int, most_words: int = 800_000) -> DataFrame:
    """Shingles dealt by value, in blocks: for each part the sets that have shingles there, 9 bytes each, and these, 6 bytes
    each. A set's size goes once a block, to the part of its signature.

    Equal sets have one signature and are one set from here on. The rows of documents themselves ride along.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (held < 6 * most_words or end == at):
                    held += len(texts[end] or b"")
                    end += 1
                tokens, n = shingle_sets(texts[at:end], hashes, size)
                owner = np.repeat(np.arange(end - at), n)
                with np.errstate(over="ignore"):
                    sums = np.zeros(end - at, np.uint64)
                    np.add.at(sums, owner, mix(tokens))
                    sig = mix(sums + n.astype(np.uint64) * _M1).view(np.int64)
                ids = batch.column(0).slice(at, end - at)
                # Of equal sets in the block only the first goes on.
                _, firsts = np.unique(sig, return_index=True)
                only = np.zeros(end - at, bool)
                only[firsts] = True
                keep = only[owner]
                tokens, owner = tokens[keep] & _TOKEN, owner[keep]
                part = (tokens % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
                order = np.argsort(part, kind="stable")
                tokens, owner, part = tokens[order], owner[order], part[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                starts, lengths = _entries(owner, part)
                first = np.searchsorted(starts, cuts)
                sigs = sig[owner[starts]]
                raw = tokens.view(np.uint8).reshape(-1, 8)[:, :6]
                known = firsts[n[firsts] > 0]
                home = sig[known] % parts
                known, home = known[np.argsort(home, kind="stable")], np.sort(home)
                homes = np.searchsorted(home, np.arange(parts + 1))
                rows: dict[str, list] = {c: [] for c in _BLOCK[:6]}
                for p in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(homes) > 0)):
                    a, z = first[p], first[p + 1]
                    mine = known[homes[p] : homes[p + 1]]
                    rows["part"].append(int(p))
                    rows["sigs"].append(sigs[a:z].tobytes())
                    rows["counts"].append(lengths[a:z].tobytes())
                    rows["tokens"].append(np.ascontiguousarray(raw[cuts[p] : cuts[p + 1]]).tobytes())
                    rows["own"].append(sig[mine].tobytes())
                    rows["ns"].append(n[mine].astype(np.int32).tobytes())
                k = len(rows["part"])
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in _BLOCK[1:6]], none, none, none], names=_BLOCK)
                m = end - at
                spread = pa.array((np.arange(m) + number) % parts, pa.int32())
                number += m
                empty = [pa.nulls(m, pa.binary())] * 5
                yield pa.RecordBatch.from_arrays([spread, *empty, ids, pa.array(sig), pa.array(n.astype(np.int64))], names=_BLOCK)
                at = end
            if len(hashes) > 1_000_000:
                hashes.clear()

    return docs.mapInArrow(work, "part int, sigs binary, counts binary, tokens binary, own binary, ns binary, doc_id long, sig long, n long")


_BLOCK = ["part", "sigs", "counts", "tokens", "own", "ns", "doc_id", "sig", "n"]
_SETS = ["part", "sig", "n", "doc_id", "sigs", "counts", "tokens", "ranks", "own", "ns"]


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of one part: every shingle that two sets or more have, with the rank of its frequency, by set; the sets of one part of
    signatures in one block, so that rows are as many as parts meet parts, however many sets share shingles."""
    sigs, tokens, owners, sizes, known, number = [], [], [], [], 0, 0
    for batch in batches:
        docs = pc.is_valid(batch.column("sig"))
        mine = batch.filter(docs)
        m = len(mine)
        if m:
            spread = pa.array((np.arange(m) + number) % parts, pa.int32())
            number += m
            empty = [pa.nulls(m, pa.binary())] * 6
            yield pa.RecordBatch.from_arrays([spread, mine.column("sig"), mine.column("n"), mine.column("doc_id"), *empty], names=_SETS)
        blocks = batch.filter(pc.invert(docs))
        for s, c, t, o, n in zip(*[blocks.column(k).to_pylist() for k in ("sigs", "counts", "tokens", "own", "ns")], strict=True):
            sizes.append((np.frombuffer(o, np.int64), np.frombuffer(n, np.int32)))
            sigs.append(np.frombuffer(s, np.int64))
            count = np.frombuffer(c, np.uint8).astype(np.int64)
            wide = np.zeros((int(count.sum()), 8), np.uint8)
            wide[:, :6] = np.frombuffer(t, np.uint8).reshape(-1, 6)
            tokens.append(wide.view(np.uint64).ravel())
            owners.append(np.repeat(np.arange(known, known + len(count), dtype=np.int64), count))
            known += len(count)
    if not tokens:
        return
    # The sizes of sets go on to the parts of their signatures, each set's once.
    own, first = np.unique(np.concatenate([s for s, _ in sizes]), return_index=True)
    n, home = np.concatenate([k for _, k in sizes])[first], own % parts
    for to in np.unique(home).tolist():
        mine = home == to
        none, empty = pa.nulls(1, pa.int64()), [pa.nulls(1, pa.binary())] * 4
        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), none, none, none, *empty, pa.array([own[mine].tobytes()], pa.binary()), pa.array([n[mine].tobytes()], pa.binary())], names=_SETS)
    every, same = np.unique(np.concatenate(sigs), return_inverse=True)
    token, owner = np.concatenate(tokens), same[np.concatenate(owners)]
    del tokens, owners, sigs, sizes
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    many = np.repeat(np.diff(np.append(starts, len(token))) > 1, np.diff(np.append(starts, len(token))))
    token, owner = token[many], owner[many]  # shingles met once are done with
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])] if len(token) else np.zeros(0, bool)
    token, owner = token[fresh], owner[fresh]  # copies of a set count once
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    df = np.diff(np.append(starts, len(token)))
    rank = np.repeat(np.minimum(255, np.round(4 * np.log2(np.maximum(df, 1)))).astype(np.uint8), df)
    many = rank > 0
    token, owner, rank = token[many], owner[many], rank[many]
    # By the part of the owner's signature, then by owner.
    part = (every % parts).astype(np.int64)
    order = np.lexsort((owner, part[owner]))
    token, owner, rank = token[order], owner[order], rank[order]
    starts, counts = _entries(owner, owner)
    mine, ends = owner[starts], np.append(starts, len(token))
    raw = token.view(np.uint8).reshape(-1, 8)
    goes, first = np.unique(part[mine], return_index=True)
    last = np.append(first[1:], len(mine))
    for lo in range(0, len(goes), 64):
        rows = []
        for to, a, z in zip(goes[lo : lo + 64].tolist(), first[lo : lo + 64].tolist(), last[lo : lo + 64].tolist(), strict=True):
            at, end = ends[a], ends[z]
            rows.append((to, every[mine[a:z]].tobytes(), counts[a:z].tobytes(), np.ascontiguousarray(raw[at:end, :6]).tobytes(), rank[at:end].tobytes()))
        to, *blobs = zip(*rows, strict=True)
        none, empty = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), none, none, none, *[pa.array(c, pa.binary()) for c in blobs], empty, empty], names=_SETS)


_CANDIDATE = "sig long, n long, doc_id long, shared array<long>, ranks array<smallint>, slots int"


def _candidates(batches: Iterator[pa.RecordBatch], keep: int, of: int) -> Iterator[pa.RecordBatch]:
    """Sets with a shared shingle in their prefix: shared shingles in the first order, and how many are in the prefix.

    The orders put rare shingles first, so a set's unshared ones fill its prefix before any other; most sets are out.
    A task holds the shared shingles of one part of signatures; documents' own rows pass through.
    """
    kind, small = pa.list_(pa.int64()), pa.list_(pa.int16())
    names = ["sig", "n", "doc_id", "shared", "ranks", "slots"]
    sigs, sizes, tokens, ranks = [], [], [], []
    for batch in batches:
        rows = pc.is_valid(batch.column("sig"))
        docs = batch.filter(rows)
        if m := len(docs):
            yield pa.RecordBatch.from_arrays([docs.column("sig"), docs.column("n"), docs.column("doc_id"), pa.nulls(m, kind), pa.nulls(m, small), pa.nulls(m, pa.int32())], names=names)
        blocks = batch.filter(pc.invert(rows))
        for s, c, t, r, o, k in zip(*[blocks.column(x).to_pylist() for x in ("sigs", "counts", "tokens", "ranks", "own", "ns")], strict=True):
            if s is None:
                sizes.append((np.frombuffer(o, np.int64), np.frombuffer(k, np.int32)))
                continue
            count = np.frombuffer(c, np.uint8).astype(np.int64)
            sigs.append(np.repeat(np.frombuffer(s, np.int64), count))
            wide = np.zeros((int(count.sum()), 8), np.uint8)
            wide[:, :6] = np.frombuffer(t, np.uint8).reshape(-1, 6)
            tokens.append(wide.view(np.uint64).ravel())
            ranks.append(np.frombuffer(r, np.uint8))
    if not tokens:
        return
    sig, token, rank = (np.concatenate(x) for x in (sigs, tokens, ranks))
    sigs.clear(), tokens.clear(), ranks.clear()
    order = np.lexsort((mix(token), rank, sig))
    sig, token, rank = sig[order], token[order].astype(np.int64), rank[order].astype(np.int16)
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    held = np.diff(np.append(first, len(sig)))
    known, at = np.unique(np.concatenate([s for s, _ in sizes]), return_index=True)
    n = np.concatenate([k for _, k in sizes])[at][np.searchsorted(known, sig[first])].astype(np.int64)
    slots = np.minimum(n - (keep * n + of - 1) // of + 1 - (n - held), held)
    kept = np.flatnonzero(slots > 0)
    for lo in range(0, len(kept), 500):
        some = kept[lo : lo + 500]
        cuts = [(first[i], first[i] + held[i]) for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([
            pa.array(sig[first[some]], pa.int64()), pa.array(n[some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([token[a:z] for a, z in cuts], kind),
            pa.array([rank[a:z] for a, z in cuts], small), pa.array(slots[some], pa.int32())], names=names)


def _stars(batches: Iterator[pa.RecordBatch], least: int, leads: int = 16) -> Iterator[pa.RecordBatch]:
    """Verified links between sets of one key: each set against the group's first few unlinked ones.

    This only finds most large groups early; what it misses the join finds.
    """
    key, heads = None, []
    for batch in batches:
        src, dst = [], []
        for k, s, n, tokens in zip(*[batch.column(c) for c in ("key", "sig", "n", "shared")], strict=True):
            if k != key:
                key, heads = k, []
            mine, n, s = np.sort(tokens.values.to_numpy()), n.as_py(), s.as_py()
            for sig, size, other in heads:
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                both = int((other[at] == mine).sum())
                if 100 * both >= least * (n + size - both):
                    src.append(s)
                    dst.append(sig)
                    break
            else:
                if len(heads) < leads:
                    heads.append((s, n, mine))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _seeded(seed: int) -> Callable[[Column], Column]:
    return lambda t: F.xxhash64(t, F.lit(seed))


def _prefix(order: int) -> Column:
    """A set's prefix under an order: shingles by rank, within a rank by the order's own hash."""
    pairs = F.arrays_zip(F.col("shared"), F.col("ranks"))
    keyed = F.transform(pairs, lambda x: F.struct(x["ranks"].alias("r"), F.xxhash64(x["shared"], F.lit(order)).alias("h"), x["shared"].alias("t")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.col("slots")), lambda x: x["t"])


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two sets that share a prefix shingle can be near enough: by their sizes, and by what each has left from that
    shingle on. The first shingle that they share passes if they are, as nothing before it is shared."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    return sizes & ((100 + percent) * F.least(f"{a}.rest", f"{b}.rest") >= percent * (n + m))


def _verified(pairs: DataFrame, held: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (src, dst, and their components) of sets that link: their prefixes meet under the other orders too, and then
    the sets themselves are compared."""
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("sig")).distinct()
    full = held.join(wanted, "sig", "left_semi").select("sig", "n", "shared", *[_prefix(k).alias(f"p{k}") for k in range(1, orders)])
    full = stored(full, "wanted-sets")
    left, right = (full.select(*[F.col(c).alias(f"{side}_{c}") for c in full.columns]) for side in ("a", "b"))
    joined = pairs.join(left, F.col("src") == F.col("a_sig")).join(right, F.col("dst") == F.col("b_sig"))
    for k in range(1, orders):
        joined = joined.where(F.arrays_overlap(f"a_p{k}", f"b_p{k}"))
    both = F.size(F.array_intersect("a_shared", "b_shared"))
    links = joined.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("a_n") + F.col("b_n") - F.col("both")))
    return links.select("src_component", "dst_component").distinct()


def _united(placed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The prefix shingles under the least component that each links to, as far as some shingle still has two. One step a
    round: what is linked over several is one component in the end."""
    both = links.unionByName(links.select(F.col("dst_component").alias("src_component"), F.col("src_component").alias("dst_component")))
    step = both.groupBy(F.col("src_component").alias("id")).agg(F.min("dst_component").alias("to")).where("to < id")
    moved = placed.join(step, F.col("component") == F.col("id"), "left")
    return _open(moved.select("token", "sig", "n", "rest", F.coalesce("to", "component").alias("component")), percent)


def _open(placed: DataFrame, percent: int) -> DataFrame:
    """The prefix shingles that another component has too, of sets to which some set with the shingle is near enough in size.

    A set finds its partners between the sizes that ``_near`` leaves it, so the next larger and the next smaller size that
    the shingle has tell if there are any. Sizes are looked at once for each shingle, however many sets have them.
    """
    sizes = placed.groupBy("token", "n").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    by_size, whole = W.partitionBy("token").orderBy("n"), W.partitionBy("token")
    sizes = sizes.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    sizes = sizes.withColumn("mixed", F.min("lo").over(whole) < F.max("hi").over(whole)).where("mixed")
    sizes = sizes.select("token", "n", (F.col("lo") < F.col("hi")).alias("same"), "smaller", "larger")
    n, most = F.col("n"), (100 + percent) * F.col("rest") - percent * F.col("n")  # percent times the largest partner's size
    up = (percent * F.col("larger") <= most) & (percent * F.col("larger") <= 100 * n)
    down = (percent * F.col("smaller") <= most) & (100 * F.col("smaller") >= percent * n)
    meets = (F.col("same") & (percent * n <= most)) | F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False))
    return stored(placed.join(sizes, ["token", "n"]).where(meets).select("token", "sig", "n", "rest", "component"), "open-prefixes")


def _crowded(placed: DataFrame, percent: int, most: int) -> bool:
    """Whether the prefix shingles meet across components in more than ``most`` pairs, counting places at which sets of one
    size could still be near."""
    early = placed.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n"))
    own = early.groupBy("token", "component").agg(F.count("*").cast("double").alias("n"))
    met = own.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    r = met.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2).alias("pairs")).first()
    return r["pairs"] is not None and r["pairs"] > most


def _star_pairs(placed: DataFrame, seed: int, percent: int) -> DataFrame:
    """For every prefix shingle one set of each component that has it, against that of one component: pairs to verify, never
    more than shingles."""
    best = F.min(F.struct(_seeded(seed)(F.col("sig")).alias("h"), "sig", "n", "rest")).alias("x")
    reps = placed.groupBy("token", "component").agg(best).select("token", "component", "x.*")
    lead = reps.groupBy("token").agg(F.min(F.struct("h", "sig", "n", "rest", "component")).alias("x")).select("token", "x.*")
    a, b = reps.alias("a"), lead.alias("b")
    found = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & _near("a", "b", percent))
    return stored(found.select(F.col("a.sig").alias("src"), F.col("b.sig").alias("dst"), F.col("a.component").alias("src_component"),
                               F.col("b.component").alias("dst_component")).distinct(), "star-pairs")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, orders: int = 3,
                    part_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included) of every row.

    A document's set: its distinct runs of ``size`` words (A-Z lower-cased, parted by ASCII white space), or all its
    words as one run if they are fewer. Two documents link when ``100 * both >= percent * either``. Null, empty and
    blank texts have an empty set, link with nothing and are their own component. Rows of one set are copies and one
    component; repeated ids stay rows of their own; a row with a null id never names a component unless it is alone.
    Other columns are ignored.

    Equal sets are collapsed by a 64-bit signature, and shingles compared by 48 bits of their hash within 12 MB of text
    (``part_bytes``) at a time: among a billion sets two different ones have one signature with a chance of 3 %. Shingles
    are dealt by value to count in how many sets each occurs; sets then learn which of theirs are shared, and how often.
    In every order rare shingles come first, so prefixes (n - ceil(t n) + 1 shingles) of most sets are full of unshared
    ones and these are out.

    Sets with a common least hash are linked to a few leads each and joined to components. While
    the prefix shingles would then meet in more than four times as many pairs as there were at first, rounds of stars follow, until one links less than a fiftieth of its pairs: for
    each prefix shingle one set of every component is held against that of one, other sets in every round. The join on prefix shingles takes only what is of different components even then, so a group
    of near copies never becomes all its pairs, and of the links between two components one goes on. Pairs whose sizes
    or places of the shingle tell that they can't be near, or whose prefixes under the other orders don't meet, are
    dropped before sets are compared.
    """
    spark = ship(docs.sparkSession)
    flat = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    parts = max(2, -(-(flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    sets = "part int, sig long, n long, doc_id long, sigs binary, counts binary, tokens binary, ranks binary, own binary, ns binary"
    dealt = _blocks(flat, parts, size).repartitionById(parts, "part").mapInArrow(lambda b: _shared(b, parts), sets)
    dealt = dealt.repartitionById(parts, "part")
    table = stored(dealt.drop("part").mapInArrow(lambda b: _candidates(b, percent, 100), _CANDIDATE), "sets")
    owners = table.where("shared IS NULL").select("doc_id", "sig", "n")
    held = table.where("shared IS NOT NULL").drop("doc_id")

    # The least hash of a set's shared shingles is the same for most near copies; two hashes miss fewer of them.
    least = F.explode(F.array(*[F.array_min(F.transform("shared", _seeded(i))) for i in (101, 202)]))
    keyed = held.select(least.alias("key"), "sig", "n", "shared").repartition(parts, "key").sortWithinPartitions("key", "n", "sig")
    stars = stored(keyed.mapInArrow(lambda b: _stars(b, percent), "src long, dst long"), "stars")
    edges = stored(components(stars, "set-components").select(F.col("id").alias("src"), F.col("component").alias("dst")).where("src <> dst"), "edges")

    # Prefix shingles whose sets are not yet of one component.
    rest = F.size("shared") - F.col("at")
    prefix = F.posexplode(F.slice("shared", F.lit(1), F.col("slots"))).alias("at", "token")
    placed = held.select("sig", "n", "shared", prefix).select("token", "sig", "n", rest.alias("rest"))
    placed = placed.join(edges, F.col("sig") == F.col("src"), "left").select("token", "sig", "n", "rest", F.coalesce("dst", "sig").alias("component"))
    placed, seed = _open(placed, percent), 0
    most = 4 * placed.count()
    while _crowded(placed, percent, most):
        stars = _star_pairs(placed, seed, percent)
        links = stored(_verified(stars, held, percent, orders), "star-links")
        n = links.count()
        edges = edges.unionByName(links.select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")))
        placed, seed = _united(placed, links, percent), seed + 1
        if 50 * n < stars.count():  # most of what still differs doesn't link
            break
    a, b = placed.alias("a"), placed.alias("b")
    met = (F.col("a.token") == F.col("b.token")) & (F.col("a.sig") < F.col("b.sig")) & (F.col("a.component") != F.col("b.component"))
    pairs = a.join(b, met & _near("a", "b", percent)).select(
        F.col("a.sig").alias("src"), F.col("b.sig").alias("dst"), F.col("a.component").alias("src_component"), F.col("b.component").alias("dst_component"))
    links = _verified(stored(pairs.distinct(), "pairs"), held, percent, orders)
    edges = edges.unionByName(links.select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")))
    final = components(edges, "set-components")

    known = owners.join(final, F.col("sig") == F.col("id"), "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("component", "sig")))
    known = known.select("doc_id", "n", "class")
    smallest = known.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    return known.join(smallest, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))
