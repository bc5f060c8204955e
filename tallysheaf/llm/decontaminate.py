"""Benchmark decontamination: suffix arrays of the training words, searched for every benchmark suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship

#: A-Z lower-cased; what is neither a digit, a letter nor beyond ASCII parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("item_word", T.IntegerType()),
    T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Questions:
    """A block of benchmark items: their words as numbers from 1 on, and every distinct window as a search key."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.window, self.ids = window, []
        at: dict[bytes, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = words(text)
            codes = np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], ">i4").tobytes()
            size = min(window, len(w))
            for p in range(len(w) - size + 1 if size else 0):
                at.setdefault(codes[4 * p : 4 * (p + size)], []).append((len(self.ids), p))
            self.ids.append(item_id)
        self.size = np.array([len(k) // 4 for k in at], np.int64)
        width = f"S{4 * window}"
        self.low = np.array([*at], width)
        self.high = np.array([k + b"\xff" * (4 * window - len(k)) for k in at], width)
        self.of = np.array([x for v in at.values() for x in v], np.int64).reshape(-1, 2)
        self.first = np.r_[0, np.cumsum([len(v) for v in at.values()])].astype(np.int64)

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, window) of each occurrence in the documents laid end to end with a break after each; the starts.

        The suffix array holds the suffixes that begin with at least the shortest window's number of benchmark words:
        no other can begin a window. It is sorted to the depth of a window; longer matches are runs of windows.
        """
        get, starts, flat = self.number.get, [], []
        for w in docs:
            starts.append(len(flat))
            flat += [get(x, 0) for x in w]
            flat.append(0)
        text = np.array(flat + [0] * self.window, np.int32)
        place = np.arange(len(text))
        stop = np.minimum.accumulate(np.where(text == 0, place, len(text))[::-1])[::-1]
        suffixes = np.flatnonzero(stop - place >= self.size.min()) if len(self.size) else place[:0]
        none = np.zeros(0, np.int64)
        if not len(suffixes):
            return none, none, np.array(starts, np.int64)
        depth = np.lib.stride_tricks.sliding_window_view(text, self.window)[suffixes].astype(">i4")
        keys = np.ascontiguousarray(depth).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return at, which, np.array(starts, np.int64)


def _judge(blocks: list[Questions], docs: list[list[bytes]]) -> Iterator[tuple[int, list, list[dict]]]:
    """For each document: words hit, item ids, and the longest matches with their places."""
    total = sum(map(len, docs)) + len(docs)
    edge = np.zeros(total + 1, np.int32)
    found: list[set] = [set() for _ in docs]
    spans: list[list[dict]] = [[] for _ in docs]
    starts = np.zeros(len(docs), np.int64)
    for q in blocks:
        at, which, starts = q.occurrences(docs)
        if not len(at):
            continue
        np.add.at(edge, at, 1)
        np.add.at(edge, at + q.size[which], -1)
        doc = np.searchsorted(starts, at, "right") - 1
        n = q.first[which + 1] - q.first[which]
        row = np.repeat(q.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, shift, at, doc, size = q.of[row, 0], q.of[row, 1], np.repeat(at, n), np.repeat(doc, n), np.repeat(q.size[which], n)
        # Windows that follow each other in document and item are one longer match.
        order = np.lexsort((at, at - shift, item, doc))
        item, shift, at, doc, size = item[order], shift[order], at[order], doc[order], size[order]
        diagonal = at - shift
        opens = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(opens)
        last = np.r_[first[1:], len(at)] - 1
        for a, b in zip(first, last, strict=True):
            d, item_id = int(doc[a]), q.ids[item[a]]
            if item_id is not None:
                found[d].add(item_id)
            spans[d].append({"item_id": item_id, "item_word": int(shift[a]), "doc_word": int(at[a] - starts[d]), "n_words": int(at[b] - at[a] + size[b])})
    hit = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    for d, w in enumerate(docs):
        yield int(hit[starts[d] + len(w)] - hit[starts[d]]), sorted(found[d], key=str), spans[d]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Questions]:
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`").cast("binary")).orderBy(1)
    held, n = [], 0
    for i, t in rows.toLocalIterator():
        held.append((i, bytes(t) if t is not None else None))
        n += len(words(held[-1][1]))
        if n >= block_words:
            yield Questions(held, window)
            held, n = [], 0
    if held:
        yield Questions(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 13, one_in: int = 20, shard_words: int = 1_000_000, block_words: int = 1_000_000) -> DataFrame:
    """Every row with what it shares with the benchmark: n_words, n_hit, n_items, items_sha256, contaminated, matches.

    The columns of ``docs`` stay, the text included; those of the names above are replaced. ``matches`` holds the
    longest verbatim matches: item, word in the item, word in the document, number of words. An item shorter than
    ``window`` words is one window of its own length; one without words never matches. A row is contaminated when at
    least one word is hit and ``one_in * n_hit >= n_words``. Null text has no words; null item ids are hit but not
    listed; equal item ids count once; an empty benchmark hits nothing.

    Each shard (rows of about ``shard_words`` words) becomes a suffix array in its task; the benchmark is the stated
    query set, sent in blocks of about ``block_words`` words, each of which every shard is searched for. No row is
    shuffled.
    """
    sc = ship(docs.sparkSession).sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(benchmark, item_id, item_text, window, block_words)]
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"]
    kept = [c for c in docs.columns if c not in made]
    flat = docs.select(*[f"`{c}`" for c in kept])
    place = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                shard, n, start = [], 0, at
                while at < len(texts) and (n < shard_words or not shard):
                    shard.append(words(texts[at]))
                    n += len(shard[-1])
                    at += 1
                out = [*_judge([b.value for b in blocks], shard)]
                n_words, n_hit = [len(w) for w in shard], [x[0] for x in out]
                digest = [hashlib.sha256(",".join(map(str, x[1])).encode()).hexdigest() for x in out]
                bad = [h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(start, at - start).columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x[1]) for x in out], pa.int64()), pa.array(digest), pa.array(bad, pa.bool_()),
                    pa.array([x[2] for x in out], _MATCH_ARROW)], names=[*kept, *made])

    schema = T.StructType([*flat.schema.fields])
    for name, kind in zip(made, ["long", "long", "long", "string", "boolean", MATCH], strict=True):
        schema = schema.add(name, kind)
    return flat.mapInArrow(work, schema)


_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
