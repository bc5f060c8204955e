"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours, which fill the window of a seed."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from .chunks import Memo, cuts, plains, slices
from .shared import stored

PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Ids:
    """Token ids of runs by the tokenizer's library, as bytes."""

    def __init__(self, file: str, kind: str, most: int):
        from tokenizers import Tokenizer, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        self.library, self.kind = Tokenizer.from_file(file), np.dtype(kind)
        vocab, suffix = self.library.get_vocab(with_added_tokens=True), getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        # For plain words the normalizer changes nothing: these are normal, in lower case and have one blank between them.
        self.plain = Tokenizer.from_file(file)
        self.plain.normalizer = normalizers.Sequence([])
        self.memo = Memo(self._runs, b"", most)

    def of_texts(self, texts: pa.Array, close: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids end, and the ids of all texts, one after another, each text's with ``close`` after them.

        What the texts are cut into is looked up once each, and its ids are then copied to all its places together.
        """
        of, found = cuts(texts)
        values = [*map(self.memo.get, found)]
        new = [i for i, ids in enumerate(values) if ids is None]
        self.memo.learn([[found[i] for i in new]])
        for i in new:
            values[i] = self.memo[found[i]]
        values.insert(0, close)
        copied = pa.array(values, pa.binary()).take(pa.array(of))
        ends = np.frombuffer(copied.buffers()[1], np.int32)[1 : len(of) + 1][of == 0] // self.kind.itemsize
        return ends.astype(np.int64), np.frombuffer(copied.buffers()[2], self.kind, ends[-1])

    def _runs(self, batch: list[bytes]) -> list[bytes]:
        words, marks, others = plains(batch)
        rest = self._texts([run for run in others if run])
        parts = [part for part in {*words, *marks} if part]
        get = {b"": b"", **dict(zip(parts, self._words(parts), strict=True))}.__getitem__
        return [next(rest) if run else get(word) + get(end) if end else get(word) for word, end, run in zip(words, marks, others, strict=True)]

    def _words(self, batch: list[bytes]) -> list[bytes]:
        """Many words in one text: the last id of each ends with the vocabulary's suffix of words, and no other does. Where
        that doesn't tell the words apart, they go one by one."""
        out: list[bytes] = []
        for at in range(0, len(batch), 2000):
            part = batch[at : at + 2000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
                out += [raw[a:z] for a, z in zip(cuts, cuts[1:])]
            else:
                out += self._texts(part)
        return out

    def _texts(self, batch: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(batch), 5000):
            texts = [run.decode("utf-8", "replace") for run in batch[at : at + 5000]]
            for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()


#: What this process has learned, kept for its next tasks, as most words of a task are those of the tasks before it.
_HELD: dict[tuple[str, str, int], _Ids] = {}


def _held(file: str, kind: str, most: int) -> _Ids:
    """The ids learned so far; of one tokenizer at a time, so a process holds no more than a task does."""
    if (file, kind, most) not in _HELD:
        _HELD.clear()
        _HELD[file, kind, most] = _Ids(file, kind, most)
    return _HELD[file, kind, most]


def _tokenised(docs: DataFrame, doc_id: str, text: str, file: str, end: int, vocabulary: int, most_runs: int) -> DataFrame:
    """A row per document: its ids, their number and a min-hash of its neighbouring ids, which brings like texts
    together. At the end of each task one row more: in how many of its documents each id occurs."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    flat = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    close = np.array([end], kind).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _held(file, kind, most_runs)
        frequency = np.zeros(vocabulary, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), b"")
            for at, rows in slices(pc.binary_length(texts).to_pylist(), 4000, 12 << 20):
                ends, flat = ids.of_texts(texts.slice(at, rows), close)
                n = np.diff(ends, prepend=0)
                keys, _ = _distinct(n, flat, vocabulary)
                frequency += np.bincount(keys % vocabulary, minlength=vocabulary)
                offsets = pa.py_buffer((np.append(0, ends) * flat.itemsize).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(_nearest(ends, flat)), pa.array(n), packed, pa.nulls(rows, pa.binary())], names=["doc_id", "near", "n", "ids", "frequency"])
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "near": [None], "n": [None], "ids": [None], "frequency": [frequency.astype("<i8").tobytes()]}, _TOKENISED)

    return flat.mapInArrow(work, "doc_id long, near long, n long, ids binary, frequency binary")


def _nearest(ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest mixture of two neighbouring ids of each document, which is the same for most near copies; 0 for a
    document of one id."""
    a, starts = ids.astype(np.uint64), np.append(0, ends[:-1])
    mixed = np.full(len(a), ~np.uint64(0))
    mixed[:-1] = (a[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(8)  # odd multipliers
    mixed[ends - 1] = ~np.uint64(0)  # the last id of a document has none after it
    return np.where(ends - starts > 1, np.minimum.reduceat(mixed, starts), 0).astype(np.int64)


def _distinct(n: list[int] | np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document * width + id) of documents of n ids each, ascending, and how often each occurs."""
    kind = np.uint32 if len(n) * width < 1 << 32 else np.uint64  # the narrower sorts faster
    keys = np.repeat(np.arange(len(n), dtype=kind) * kind(width), n) + ids.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first].astype(np.int64), np.diff(np.append(first, len(keys)))


_TOKENISED = pa.schema([("doc_id", pa.int64()), ("near", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("frequency", pa.binary())])


def _frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Documents holding each id, over all documents: at most one number for each id of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total += np.frombuffer(b, "<i8")
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = tokens.where("frequency IS NOT NULL").select("frequency").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


class Shard:
    """A BM25 inverted index over the open documents of a shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int, k1: float = 1.2, b: float = 0.75):
        width, n = len(idf), np.fromiter(map(len, ids), np.int64, len(ids))
        pairs, times = _distinct(n, np.concatenate(ids) if ids else np.zeros(0, np.int64), width)
        doc, term = pairs // width, pairs % width
        telling = idf[term] > 0
        doc, term, times = doc[telling], term[telling], times[telling]
        weight = idf[term] * times * (k1 + 1) / (times + k1 * (1 - b + b * n[doc] / max(mean, 1.0)))
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = doc[order], weight[order].astype(np.float32)
        self.terms, self.at = np.unique(term[order], return_index=True)
        self.at = np.append(self.at, len(order))
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.query = []
        for d in range(len(ids)):
            t, w = term[first[d] : first[d + 1]], weight[first[d] : first[d + 1]]
            self.query.append(t if len(t) <= query_terms else t[np.argpartition(-w, query_terms)[:query_terms]])

    def neighbours(self, seed: int, open_: np.ndarray) -> np.ndarray:
        """Open documents that share a query term with the seed, best score first."""
        score = np.zeros(len(open_), np.float32)
        for i in np.searchsorted(self.terms, self.query[seed]):
            a, z = self.at[i], self.at[i + 1]
            score[self.posting[a:z]] += self.weight[a:z]
        found = np.flatnonzero((score > 0) & open_)
        return found[np.argsort(-score[found], kind="stable")]


def fill(docs: list[tuple], idf: np.ndarray, mean: float, window: int, query_terms: int, tail: list[tuple], numbers: Iterator[int], last: bool) -> tuple[list[tuple], list[tuple]]:
    """Pieces (document, start, length, sequence, offset) of full sequences, and what is left for the next shard.

    A document is (id, ids, start). Whole windows of long documents are sequences of their own. A seed's neighbours
    join it in the order of their score; the one that no longer fits is cut, and its rest stays open. When a window's
    neighbours run out, the next seed joins it. The last rest is cut at powers of two, which need no padding.
    """
    pieces, open_docs = [], []
    for doc, ids, start in [*tail, *docs]:
        while len(ids) - start >= window:
            pieces.append((doc, ids, start, window, next(numbers), 0))
            start += window
        if start < len(ids):
            open_docs.append([doc, ids, start])
    left = np.array([len(d[1]) - d[2] for d in open_docs], np.int64)
    shard = Shard([d[1][d[2] :] for d in open_docs], idf, mean, query_terms)
    is_open = np.ones(len(open_docs), bool)
    held: list[tuple[int, int, int]] = []  # (document, start, length) in the window being filled
    used, rest = 0, int(left.sum())

    def close() -> None:
        sequence, offset = next(numbers), 0
        for d, start, n in held:
            pieces.append((open_docs[d][0], open_docs[d][1], start, n, sequence, offset))
            offset += n
        held.clear()

    def take(d: int) -> None:
        nonlocal used, rest
        n = int(min(left[d], window - used))
        held.append((d, open_docs[d][2], n))
        open_docs[d][2] += n
        left[d] -= n
        is_open[d] = left[d] > 0
        used, rest = used + n, rest - n

    cut = -1
    while used + rest >= window:
        # A document that was cut goes on as the next seed, else the first one still open.
        seed = cut if cut >= 0 and is_open[cut] else int(np.argmax(is_open))
        for d in [seed, *shard.neighbours(seed, is_open).tolist()]:
            if used == window:
                break
            if is_open[d]:
                take(d)
        if used == window:
            cut, used = held[-1][0], 0
            close()
    over = [(open_docs[d][0], open_docs[d][1], s, n) for d, s, n in held]
    over += [(d[0], d[1], d[2], int(n)) for d, n in zip(open_docs, left, strict=True) if n]
    if not last:
        # Pieces of an unfinished window go back to their documents' rests.
        back: dict[int, tuple] = {}
        for doc, ids, start, _ in over:
            k = id(ids)
            back[k] = (doc, ids, min(start, back[k][2]) if k in back else start)
        return pieces, [*back.values()]
    total = sum(o[3] for o in over)
    queue = [list(o) for o in over]
    while total:
        size, sequence, offset = 1 << (total.bit_length() - 1), next(numbers), 0
        while offset < size:
            doc, ids, start, n = queue[0]
            n = min(n, size - offset)
            pieces.append((doc, ids, start, n, sequence, offset))
            offset += n
            queue[0][2] += n
            queue[0][3] -= n
            if not queue[0][3]:
                queue.pop(0)
        total -= size
    return pieces, []


def pack(docs: DataFrame, file: str, end: int, doc_id: str = "doc_id", text: str = "text", window: int = 4096,
         shard_tokens: int = 1_500_000, query_terms: int = 16, most_runs: int = 800_000) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text by the tokenizer ``file``, without added tokens, then ``end``. Every id is
    in exactly one piece; a sequence has ``window`` ids or a power of two, so nothing is padded. Null and empty texts
    are documents of one id. Rows with equal or null ids are packed one by one. Other columns are ignored. No rows,
    no pieces.

    Ids are written once to the shared folder; documents then go to tasks by ranges of (min-hash, id), which keep
    near copies together and split a large group of them over tasks. A task reads its range in shards of about
    ``shard_tokens`` ids, so its memory doesn't grow with the range. BM25 takes document frequencies from all
    documents: one number for each id of the vocabulary, which bounds what is sent to the tasks.
    """
    from tokenizers import Tokenizer

    spark = ship(docs.sparkSession)
    vocabulary = Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = stored(_tokenised(docs, doc_id, text, file, end, vocabulary, most_runs), "tokens")
    frequency = _frequencies(tokens, vocabulary)
    rows = tokens.where("frequency IS NULL").select("doc_id", "near", "n", "ids")
    n_docs, n_ids = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Ids in half of the documents or more tell nothing apart and get no weight.
    idf = np.maximum(np.log((n_docs - frequency + 0.5) / (frequency + 0.5)), 0)
    sent = spark.sparkContext.broadcast((idf, n_ids / max(n_docs, 1)))
    n = max(1, -(-n_ids // (3 * shard_tokens)))
    dealt = rows.repartitionByRange(n, "near", "doc_id").sortWithinPartitions("near", "doc_id", F.crc32("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = sent.value
        numbers = count(TaskContext.get().partitionId() << 40)
        tail: list[tuple] = []
        held, size = [], 0

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            crc = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for _, ids, s, n, _, _ in pieces]
            columns = [[p[0] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], crc, [len(p[1]) for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", *_NAMES])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(ids, kind), 0))
                size += len(held[-1][1])
                if size >= shard_tokens:
                    pieces, tail = fill(held, weights, mean, window, query_terms, tail, numbers, False)
                    held, size = [], 0
                    yield out(pieces)
        pieces, _ = fill(held, weights, mean, window, query_terms, tail, numbers, True)
        yield out(pieces)

    return dealt.select("doc_id", "ids").mapInArrow(work, f"doc_id long, {PIECE}")
