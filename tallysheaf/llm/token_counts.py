"""Token counts of whole texts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from .chunks import Memo, plain, runs

#: Byte-level vocabularies write bytes that don't print as the characters from U+0100 on, in order.
_PRINT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BESIDE = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
_SYMBOLS = [_BESIDE.get(b, chr(b)) for b in range(256)]
_BYTE = {ord(c): b for b, c in enumerate(_SYMBOLS)}
_NONE = np.iinfo(np.int32).max


class Merger:
    """Counts the symbols that a BPE vocabulary leaves of pre-tokens."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.symbol = np.array([self.vocab[c] for c in _SYMBOLS], np.int64)
        self.last = np.array([self.vocab[c + end] for c in _SYMBOLS], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.width = max(self.vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.words = Memo(self._merge, 0, 400_000)

    def pretokens(self, run: bytes) -> tuple[list[bytes], int]:
        """The pre-tokens of a run as bytes, and how many special tokens stand between them."""
        if found := plain(run):
            return found, 0
        text, special = run.decode("utf-8", "replace"), 0
        parts = [text]
        if self.cut and self.cut.search(text):
            parts, special = self.cut.split(text), len(self.cut.findall(text))
        out = []
        for part in filter(None, parts):
            normal = self.library.normalizer.normalize_str(part)
            out += [p.translate(_BYTE).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out, special

    def counts(self, batch: list[bytes]) -> list[int]:
        """Tokens of each run."""
        cut = [self.pretokens(run) for run in batch]
        self.words.learn([p for p, _ in cut])
        get = self.words.__getitem__
        return [special + (get(p[0]) if len(p) == 1 else sum(map(get, p))) for p, special in cut]

    def _merge(self, words: list[bytes]) -> list[int]:
        """Surviving symbols of each word, all words at once: per round, every word applies its lowest-rank pair."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, last = self.symbol[raw], np.cumsum(sizes) - 1
        ids[last] = self.last[raw[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        result = sizes.copy()
        while len(ids):
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(least, np.diff(np.append(starts, len(ids))))) & (rank != _NONE)
            # Of touching matches (a a a) every second one counts, from the left.
            place = np.arange(len(ids))
            fresh = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(fresh, place, 0))
            hit &= (place - run) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            np.subtract.at(result, word[hit], 1)
            # Words without a pair left are done.
            going = np.zeros(len(words), bool)
            going[word[starts[least != _NONE]]] = True
            keep &= going[word]
            ids, word = ids[keep], word[keep]
        return result.tolist()


def token_counts(docs: DataFrame, file: str, text: str = "text", limit: int = 2048, most_runs: int = 700_000) -> DataFrame:
    """Every row without its text, with n_bytes (UTF-8), n_tokens and over_limit beside its other columns (which they
    replace on a clash).

    ``file`` is a tokenizer file whose model is BPE. No begin, end or added tokens, no truncation or padding; special
    strings in a text count as the library's default has it: one token each. Null text counts as empty: 0 and 0.
    Nothing is shuffled; a worker keeps the counts of at most ``most_runs`` distinct runs, then starts over.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    flat = docs.select(F.col(f"`{text}`").cast("binary").alias("__text"), *[f"`{c}`" for c in kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(file)
        memo = Memo(merger.counts, 0, most_runs)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                raw = part.column(0).to_pylist()
                cut = [runs(t) for t in raw]
                memo.learn(cut)
                n = pa.array([sum(map(memo.__getitem__, r)) for r in cut], pa.int64())
                size = pa.array([len(t or b"") for t in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], size, n], names=[*kept, "n_bytes", "n_tokens"])

    schema = flat.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long")
    return flat.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
