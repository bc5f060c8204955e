"""Language of text by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship

_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; whatever has a letter has a word."""
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))] if text else []


def observations(word: str, lexicon: dict[str, int], slots: int) -> list[int]:
    """Hashed affixes and n-grams of a word, and its place in the lexicon if it has one."""
    w = f"<{word}>".encode()
    out = {zlib.crc32(w[i : i + n]) % slots for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} if len(w) <= 64 else {zlib.crc32(w[:5]) % slots}
    for n in (2, 3, 4):
        out.add(zlib.crc32(b"^" + w[: n + 1]) % slots)
        out.add(zlib.crc32(b"$" + w[-n - 1 :]) % slots)
    if (at := lexicon.get(word)) is not None:
        out.add(slots + at)
    return [*out]


def _crc_table() -> np.ndarray:
    """What a byte of state becomes in a step of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def observed(some: list[str], lexicon: dict[str, int], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """observations of many words, laid end to end (each word's ascending), and their numbers.

    One pass over all bytes a length: the hash of the n bytes from each place is that of n - 1 with one byte more.
    """
    raw = [f"<{word}>".encode() for word in some]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw) + bytes(5), np.uint8).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(raw)), sizes)
    room = np.repeat(first + sizes, sizes) - np.arange(len(word))  # bytes from a place to its word's end
    every = np.repeat(sizes <= 64, sizes)
    owners, found = [], []

    def take(owner: np.ndarray, state: np.ndarray) -> None:
        owners.append(owner)
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(slots))

    state = np.full(len(word), 0xFFFFFFFF, np.uint32)
    for n in (1, 2, 3, 4):
        state = _crc_step(state, text[n - 1 : n - 1 + len(word)])
        fits = every & (room >= n)
        take(word[fits], state[fits])
    long = np.flatnonzero(sizes > 64)
    take(long, _crc_step(state[first[long]], text[first[long] + 4]))
    mine = np.arange(len(raw))
    for mark in b"^$":
        opened = _crc_step(np.full(len(raw), 0xFFFFFFFF, np.uint32), np.uint32(mark))
        for width in (3, 4, 5):
            n = np.minimum(sizes, width)
            at, state = first if mark == ord("^") else first + sizes - n, opened
            for i in range(width):
                state = np.where(i < n, _crc_step(state, text[at + i]), state)
            take(mine, state)
    known = np.fromiter((lexicon.get(w, -1) for w in some), np.int64, len(some))
    owners.append(np.flatnonzero(known >= 0))
    found.append(known[known >= 0] + slots)
    width = slots + len(lexicon)
    kind = np.uint32 if len(some) * width < 1 << 32 else np.int64  # the narrower sorts faster
    keys = np.concatenate(owners).astype(kind) * kind(width) + np.concatenate(found).astype(kind)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    owner = keys // kind(width)
    return (keys - owner * kind(width)).astype(np.int64), np.bincount(owner.astype(np.int64), minlength=len(some))


@dataclass
class Chain:
    """labels, lexicon, a weight for each observation and label, start and transition weights."""

    labels: list[str]
    lexicon: dict[str, int]
    slots: int
    weight: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        seen = observations(word, self.lexicon, self.slots)
        return self.weight[seen].sum(0) / np.sqrt(len(seen))

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over a batch (rows x longest x labels, padded): the posterior of each word's label."""
        rows, longest, k = emissions.shape
        near = np.exp(emissions - emissions.max(2, keepdims=True))
        move = np.exp(self.step - self.step.max())
        ahead, back = np.empty_like(near), np.ones_like(near)
        a = near[:, 0] * np.exp(self.start - self.start.max())
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, longest):
            a = (ahead[:, t - 1] @ move) * near[:, t]
            ahead[:, t] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            b = (back[:, t + 1] * near[:, t + 1]) @ move.T
            b /= b.sum(1, keepdims=True)
            back[:, t] = np.where((t + 1 < sizes)[:, None], b, 1.0)
        p = ahead * back
        return p / p.sum(2, keepdims=True)


def train(rows: list[tuple[list[str], str]], slots: int = 1 << 16, lexicon_words: int = 4000, length: int = 48, epochs: int = 3, seed: int = 11) -> Chain | None:
    """Fit on (words, label of all of them) rows; None without labels.

    A training sequence is a stretch of one row, or of two rows of different labels one after the other, so that
    transitions are learned from texts that switch as well as from texts that don't. Adagrad on the likelihood.
    """
    labels = sorted({label for _, label in rows})
    rows = [(w, labels.index(label)) for w, label in rows if w]
    if not rows:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    lexicon = {w: i for i, (w, _) in enumerate(sorted(Counter(w for ws, _ in rows for w in ws).items(), key=lambda x: (-x[1], x[0]))[:lexicon_words])}
    chain = Chain(labels, lexicon, slots, np.zeros((slots + len(lexicon), k)), np.zeros(k), np.zeros((k, k)))
    seen: dict[str, list[int]] = {}
    squares, step_squares = np.full_like(chain.weight, 1e-2), np.full((k, k), 1e-2)

    def stretch(i: int, n: int) -> tuple[list[str], list[int]]:
        ws, label = rows[i]
        at = int(rng.integers(0, max(1, len(ws) - n + 1)))
        part = ws[at : at + n]
        return part, [label] * len(part)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = []
            for i in order[at : at + 64]:
                if rng.random() < 0.3:
                    a, b = stretch(i, length // 2), stretch(int(rng.integers(len(rows))), length // 2)
                    batch.append((a[0] + b[0], a[1] + b[1]))
                else:
                    batch.append(stretch(i, length))
            sizes = np.array([len(w) for w, _ in batch])
            flat = [w for ws, _ in batch for w in ws]
            for w in flat:
                if w not in seen:
                    seen[w] = observations(w, lexicon, slots)
            counts = np.array([len(seen[w]) for w in flat])
            index, owner = np.concatenate([seen[w] for w in flat]).astype(np.int64), np.repeat(np.arange(len(flat)), counts)
            scale = 1 / np.sqrt(counts)
            first = np.cumsum(counts) - counts
            e = np.add.reduceat(chain.weight[index], first) * scale[:, None]
            inside = np.arange(sizes.max()) < sizes[:, None]
            padded = np.zeros((len(batch), sizes.max(), k))
            padded[inside] = e
            p = chain.marginals(padded, sizes)
            truth = np.zeros_like(p)
            truth[inside] = np.eye(k)[[y for _, ys in batch for y in ys]]
            wrong = (p - truth)[inside] * scale[:, None]
            slots_hit, place = np.unique(index, return_inverse=True)
            g = np.stack([np.bincount(place, wrong[owner, c], len(slots_hit)) for c in range(k)], 1) / len(batch) + 1e-5 * chain.weight[slots_hit]
            squares[slots_hit] += g * g
            chain.weight[slots_hit] -= 0.3 * g / np.sqrt(squares[slots_hit])
            # Expected against seen transitions; the pair's posterior is its parts' product renormalised by the step.
            both = p[:, :-1, :, None] * p[:, 1:, None, :] * np.exp(chain.step)
            both /= both.sum((2, 3), keepdims=True)
            pairs = inside[:, 1:, None, None]
            h = ((both - truth[:, :-1, :, None] * truth[:, 1:, None, :]) * pairs).sum((0, 1)) / len(batch) + 1e-4 * chain.step
            step_squares += h * h
            chain.step -= 0.1 * h / np.sqrt(step_squares)
    return chain


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", train_rows: int = 3000) -> Chain | None:
    """A chain from at most ``train_rows`` labelled rows, those of the lowest text hashes; null labels and texts are left out.

    At most 400 words from the middle of each come to the driver; the chain is a few megabytes. None without rows.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("y")).where("y IS NOT NULL AND text IS NOT NULL")
    key = F.xxhash64("text")
    bound = rows.select(key.alias("k")).orderBy("k").limit(train_rows).agg(F.max("k"), F.count("*")).first()
    sample = rows.where(key <= F.lit(bound[0])) if bound[1] == train_rows else rows

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                w = words(t)
                at = max(0, len(w) // 2 - 200)
                found.append(" ".join(w[at : at + 400]))
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1), batch.column(2)], names=["words", "y", "k"])

    got = sample.select("text", "y", key.alias("k")).mapInArrow(middle, "words string, y string, k long").orderBy("k", "words", "y").limit(train_rows).toArrow()
    pairs = zip(got.column("words").to_pylist(), got.column("y").to_pylist(), strict=True)
    return train([(w.split(" ") if w else [], y) for w, y in pairs])


class _Tagger:
    def __init__(self, chain: Chain, most: int):
        self.chain, self.most = chain, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.chain.labels)))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The posterior of each word of each text."""
        if len(self.at) > self.most:
            self._clear()
        new = list({w for ws in texts for w in ws if w not in self.at})
        if new:
            found = []
            for at in range(0, len(new), 20_000):
                flat, counts = observed(new[at : at + 20_000], self.chain.lexicon, self.chain.slots)
                found.append(np.add.reduceat(self.chain.weight[flat], np.cumsum(counts) - counts) / np.sqrt(counts)[:, None])
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *found])
        out: list[np.ndarray] = [np.zeros((0, len(self.chain.labels)))] * len(texts)
        order = sorted((i for i, ws in enumerate(texts) if ws), key=lambda i: len(texts[i]))
        lo = 0
        while lo < len(order):
            # Texts of like length together; the padded batch stays small where they are long.
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(texts[order[hi]]) <= 400_000:
                hi += 1
            part = order[lo:hi]
            sizes = np.array([len(texts[i]) for i in part])
            padded = np.zeros((len(part), sizes.max(), len(self.chain.labels)))
            for r, i in enumerate(part):
                padded[r, : sizes[r]] = self.table[np.fromiter(map(self.at.__getitem__, texts[i]), np.int64, sizes[r])]
            p = self.chain.marginals(padded, sizes)
            for r, i in enumerate(part):
                out[i] = p[r, : sizes[r]]
            lo = hi
        return out


def identify(docs: DataFrame, chain: Chain | None, text: str = "text", most_words: int = 300_000, spans: bool = False) -> DataFrame:
    """Every row with lang_pred and score: the label with the largest mean posterior over all words, and that mean.

    Whole texts are labelled word by word, so code-switched ones too; with ``spans`` the column ``lang_spans`` lists
    the stretches of one label as (lang, first word, words). Null texts, texts without a letter, and every text if
    there is no chain, are ``und`` with score 0 and no spans. Columns of these names are replaced; repeated rows stay.
    Nothing is shuffled; the chain is a few megabytes, sent once to each executor.
    """
    sc = ship(docs.sparkSession).sparkContext
    sent = sc.broadcast(chain)
    made = ["lang_pred", "score", *(["lang_spans"] if spans else [])]
    kept = [c for c in docs.columns if c not in made]
    flat = docs.select(*[f"`{c}`" for c in kept])
    place = kept.index(text)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tagger = _Tagger(model, most_words) if model else None
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                said = [words(t) for t in part.column(place).to_pylist()]
                found = tagger.label(said) if tagger else [np.zeros((0, 1))] * len(said)
                mean = [p.mean(0) if len(p) else None for p in found]
                lang = [model.labels[int(m.argmax())] if m is not None else UNDETERMINED for m in mean]
                score = [min(1.0, float(m.max())) if m is not None else 0.0 for m in mean]
                columns = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array([_stretches(p, model) for p in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    schema = T.StructType([*flat.schema.fields]).add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("lang_spans", T.ArrayType(T.StructType().add("lang", "string").add("first_word", "integer").add("n_words", "integer")))
    return flat.mapInArrow(work, schema)


def _stretches(p: np.ndarray, model: Chain | None) -> list[dict]:
    if not len(p):
        return []
    best = p.argmax(1)
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return [{"lang": model.labels[best[a]], "first_word": int(a), "n_words": int(n)} for a, n in zip(first, np.diff(np.append(first, len(best))), strict=True)]
