"""Phrase collocations from one kind of window: the longest, padded at the end of its piece, whose prefixes are summed."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from .shared import stored

#: A-Z to lower case, tabs to spaces, and every mark or break that ends a piece to a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: The words of the longest window, each the lead of the one before; empty past the end of a piece.
_LEADS = ["w1", "w2", "w3", "w4"]
_BITS = 26
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("body")).where("body IS NOT NULL")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes, int]]:
    """(lang, folded text, how far windows may start) in blocks of about ``size`` bytes: texts of one lang together, or a
    part of a long one, which reaches three words past where the next part starts."""
    held: dict[str, list[bytes]] = {}
    total: Counter = Counter()
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body, at = body.as_py().translate(_FOLD), 0
            while len(body) - at > size:
                end = _word_end(body, at + size)
                past = end
                for _ in range(3):
                    past = _word_end(body, _word_start(body, past))
                yield lang, body[at:past], end - at
                at = end
            held.setdefault(lang, []).append(body[at:])
            total[lang] += len(body) - at
            if total[lang] > size:
                block = b"\n".join(held.pop(lang))
                total[lang] = 0
                yield lang, block, len(block)
    for lang, parts in held.items():
        block = b"\n".join(parts)
        yield lang, block, len(block)


def _word_end(body: bytes, at: int) -> int:
    ends = [e for e in (body.find(b" ", at), body.find(b"\n", at)) if e >= 0]
    return min(ends, default=len(body))


def _word_start(body: bytes, at: int) -> int:
    while at < len(body) and body[at] in b" \n":
        at += 1
    return at


def _spread(h: np.ndarray, lang: str) -> np.ndarray:
    """Hashes told apart by lang, all of whose bits depend on all others."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(zlib.crc32(lang.encode()))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _pairs(lang: str, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the block's words start, hashes of these, which of them has a lead in its piece, and hashes of those pairs (of
    all words but the last)."""
    text = np.frombuffer(block, np.uint8)
    solid = (text != 32) & (text != 10)
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if len(start) == 0:
        return start, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    inside = np.arange(len(text)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(text)]])))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((end - start).max()), _PRIME))
        value = np.zeros(len(text), np.uint64)
        value[solid] = (text[solid].astype(np.uint64) + np.uint64(1)) * power[inside[solid]]
        word = np.add.reduceat(value, start)
        pair = (word[:-1] ^ (word[:-1] >> np.uint64(29))) * _PRIME + word[1:]
    piece = np.cumsum(text == 10)[start]
    return start, _spread(word, lang), piece[:-1] == piece[1:], _spread(pair, lang)


def _bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return bits[slot >> 6] >> (slot & 63) & 1 == 1


def _longer(lang: str, word: np.ndarray, led: np.ndarray, pair: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For phrases of three and of four words: which words start one whose pairs all may be frequent, and its hash."""
    n = len(word)
    on = np.zeros(n + 3, bool)
    on[: len(pair)] = led & _bit(bits, pair)
    ahead = np.concatenate([word, np.zeros(3, np.uint64)])
    with np.errstate(over="ignore"):
        three = _spread(np.append(pair, np.uint64(0))[:n] * _PRIME + ahead[2 : n + 2], lang + " 3")
        four = _spread(three * _PRIME + ahead[3 : n + 3], lang + " 4")
    return [(on[:n] & on[1 : n + 1], three), (on[:n] & on[1 : n + 1] & on[2 : n + 2], four)]


def _counted(rows: DataFrame, hashes, least: int, size: int, most: int, name: str) -> DataFrame:
    """(h, n): the hashes that ``hashes`` (of lang, block, limit) gives, ``least`` times or more over all texts. Tasks merge
    counts until they hold ``most`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([s[1] for s in seen]), len(h)).astype(np.int64)

        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for lang, block, limit in _blocks(batches, size):
            seen.append(np.unique(hashes(lang, block, limit), return_counts=True))
            if sum(len(s[0]) for s in seen) > most:
                seen[:] = [merged()]
                if len(seen[0][0]) > most // 2:
                    yield out(*seen.pop())
        if seen:
            yield out(*merged())

    return stored(rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


def _bitmap(counts: DataFrame, bits: np.ndarray | None = None) -> np.ndarray:
    """A bit for each hash, in 2^26 bits, whatever their number."""
    slot = F.col("h").bitwiseAND(F.lit((1 << _BITS) - 1))
    words = counts.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros((1 << _BITS) // 64, np.int64) if bits is None else bits.copy()
    out[words["at"].to_numpy()] |= words["bits"].to_numpy()
    return out


def frequent_phrases(rows: DataFrame, least: int, share: float = 0.001, size: int = 1 << 20, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A bit for every hash that words and phrases of two to four words with ``least`` occurrences have, in 2^26 bits; and the
    hashes of words and pairs that make up more than ``share`` of all, at most 1 / share.

    Tasks count by a 64-bit hash, words and pairs first, then longer phrases of which all pairs may be frequent. The
    bits can only let too much pass: what they let pass is counted exactly by its words, so neither a chance meeting of
    hashes nor a corpus that fills all bits changes a result.
    """
    ship(rows.sparkSession)

    def short(lang: str, block: bytes, limit: int) -> np.ndarray:
        start, word, led, pair = _pairs(lang, block)
        begins = start < limit
        return np.concatenate([word[begins], pair[led & begins[:-1]]])

    counts = _counted(rows, short, least, size, most, "pair-hashes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > share * total).orderBy(F.desc("n"), "h").limit(int(1 / share)).collect()
    pairs = _bitmap(counts)
    sent = rows.sparkSession.sparkContext.broadcast(pairs)

    def long(lang: str, block: bytes, limit: int) -> np.ndarray:
        start, word, led, pair = _pairs(lang, block)
        return np.concatenate([h[goes & (start < limit)] for goes, h in _longer(lang, word, led, pair, sent.value)])

    return _bitmap(_counted(rows, long, least, size, most, "phrase-hashes"), pairs), np.array([r["h"] for r in hot], np.int64)


def windows(rows: DataFrame, bits: np.ndarray, hot: np.ndarray, size: int = 1 << 20, most: int = 500_000) -> DataFrame:
    """lang, w1 to w4, salt, n: for every word of the texts (lang, body) the window that it starts, and how often.

    A window goes on with the words' leads in their piece as long as ``bits`` let its pairs pass and it itself, and is
    padded from there: no phrase past that place can be frequent. Words that can't be frequent themselves are one
    row without any. A task counts until it holds ``most`` windows, so
    a line that a third of all texts repeat is a few rows a task. ``salt`` tells the windows of a hot first pair apart
    by their third word; it is 0 for others.
    """
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((bits, np.sort(hot)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = sent.value

        def out(lang: str, counted: Counter, hots: set[bytes]) -> Iterator[pa.RecordBatch]:
            found = sorted(counted.items())
            for at in range(0, len(found), 65536):
                part = found[at : at + 65536]
                leads = [(w.split(b" ") + [b"", b"", b""])[:4] for w, _ in part]
                salts = [zlib.crc32(w[2]) + 1 if hots and b" ".join([lang.encode(), *w[:2]]) in hots else 0 for w in leads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), *[pa.array(c, pa.binary()) for c in zip(*leads, strict=True)], pa.array(salts, pa.int64()), pa.array([n for _, n in part], pa.int64())],
                    names=["lang", *_LEADS, "salt", "n"])

        # Words alone are few and come again in every block; windows are handed out when there are many.
        held: dict[str, Counter] = {}
        alones: dict[str, Counter] = {}
        rare: Counter = Counter()
        hots: set[bytes] = set()
        for lang, block, limit in _blocks(batches, size):
            start, word, led, h = _pairs(lang, block)
            words, begins = block.split(), start < limit
            one = np.zeros(len(start), bool)
            one[: len(h)] = led & _bit(bits, h)
            three, four = (goes & _bit(bits, own) for goes, own in _longer(lang, word, led, h, bits))
            reach = 1 + one.astype(np.int64) + three + (three & four)
            counted = held.setdefault(lang, Counter())
            alone, known = begins & ~one, _bit(bits, word)
            rare[lang] += int((alone & ~known).sum())
            alones.setdefault(lang, Counter()).update(compress(words, (alone & known).tolist()))
            at = np.nonzero(begins & one)[0]
            counted.update(b" ".join(words[i : i + k]) for i, k in zip(at.tolist(), reach[at].tolist(), strict=True))
            if len(hot) and len(h):
                hots |= {b" ".join([lang.encode(), *words[i : i + 2]]) for i in np.nonzero(led & np.isin(h.view(np.int64), hot))[0].tolist()}
            for counters, pairs in ((held, hots), (alones, set())):
                if sum(map(len, counters.values())) > most:
                    for each in sorted(counters):
                        yield from out(each, counters[each], pairs)
                    counters.clear()
        for counters, pairs in ((held, hots), (alones, set())):
            for each in sorted(counters):
                yield from out(each, counters[each], pairs)
        for each, n in sorted(rare.items()):
            yield from out(each, Counter({b"": n}), set())

    counted = rows.mapInArrow(count, "lang string, " + ", ".join(f"{w} binary" for w in _LEADS) + ", salt long, n long")
    return counted.select("lang", *[F.col(w).cast("string").alias(w) for w in _LEADS], "salt", "n")


def phrase_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, w1 to w4 and a: the count of every phrase of 1 to 4 words that occurs ``least`` times or more, null after its
    last word; and of each lang, with no words, the count of all its words.

    A window is cut, and padded, where it isn't frequent: the windows of its lang and first two words tell that, so all of
    them are in one place (those of a hot pair by their third word, and they keep both words). This is the one shuffle
    of windows; what ROLLUP then sums over shorter and shorter prefixes is small.
    """
    dealt = rows.repartition("lang", "w1", "w2", "salt")

    def within(*words: str) -> Column:
        return F.sum("n").over(W.partitionBy("lang", "w1", "w2", "salt", *words))

    told = dealt.withColumn("f4", within("w3", "w4")).withColumn("f3", within("w3")).withColumn("f2", within())
    cut = told.select("lang", "w1", F.when((F.col("f2") >= least) | (F.col("salt") > 0), F.col("w2")).otherwise("").alias("w2"),
                      F.when(F.col("f3") >= least, F.col("w3")).otherwise("").alias("w3"), F.when(F.col("f4") >= least, F.col("w4")).otherwise("").alias("w4"), "n")
    padded = cut.groupBy("lang", *_LEADS).agg(F.sum("n").alias("n"))
    sums = padded.rollup("lang", *_LEADS).agg(F.sum("n").alias("a"), F.grouping_id().alias("rolled"))
    # The last word that isn't summed over must be one, not padding; rolled is 31 over all, 15 of a lang.
    last = F.when(F.col("rolled") == 7, F.col("w1")).when(F.col("rolled") == 3, F.col("w2")).when(F.col("rolled") == 1, F.col("w3")).when(F.col("rolled") == 0, F.col("w4"))
    return sums.where((F.col("rolled") == 15) | ((last != "") & (F.col("a") >= least))).select("lang", *_LEADS, "a")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, absorbed: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of 2 to 4 words of each lang.

    Texts are lower-cased (A-Z), split at marks and line breaks into pieces and these at spaces and tabs into words; a
    phrase lies within a piece, and overlapping occurrences count. a is a phrase's count (``least`` or more), n that of
    all words of its lang; l and r are the counts of the two parts of the cut with the lowest score, 2000000 * a / (l +
    r) rounded down (the first such cut). A phrase inside a longer one that occurs at least ``absorbed`` % as often is left
    out. By score, then a, both descending, then phrase in byte order. A null lang is ``und``; null and empty texts,
    and empty tables, give nothing; repeated rows count again; other columns are ignored. All sums are exact; products
    are taken in 38 digits.
    """
    rows = _texts(documents, text, lang)
    bits, hot = frequent_phrases(rows, least)
    counts = stored(phrase_counts(windows(rows, bits, hot), least), "phrase-counts")
    all_words = counts.where("w1 IS NULL").select("lang", F.col("a").alias("n"))
    words = F.filter(F.array(*_LEADS), lambda w: w.isNotNull())
    found = counts.where("w1 IS NOT NULL").select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "a")
    phrases = stored(found.where(F.size("words") > 1), "phrases")
    part = found.select("lang", "phrase", "a")

    # Every cut of every candidate finds both of its parts among the counts, as they are at least as frequent.
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = phrases.select("lang", "phrase", "a", "words", k.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    exact = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)"))
    scored = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Shorter phrases inside each longer candidate, whether that one is left out itself or not.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))))
    around = phrases.where(F.size("words") > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.expr(
        f"longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(20,0)) < CAST({absorbed} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0))"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
