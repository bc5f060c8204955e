"""Texts as runs between blanks: what tokenizers give for a text is what they give for its runs, one after another."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Letters of ASCII and Latin-1, then marks of ASCII but for the apostrophe: normal already, lower case one by one, and no
#: contraction among them.
_LETTERS, _MARKS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+", rb"[!-&(-/:-@\[-`{-~]*+"
_PLAIN = re.compile(rb"(%b)(%b)" % (_LETTERS, _MARKS))
_SPACE, _LETTER, _MARK, _ELSE = range(4)
_CLASS = np.full(256, _ELSE, np.int8)
_CLASS[[*b" \t\n\r"]] = _SPACE
_CLASS[[b for b in range(33, 127) if re.fullmatch(_MARKS, bytes([b]))]] = _MARK
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_BLANK = _CLASS == _SPACE
#: Second bytes of letters that begin with the byte 0xC3.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Memo(dict):
    """Run (or word) -> value, worked out for many new runs at a time. Grown to ``most`` entries, it keeps the first half:
    frequent runs come early."""

    def __init__(self, work: Callable[[list[bytes]], list], empty, most: int):
        super().__init__()
        self.work, self.empty, self.most = work, empty, most
        self[b""] = empty

    def learn(self, texts) -> None:
        if len(self) > self.most:
            early = dict(islice(self.items(), self.most // 2))
            self.clear()
            self.update(early)
        new = [run for run in set().union(*texts) if run not in self]
        if new:
            self.update(zip(new, self.work(new), strict=True))


def runs(text: bytes | None) -> list[bytes]:
    """The text cut at spaces, tabs and line breaks; runs may be empty, and other white space stays inside them."""
    return text.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" ") if text else []


def cuts(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The runs of all texts (binary, no nulls), plain ones as their lower-cased letters and their marks, as numbers, 0 after
    each text; and what has the numbers 1, 2 and so on. The same may have more than one number."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(body) == 0:
        return np.zeros(len(texts), np.int32), []
    # Cut after every blank, and where texts begin: a piece is a run and the blank after it, if any.
    edge = np.zeros(len(body) + 1, bool)
    edge[1:] = _BLANK[body]
    edge[offsets - offsets[0]] = True
    kind, lower = _kinds(body, edge)
    inner = edge[1:-1]  # whether a byte and the one after it are in different runs
    wrong = kind == _ELSE
    wrong[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK) & ~inner
    run = np.flatnonzero(edge)
    odd = np.logical_or.reduceat(wrong, run[:-1])
    marks = np.flatnonzero((kind[1:] == _MARK) & (kind[:-1] == _LETTER) & ~inner) + 1
    edge[marks[~odd[np.searchsorted(run, marks, "right") - 1]]] = True
    if odd.any():
        lower = np.where(np.repeat(odd, np.diff(run)), body, lower)
    at = np.flatnonzero(edge).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(lower)]).dictionary_encode()
    ends = np.frombuffer(pieces.dictionary.buffers()[1], np.int32)[: len(pieces.dictionary) + 1]
    raw = pieces.dictionary.buffers()[2].to_pybytes()
    bare = ends[1:] - _BLANK[np.frombuffer(raw, np.uint8)[ends[1:] - 1]]
    found = [raw[a:z] for a, z in zip(ends.tolist(), bare.tolist())]
    return np.insert(pieces.indices.to_numpy() + np.int32(1), np.searchsorted(at, offsets[1:] - offsets[0]), 0), found


def _kinds(text: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte the class, and the letters in lower case. A letter of two bytes is not one where ``edge`` parts them."""
    kind = _CLASS[text]
    latin = np.flatnonzero((text[:-1] == 0xC3) & _LATIN[text[1:]])
    if edge is not None:
        latin = latin[~edge[latin + 1]]
    kind[latin] = kind[latin + 1] = _LETTER
    lower = _LOWER[text]
    upper = latin[text[latin + 1] < 0x9F] + 1
    lower[upper] += 0x20
    return kind, lower


def plain(run: bytes) -> list[bytes] | None:
    """The pre-tokens of a run of plain letters and marks, lower-cased; None for any other run."""
    m = _PLAIN.fullmatch(run)
    if not m:
        return None
    at = m.end(1)
    word = run[:at].lower() if run.isascii() else run[:at].decode().lower().encode()
    return [word, run[at:]] if word and at < len(run) else [word or run]


def plains(batch: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Of runs without blanks, one or more, the letters, lower-cased, and the marks, as ``plain`` has them; and, where a run
    isn't plain, both empty and the whole run last."""
    text = np.frombuffer(b" ".join(batch), np.uint8)
    kind, lower = _kinds(text)
    blank = kind == _SPACE
    run = np.cumsum(blank)
    wrong = kind == _ELSE
    wrong[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
    odd = np.zeros(len(batch), bool)
    odd[run[wrong]] = True
    good = ~odd[run]
    words, marks = (lower[blank | (good & (kind == k))].tobytes().split(b" ") for k in (_LETTER, _MARK))
    others = [b""] * len(batch)
    for i in np.flatnonzero(odd).tolist():
        others[i] = batch[i]
    return words, marks, others


def slices(sizes: list[int], most_rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts of at most so many rows and, unless a row alone has more, bytes."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == most_rows or held + n > most_bytes):
            yield at, i - at
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes) - at
