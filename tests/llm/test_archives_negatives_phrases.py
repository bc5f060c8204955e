"""Archives, hard negatives and collocations against brute force and round trips on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheaf.llm import collocations, hard_negatives, shared, warc

# ---- archives ------------------------------------------------------------------------------------------------------

MAGIC = "WARC/1.0\r\n"
LONG = "a" * 1500
PAGES = [
    (1, "http://a/x", LONG), (2, "http://b/ WARC/1.0\r\n", LONG), (9, "u", LONG), (9, "u", LONG), (None, "n", LONG),
    (3, None, None), (4, "", ""), (5, "é", MAGIC + "Content-Length: 0\r\n\r\n\r\n\r\n"),
    (6, "u", "x\r\n\r\n" + MAGIC + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + MAGIC), (7, "u", "\r\n" * 50 + "WARC/1.0"), (8, "u", "é\n" * 9000),
    (10, "u", ("\r\n\r\n" + MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\n") * 90),
]


def expected(rows):
    top = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            top[body] = max(top.get(body, -1), -1 if page is None else page)
    for page, _, html in rows:
        body = (html or "").encode()
        refers = top[body] if body in top and page != top[body] else None
        yield page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers, True


def archived(spark, rows, parts=2):
    # Columns named like those that the operator makes.
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, payload string").repartition(parts)
    folder = f"{shared.shared_folder(spark)}/archive-{random.random()}"
    warc.write_warc(warc.with_revisits(pages), folder)
    return folder


def files(folder):
    import glob

    return {f: open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/part-*"))}


@pytest.mark.parametrize("split", [1 << 25, 3000])
def test_pages_come_back_whatever_their_payloads_hold(spark, split):
    folder = archived(spark, PAGES)
    got = [tuple(r) for r in warc.page_payloads(warc.read_warc(spark, folder, split)).collect()]
    assert sorted(got, key=str) == sorted(expected(PAGES), key=str)
    assert warc.chains(spark, folder, split)[1].count() == 0


def test_random_pieces_of_records_as_payloads(spark):
    rng = random.Random(3)
    bits = [MAGIC, "\r\n", "\n", "W", "Content-Length: 12\r\n", "abc", "x" * 200, "\r\n\r\n" + MAGIC + "Content-Length: 5\r\n\r\n"]
    rows = [(i, f"http://h/{i}", "".join(rng.choices(bits, k=rng.randrange(14)))) for i in range(60)]
    got = [tuple(r) for r in warc.page_payloads(warc.read_warc(spark, archived(spark, rows, 1), 2500)).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_files_hold_records_by_their_lengths(spark):
    """A plain reader, one record after another, finds the same records in the files."""
    folder = archived(spark, PAGES)
    plain = []
    for body in files(folder).values():
        at = 0
        while at < len(body):
            assert body.startswith(MAGIC.encode(), at)
            end = body.index(b"\r\n\r\n", at) + 4
            n = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", body[at:end])[1])
            assert body[end + n : end + n + 4] == b"\r\n\r\n"
            plain.append((at, re.search(rb"WARC-Type: (\w+)", body[at:end])[1].decode()))
            at = end + n + 4
    got = warc.read_warc(spark, folder, 2500).select("offset", "type").collect()
    assert sorted(map(tuple, got)) == sorted(plain)


def test_a_broken_chain_is_told_and_what_lies_before_it_is_read(spark):
    folder = archived(spark, [(i, "u", f"page {i} " * 30) for i in range(20)], 1)
    (name, body), = files(folder).items()
    places = sorted(r.offset for r in warc.read_warc(spark, folder).collect())
    bad = f"{folder}-bad"
    import os

    os.mkdir(bad)
    length = body.index(b"Content-Length: ", places[12]) + 16
    open(f"{bad}/a.warc", "wb").write(body[:length] + b"9" + body[length + 1 :])  # a wrong length
    open(f"{bad}/b.warc", "wb").write(body[: places[-1] + 300])                   # cut off in its last record
    open(f"{bad}/c.warc", "wb").write(b"not an archive\r\n\r\n" + body)
    open(f"{bad}/d.warc", "wb").write(b"")
    for split in (1 << 25, 1500):
        got = Counter(r.file[-6:-5] for r in warc.read_warc(spark, bad, split).select("file").collect())
        breaks = {r.file[-6:-5]: r.offset for r in warc.chains(spark, bad, split)[1].collect()}
        assert got["a"] in (12, 13) and got["b"] == len(places) - 1 and got["c"] == got["d"] == 0
        assert breaks["a"] > places[12] and breaks["b"] >= places[-1] and breaks["c"] == 0 and len(breaks) == 3


def test_no_pages_no_records(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{shared.shared_folder(spark)}/archive-{random.random()}"
    warc.write_warc(warc.with_revisits(empty), folder)
    assert warc.page_payloads(warc.read_warc(spark, folder)).count() == 0


# ---- hard negatives -------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchor, positives=5, negatives=3):
    v = {}
    for i, e, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None), key=lambda r: (r[0], r[2], r[1])):
        if all(x is not None and np.isfinite(x) for x in e):
            v.setdefault(i, (label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    out = set()
    for a in filter(anchor, v):
        kin, e = v[a]
        scored = sorted((-sum(p * q for p, q in zip(e, f)), b, label) for b, (label, f) in v.items() if b != a and len(f) == len(e))
        for s, p, _ in [x for x in scored if x[2] == kin][:positives]:
            inside = [x for x in scored if x[2] != kin and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out |= {(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)}
    return out


@pytest.mark.parametrize("shard_bytes,members,step", [(16 << 20, 256, 1024), (4000, 3, 7)])
def test_negatives_against_brute_force(spark, shard_bytes, members, step):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), int(rng.integers(4))) for i in range(160)]  # many ties
    rows += [(200 + i, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 3)).tolist(), i % 4) for i in range(60)]
    rows += [(300, [0.0] * 6, 1), (301, [float("nan")] * 6, 1), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (303, None, 1), (304, [1.0] * 6, None), (None, [1.0] * 6, 1),
             (305, [], 1), (306, [], 2), (307, [2.0] * 3, 1), (308, [2.0] * 3, 1), (309, [1.5] * 3, 2), (310, [1e6, -1e6, 3.5e5, 0.0, 1e6, 1e6], 1), (311, [1e6] * 6, 2), rows[5], rows[5], (7, [9.0] * 6, 3)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, score int")
    got = hard_negatives.hard_negatives(table, F.col("id") % 5 == 0, shard_bytes=shard_bytes, members=members, step=step).collect()
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_negatives_of_empty_tables_and_of_one_row(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(50, [1.0, 0.0], 1)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") % 50 == 0).count() == 0


def test_walks_end_before_the_end_of_the_list():
    """Where vectors have clear directions, few candidates are scored."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32)) * 100
    x = np.floor(np.repeat(centres, 500, 0) + rng.standard_normal((10_000, 32)))
    shard = {"ids": np.arange(10_000), "labels": np.arange(10_000) % 3, "x": x, "size": np.linalg.norm(x, axis=1)}
    asked, whole = [], hard_negatives._scores
    hard_negatives._scores = lambda q, y: asked.append(len(y)) or whole(q, y)
    try:
        hard_negatives._walk_positives(shard, x[:8], np.arange(8), shard["labels"][:8], 5, 500)
    finally:
        hard_negatives._scores = whole
    assert sum(asked) <= 2000


# ---- collocations ----------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, absorbed, top):
    counts = {}
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            f = counts.setdefault("und" if lang is None else lang, Counter())
            f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in kept.items():
            s, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            around = [q for q in kept if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * kept[q] >= absorbed * a for q in around):
                rows.append((-s, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}
    return out


TEXTS = [(None, "en"), ("", "en"), (" \t. ,", "en"), ("The END.the end\x0bthe end, THE\tend of; the end of all\r\nÄ ä Ä", None), ("und so weiter und so weiter", "und"),
         ("a b c d " * 3000, "de"), ("new york city hall\n" * 40 + "new york\n" * 5, "de"), ("one\x1ctwo\x1fthree\xa0four one\x1ctwo\x1fthree\xa0four", "")]


@pytest.mark.parametrize("size,share,bits", [(4 << 20, 0.001, 26), (60, 0.01, 26), (700, 0.9, 7)])
def test_phrases_against_brute_force(spark, monkeypatch, size, share, bits):
    """In blocks of a few words, with many hot pairs; and with so few bits that nearly every pair passes."""
    rng = random.Random(2)
    rows = TEXTS + [(" ".join(rng.choice(["x1", "x2", "x3", "X4", ",", "é"]) for _ in range(rng.randrange(200))), rng.choice(["en", "fr", None])) for _ in range(40)]
    table = spark.createDataFrame([(t, lang, 1, "w") for t, lang in rows], "text string, lang string, n int, w1 string").repartition(3)
    phrases, windows = collocations.frequent_phrases, collocations.windows
    monkeypatch.setattr(collocations, "_BITS", bits)
    monkeypatch.setattr(collocations, "frequent_phrases", lambda r, least: phrases(r, least, share, size, 100))
    monkeypatch.setattr(collocations, "windows", lambda r, b, hot: windows(r, b, hot, size, 100))
    for least, absorbed, top in ((3, 80, 2000), (30, 80, 7)):
        got = collocations.collocations(table, least=least, absorbed=absorbed, top=top).collect()
        want = brute_phrases(rows, least, absorbed, top)
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_only_frequent_words_and_pairs_go_on(spark):
    rows = collocations._texts(spark.createDataFrame([("a b c " * 400 + "d e", "en"), ("f g", "de")], "text string, lang string"), "text", "lang")
    bits, hot = collocations.frequent_phrases(rows, 30)
    assert sum(int(b).bit_count() for b in bits.view(np.uint64)) == 12 and len(hot) == 6
    found = {(r.lang, r.w1, r.w2, r.w3): r.n for r in collocations.windows(rows, bits, hot).collect()}
    assert found[("de", "", "", "")] == 2 and found[("en", "", "", "")] == 2 and ("de", "f", "g", "") not in found
    assert found[("en", "c", "", "")] == 1 and found[("en", "a", "b", "c")] > 300
