"""Line dedup, near-duplicates, embeddings, packing and the pipeline against brute force on small tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallysheaf.llm import chunks, embedding_dedup, line_dedup, near_duplicates, packing, shared

FILE = public_tokenizers.path("word_bpe_49k.json")


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.random()
        if kind < 0.34:
            text[at] = rng.choice("abé")
        elif kind < 0.67:
            del text[at]
        else:
            text.insert(at, rng.choice("abé"))
    return "".join(text)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (3, 4), (300, 200)], "src long, dst long")
    got = {r.id: r.component for r in shared.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert shared.components(edges.limit(0)).isEmpty()


def test_banded_distance(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(30, 60))) for _ in range(20)]
    pairs = [(a, edited(rng, a, rng.randint(0, 4))) for a in texts for _ in range(6)] + [("", ""), ("", "ab"), ("ab", "abc"), ("abc", "xyz")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i for r in line_dedup.within(df, "a", "b", 2).collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= 2}


def line_fixture():
    rng = random.Random(2)
    family = ["".join(rng.choices("abcdé ", k=rng.randint(32, 48))) for _ in range(10)]
    lines = [edited(rng, f, rng.randint(0, 3)) for f in family for _ in range(5)]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(16)]
    return [*docs, (16, None), (17, ""), (18, "short\n\nshort"), (19, docs[0][1]), (20, "x" * 9000), (21, "x" * 9001), (21, "x" * 9001), (None, docs[1][1])]


def line_classes_by_force(docs, least=32):
    places = [(i if i is not None else -1, k, line) for i, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    links = [(a, b) for b in range(len(places)) for a in range(b) if len(places[a][2]) >= least and len(places[b][2]) >= least
             and abs(len(places[a][2]) - len(places[b][2])) <= 2 and (places[a][2] == places[b][2] or (len(places[a][2]) < 100 and distance(places[a][2], places[b][2]) <= 2)
             or places[a][2] + "x" == places[b][2])]
    root = union_find(len(places), links)
    first = {}
    for at, r in enumerate(root):
        first[r] = min(first.get(r, places[at][:2]), places[at][:2])
    return {(p[0], p[1]): first[r] for p, r in zip(places, root, strict=True)}


def test_line_classes_against_brute_force(spark):
    docs = line_fixture()
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, line_no int, h string")
    rows = line_dedup.line_classes(frame).collect()
    none = lambda x: -1 if x is None else x
    got = {(none(r.doc_id), r.line_no): (none(r.class_doc_id), r.class_line_no) for r in rows}
    want = line_classes_by_force(docs)
    assert got == want
    assert all(r.kept == (got[none(r.doc_id), r.line_no] == (none(r.doc_id), r.line_no)) for r in rows)
    kept = {none(r.doc_id): r for r in line_dedup.dedup_lines(frame).collect()}
    for i, t in docs:
        i = none(i)
        if t is None or t == "":
            assert kept[i].text == t
            continue
        left = [line for k, line in enumerate(t.split("\n")) if want[i, k] == (i, k)]
        assert (kept[i].text if i in kept else None) == ("\n".join(left) if left else None)
    assert line_dedup.line_classes(frame.limit(0)).isEmpty()


def test_segment_keys_find_every_line_within_two_edits(spark):
    """Eleven keys a line, of fixed-width characters: each line two edits away shares one that either of the two owns."""
    rng = random.Random(7)
    line = "".join(rng.choice("abcdeßé日👩") for _ in range(34))
    near = {line}
    for p in range(35):
        for q in range(35):
            near.add((line[:p] + "+" + line[p:])[: q + 1] + (line[:p] + "+" + line[p:])[q + 2 :])
            near.add((line[:p] + "+" + line[p:])[:q] + "-" + (line[:p] + "+" + line[p:])[q:])
            near.add((line[:p] + "+" + line[p + 1 :])[:q] + "-" + (line[:p] + "+" + line[p + 1 :])[q + 1 :])
            near.add(line[:p] + line[p + 1 :][:q] + line[p + 1 :][q + 1 :])
    lines = spark.createDataFrame([(t,) for t in sorted(near)], "line string").select("line", line_dedup.wide(F.col("line")).alias("wide"))
    keys = {r.line: dict(sorted(r.keys)) for r in lines.select("line", line_dedup.segment_keys(F.col("wide"), F.char_length("line"), 2).alias("keys")).collect()}
    assert {len(k) for k in keys.values()} == {11}
    mine = keys[line]
    assert all(any(mine[k] or k_own for k, k_own in other.items() if k in mine) for other in keys.values())


def test_short_lines_of_one_text_are_one_class(spark):
    long = "a line of more than thirty-two characters"
    docs = [(1, f"menu\n{long}\n\nmenu"), (2, f"Menu\nmenu\n{long}!"), (2, f"Menu\nmenu\n{long}!"), (3, "\nmenu"), (None, "Menu"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in line_dedup.line_classes(frame, short_copies=True).collect()}
    menu, title, blank = (1, 0), (None, 0), (1, 2)
    want = {(1, 0): menu, (1, 1): (1, 1), (1, 2): blank, (1, 3): menu, (2, 0): title, (2, 1): menu, (2, 2): (1, 1), (3, 0): blank, (3, 1): menu, (None, 0): title}
    assert got == {at: (*head, at == head) for at, head in want.items()}
    texts = lambda **kw: sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(frame, **kw).where("text IS NOT NULL").collect())
    assert texts() == [(0, "Menu"), (1, docs[0][1]), (2, "Menu\nmenu"), (2, "Menu\nmenu"), (3, "\nmenu")]
    assert texts(drop_short_copies=True) == [(0, "Menu"), (1, f"menu\n{long}\n")]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    line = " ".join(word() for _ in range(14))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(90)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(line + "\n" + " ".join(copy))
    return [*texts, texts[0].upper(), texts[3], None, "", " \t\n", "one two", "ONE\x0btwo", "one two three", "q " * 3000, "q " * 4000]


def test_near_duplicates_against_brute_force(spark):
    texts = near_fixture()
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, sig string, n int")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == {i: (len(s), root) for i, (s, root) in enumerate(zip(sets, union_find(len(sets), links), strict=True))}
    twice = frame.where("doc_id < 2").unionByName(frame.where("doc_id = 1"))
    assert near_duplicates.near_duplicates(twice).count() == 3
    assert near_duplicates.near_duplicates(frame.limit(0)).isEmpty()


def test_sets_cost_few_bytes_beside_their_shingles(spark):
    """With more parts than a set has shingles, each is alone in its part: 9 bytes for the set there, 12 for its size."""
    r = random.Random(3)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(304)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, text binary")
    blocks = near_duplicates._blocks(docs, 50_000, 5).where("sig IS NULL")
    sent = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in blocks.dtypes if kind == "binary")
    assert blocks.agg(F.sum(sent)).first()[0] <= 30 * (300 * 15 + 12)


def test_long_runs_of_one_set_are_entries_of_a_byte():
    owner, key = np.repeat([4, 4, 7], [600, 255, 1]), np.repeat([0, 1, 1], [600, 255, 1])
    starts, lengths = near_duplicates._entries(owner, key)
    assert starts.tolist() == [0, 255, 510, 600, 855] and lengths.tolist() == [255, 255, 90, 255, 1]


def test_sets_of_several_hundred_shingles_in_one_part(spark):
    """Two parts, and far more than 255 shingles of a set in each."""
    r = random.Random(5)
    words = [str(r.randrange(10**6)) for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[:2900]), " ".join(words[::-1]), " ".join(words)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {row[0]: (row[1], row[2]) for row in near_duplicates.near_duplicates(docs).collect()}
    assert got == {0: (2996, 0), 1: (2896, 0), 2: (2996, 2), 3: (2996, 0)}


def test_only_shingles_that_sets_near_in_size_share_stay_open(spark):
    r = random.Random(9)
    rows = {(r.randrange(60), s, n, r.randrange(n * 3 // 4, n + 1), r.randrange(6)) for s in range(300) for n in [r.choice([8, 10, 13, 40, 300])]}
    rows |= {(99, 1000, 10, 10, 1), (99, 1001, 300, 300, 2)}  # of two components, but far apart in size
    placed = spark.createDataFrame([*rows], "token long, sig long, n long, rest long, component long")
    kept = {tuple(x) for x in near_duplicates._open(placed, 75).select("token", "sig", "n", "rest", "component").collect()}

    def near(a, b):
        return a[0] == b[0] and a[4] != b[4] and 100 * a[2] >= 75 * b[2] and 100 * b[2] >= 75 * a[2] and 175 * min(a[3], b[3]) >= 75 * (a[2] + b[2])

    assert kept >= {a for a in rows if any(near(a, b) for b in rows)}
    assert not any(x[0] == 99 for x in kept) and len(kept) < len(rows)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [base[i % 30] + 0.12 * rng.standard_normal(16) for i in range(200)] + [base[0] + 0.02 * rng.standard_normal(16) for _ in range(90)]
    vectors = [v.tolist() for v in rows] + [rows[5].tolist(), (rows[5] * 2).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate([*vectors, *odd])], "vec_id long, embedding array<double>, key int")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = [(a, b) for a, b in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()] + [(len(vectors) + 6, len(vectors) + 7)]
    n, root = np.zeros(len(vectors) + len(odd), int), union_find(len(vectors) + len(odd), links)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    found, true = sum(r.n_links for r in got.values()), n.sum()
    assert 0.97 * true <= found <= true
    assert sum(got[i].component_id == root[i] for i in got) >= 0.98 * len(got)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(len(vectors), len(vectors) + 6))
    assert got[len(vectors) + 7].component_id == len(vectors) + 6
    assert embedding_dedup.near_vectors(frame.limit(0)).isEmpty()


def test_isolated_pairs_of_vectors_are_found_or_the_audit_fails(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((800, 64))
    side -= (side * x[:800]).sum(1, keepdims=True) * x[:800]
    near = 0.905 * x[:800] + (1 - 0.905**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(np.r_[x, near].tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(frame, leaf=8).collect()}
    assert sum(got[3000 + i] == i for i in range(800)) >= 0.93 * 800
    assert all(got[i] == i for i in range(3000))
    with pytest.raises(RuntimeError, match="trees find"):
        embedding_dedup.near_vectors(frame, leaf=8, most_trees=4)


def test_ids_of_runs_learned_together_are_the_librarys():
    runs = [b"it's", b"\xff\xfe", b"<|endoftext|>", b"a<|endoftext|>", b"--", b"<|", b"x''", b"'", b"A^~`", b"\xc3\x97a", b"\xc3\x9f!",
            "CAFÉ##".encode(), b"x" * 50_000 + b"1", b"'s", b"foo_bar", b"foo_", "ﬁ".encode(), b"word###", b"Word$$$", b"12", b"(a)", b"a)."]
    words, marks, others = chunks.plains([*runs, b""])
    assert dict(zip(runs, others))[b"word###"] == b"" and (words[runs.index(b"Word$$$")], marks[runs.index(b"Word$$$")]) == (b"word", b"$$$")
    for run, word, mark, other in zip([*runs, b""], words, marks, others, strict=True):
        assert chunks.plain(run) == (None if other else [word, mark] if word and mark else [word or mark])
    ids = packing._Ids(FILE, "<u2", 1000)
    ids.memo.learn([runs, [b""]])
    library = Tokenizer.from_file(FILE)
    assert all(np.frombuffer(ids.memo[r], "<u2").tolist() == library.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids for r in runs)
    assert ids._words([b"one", b"two words", b"three"])[1] == b"".join(ids._words([b"two", b"words"]))


def test_ids_of_texts_cut_together_are_the_librarys():
    texts = [b"skipped", b"", b"The END.the end", b" \t\r\n", "CAFÉ## é, Ärger!\tßÄ\n(a) it's 12".encode(), b"x\xc3", b"\x80y", b"end\xc3", b"\xa9 A\xc3", b"!a", b"B", b"!!", b"",
             "ﬁ 日本 <|endoftext|>a a<| foo_bar foo_ \x1cx\xa0y".encode(), b"A\n", b"word### Word$$$ word###"]
    whole = pa.array(texts, pa.binary())
    library = Tokenizer.from_file(FILE)
    want = [[*library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2] for t in texts]
    ids = packing._Ids(FILE, "<u2", 1000)
    for part in (slice(1, None), slice(1, 2), slice(1, 4), slice(5, 11), slice(0, 3)):
        ends, flat = ids.of_texts(whole[part], np.array([2], "<u2").tobytes())
        assert [a.tolist() for a in np.split(flat, ends)[:-1]] == want[part]
        near = packing._nearest(ends, flat).tolist()
        for n, w in zip(near, want[part], strict=True):
            mixed = [((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) % (1 << 64)) >> 8 for a, b in zip(w, w[1:])]
            assert n == min(mixed, default=0)


def test_a_process_keeps_the_ids_it_learned():
    texts, asked = pa.array([b"alpha, beta gamma!", b"Beta delta"], pa.binary()), []
    ids = packing._held(FILE, "<u2", 1000)
    ids._words = lambda batch, work=ids._words: asked.extend(batch) or work(batch)
    first = ids.of_texts(texts, b"")
    again = packing._held(FILE, "<u2", 1000).of_texts(texts, b"")
    assert sorted(asked) == [b"!", b",", b"alpha", b"beta", b"delta", b"gamma"] and (first[1] == again[1]).all()
    assert packing._held(FILE, "<u2", 999) is not ids and len(packing._HELD) == 1


def test_slices_hold_so_many_rows_or_bytes():
    assert [*chunks.slices([], 2, 10)] == [] and [*chunks.slices([1, 1, 1], 2, 10)] == [(0, 2), (2, 1)]
    assert [*chunks.slices([4, 7, 30, 0, 3], 9, 10)] == [(0, 1), (1, 1), (2, 1), (3, 2)]


def check_pieces(pieces, texts, window):
    library = Tokenizer.from_file(FILE)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    spans, sequences = {}, {}
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        spans.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, all_ in ids.items():
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == len(all_)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0


def test_packing_round_trip_and_neighbours(spark):
    rng = random.Random(5)
    topics = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(30)] for _ in range(8)]
    texts = [(i, " ".join(rng.choices(topics[i % 8], k=rng.randint(5, 60)))) for i in range(160)]
    texts += [(160, None), (161, ""), (162, "<|endoftext|> x\x1cy é́ 日本"), (163, "long " * 3000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    pieces = packing.pack(frame, FILE, 2, window=256, shard_tokens=20_000).collect()
    check_pieces(pieces, texts, 256)
    together = {}
    for p in pieces:
        if p.doc_id < 160:
            together.setdefault(p.sequence_id, set()).add(p.doc_id % 8)
    mixed = [s for s in together.values() if len(s) > 0]
    assert sum(len(s) for s in mixed) / len(mixed) < 3  # by chance a window would hold three topics and more
    assert packing.pack(frame.limit(0), FILE, 2).isEmpty()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    stems = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(stems, k=n))
    passage = prose(20)
    docs = {i: prose(60) + "\n" + prose(60) for i in range(120)}
    toxic = {i for i in docs if i % 6 == 0}
    for i in toxic:
        docs[i] += " " + rng.choice(["idiot", "scum"]) + " moron trash"
    line = prose(55)
    for i in (1, 2, 3):
        docs[i] = line + "\n" + docs[i]
    docs[120] = docs[7]  # an exact copy
    near = docs[8].replace("\n", " ").split(" ")
    near[10], near[70] = "changed", "words"
    docs[121] = " ".join(near)  # a near copy, as one line
    docs[13] += "\n" + passage
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    was = frame
    out = {}
    for name in list(stages)[:-1]:
        was = shared.stored(stages[name](spark, was, str(tmp_path)), "stage")
        assert was.columns == frame.columns
        out[name] = {r.doc_id: r.text for r in was.collect()}
    assert set(out["toxicity"]) == set(docs) - toxic
    dedup = out["line dedup"]
    assert dedup[1] == docs[1] and dedup[2] == docs[2].split("\n", 1)[1] and dedup[3] == docs[3].split("\n", 1)[1]
    assert set(dedup) == set(out["toxicity"]) - {120}
    assert set(out["n-gram Jaccard join"]) == set(dedup) - {121}
    assert set(out["benchmark decontamination"]) == set(dedup) - {121, 13}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(pieces, out["benchmark decontamination"].items(), 4096)
