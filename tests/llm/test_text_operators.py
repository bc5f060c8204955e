"""Chat formatting, URL filters, toxicity, language, token counts and decontamination against plain Python."""

import hashlib
import json
import random
import re
import tracemalloc

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallysheaf.llm import chat, decontaminate, language, token_counts, toxicity, url_filter

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n\t", "x" * 40_000, "it's They'RE 's <|endoftext|>b<|ENDOFTEXT|> 12", "ﬁ İ Σας é́ 日本語 👩‍👩 ..,,!!", "aaaa aaaa aaaa"]


def docs_of(spark, texts):
    """Rows with repeats, and a column named like one that operators make."""
    rows = [(i, t, "kept", -1.0) for i, t in enumerate([*texts, *texts[-1:]])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double")


def test_token_counts_match_the_library(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, ODD), FILE, limit=3).collect()}
    library = Tokenizer.from_file(FILE)
    for i, t in enumerate([*ODD, ODD[-1]]):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit, got[i].source) == (n, len((t or "").encode()), n > 3, "kept")


def test_merging_survives_a_forgetful_memo(spark):
    random.seed(1)
    texts = [" ".join("".join(random.choices("abcthe", k=random.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    got = token_counts.token_counts(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), FILE, most_runs=10).collect()
    library = Tokenizer.from_file(FILE)
    assert [r.n_tokens for r in sorted(got)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            for q in range(len(words) - k + 1):
                if words[q : q + k] == w[p : p + k]:
                    hit |= set(range(q, q + k))
                    found.add(item_id)
    return len(words), len(hit), found


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_decontamination_against_brute_force(spark, block):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(random.choices(vocabulary, k=n))) for i, n in enumerate([30, 20, 13, 4, 2, 1, 0])]
    items += [(7, None), (0, items[0][1])]
    texts = [None, "", ".,!", "W1 " * 5000, " ".join(random.choices(vocabulary, k=60))]
    texts += [" ".join(random.choices(["z", *vocabulary], k=20)) + " " + items[i % 3][1].upper() + " z" * (i * 20) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, texts), bench, shard_words=50, block_words=block).collect()}
    for i, t in enumerate([*texts, texts[-1]]):
        n, hit, found = brute_hits(t, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(found), digest)
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
        for m in got[i].matches:
            ws = brute_words(t)[m.doc_word : m.doc_word + m.n_words]
            assert ws == brute_words(dict(items)[m.item_id])[m.item_word : m.item_word + m.n_words]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_decontamination_without_a_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(docs_of(spark, ["a b", None]), bench).collect()} == {0}


RECORDS = [
    {"messages": [{"role": "user", "content": "</s>[INST] ok [/INST] \\ | <|end|>"}, {"role": "assistant", "content": "a\nb"}], "id": 3},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "<|turn|>assistant<|text|>"}]},
    {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "input": "this", "output": "done"},
    {"system": "be kind", "prompt": "p", "response": "r"}, {"question": "q", "answer": "a"},
]


def test_layouts_format_and_read_back(spark):
    rows = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(RECORDS)], "i int, record string, turns string")
    turns = chat.canonical_turns(rows)
    got = [[(t.role, t.text) for t in r.turns] for r in turns.orderBy("i").collect()]
    assert got[0] == [("user", RECORDS[0]["messages"][0]["content"]), ("assistant", "a\nb")]
    assert got[1] == [("user", "q"), ("assistant", "<|turn|>assistant<|text|>")]
    assert got[2] == [("user", "do"), ("assistant", "done")] and got[3][1] == ("user", "this")
    assert got[4][0] == ("system", "be kind") and got[5] == [("user", "q"), ("assistant", "a")]
    back = chat.read_back(chat.format_turns(turns)).orderBy("i").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in back] == got
    assert [r.loss_texts for r in back] == [[text for role, text in g if role == "assistant"] for g in got]
    control = re.compile(r"</s>|\[INST\]|\[/INST\]")
    assert not any(control.search(r.formatted) for r in back)
    assert all(r.formatted.count("<|turn|>") == len(g) for r, g in zip(back, got, strict=True))


def test_unknown_layouts_are_named_not_guessed(spark):
    rows = spark.createDataFrame([("{",), (None,), ('{"a": 1}',), ('{"messages": [{"role": "user"}]}',), ('{"messages": 3}',)], "record string")
    assert [r.turns for r in chat.canonical_turns(rows).collect()] == [None] * 5


def test_conversation_rows_in_order(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 0, None, "x"), (2, None, "user", "")]
    records = chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(records).collect()}
    assert got == {1: [("user", "a"), ("user", "b"), ("assistant", "")], None: [("", "x")], 2: [("user", "")]}


def test_url_rules_and_trees(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.ORG/es/a?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://a.com/fr/x",
            "http://acom/fr/x", "http://org", "x://a.net?q=1/2", "http://a.net/" + "z" * 5000, "http://a.net/1", "http://a.net/1"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://good{i}.net/a", 0) for i in range(60)] + [(f"http://cheap-pills{i}.xyz/a?b=1&c=2", 1) for i in range(60)] + [(None, 1), ("u", None)], "url string, bad int")
    out = url_filter.url_filter(frame, labelled, allow=["org/", "com/fr/"], block=["example.org/es/", "example.org/en/1"])
    got = {r.page_id: r for r in out.collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 3, 9)] == [("", "")] * 3 + [("www.example.org", "/es/a"), ("a.net", "")]
    assert [got[i].rule for i in range(3, 10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, None]
    assert [got[i].verdict for i in range(3, 7)] == ["block", "block", "allow", "allow"]
    assert all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in got.values())
    probe = spark.createDataFrame([("http://good7.net/a",), ("http://cheap-pills7.xyz/a?b=1&c=2",)], "url string")
    assert [r.verdict for r in url_filter.url_filter(probe, labelled).orderBy("url").collect()] == ["block", "allow"]
    assert url_filter.url_filter(probe, labelled.where("bad = 0")).where("verdict = 'block'").isEmpty()
    assert url_filter.url_filter(frame.limit(0), labelled.limit(0)).isEmpty()


def prose(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def test_toxicity_learns_stems_and_spares_the_clean(spark):
    rng = random.Random(4)
    plain = [f"stem{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        text = prose(rng, plain, 40) + (" " + prose(rng, ["grobnik", "plurk"], 3) if bad else "")
        rows.append((i, text, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.where("doc_id >= 200"))
    scored = toxicity.toxicity(docs_of(spark, [r[1] for r in rows[:200]]), model)
    got = {r.doc_id: r for r in scored.collect()}
    assert all(got[i].predicted == rows[i][2] for i in range(200))
    odd = toxicity.toxicity(docs_of(spark, ODD), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert toxicity.toxicity(docs_of(spark, ODD), toxicity.fit(frame.limit(0))).where("predicted = 1").isEmpty()
    assert toxicity.fit(frame.where("toxic = 0")).score({"=idiot"}) > 0.5


def test_toxicity_is_learned_from_rows_that_come_one_by_one():
    """The training rows are never held together as words; a mark of the classifier is a byte a row, not eight."""
    def rows():
        r = random.Random(2)
        for i in range(3000):
            y = i % 10 == 0
            yield [f"w{i % 20}x{r.randrange(400)}" for _ in range(40)] + [f"bad{r.randrange(60)}word"] * y, int(y)

    tracemalloc.start()
    model = toxicity.train(rows())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    same = toxicity.train([*rows()])
    assert model.weight == same.weight and model.bias == same.bias and len(model.weight) > 20
    assert most < 45_000_000


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    chain = language.Chain(["a", "b"], {}, 4, np.zeros((4, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    e = rng.normal(size=(2, 4, 2))
    sizes = np.array([4, 3])
    got = chain.marginals(e.copy(), sizes)
    for row, n in enumerate(sizes):
        p = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=n):
            w = np.exp(chain.start[path[0]] + sum(e[row, t, s] for t, s in enumerate(path)) + sum(chain.step[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                p[t, s] += w
        assert np.allclose(got[row, :n], p / p.sum(1, keepdims=True))


def test_observations_of_many_words_at_once():
    words = ["a", "ab", "aaaa", "straße", "日本語", "x" * 62, "x" * 63, "ab" * 40, "日本" * 30, "der", "é"]
    lexicon = {"der": 0, "日本語": 1, "ab": 3, "other": 2}
    for slots in (1 << 16, 97):
        found, counts = language.observed(words, lexicon, slots)
        ends = counts.cumsum()
        parts = [found[z - n : z].tolist() for z, n in zip(ends, counts, strict=True)]
        assert parts == [sorted(language.observations(w, lexicon, slots)) for w in words] and ends[-1] == len(found)


def test_language_held_out_and_code_switched(spark):
    rng = random.Random(5)
    make = {"xa": ["thoun", "wher", "ingre"], "yb": ["chkeit", "ungzu", "pfver"]}
    text = {k: [prose(rng, v, 30) for _ in range(80)] for k, v in make.items()}
    rows = [(t, k) for k, ts in text.items() for t in ts[:60]] + [("nothing", None)]
    chain = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    held = [(i, t, k) for k, ts in text.items() for i, t in enumerate(ts[60:])]
    out = language.identify(spark.createDataFrame(held, "i int, text string, lang string"), chain).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)
    mixed = text["xa"][70] + " " + text["yb"][70]
    spans = language.identify(docs_of(spark, [mixed]), chain, spans=True).first().lang_spans
    assert [s.lang for s in spans] == ["xa", "yb"] and abs(spans[1].first_word - 30) <= 1
    odd = language.identify(docs_of(spark, [*ODD, "123 !?", "²"]), chain).collect()
    assert [r.lang_pred == "und" for r in sorted(odd)] == [True, True, True, False, False, False, False, True, True, True]
    assert {r.lang_pred for r in language.identify(docs_of(spark, ODD), None).collect()} == {"und"}
