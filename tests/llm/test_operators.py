"""The operators against brute force on small tables, with nulls, blanks, ties, repeated rows and empty tables."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linewarden.llm import decontaminate, mixture, nearjoin, quality, queries, repeats, templates, tokens, toolcalls, toxicity, urlrules
from linewarden.session import work_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(spark, rows, schema):
    folder = work_folder(spark, "fixture")
    spark.createDataFrame(rows, schema).repartition(3, "doc_id" if "doc_id" in schema else schema.split()[0]).write.parquet(folder)
    return spark.read.parquet(folder)


def prose(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + rng.choice(["a", "é", "x,", "."]) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(25)]
    texts = [None, "", "  \n", "one two", "one two", "ONE two", *base, base[3], base[3], base[7]]
    for b in base[:12]:
        words = b.split(" ")
        for _ in range(3):
            w = list(words)
            for _ in range(rng.randint(1, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["new", "Word", "zz"])
            texts.append(" ".join(w))
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, rng.randint(0, 40)) for _ in range(12)]
    texts += ["ab" * 300, "x" * 199, "x" * 200, "y" * 450, "\x00" * 250, "\x00" * 240 + "a", "q" + "\x00" * 230]
    return [(i, t) for i, t in enumerate(texts)]


def clashing(df, *names):
    """The frame with columns that are named like results."""
    for n in names:
        df = df.withColumn(n, F.lit("old"))
    return df


# -- repeated strings ------------------------------------------------------------------------------------------


def brute_repeats(rows):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed, monkeypatch):
    rows = [*corpus(seed), (500, "same id " * 40), (500, "same id " * 40)]
    docs = clashing(stored(spark, rows, "doc_id long, text string"), "n_bytes", "n_spans")
    got = repeats.remove_repeats(docs)
    found = sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert found == brute_repeats(rows)
    empty = stored(spark, [], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0


def test_merged_shards_are_the_sorted_suffixes():
    import numpy as np

    rng = np.random.default_rng(3)
    n = 700
    key = rng.integers(0, 4, n)
    right = np.zeros((n, repeats.SIDE), np.uint8)
    length = rng.integers(0, repeats.SIDE + 1, n)
    for k in range(n):
        right[k, : length[k]] = rng.integers(0, 2, length[k]) * (rng.random() < 0.5)
    shards = [k + repeats.shard_order(key[k : k + 50], right[k : k + 50], length[k : k + 50]) for k in range(0, n, 50)]
    order, common = repeats.merge_shards(key, right, length, shards)
    strings = [(int(key[k]), bytes(right[k, : length[k]])) for k in order]
    padded = [(a, b.ljust(repeats.SIDE, b"\x00"), len(b)) for a, b in strings]
    assert padded == sorted(padded)
    for k in range(1, n):
        (a, x), (b, y) = strings[k - 1], strings[k]
        expected = -1 if a != b else next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert common[k] == expected


# -- benchmark passages ----------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def test_decontaminate(spark):
    rows = corpus(5)
    items = [(1, rows[10][1]), (2, rows[-12][1]), (3, None), (4, ""), (5, "one two"), (6, "never here at all my friend"), (7, rows[12][1]), (7, rows[12][1])]
    docs = stored(spark, rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.find_items(docs, benchmark).select("doc_id", "item_id", "n_shingles", "n_common").collect()}
    expected = set()
    for d, t in rows:
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        for i, item in items:
            q = shingles(item)
            n = len(next(iter(q))) if q else 1
            common = len(q & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
            if q and 100 * common >= 75 * len(q):
                expected.add((d, i, len(q), common))
    assert got == expected and len(got) > 8
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {e[0] for e in expected}
    assert decontaminate.find_items(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_items(docs, benchmark.limit(0)).count() == 0


# -- tool calls ------------------------------------------------------------------------------------------------


HELD = """
import random, re
import numpy as np
import pyarrow as pa
from linewarden.llm import decontaminate, nearjoin

def memory():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

rng = random.Random(1)
words = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(k) for k in range(5000)]
texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(8000)])
ids = pa.array(np.arange(len(texts)))
bitmap = np.packbits(np.arange(decontaminate.BITMAP_BITS) % 1000 == 0, bitorder="little").tobytes()
for batch, made in [
    (pa.record_batch([ids, texts], ["row", "text"]), decontaminate._grams((1, 5), bitmap)),
    (pa.record_batch([ids, texts], ["place", "text"]), nearjoin._sets(type("Sent", (), {"value": b"\\xff" * (nearjoin.SLOTS // 8)}))),
]:
    pa.default_memory_pool().release_unused()
    before = memory()
    rows = sum(b.num_rows for b in made(iter([batch])))
    print(rows, memory() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads the process's memory from /proc")
def test_tasks_give_back_what_they_took():
    """Workers outlive their stages, so what a task keeps lies beside the memory of the next ones."""
    got = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=ROOT)
    for line in got.stdout.splitlines():
        rows, held = map(int, line.split())
        assert rows and held < 25, got.stdout


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", None, "search", '{"query":"x \\"y\\"","limit":3}'),
            (1, 3, "b", "a", "search", '{"limit":"3"}'),
            (1, 5, "c", "b", "search", '{"query":"q","limit":1,"more":[1,{"b":2,"a":1}]}'),
            (1, 7, "c", None, "search", "{}"),
            (1, 9, None, None, "search", "{}"),
            (2, 1, "x", "y", "check", '{"strict":true,"text":"t"}'),
            (2, 3, "y", "x", "check", "broken"),
            (2, 5, "z", "gone", "none", None),
        ],
        "conv_id long, turn long, call_id string, after string, tool string, arguments string",
    )
    results = spark.createDataFrame(
        [(1, 2, "a", "ok\n"), (1, 4, "a", "late"), (1, 6, "c", None), (1, 8, None, "n"), (2, 2, "q", "nobody")],
        "conv_id long, turn long, call_id string, content string",
    )
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, field string, type string, required boolean")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == calls.count() + results.count() - 2
    assert (got[1, 1].status, got[1, 1].level, got[1, 1].errors) == ("linked", 0, "")
    assert got[1, 1].json == '{"arguments":{"limit":3,"query":"x \\"y\\""},"id":"a","name":"search","result":"ok\\n"}'
    assert (got[1, 3].status, got[1, 3].level, got[1, 3].errors) == ("missing", 1, "missing query;type limit")
    assert (got[1, 5].level, got[1, 5].errors) == (2, "unknown more")
    assert json.loads(got[1, 5].json)["arguments"]["more"] == [1, {"a": 1, "b": 2}]
    assert [got[1, t].status for t in (4, 7, 8, 9)] == ["repeated", "repeated", "orphan", "missing"]
    assert [got[2, t].status for t in (1, 2, 3, 5)] == ["cycle", "orphan", "cycle", "missing"]
    assert got[2, 3].errors == "no object" and got[2, 5].errors == "no object"
    assert toolcalls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_tied_calls_and_calls_without_a_conversation(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", None, "search", '{"limit":1}'), (1, 1, "a", None, "count", '{"limit":1}'), (1, 1, "a", "z", "count", '{"limit":1}')]
        + [(1, 1, "a", None, "count", '{"limit":1}'), (None, 4, "b", None, "count", "{}")],
        "conv_id long, turn long, call_id string, after string, tool string, arguments string",
    )
    results = spark.createDataFrame([(None, 5, "b", "x")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, field string, type string, required boolean")
    for parts in (1, 5):
        got = toolcalls.link_tool_calls(calls.repartition(parts), results, schemas).collect()
        rows = sorted((str(r.conv_id), r.turn, r.status, json.loads(r.json)["name"] if r.json != "null" else "") for r in got)
        assert rows == [("1", 1, "missing", "count"), ("1", 1, "repeated", ""), ("1", 1, "repeated", ""), ("None", 4, "missing", ""), ("None", 5, "orphan", "")]


def test_turns_without_a_role_are_results(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, None, "r"), (2, 5, None, "lone")]
    calls, results = toolcalls.calls_of_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, field string, type string, required boolean")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link_tool_calls(calls, results, schemas).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 0): "orphan", (1, 1): "linked", (2, 5): "orphan"}
    assert json.loads(got[1, 1].json)["result"] == "r"


def test_long_chain_of_calls(spark):
    rows = [(1, i, f"c{i}", f"c{i - 1}" if i else None, "check", "{}") for i in range(70)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after string, tool string, arguments string")
    got = {r.call_id: r.level for r in toolcalls.levels(calls).collect()}
    assert got == {f"c{i}": i for i in range(70)}


# -- pages -----------------------------------------------------------------------------------------------------


def test_templates(spark):
    def page(k, body, tail="</body></html>"):
        return (
            f'<!DOCTYPE html><html><head><title>T{k}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/{k}">Menu {k}</a></ul></nav>'
            f'<!-- x --><div class="ad">Buy {k}</div>{body}<footer>&copy; {k}</footer>{tail}'
        )

    article = "<article><h1>Head &amp; more</h1><p><b>First  line<br>next<p>Second &lt;p&gt;</p><form>no</form><div class='comments'>me too</div></article>"
    rows = [(k, f"http://h.example/{k}", page(k, article)) for k in range(5)]
    rows += [
        (10, None, None),
        (11, "http://x/", ""),
        (12, "http://y/", page(12, article, "")),
        (13, "http://z/", "plain &eacute; text"),
        (14, "http://z/", "<div>short</div><div class=sidebar>" + "long " * 50 + "</div>"),
        (15, "http://z/", page(15, "<article><p>" + "word " * 5000 + "</article>")),
    ]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "n_chars")
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    for k in (0, 4, 12):
        assert got[k].text == "Head & more\n\nFirst line next\n\nSecond <p>", got[k].text
    assert (got[10].text, got[10].n_chars, got[11].text) == ("", 0, "")
    assert got[13].text == "plain é text" and got[14].text == "short"
    assert got[15].n_chars == 24_999 and len(got) == len(rows)
    assert templates.extract(pages.limit(0)).count() == 0


def test_pages_without_article_keep_all_slots(spark):
    """Headings, images, lists and links that stand once on most pages of a host do not cut the body."""

    def page(k):
        extra = f"<table><tr><td>cell {k}</td></tr></table>" if k % 2 else ""
        return (
            f"<html><body><div><a href='/'>Home</a> <a href=/x{k}>Topic {k}</a></div><div id=content><h1><a href=/{k}>Title {k}</a></h1><p>First {k} part</p>"
            f"<img src={k}.png><p>Second <em>part</em> of {k}, the longest one of the page by far</p><ul><li>item {k}<li>thing {k}</ul>{extra}"
            f"<blockquote><a href=/q>quoted {k}</a></blockquote><p>End of {k}</p></div><div>All rights reserved</div></body></html>"
        )

    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in templates.extract(pages).collect():
        k = r.page_id
        parts = [f"Title {k}", f"First {k} part", f"Second part of {k}, the longest one of the page by far", f"item {k}", f"thing {k}"]
        parts += [f"cell {k}"] * (k % 2) + [f"quoted {k}", f"End of {k}"]
        assert r.text.split("\n\n") == parts, r.text


def test_repeats_of_a_host_leave_the_article(spark):
    """Notices and menus under unknown names inside main go, marks on p and inline elements count, copies stay whole."""

    def page(k):
        return (
            f"<html><body><main><div class=zz><a href='/a'>All topics</a></div><h1>Story {k}</h1><p>Body of {k} <b>the</b> end</p>"
            f"<p class=ad>Buy {k}<p>More <span class=share>Tell <span>a</span> friend {k}</span>of {k}</p><i hidden>secret {k}</i>"
            "<div class=qq>We have changed our terms, please read them.</div></main></body></html>"
        )

    def copy(k):
        rest = "".join(f"<p>Paragraph {i} of a text that many pages copy with a word changed</p>" for i in range(8) if i != k)
        return f"<html><body><article><p>Changed {k}</p>{rest}</article></body></html>"

    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://c.example/{k}", copy(k)) for k in range(6)]
    rows += [(20 + k, f"http://e.example/{k}", "<main><p>One text</p><p>Two</p></main>") for k in range(6)]
    rows += [(30 + k, f"http://q.example/{k}", f"<article><p>Text {k}</p><p>{'A quoted line' if k % 2 else f'Line {k}'}</p></article>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(pages).collect()}
    assert got[31] == "Text 1\n\nA quoted line"
    for k in range(6):
        assert got[k].split("\n\n") == [f"Story {k}", f"Body of {k} the end", f"More of {k}"], got[k]
        assert len(got[10 + k].split("\n\n")) == 8 and got[20 + k] == "One text\n\nTwo"


def test_large_templates_are_whole(spark, monkeypatch):
    shared = "".join(f"<div>Offer number {i}</div>" for i in range(2500))
    rows = [(k, "http://h.example/", f"<body><div>Own text {k}</div>{shared}</body>") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in templates.extract(pages).collect()} == {f"Own text {k}" for k in range(5)}
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", 10)
    assert sorted(r.text for r in templates.extract(pages).collect()) == [f"Own text {k}" for k in range(5)]


# -- toxicity --------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 40).split(" ")
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["grumpf", "blarg", "snotling" + rng.choice("abc")])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "...")]
    labels += [(0, None), (None, 1), (4, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "score")
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] is None or x[0] < 300], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    assert right >= 98
    assert got[1000].score == got[1001].score == got[1002].score < 0.3
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def test_grammar_reads_clauses():
    import numpy as np
    import pyarrow as pa

    step, kinds = toxicity.composed(*toxicity.GRAMMAR)
    [insult] = toxicity._hash_of(["grumpf"])
    lexicon = toxicity.Lexicon({int(insult): 4.0})
    texts = ["a grumpf", "you big grumpf", "you are not a grumpf", 'he said: no. they said you grumpf', 'a "grumpf" x', "not this, a grumpf", "kill him", "you kill"]
    [part] = toxicity.byte_chunks(pa.array(texts))
    found = [int(np.argmax(r)) if r.any() else None for r in lexicon.read(part, step, kinds)]
    p, t, n, r = toxicity.PLAIN, toxicity.TARGETED, toxicity.NEGATED, toxicity.REPORTED
    assert found == [p, t, n, r, r, p, 4 + p, 4 + t]


# -- token files -----------------------------------------------------------------------------------------------


def test_encoder_holds_words_outside_of_python():
    path = queries.tokenizer_path()
    code = tokens.Encoder(path)
    texts = [" ".join(f"w{i * 7919:x} Straße{i}\nline{i % 50}" for i in range(k, k + 1000)) for k in range(0, 20_000, 1000)] + ["", None, "\n", "a"]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for _ in code.encode(column):
        pass
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    # ids and where they start stay as numbers; as Python strings 40,000 words would take about 5 MB more
    assert len(code.known) > 40_000
    assert held < 60 * len(code.known)
    for _ in range(2):  # words that are new, and words that are known
        got = [x.tolist() for x in code.encode(column)]
        assert got == code.plain([t or "" for t in texts])


def test_encoder_forgets_long_words(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 1000)
    monkeypatch.setattr(tokens, "STRIDE", 500)
    code = tokens.Encoder(queries.tokenizer_path())
    texts = ["x" * 900 + f" word{k}\nnext y{k}" for k in range(20)]
    assert [x.tolist() for x in code.encode(pa.array(texts))] == code.plain(texts)
    assert code.known.nbytes < 4000


def test_encoder_keeps_words_that_come_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    monkeypatch.setattr(tokens, "STRIDE", 1)
    code = tokens.Encoder(queries.tokenizer_path())
    learned, learn = Counter(), code.learn
    monkeypatch.setattr(code, "learn", lambda words: [learned.update(words.to_pylist()), learn(words)])
    common = [f"common{i}" for i in range(100)]
    texts = [" ".join(["on", *common, *(f"rare{k}x{i}" for i in range(100))]) for k in range(20)]
    assert [x.tolist() for x in code.encode(pa.array(texts))] == code.plain(texts)
    assert {learned[f" {w}"] for w in common} == {1}
    assert len(code.known) < 800


def test_encoder_learns_words_without_their_last_mark(monkeypatch, tmp_path):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    texts = [
        "so word word, word. word; word: word! word?\nword,\nword",
        "it's, don't. U.S., 3.14, 1,000. a!? b?! ... , . (x), 'q', _a. a_, x9: é, ß. e\u0301. 中文。 \u0661. \u00bd, a\u200b,",
        ",", "a,", ".\n,\n!", "", None,
    ]
    code = tokens.Encoder(queries.tokenizer_path())
    learned, learn = Counter(), code.learn
    monkeypatch.setattr(code, "learn", lambda words: [learned.update(words.to_pylist()), learn(words)])
    for _ in range(2):
        assert [x.tolist() for x in code.encode(pa.array(texts))] == code.plain([t or "" for t in texts])
    assert [w for w in learned if "word" in w] == [" word", "word"] and set(learned.values()) == {1}
    # a vocabulary that has marks together with letters
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    joined = Tokenizer(models.BPE({w: i for i, w in enumerate([*letters, "d,", "rd,"])}, [("d", ","), ("r", "d,")]))
    joined.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(" ?[^ \\n]+|\\n"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    joined.save(str(tmp_path / "joined.json"))
    code = tokens.Encoder(str(tmp_path / "joined.json"))
    assert len(code.plain(["word,"])[0]) == 3
    assert [x.tolist() for x in code.encode(pa.array(texts))] == code.plain([t or "" for t in texts])


def test_encoder_learns_words_between_runs_of_white_space(monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = ["", " ", "\n", "  ", " \n", "\n ", "\n\n", " a", "\na", "a ", "a\n", "  a", "\n\na\n\n", "a \n b\n  c", None]
    texts += ["".join(rng.choice([" ", " ", "\n", "  ", "\n\n", "\n    ", "\ta", "ab", "ab", "it's", "x.", "é"]) for _ in range(30)) for _ in range(300)]
    texts += ["\n\n".join("    word other" for _ in range(50)), "x" + " " * 5000 + "\n" * 3000]
    code = tokens.Encoder(queries.tokenizer_path())
    wanted = code.plain([t or "" for t in texts])
    alone, plain = [], code.plain
    monkeypatch.setattr(code, "plain", lambda texts: [alone.extend(texts), plain(texts)][1])
    assert [x.tolist() for x in code.encode(pa.array(texts))] == wanted
    assert any("\t" in x for x in alone) and not any("word" in x for x in alone if "    " in x)
    # a tokenizer that keeps line feeds apart from blanks
    from tokenizers import Regex, pre_tokenizers

    code.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(" ?[^ \\n]+|\\n+| +"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    code.tokenizer.save(str(tmp_path / "other.json"))
    code = tokens.Encoder(str(tmp_path / "other.json"))
    assert [x.tolist() for x in code.encode(pa.array(texts))] == code.plain([t or "" for t in texts])


def test_tasks_encode_on_one_thread():
    run = """
import os
from linewarden.llm import queries, tokens
before = len(os.listdir("/proc/self/task"))
tokens.encoder(queries.tokenizer_path()).plain([f"text {k} of many" for k in range(1000)])
print(before, len(os.listdir("/proc/self/task")))
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    done = subprocess.run([sys.executable, "-c", run], cwd=ROOT, env=env, capture_output=True, text=True, check=True, timeout=100)
    before, after = done.stdout.split()
    assert before == after


def test_token_files(spark):
    path = queries.tokenizer_path()
    rows = [*corpus(7), (3, "again id 3"), (None, "no id"), (900, "a  b\n\n c\td"), (901, " x "), (902, "<|endoftext|> it's 'tis")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "start", "tie").repartition(5)
    folder = work_folder(spark, "token-test")
    tokens.write_files(docs, folder, path)
    got = tokens.read_files(spark, folder, with_ids=True).orderBy("start").collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    expected = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    start = 0
    for r in got:
        raw = b"".join(x.to_bytes(4, "little") for x in r.ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(raw))
        start += len(r.ids)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    some = tokens.read_files(spark, folder, wanted=[3, 901]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 901]
    assert tokens.round_trip(docs.limit(0), path).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    import numpy as np
    import zstandard

    file = tokens.FrameWriter(str(tmp_path), 0)
    big = np.arange(tokens.FRAME_LIMIT + 5, dtype=np.uint32)
    for k, ids in enumerate([np.arange(40_000), np.arange(40_000), big, np.array([7])]):
        file.add(k, ids.astype(np.uint32))
    name, docs, n = file.finish()
    assert (docs, n) == (4, 80_006 + tokens.FRAME_LIMIT)
    reader = tokens.FrameReader(str(tmp_path), name)
    assert len(reader.seek) > 2 and (reader.document(2) == big).all() and reader.document(3).tolist() == [7]
    raw = (tmp_path / name).read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as whole:
        assert len(whole.read()) == 4 * n  # a plain reader skips the tables
    broken = bytearray(raw)
    broken[int(reader.packed_at[1]) + 30] ^= 255
    (tmp_path / name).write_bytes(bytes(broken))
    again = tokens.FrameReader(str(tmp_path), name)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        again.document(2)


# -- URLs ------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("example.org", "/es/", "allow"), ("net", "/", "allow"), (None, "/", "block")]
    urls = [None, "", "x.org/es/", "http://A.Example.ORG/es/1", "http://a.example.org/en/12?x", "http://org", "http://org/", "http://myexample.org/es/", "https://b.com/de/", "https://b.com/DE/", "ftp://n.net?/q", "http://u@n.net/x", "http://b.com/fr/#/de/", "a://b://c/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "rule")
    got = urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v == "block", h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], "block" if best and best[1] else "allow"

    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted(
        (i, b[0], b[1], b[2] or "", b[3]) for i, u in rows for b in [brute(u)]
    )
    assert urlrules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).count() == len(rows)


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, '<a "' * 250_000, "<title " * 150_000, "<div>t" * 80_000 + "</div>" * 80_000, "<div>" * 40_000 + "t" + "</div>x" * 40_000,
     '<a "' * 200_000 + "'>'", "<!x" * 300_000, "<div><a>t</a>" * 40_000],
)
def test_broken_pages_take_time_in_proportion(page):
    def seconds(text):
        start = time.perf_counter()
        templates.main_text(text, None, None)
        return time.perf_counter() - start

    part = page[: len(page) // 8]
    assert seconds(page) < 24 * seconds(part) + 1


def test_broken_tags_are_text_and_quotes_hide_ends():
    read = lambda page: templates.main_text(page, None, None)
    assert read("<p>one <b two</p>") == "one"
    assert read("<p>a &lt; b</p><p>c < d") == "a < b\n\nc < d"
    assert read("<p title='a>b'>one</p><p>two") == "one\n\ntwo"
    assert read("<p>kept</p><!-- never closed <p>not</p>") == "kept"
    assert read("<p>kept</p> tail <b") == "kept\n\ntail <b"


# -- mixtures --------------------------------------------------------------------------------------------------


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(8)
    rows = [(g, i, float(rng.choice([0, 1, 5, 50, 400, rng.randint(1, 300)])), s) for g, s in ((1, 7), (2, 100), (3, 0), (4, 13)) for i in range(9)]
    parties = spark.createDataFrame(rows, "g int, i int, v double, s long")
    got = {(r.g, r.i): r.quota for r in mixture.apportion(parties, F.col("v"), F.col("s"), ("g", "i"), ("g",)).collect()}
    for g in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == g]
        quota = Counter()
        for _ in range(own[0][3]):
            best = max(own, key=lambda r: (Fraction(r[2]) / (2 * quota[r[1]] + 1), -r[1]))
            quota[best[1]] += 1
        votes = {r[1]: r[2] for r in own}
        assert sum(got[g, i] for i in votes) == own[0][3]
        # Parties with equal votes may swap; the quotas by votes are the same.
        assert sorted((votes[i], got[g, i]) for i in votes) == sorted((votes[i], quota[i]) for i in votes)


def test_mixture(spark):
    rng = random.Random(2)
    sizes = {"b": 30, "a": 200, None: 40, "c": 3, "d": 0}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n or 2):
            rows.append((k, prose(rng, rng.randint(1, 900)) if n else rng.choice([None, " "]), s))
            k += 1
    rows += [rows[5], rows[5]]
    docs = clashing(stored(spark, rows, "doc_id long, text string, source string"), "taken", "size")
    got = mixture.mix(docs).collect()
    again = mixture.mix(docs).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, live = 1.5 * sum(total.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 2 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            live.discard(s)
    source = {k: s for k, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == len(WORD.findall(next(t for k, t, _ in rows if k == r.doc_id) or ""))
        assert (r.source_size, round(r.target, 3)) == (total[s], round(target[s], 3))
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.05 * target[s]), (s, taken[s], target[s])
    assert mixture.mix(docs.limit(0)).count() == 0


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    sizes = {"a": [40, 9, 1], "b": [100], "c": [600], "d": [1] * 7, "e": [3], "f": [rng.randint(1, 400) for _ in range(300)]}
    rows = [(f"{s}{k}", "w " * n, s) for s, ns in sizes.items() for k, n in enumerate(ns)]
    docs = stored(spark, rows, "doc_id string, text string, source string")
    taken, target = Counter(), {}
    for r in mixture.mix(docs).collect():
        taken[r.doc_id[0]] += r.taken
        target[r.doc_id[0]] = r.target
    assert target["a"] == 100 and taken["a"] == 100
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= max(2, 0.05 * goal), (s, taken[s], goal)


def test_columns_named_like_inner_ones_pass_through(spark):
    rows = [(k, f"Some words of text {k % 5} stand here, and a few more of them. " * 8, "s", f"http://h.org/{k}", "<p>text</p>") for k in range(12)]
    names = ["words", "row", "template", "frame", "settled", "n", "sid", "comp", "quota", "shingle", "hashes", "key", "place", "host", "limit"]
    docs = stored(spark, rows, "doc_id long, text string, source string, url string, html string").withColumns({c: F.lit(c) for c in names})
    docs.write.parquet(folder := work_folder(spark, "clash"))
    docs = spark.read.parquet(folder)
    made = {
        "mix": mixture.mix(docs), "repeats": repeats.remove_repeats(docs), "judge": quality.judge(docs.drop("url", "html")),
        "near": nearjoin.near_duplicates(docs), "keep": nearjoin.keep_one(docs), "pages": templates.extract(docs.drop("text")),
    }
    for name, df in made.items():
        got = df.collect()
        assert len(got) == (5 if name == "keep" else 12), name
        assert all(r[c] == c for r in got for c in names if c in df.columns and c not in ("words",) or c == "words" and name != "judge"), name


def test_whole_documents_meet_the_targets(spark):
    """Long documents with small ratios: rounding each by itself would lose nearly all of them."""
    rng = random.Random(12)
    long_texts = [" ".join(["w"] * rng.choice([30, 200, rng.randint(600, 3000), 2500])) + f" {i}" for i in range(1300)]
    rows = [(i, t, "b") for i, t in enumerate(long_texts)]
    rows += [(5000 + i, " ".join(["v"] * rng.randint(1000, 2500)) + f" {i}", s) for s, n in (("a", 40), ("c", 50)) for i in range(n)]
    rows += [(9000, None, "b"), (9001, " ", None)]
    docs = stored(spark, rows, "doc_id long, text string, source string")
    options = {"share": 0.2}
    goal = {r.source: (r.target, r.source_size) for r in mixture.mix(docs, **options).collect()}
    got = mixture.repeat_documents(docs, **options).collect()
    words, longest, texts = Counter(), Counter(), {(i, s): t for i, t, s in rows}
    for r in got:
        assert texts[r.doc_id, r.source] == r.text
        words[r.source] += len(r.text.split())
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    assert goal["b"][0] < 0.1 * goal["b"][1]
    for s, (target, _) in goal.items():
        assert abs(words[s] - target) <= longest[s] + 256, (s, words[s], target)
    # Long documents have their share too.
    above = [r for r in got if r.source == "b" and len(r.text.split()) > 1500]
    assert sum(len(r.text.split()) for r in above) > 0.8 * goal["b"][0] / goal["b"][1] * sum(n for n in (len(t.split()) for t in long_texts) if n > 1500)
    # The choice follows from the documents, not from their order in files.
    folder = work_folder(spark, "other-order")
    spark.createDataFrame(rows[::-1], docs.schema).repartition(7).write.parquet(folder)
    again = mixture.repeat_documents(spark.read.parquet(folder), **options).collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in got)
    assert mixture.repeat_documents(docs.limit(0)).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality(spark):
    rng = random.Random(9)
    rows = corpus(3) + [(600, "a b c d e f g h " * 9), (601, "x# " * 40), (602, "one line\n" * 30), (603, "𝒳𝒴 é\u00a0z " * 30), (604, "w " * 3 + "\x0bq\x0c\r"), (605, "a b c d e f g h i a b c d e f g h")]
    rows += [(700 + i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(10)] + [rows[8]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_words", "kept", "failed")
    got = quality.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id, *[r[n] for n in names]) for r in got) == sorted((i, *brute_quality(t)) for i, t in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[601] and not kept[600] and not kept[0]
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


# -- near duplicates -------------------------------------------------------------------------------------------


def brute_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "e" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize(("small", "rounds"), [(24, 8), (2, 8), (2, 1)])
def test_near_join(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(nearjoin, "SMALL_CELL", small)
    monkeypatch.setattr(nearjoin, "ROUNDS", rounds)
    rng = random.Random(11)
    rows = corpus(11)
    for _ in range(4):  # groups around the similarity of a link
        words = prose(rng, 120).split(" ")
        rows += [(0, edited(rng, words, rng.randint(0, 5))) for _ in range(14)]
    shared = prose(rng, 60)
    rows += [(0, shared + " " + edited(rng, shared.split(" "), 3)) for _ in range(8)]
    rows += [(0, shared + " " + prose(rng, rng.randint(5, 25))) for _ in range(20)]
    rows = [(i * 7 % 1009, t) for i, (_, t) in enumerate(rows)]
    docs = clashing(stored(spark, rows, "doc_id long, text string"), "component_id")
    got = sorted(tuple(r) for r in nearjoin.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_near_join_of_a_large_group_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "SMALL_CELL", 2)
    monkeypatch.setattr(nearjoin, "CROSSING", 0)  # no cell is joined before the last round
    rng = random.Random(13)
    words = prose(rng, 110).split(" ")
    rows = [(i * 31 % 997, edited(rng, words, i % 9)) for i in range(170)]
    docs = stored(spark, rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nearjoin.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows) and len({c for _, _, c in got}) > 3


def test_bitmaps_bound_what_sets_have_in_common():
    rng = np.random.default_rng(4)
    for _ in range(200):
        both, one, two = (rng.integers(0, 1 << 62, rng.choice([0, 1, 5, 80, 900]), dtype=np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        if not len(x) or not len(y):
            continue
        columns = [[1], [2], [len(x)], [len(y)], [nearjoin._parity(x)], [nearjoin._parity(y)]]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list("abnmxy"))
        [row] = next(nearjoin._bounded(iter([batch]))).to_pylist()
        common, total = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert common * row["total"] <= row["common"] * total
        apart = int(np.bitwise_count(nearjoin._folded(x).view(np.uint64) ^ nearjoin._folded(y).view(np.uint64)).sum())
        assert apart <= total - common


def test_near_join_keeps_one(spark):
    rows = [*corpus(12), (1, None), (2, "")]
    docs = stored(spark, rows, "doc_id long, text string").withColumn("__place", F.lit(1)).withColumn("extra", F.lit("x"))
    kept = sorted(r.doc_id for r in nearjoin.keep_one(docs.drop("__place")).collect())
    expected = sorted({c for d, n, c in brute_components(rows) if n} | set()) + [d for d, n, _ in brute_components(rows) if not n]
    assert kept == sorted(expected)
    empty = stored(spark, [], "doc_id long, text string")
    assert nearjoin.near_duplicates(empty).count() == 0 and nearjoin.keep_one(empty).count() == 0
