"""Merkle manifests, periodic runs and packing against brute force, and on nulls, ties and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewarden.llm import manifest, packing, queries, runs

DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    """(left, right) siblings of a leaf on every level."""
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def brute_manifest(rows, later):
    """{(doc_id, leaf): result row} with doc_ids in order, NULL first and equal ones by leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), leaf_of(r, later(r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (known, doc_id, leaf, now) in enumerate(sorted(groups[g])):
            path = way(trees[g], at) + way(top, k)
            folded = now
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            proof = sha("".join(a + b for a, b in path))
            out.append((doc_id if known else None, leaf, trees[g][-1][0], root, proof, folded, folded == root))
    return out


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def later_text(r):
    tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    return lowered(r["text"]) if tampered else r["text"]


def run_manifest(df):
    tampered = {"text": F.when(queries.crc32_of_id() % 3 == 0, F.translate("text", queries._UPPER, queries._LOWER)).otherwise(F.col("text"))}
    return sorted(map(tuple, manifest.manifest(df, changed=tampered).collect()), key=repr)


def test_manifest_is_that_of_brute_force(spark):
    rng = random.Random(5)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)] + list(range(-70, 640)) + [(1 << 63) - 1, -(1 << 63)]
    rows = [
        {"doc_id": i, "source": rng.choice([None, "", "s é"]), "lang": rng.choice(["en"] * 9 + ["de", "", None]), "n_chars": rng.choice([None, 3, -1]),
         "text": rng.choice([None, "", "Aé b", "plain", "Z" * 50])}
        for i in ids
    ]
    rows.append({"doc_id": 5, "source": "x", "lang": "zz", "n_chars": 1, "text": "Alone"})
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DOCUMENTS).withColumns({c: F.lit(1) for c in ("tree", "word", "n", "l0", "place")})
    got = run_manifest(df.repartition(3))
    assert got == sorted(brute_manifest(rows, later_text), key=repr)
    assert {g[-1] for g in got} == {True, False}


def test_manifest_of_ties_nulls_and_repeated_rows(spark):
    rows = [(7, "s", "en", 1, f"T{i % 5}") for i in range(40)] + [(None, None, None, None, None)] * 12 + [(None, "s", "en", 2, "N")] * 3
    rows += [(i, "s", "en", 1, "x") for i in range(12)]
    named = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows]
    got = run_manifest(spark.createDataFrame(rows, DOCUMENTS).repartition(4))
    assert got == sorted(brute_manifest(named, later_text), key=repr)


def test_small_manifests(spark):
    assert run_manifest(spark.createDataFrame([], DOCUMENTS)) == []
    one = [(3, "s", "en", 1, "Text")]
    named = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), one[0], strict=True))]
    got = run_manifest(spark.createDataFrame(one, DOCUMENTS))
    assert got == brute_manifest(named, later_text)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


# --- runs -------------------------------------------------------------------------------------


def brute_runs(words, exponent=4, least=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(0, 5)):
            n = rng.choice([0, 1, 5, 20, 60])
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = min(1 + rng.randrange(max(1, (n - a) // 3 + 1)), n - a)
                words[a:] = [words[a + i % p] for i in range(n - a)]
            docs.append(words)
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        flat = np.array(sum(docs, []), np.uint64)
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            got = runs.find_runs(flat, ends, exponent, least)
            expected, before = [], 0
            for d in docs:
                expected += [(s + before, n, q) for s, n, q in brute_runs(d, exponent, least)]
                before += len(d)
            assert sorted(zip(got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True)) == sorted(expected)


def test_runs_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 1 << 20)
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "a " * 6, "a " * 5, "A a " * 4, "  " * 7, "x y\tx\ny " * 3, "no run here at all", "é ü " * 9 + "é"]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(4, "a " * 6)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("seed", F.lit("s"))
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect())
    expected = []
    for i, t in rows:
        words = split(t)
        found = brute_runs(words)
        expected.append((i or -1, len(words), found, brute_collapsed(words, found)))
    assert got == sorted(expected)
    assert runs.periodic_runs(df.where("false")).collect() == []


def test_a_long_text_is_worked_whole(spark):
    words = [f"w{i}" for i in range(200_000)] + ["x", "y"] * 50_000 + [f"v{i}" for i in range(150_000)]
    text = " ".join(words)
    assert len(text) > 2 * runs.CHUNK
    [row] = runs.periodic_runs(spark.createDataFrame([(1, text), ], "doc_id long, text string")).collect()
    assert [tuple(x) for x in row["runs"]] == [(200_000, 100_000, 2)] and row["n_words"] == len(words)
    assert row["collapsed"] == " ".join(words[:200_002] + words[300_000:])


def test_op12_is_that_of_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    planted = 0
    for r in queries.op12_periodic_runs(spark, sf).collect():
        words = split(docs[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = [words[a + i % p] for i in range(n - a)]
            planted += 1
        found = brute_runs(words)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = best[1] * 1000 // best[2] if found else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *best, milli)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda x: (x[0], x[2]))))
        assert r["collapsed_sha256"] == sha(brute_collapsed(words, found))
    assert planted > 5


# --- packing ----------------------------------------------------------------------------------


def checked(examples, limits):
    """The sequences of examples, after all rules have been checked."""
    out, pieces = list(packing.sequences(iter(examples), limits)), {}
    for sequence in out:
        n = sum(p.length for p in sequence)
        assert 0 < n <= limits.tokens and n & (n - 1) == 0
        assert len(sequence) <= limits.segments and sum(map(packing.bearing_tokens, sequence)) <= limits.loss
        for p in sequence:
            pieces.setdefault(id(p.example), []).append((p.start, p.length))
    for e in examples:
        at = 0
        for start, length in sorted(pieces[id(e)]):
            assert start == at and length > 0
            at += length
        assert at == len(e.ids)
    return out


def test_packing_keeps_limits_and_ids(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        monkeypatch.setattr(packing, "POOL", rng.choice([50, 1000, 1 << 20]))
        monkeypatch.setattr(packing, "RESERVE", packing.POOL // 8)
        limits = packing.Limits(rng.choice([1, 8, 64, 256]), rng.choice([1, 2, 5, 64]), rng.choice([1, 7, 64, 256]))
        examples = []
        for _ in range(rng.randint(0, 50)):
            n = rng.choice([1, 1, 3, 20, rng.randint(1, 700)])
            examples.append(packing.Example(None, np.zeros(n, np.uint32), rng.choice([0, 0, rng.randint(0, n)])))
        checked(examples, limits)
    with pytest.raises(ValueError, match="power of two"):
        list(packing.sequences(iter([]), packing.Limits(100)))


def test_packing_prefers_the_greatest_product():
    sizes = [10, 60, 4, 50, 30]
    examples = [packing.Example(i, np.zeros(n, np.uint32), 0) for i, n in enumerate(sizes)]
    first = next(packing.sequences(iter(examples), packing.Limits(64, 8, 64)))
    assert [(p.example.doc_id, p.length) for p in first] == [(1, 60), (2, 4)]
    # Few examples are cut.
    rng = np.random.default_rng(0)
    examples = [packing.Example(i, np.zeros(max(1, int(x)), np.uint32), 0) for i, x in enumerate(rng.lognormal(5.6, 1.2, 4000))]
    out = checked(examples, packing.Limits())
    whole = sum(-(-len(e.ids) // 2048) for e in examples)
    assert sum(map(len, out)) < 1.1 * whole


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_of_odd_texts(spark):
    code = tokenizer()
    texts = [None, "", "one", "two words", "é" * 3000, "Tool call.\n" * 900, "two words"]
    rows = [(i if i != 3 else None, t, "Ask: " + "why " * i) for i, t in enumerate(texts)] + [(2, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ask string").withColumn("ids", F.lit(1)).withColumn("offset", F.lit(2))
    for prompt in (None, "ask"):
        limits = packing.Limits(512, 4, 300)
        got = packing.pack(df.coalesce(1), queries.tokenizer_path(), prompt=prompt, limits=limits, with_ids=True).collect()
        expected = []
        for i, t, ask in rows:
            silent = code.encode(ask or "", add_special_tokens=False).ids if prompt else []
            expected.append((i, silent + code.encode(t or "", add_special_tokens=False).ids + [1]))
        tokens = sum(len(ids) for _, ids in expected)
        assert sum(r["length"] for r in got) == tokens
        sequences = {}
        for r in got:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
            assert any(i == r["doc_id"] and r["ids"] == ids[r["start"] : r["start"] + r["length"]] and len(ids) == r["doc_tokens"] for i, ids in expected)
            sequences.setdefault(r["sequence_id"], []).append(r)
        for rs in sequences.values():
            rs.sort(key=lambda r: r["offset"])
            ends = np.cumsum([r["length"] for r in rs])
            assert [r["offset"] for r in rs] == [0, *ends[:-1]] and ends[-1] & (ends[-1] - 1) == 0
            assert len(rs) <= 4 and sum(r["n_loss"] for r in rs) <= 300
    assert packing.pack(df.where("false"), queries.tokenizer_path()).collect() == []


def test_op13_is_the_tokenizers(spark, sf):
    code, pieces = tokenizer(), {}
    got = queries.op13_pack_sequences(spark, sf).collect()
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    docs = queries.table(spark, sf, "documents").collect()
    assert len(docs) == len(pieces)
    for d in docs:
        ids = np.array(code.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = {}
    for r in got:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
