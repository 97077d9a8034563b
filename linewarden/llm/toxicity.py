"""Toxicity by a weighted pattern grammar: composed transducers that score clauses.

Four small transducers read the words of a clause as classes: evidence (insults and threats), target,
negation and reported speech.  Their composition is one machine whose output names the kind of each match, as
plain, targeted, negated or reported, so a word counts by the clause around it.  Words and word beginnings
that mark insults, and the weights of kinds, are learned from labelled rows.

Defined results: NULL, blank and wordless texts have no match and get the score of none.  Labels that are NULL
are ignored; a document with several labels is toxic if one says so.  Without labels of both values nothing is
learned and every score is 0.5 at most.  Repeated rows score alike; texts are read whole.  Columns named like a
result column are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.words import Bytes, byte_chunks, freeing, give_back, words_of

THRESHOLD = 0.7
#: The lexicon and the weights are fitted on about this many labelled rows at most, chosen by a hash of the id.
FIT_ROWS = 24_000
#: A word or beginning is learned from this many toxic rows on, and this share of them.
LEAST_ROWS, LEAST_SHARE = 3, 0.002
#: Log odds from which on a word or beginning marks an insult.
LEAST_ODDS = 3.0
#: Bytes of texts that are read at a time.
CHUNK = 1 << 20
#: Lengths of learned word beginnings, in bytes.
BEGINNINGS = (4, 5, 6, 7)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n()"]] = True

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
CLASSES = {
    THREAT: "kill murder hurt destroy shoot stab strangle beat hang rape burn töten umbringen tuer frapper matar golpear",
    TARGET: "you your you're he she they them him her this that these those people du dich ihr euch er sie "
    "tu te toi vous il elle ils tú usted él ella ellos",
    NEGATION: "not never no nobody isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca ningún",
    REPORT: "said says say called calls wrote writes quoted quotes claimed told reported sagte schrieb nannte "
    "dit disait écrit appelle dijo escribió llamó",
}
PLAIN, TARGETED, NEGATED, REPORTED = range(4)
#: Weights of the kinds before labels are seen: insults and threats, each plain, targeted, negated, reported.
PRIOR = np.array([1.0, 1.5, 0.2, 0.4, 0.1, 1.0, 0.0, 0.1])
KINDS = len(PRIOR)


class Transducer(NamedTuple):
    """A synchronous machine over word classes: ``step[state][class]`` is (next state, output)."""

    step: list[list[tuple[int, int]]]


def counting(starts: set[int], span: int) -> Transducer:
    """Outputs 1 for ``span`` words after a word of the starting classes."""
    n = len(CLASSES) + 3
    return Transducer([[(span if c in starts else max(0, s - 1), int(s > 0)) for c in range(n)] for s in range(span + 1)])


def evidence() -> Transducer:
    """Outputs the class of a word of evidence: 1 for an insult, 2 for a threat, else 0."""
    return Transducer([[(0, {INSULT: 1, THREAT: 2}.get(c, 0)) for c in range(len(CLASSES) + 3)]])


def composed(*machines: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The product machine as tables: next state, and the tuple of outputs read as a kind (-1: no evidence)."""
    start = (0,) * len(machines)
    states, queue, steps, kinds = {start: 0}, [start], [], []
    while queue:
        state = queue.pop(0)
        steps.append([])
        kinds.append([])
        for c in range(len(CLASSES) + 3):
            moves = [m.step[s][c] for m, s in zip(machines, state, strict=True)]
            after = tuple(m[0] for m in moves)
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            found, target, negated, reported = (m[1] for m in moves)
            how = REPORTED if reported else NEGATED if negated else TARGETED if target else PLAIN
            steps[-1].append(states[after])
            kinds[-1].append(-1 if not found else 4 * (found - 1) + how)
    return np.array(steps), np.array(kinds)


#: A target counts for six words, a negation for three, reported speech for the rest of the clause.
GRAMMAR = (evidence(), counting({TARGET}, 6), counting({NEGATION}, 3), counting({REPORT, QUOTE}, 40))


def _hash_of(words: list[str]) -> np.ndarray:
    out = []
    for part in byte_chunks(pa.array(words)):
        w = words_of(part, np.ones(256, bool))
        out.append(w.hashes)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Lexicon:
    """Learned words and beginnings with their log odds, and the fixed words of the other classes."""

    def __init__(self, learned: dict[int, float]):
        self.keys = np.array(sorted(learned), np.uint64)
        self.odds = np.array([learned[int(k)] for k in self.keys])
        fixed = {int(h): c for c, text in CLASSES.items() for h in _hash_of(text.split())}
        self.fixed = np.array(sorted(fixed), np.uint64)
        self.classes = np.array([fixed[int(k)] for k in self.fixed])

    def _odds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.odds[at], 0.0)

    def read(self, part: Bytes, step: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """For every row the mass of matches of each kind."""
        words = words_of(part, _LETTERS)
        rows = np.zeros((part.last - part.first, KINDS))
        if not len(words.hashes):
            return rows
        odds = self._odds(words.hashes)
        for n in BEGINNINGS:
            np.maximum(odds, self._odds(words.prefixes(n)), out=odds)
        at = np.minimum(np.searchsorted(self.fixed, words.hashes), len(self.fixed) - 1)
        cls = np.where(self.fixed[at] == words.hashes, self.classes[at], OTHER)
        cls = np.where(odds > 0, INSULT, cls)
        hits = np.flatnonzero((cls == INSULT) | (cls == THREAT))
        if not len(hits):
            return rows
        # Only clauses with evidence are read; a clause ends at a mark or with its row.
        ends = np.flatnonzero(_ENDS[part.data])
        row = np.searchsorted(words.first, np.arange(len(cls)), "right") - 1
        clause = np.searchsorted(ends, words.begin) + row
        quotes = part.data == 34
        quoted = quotes[np.maximum(words.begin - 1, 0)] & (words.begin > 0)
        for c in np.unique(clause[hits]):
            a, b = np.searchsorted(clause, c), np.searchsorted(clause, c, "right")
            state = 0
            for k in range(a, b):
                if quoted[k]:
                    state = step[state, QUOTE]
                kind = kinds[state, cls[k]]
                if kind >= 0:
                    rows[row[k], kind] += odds[k] if cls[k] == INSULT else LEAST_ODDS
                state = step[state, cls[k]]
        return rows


def features(masses: np.ndarray) -> np.ndarray:
    return np.log1p(masses)


def _counted(candidates) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word or beginning, toxic rows, clean rows) of a task; with candidates only of these, else of toxic rows."""
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if candidates is None else np.sort(candidates.value)
        counts = None if keys is None else np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(1)).astype(np.int64)
            for part in byte_chunks(batch.column(0), CHUNK):
                words = words_of(part, _LETTERS)
                found = []
                row = np.searchsorted(words.first, np.arange(len(words.hashes)), "right") - 1
                for hashes in [words.hashes, *[words.prefixes(n) for n in BEGINNINGS]]:
                    ok = hashes != 0
                    if keys is None:
                        ok &= toxic[part.first + row] > 0
                        found.append(np.stack([row[ok].astype(np.uint64), hashes[ok]], 1))
                    elif len(keys):
                        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                        ok &= keys[at] == hashes
                        found.append(np.stack([row[ok].astype(np.uint64), at[ok].astype(np.uint64)], 1))
                if not found or not sum(map(len, found)):
                    continue
                each = np.concatenate(found)
                packed = np.unique(each, axis=0)
                if keys is None:
                    key, n = np.unique(packed[:, 1], return_counts=True)
                    columns = [key.view(np.int64), n, np.zeros(len(n), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
                else:
                    label = toxic[part.first + packed[:, 0].astype(np.int64)]
                    for v in (0, 1):
                        counts[v] += np.bincount(packed[label == v, 1].astype(np.int64), minlength=len(keys))
        if counts is not None:
            some = np.flatnonzero(counts.sum(0))
            columns = [keys[some].view(np.int64), counts[1][some], counts[0][some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return made


def _masses(lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("toxic", pa.int32()), ("masses", pa.list_(pa.float64()))])

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, kinds = composed(*GRAMMAR)
        for batch in batches:
            rows = [lexicon.value.read(p, step, kinds) for p in byte_chunks(batch.column(0), CHUNK)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(np.concatenate(rows)), pa.list_(pa.float64()))], schema=schema)

    return made


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (intercept first), drawn to the prior of the kinds."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.concatenate([[-4.0], 2 * PRIOR])
    w, pull = prior.copy(), np.array([0.1] + [ridge] * KINDS)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    # More evidence never lowers a score.
    return np.concatenate([w[:1], np.maximum(w[1:], 0.0)])


class Model(NamedTuple):
    learned: dict[int, float]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows with ``toxic`` 0 or 1; about ``rows`` of them at most."""
    spark = docs.sparkSession
    named = labels.where(f"toxic IS NOT NULL AND {doc_id} IS NOT NULL").groupBy(doc_id).agg(F.max("toxic").cast("int").alias("__toxic"))
    every = named.count()
    chosen = named.where(F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(max(every, 1))) < rows)
    sample = docs.select(doc_id, F.col(text).cast("string").alias("__text")).join(F.broadcast(chosen), doc_id).select("__text", "__toxic")
    by_label = {r["__toxic"]: r["n"] for r in chosen.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = by_label.get(1, 0), by_label.get(0, 0)
    if not toxic or not clean:
        return Model({}, np.concatenate([[0.0], 0 * PRIOR]))
    fields = "key long, toxic long, clean long"
    least = max(LEAST_ROWS, LEAST_SHARE * toxic)
    often = sample.where("__toxic = 1").mapInArrow(_counted(None), fields).groupBy("key").agg(F.sum("toxic").alias("n"))
    # Few keys reach the least share of a bounded sample.
    keys = np.array([r.key for r in often.where(F.col("n") >= least).select("key").collect()], np.int64).view(np.uint64)
    counts = sample.mapInArrow(_counted(spark.sparkContext.broadcast(keys)), fields).groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    marked = counts.withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= least)).collect()
    learned = {int(np.int64(r.key).view(np.uint64)): float(r.odds) for r in marked}
    lexicon = spark.sparkContext.broadcast(Lexicon(learned))
    got = sample.mapInArrow(_masses(lexicon), "toxic int, masses array<double>").collect()
    x = features(np.array([r.masses for r in got]).reshape(-1, KINDS))
    return Model(learned, fit_weights(x, np.array([r.toxic for r in got], float)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``score`` and ``predicted``."""
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(Lexicon(model.learned))
    weights = model.weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        step, kinds = composed(*GRAMMAR)
        rows = [lexicon.value.read(p, step, kinds) for p in byte_chunks(texts, CHUNK)]
        x = features(np.concatenate(rows)) if rows else np.zeros((0, KINDS))
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -40, 40))))

    kept = docs.drop("score", "predicted")
    out = kept.withColumn("score", scored(F.col(text).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
