"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes of one to three letters, its character bigrams and trigrams, its length class, and the
languages in whose lexicon it is (words that training texts of that language use at least twice). Weights
and transitions are learned from labelled texts; as a label holds for a whole text, code-switched sequences
are made by joining stretches of texts of different languages. Forward-backward gives every word's label
distribution; a text's language is the one of greatest mean, and the score is that mean.

Training takes at most `per_language` texts of each label, those of least hash of id, and a stretch of
`stretch` words from the middle of each: a documented bound that doesn't grow with the corpus. One task learns from them.

Defined cases: a null text, or one without letters (superscripts, fractions and other numerals are none), is `und` with score 0; a null label is not learned from;
with no labelled text at all everything is `und`; words longer than 48 letters are labelled in pieces of 48;
equal texts get equal predictions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe.llm import crf
from mailframe.llm.common import release_memory
from mailframe.llm.textops import mix64, slices

PER_LANGUAGE, STRETCH, DIM, PIECE, CACHE, UNDECIDED = 600, 80, 1 << 17, 48, 400_000, "und"
#: Signs that count as parts of words in patterns, but are numbers and no letters: superscripts, fractions, circled and Roman numerals and the like.
_NUMBERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NUMBER = re.compile(f"[{_NUMBERS}]")
_MASK = np.uint64(DIM - 1)


def split(text: str | None) -> list[str]:
    """Lower-cased runs of letters, long ones in pieces."""
    text = (text or "").lower()
    found = _WORD.findall(text)
    if not text.isascii() and found and not "".join(found).replace("'", "").replace("’", "").isalpha():
        found = _WORD.findall(_NUMBER.sub(" ", text))
    if max(map(len, found), default=0) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(parts[0].shape, kind + 1, np.uint64)
    for p in parts:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64))
    return h & _MASK


def features(vocabulary: list[str], lexicons: list[frozenset[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each word, and n + 1 offsets."""
    n = len(vocabulary)
    chars = np.array(vocabulary, f"U{PIECE}").view(np.uint32).reshape(n, PIECE) if n else np.zeros((0, PIECE), np.uint32)
    size = np.array([len(w) for w in vocabulary], np.int64)
    rows = np.arange(n)
    wide = np.zeros((n, PIECE + 2), np.uint32)  # a boundary before and after
    wide[:, 0] = 1
    wide[:, 1:-1] = chars
    wide[rows, size + 1] = 1
    at = np.arange(PIECE + 2)
    made: list[tuple[np.ndarray, np.ndarray]] = [(rows, _hash(0, np.minimum(size, 12)))]
    for k in (1, 2, 3):
        long = rows[size >= k]
        made.append((long, _hash(k, *(chars[long, j] for j in range(k)))))
        made.append((long, _hash(10 + k, *(chars[long, size[long] - k + j] for j in range(k)))))
    for k in (2, 3):
        r, c = np.nonzero(at[None, :] + k <= (size + 2)[:, None])
        made.append((r, _hash(20 + k, *(wide[r, c + j] for j in range(k)))))
    for i, lexicon in enumerate(lexicons):
        known = np.array([j for j, w in enumerate(vocabulary) if w in lexicon], np.int64)
        made.append((known, _hash(30, np.full(len(known), i))))
    owner, ids = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(n + 1))


class Labeller:
    """A trained model with its lexicons; keeps word scores of a bounded number of words."""

    def __init__(self, model: crf.Model | None, lexicons: list[frozenset[str]]):
        self.model, self.lexicons = model, lexicons
        self._known: dict[str, int] = {}
        self._scores = np.zeros((0, len(model.labels) if model else 0), np.float32)

    def __getstate__(self):
        return {"model": self.model, "lexicons": self.lexicons}

    def __setstate__(self, state):
        self.__init__(**state)

    def _score(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE:
            known.clear()
            self._scores = self._scores[:0]
        get = known.get
        ids = [get(w, -1) for w in words]
        if new := sorted({w for w, i in zip(words, ids, strict=True) if i < 0}):
            for w in new:
                known[w] = len(known)
            scores = [crf.emissions(self.model.weights, *features(new[i : i + 50_000], self.lexicons)) for i in range(0, len(new), 50_000)]
            self._scores = np.concatenate([self._scores, *scores]).astype(np.float32)
            ids = [known[w] for w in words]
        return self._scores[np.array(ids, np.int64)]

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, label distributions of all words, and offsets."""
        each = [split(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
        flat = [w for ws in each for w in ws]
        if not flat or not self.model:
            return each, np.zeros((len(flat), 0)), offsets
        return each, crf.marginals(self.model, self._score(flat), offsets), offsets

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Label, score, number of words, and number of places where the label of words changes."""
        _, p, offsets = self.words(texts)
        n = np.diff(offsets)
        score, switches, label = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [UNDECIDED] * len(texts)
        some = np.flatnonzero(n)
        if len(some) and self.model:
            mean = np.add.reduceat(p, offsets[:-1][some], axis=0) / n[some][:, None]
            best = mean.argmax(1)
            score[some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
            for i, b in zip(some, best, strict=True):
                label[i] = self.model.labels[b]
            top = p.argmax(1)
            change = np.concatenate([[0], (top[1:] != top[:-1]).astype(np.int64)])
            change[offsets[:-1][some]] = 0
            switches[some] = np.add.reduceat(change, offsets[:-1][some])
        return label, score, n, switches


def fit(rows: list[tuple[str, str]], stretch: int = STRETCH, seed: int = 1) -> Labeller:
    """Train on (text, label) rows."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return Labeller(None, [])
    rng = np.random.default_rng(seed)
    texts = [(split(t), labels.index(label)) for t, label in rows]
    counts = [Counter() for _ in labels]
    sequences: list[tuple[list[str], list[int]]] = []
    for ws, y in texts:
        at = max(0, (len(ws) - stretch) // 2)
        if ws := ws[at : at + stretch]:
            counts[y].update(ws)
            sequences.append((ws, [y] * len(ws)))
    lexicons = [frozenset(w for w, n in c.items() if n > 1) for c in counts]
    for _ in range(len(sequences) // 3):  # code-switched: stretches of different texts, joined
        ws, ys = [], []
        for i in rng.integers(0, len(sequences), rng.integers(2, 5)):
            a = rng.integers(0, len(sequences[i][0]))
            b = a + rng.integers(3, 20)
            ws += sequences[i][0][a:b]
            ys += sequences[i][1][a:b]
        sequences.append((ws, ys))
    vocabulary = sorted({w for ws, _ in sequences for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids, at = features(vocabulary, lexicons)
    tokens = [number[w] for ws, _ in sequences for w in ws]
    token_ids = [ids[at[i] : at[i + 1]] for i in tokens]
    token_offsets = np.concatenate([[0], np.cumsum([len(x) for x in token_ids])])
    offsets = np.concatenate([[0], np.cumsum([len(ws) for ws, _ in sequences])])
    tags = np.array([y for _, ys in sequences for y in ys])
    model = crf.train(np.concatenate(token_ids), token_offsets, tags, offsets, labels, DIM, epochs=4)
    return Labeller(model, lexicons)


def held_out() -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """draw, text, lang: about 1.3 * per_language rows of each label, of documents that are not held out.

    Takes rows whose id hash is below a bound that the label's count sets, so a scan of the table finds them
    without a shuffle; ids only choose training rows. The driver holds a count for each label; the model has more than that.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r.lang, per_language * 1.3 / r.n))), F.col("lang")) if counts else F.lit(0.0)
    middle = F.expr(f"substring(text, greatest(1, length(text) div 2 - {8 * STRETCH}), {16 * STRETCH})")
    return usable.filter(draw < bound).select(draw.alias("draw"), middle.alias("text"), "lang")


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Labeller:
    """fit() on the per_language rows of least draw of each label, in one task, as the sample is bounded; the driver gets the model only."""

    def run(batches: Iterator[pa.RecordBatch]):
        found = sorted((r["lang"], r["draw"], r["text"]) for b in batches for r in b.to_pylist())
        seen: Counter = Counter()
        own = []
        for lang, _, text in found:
            seen[lang] += 1
            if seen[lang] <= per_language:
                own.append((text, lang))
        model = pickle.dumps(fit(own))
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else Labeller(None, [])


COLUMNS = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def predict(docs: DataFrame, labeller: Labeller) -> DataFrame:
    """docs (doc_id, held_out, text) to COLUMNS."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in slices(batch):
                label, score, n, switches = labeller.predict(b["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(label), pa.array(score), pa.array(n), pa.array(switches)], names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    return docs.mapInArrow(run, COLUMNS)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the labelled documents that are not held out, and predict all of them."""
    labeller = train(training_rows(docs, per_language), per_language)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), labeller)


def keep(docs: DataFrame, labeller: Labeller, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least the score."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in slices(batch):
                label, score, _, _ = labeller.predict(b["text"].to_pylist())
                yield b.filter(pa.array([x != UNDECIDED and s >= least for x, s in zip(label, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
