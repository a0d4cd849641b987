"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of characters other than letters, digits and _ as one space.
An item of m characters may occur with at most e = floor(rate * m) edits. It is split into e + 1 pieces; an
occurrence with e edits leaves one piece untouched, so an Aho-Corasick automaton over all pieces finds every
place where an occurrence can be, and Myers' bit-parallel distance decides there. It does so from small to large: of an
occurrence's halves one has fewer edits than pieces, and so on down to an untouched piece, so a hit is dropped as soon as the
half, quarter and so on around it has as many edits as pieces; only what is left is compared in whole. Documents are scanned once
for each block of items; a block is bounded by its bytes, and blocks are as many as the benchmark needs.

Items shorter than min_chars occur only without edits and on word bounds; next to a letter of a script written without
spaces (Han, kana, Thai and the like) every place is a bound.

Defined cases: null and empty texts match nothing; items that are null or empty when normalized match nothing; repeated items match under each of their ids; of an item's occurrences in a text
the one of least distance is reported, the first of them at ties; repeated documents are reported each; an
empty table or benchmark gives no matches; other columns are ignored by match() and kept by clean().
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, MIN_CHARS, BLOCK_CHARS = 0.1, 20, 2_000_000
_OTHER = re.compile(r"\W+")
#: Thai, Lao, Tibetan, Burmese, Khmer; kana, bopomofo, Han and what marks its repetition.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3031-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normalize(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def masks(pattern: str) -> dict[str, int]:
    """For each character a bit for each of its places."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end where it is reached."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = mask.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        more, less = down | (~(horizontal | up) & full), up & horizontal
        if more & high:
            score += 1
        elif less & high:
            score -= 1
            if score < best:
                best, end = score, at
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (~(vertical | more) & full), more & vertical
    return best, end


def _around(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the ranges of pieces around it, by halving, from the smallest to the last but the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    todo = [(0, pieces)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            if hi - lo < pieces:
                for j in range(lo, hi):
                    out[j].append((lo, hi))
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
    return [x[::-1] for x in out]


class Matcher:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.items = [(i, t, int(rate * len(t)) if len(t) >= min_chars else 0, masks(t)) for i, text in items if (t := normalize(text))]
        pieces: dict[str, list[tuple[int, int, tuple]]] = defaultdict(list)
        for n, (_, t, e, _) in enumerate(self.items):
            if len(t) < min_chars:
                pieces[t].append((n, 0, None))
                continue
            cuts = [len(t) * j // (e + 1) for j in range(e + 2)]
            part = lambda lo, hi, t=t, cuts=cuts: (cuts[lo], cuts[hi] - cuts[lo], hi - lo - 1, masks(t[cuts[lo] : cuts[hi]]))
            made: dict[tuple[int, int], tuple] = {}
            for j, ranges in enumerate(_around(e + 1)):
                steps = tuple(made.setdefault(r, part(*r)) for r in ranges)
                pieces[t[cuts[j] : cuts[j + 1]]].append((n, cuts[j], steps))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    @staticmethod
    def _stands(text: str, start: int, end: int) -> bool:
        """Whether text[start:end] begins and ends on word bounds."""
        return all(i in (0, len(text)) or " " in text[i - 1 : i + 1] or _UNSPACED.search(text, i - 1, i + 1) for i in (start, end))

    @staticmethod
    def _may(text: str, start: int, steps: tuple) -> bool:
        """Whether all that stands around a piece, from small to large, has fewer edits than pieces."""
        for at, size, edits, mask in steps:
            lo = start + at - edits
            if myers(mask, size, text[max(0, lo) : lo + size + 2 * edits])[0] > edits:
                return False
        return True

    def match(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, allowed distance, end in the normalized text) of each item that occurs."""
        text = normalize(text)
        if not text or not self.items:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for n, a, steps in places:
                start = end - size + 1 - a
                if start not in begins[n] and (self._stands(text, start, end + 1) if steps is None else self._may(text, start, steps)):
                    begins[n].add(start)
        found = []
        for n, starts in begins.items():
            if not starts:
                continue
            id_, t, e, mask = self.items[n]
            best = (e + 1, 0)
            lo = hi = None
            for s in [*sorted(starts), None]:
                if lo is not None and (s is None or s - e > hi):
                    d, end = myers(mask, len(t), text[lo:hi])
                    best = min(best, (d, lo + end))
                    lo = None
                if s is not None:
                    lo = max(0, s - e) if lo is None else lo
                    hi = s + len(t) + e
            if best[0] <= e:
                found.append((id_, best[0], e, best[1]))
        return found


_BUILT: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]], rate: float, min_chars: int) -> Matcher:
    """Built once in each worker; the last few are kept."""
    if key not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[key] = Matcher(items, rate, min_chars)
    return _BUILT[key]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def match(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, match_end: every item that a document holds within its error budget."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, budget long, match_end long")
    schema = pa.schema([(c, pa.int64()) for c in out.columns])

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]):
            m = _matcher(key, items, rate, min_chars)
            for b in batches:
                rows = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True) for x in m.match(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        return docs.mapInArrow(run, "doc_id long, item_id long, distance long, budget long, match_end long")

    for items in blocks(benchmark, block_chars):
        out = out.unionAll(scan(items))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, that hold no item of the benchmark."""

    def keep(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]):
            m = _matcher(key, items, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not m.match(t.as_py()) for t in b["text"]], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for items in blocks(benchmark, block_chars):
        docs = keep(docs, items)
    return docs
