"""Removal of repeated substrings with a logarithmic family of sparse suffix arrays.

Every byte that a string of `length` bytes covers which also starts anywhere else goes. Each window of that
length has an anchor, the leftmost of its `gram`-byte strings of least hash; equal windows have the same
anchor at the same place, and neighbouring windows mostly share one. So the suffixes that start at anchors
are all that an index has to hold (a sparse suffix array), each with the bytes before it.

1. Slices of documents (a written table) ask, packed by ranges of hash values, how often each anchor string occurs,
   and with which surroundings (the union of the windows that share the anchor: a stretch). An anchor that occurs once
   is in no match. Stretches that are equal byte by byte are repeated in whole: copies, however many, are counted
   before anything is dealt out and never meet in one task as rows.
2. One of each set of equal stretches whose anchor also occurs with other surroundings goes to a shard of the index, in the batch that its
   slice arrives with. The index is a family of levels, tables in the shared folder, each of twice as many batches as the one below. A batch's
   stretches get a suffix array with their longest common prefixes (and the same of what stands
   before the anchors, reversed); it is merged with each level, and a scan of both orders finds the windows that they share. It
   takes up the levels that equal it in size, and is written as the next one. Merges merge sorted orders; nothing is sorted twice.
3. Anchors with more than `hot` different surroundings would make a shard's group large. They have an exact way of their own: their windows are counted
   one by one, by the same packed questions as in 1, in which no key is hot.
4. Slices put the answers together, and remove.

Defined cases: texts are taken as UTF-8, null as empty; matches never cross documents; repeated rows are documents of
their own, and repeat each other; a text shorter than `length` loses nothing; an empty table gives no rows; other columns
are ignored. Windows are told apart by bytes in the shards; anchors, stretches and the windows of hot anchors by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe.llm import packed, textops
from mailframe.llm.common import materialize, release_memory, sorted_groups

LENGTH, GRAM, SLICE_BYTES, RANGE_ROWS, SHARD_ROWS, BATCHES, HOT = 200, 40, 1 << 20, 400_000, 8_000, 4, 2_000
RANGES_A_TASK = 8
REPEATED, WHOLE, OPEN, SENDER, CROWDED = 1, 2, 4, 8, 16
_POSITION = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """For each run of windows that share an anchor: place of the anchor, first and last window start, and hashes."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return {"at": none, "first": none, "last": none, "key": none.astype(np.uint64), "stretch": none.astype(np.uint64)}
    h = textops.prefix(data)
    grams = textops.all_spans(h, gram)
    least = (grams & ~_POSITION) | np.arange(n - gram + 1, dtype=np.uint64)  # ties go to the left
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        np.minimum(least[:-step], least[step:], out=least[:-step])
        step *= 2
    least = np.minimum(least[: n - length + 1], least[width - step : width - step + n - length + 1])
    at = (least & _POSITION).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)  # window starts whose window ends within the document
    some = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - length + 1, -1)
    inside = np.cumsum(inside[: n - length + 1], dtype=np.int8).astype(bool)
    begins, ends = inside.copy(), inside.copy()
    changed = at[1:] != at[:-1]
    begins[1:] &= changed | ~inside[:-1]
    ends[:-1] &= changed | ~inside[1:]
    starts = offsets[:-1][some]  # a document's first window begins a run of its own
    begins[starts] = True
    before = starts[(starts > 0)] - 1
    before = before[before < len(ends)]
    ends[before] = inside[before]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = at[first]
    whole = textops.mix64(textops.spans(h, first, last + length) + textops.mix64((at - first).astype(np.uint64) + np.uint64(1)))
    key = textops.mix64(grams[at])  # anchors have the least hashes around, so spread them over the ranges again
    return {"at": at, "first": first, "last": last, "key": key, "stretch": whole}


def _pairs(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the runs by (key, stretch), and where each distinct pair starts in it."""
    order = np.lexsort((found["stretch"], found["key"]))
    k, s = found["key"][order], found["stretch"][order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return textops.utf8(table["text"])


def ask(parts: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    """Each slice's distinct (anchor, stretch) pairs with their counts, to the owners of ranges of anchor hashes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for name, data in zip(b["slice"].to_pylist(), b["packed"], strict=True):
                found = anchors(*_texts(packed.opened(data.as_py())), length, gram)
                order, first = _pairs(found)
                count = np.diff(np.append(first, len(order)))
                key, stretch = found["key"][order[first]], found["stretch"][order[first]]
                for r, lo, hi in packed.segments(key, ranges):
                    q = packed.question(name, r, key[lo:hi], count[lo:hi])
                    yield pa.RecordBatch.from_arrays([*q.columns, pa.array([packed.pack(stretch[lo:hi])], pa.binary())], names=["slice", "range", "values", "counts", "stretches"])
                del found, order, key, stretch
                release_memory()

    return parts.select("slice", "packed").mapInArrow(run, packed.QUESTION + ", stretches binary")


def answer(questions: DataFrame, hot: int, tasks: float = 0) -> DataFrame:
    """slice, range, codes (a byte per pair asked), and how many stretches a shard or the counting of windows will get."""

    def run(batches: Iterator[pa.RecordBatch]):
        for group in sorted_groups(batches, ["range"]):
            keys = [np.cumsum(packed.unpack(x), dtype=np.uint64) for x in group["values"].to_pylist()]
            size = np.cumsum([len(v) for v in keys])[:-1]
            key = np.concatenate(keys)
            count = np.concatenate([packed.unpack(x) for x in group["counts"].to_pylist()]).astype(np.int64)
            stretch = np.concatenate([packed.unpack(x) for x in group["stretches"].to_pylist()])
            order = np.lexsort((stretch, key))
            k, s, c = key[order], stretch[order], count[order]
            new_key = np.concatenate([[True], k[1:] != k[:-1]])
            new = new_key | np.concatenate([[True], s[1:] != s[:-1]])
            of_key, of_pair = np.cumsum(new_key) - 1, np.cumsum(new) - 1
            n_key, n_pair = np.add.reduceat(c, np.flatnonzero(new_key))[of_key], np.add.reduceat(c, np.flatnonzero(new))[of_pair]
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[of_key]
            open_, crowded = n_key > n_pair, kinds > hot
            code = REPEATED * (n_key > 1) + WHOLE * (n_pair > 1) + OPEN * open_ + SENDER * (open_ & new & ~crowded) + CROWDED * (open_ & crowded)
            back = np.zeros(len(code), np.uint8)
            back[order] = code
            for name, r, part in zip(group["slice"].to_pylist(), group["range"].to_pylist(), np.split(back, size), strict=True):
                sent, hot_ = int(((part & SENDER) > 0).sum()), int(((part & CROWDED) > 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.int32()), pa.array([packed.pack(part)], pa.binary()), pa.array([sent], pa.int64()), pa.array([hot_], pa.int64())], names=["slice", "range", "codes", "sent", "crowded"])

    return packed.dealt(questions, "range", tasks).sortWithinPartitions("range").mapInArrow(run, "slice string, range int, codes binary, sent long, crowded long")


def _codes(found: dict[str, np.ndarray], answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each run, and whether it is the first of its (anchor, stretch) pair in the slice."""
    order, first = _pairs(found)
    codes = np.concatenate([packed.unpack(x) for x in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
    out, lead = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    out[order] = np.repeat(codes, np.diff(np.append(first, len(order))))
    lead[order[first]] = True
    return out, lead


def _in_order(right: pa.Table, column: str) -> list[bytes]:
    return [x for _, x in sorted(zip(right["range"].to_pylist(), right[column].to_pylist(), strict=True))]


STRETCH = "slice string, shard long, run int, key long, before binary, after binary, low int, high int, whole boolean"


def stretches(parts: DataFrame, answers: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """The open stretches that slices send to shards: bytes before and from the anchor, and how far windows reach to the left of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for name, data in zip(left["slice"].to_pylist(), left["packed"].to_pylist(), strict=True):
            text, offsets = _texts(packed.opened(data))
            found = anchors(text, offsets, length, gram)
            code, lead = _codes(found, _in_order(right, "codes"))
            pick = np.flatnonzero(lead & ((code & SENDER) > 0))
            at, first, last, key = (found[k][pick] for k in ("at", "first", "last", "key"))
            raw = text.tobytes()
            made.append(pa.table({
                "slice": pa.array([name] * len(pick), pa.string()), "shard": pa.array((key % np.uint64(shards)).astype(np.int64)), "run": pa.array(pick.astype(np.int32)), "key": pa.array(key.view(np.int64)),
                "before": pa.array([raw[a:b] for a, b in zip(first, at, strict=True)], pa.binary()), "after": pa.array([raw[a : b + length] for a, b in zip(at, last, strict=True)], pa.binary()),
                "low": pa.array((at - last).astype(np.int32)), "high": pa.array((at - first).astype(np.int32)), "whole": pa.array((code[pick] & WHOLE) > 0),
            }))
        del raw, found
        release_memory()
        return pa.concat_tables(made)

    return parts.select("slice", "packed").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, STRETCH)


class SuffixArray:
    """Suffixes at anchors in the order of their bytes, with the lengths of common prefixes of neighbours.

    `after` and `before` are byte matrices: from the anchor on, and what stands before it, reversed. The second
    order, `left`, is that of `before` and gives the same for extensions to the left. `names` are rows of what scan() marks.
    """

    def __init__(self, after: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray, left: np.ndarray | None = None):
        if left is None:  # new suffixes, in any order
            order = np.argsort(_keys(after), kind="stable")
            after, before, low, high, names = after[order], before[order], low[order], high[order], names[order]
            left = np.argsort(_keys(before), kind="stable")
        self.after, self.before, self.low, self.high, self.names, self.left = after, before, low, high, names, left
        self.common, self.left_common = self._neighbours(after), self._neighbours(before[left])

    @staticmethod
    def _neighbours(rows: np.ndarray) -> np.ndarray:
        """Bytes that each row has in common with the row before; bytes beyond a row's end are equal zeros, and never asked for."""
        out = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            differ = rows[1:] != rows[:-1]
            out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        return out

    def __len__(self) -> int:
        return len(self.names)

    @staticmethod
    def merged(a: SuffixArray, b: SuffixArray) -> SuffixArray:
        """One array of two, by merging their two orders; nothing is sorted again."""
        to_a, to_b = _merge(_keys(a.after), _keys(b.after))
        n = len(a) + len(b)

        def both(k: str) -> np.ndarray:
            out = np.empty((n, *getattr(a, k).shape[1:]), getattr(a, k).dtype)
            out[to_a], out[to_b] = getattr(a, k), getattr(b, k)
            return out

        left = np.empty(n, np.int64)
        left_a, left_b = _merge(_keys(a.before[a.left]), _keys(b.before[b.left]))
        left[left_a], left[left_b] = to_a[a.left], to_b[b.left]
        return SuffixArray(*(both(k) for k in ("after", "before", "low", "high", "names")), left)

    def some(self, rows: np.ndarray) -> SuffixArray:
        """The array of some of the suffixes, given by ascending places."""
        place = np.full(len(self), -1)
        place[rows] = np.arange(len(rows))
        left = place[self.left]
        return SuffixArray(*(getattr(self, k)[rows] for k in ("after", "before", "low", "high", "names")), left[left >= 0])

    def shared(self, depth: int) -> np.ndarray:
        """Rows that have at least depth bytes in common with a neighbour: only these can share a window."""
        near = self.common >= depth
        near[:1] = False
        return np.flatnonzero(near | np.append(near[1:], False))

    def scan(self, length: int, gram: int, found: np.ndarray) -> None:
        """Set found[name, l] where the window that starts l bytes before the suffix of that name is that of another suffix.

        Suffixes are in one class at a depth as long as neighbours have that many bytes in common, so for each l two
        running sums give the classes of what lies left and right of the anchor; windows are equal if both classes are.
        """
        some = self.shared(gram)
        if len(some) < 0.8 * len(self):
            if len(some):
                self.some(some).scan(length, gram, found)
            return
        left = np.empty(len(self), np.int64)
        for l in range(int(self.low.min(initial=0)), int(self.high.max(initial=-1)) + 1):  # noqa: E741
            own = np.flatnonzero((self.low <= l) & (self.high >= l))
            if len(own) < 2:
                continue
            left[self.left] = np.cumsum(self.left_common < l)
            both = (left * (len(self) + 1) + np.cumsum(self.common < length - l))[own]
            order = np.argsort(both)
            same = both[order][1:] == both[order][:-1]
            found[self.names[own[order[1:][same]]], l] = True
            found[self.names[own[order[:-1][same]]], l] = True


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that compare like them (but for zeros at their ends)."""
    return np.ascontiguousarray(rows).view(f"S{max(1, rows.shape[1])}").ravel()


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of two sorted arrays in the sorted whole."""
    to_b = np.searchsorted(a, b, side="right") + np.arange(len(b))
    free = np.ones(len(a) + len(b), bool)
    free[to_b] = False
    return np.flatnonzero(free), to_b


def carry(ranks: set[int]) -> int:
    """The rank at which a new array ends up among these: it takes up equals, one after the other, as in counting."""
    rank = 0
    while rank in ranks:
        rank += 1
    return rank


def add(levels: dict[int, SuffixArray], new: SuffixArray, length: int, gram: int, found: np.ndarray) -> SuffixArray:
    """Scan a new array, and merged with each level, for equal windows; gives it merged with the levels that it takes up."""
    rank = carry(set(levels))
    new.scan(length, gram, found)
    out = new
    for k in sorted(levels):
        both = SuffixArray.merged(out if k < rank else new, levels[k])
        both.scan(length, gram, found)
        out = both if k < rank else out
    return out


def _matrix(values: list[bytes], width: int, backwards: bool = False) -> np.ndarray:
    out = np.zeros((len(values), width), np.uint8)
    for i, v in enumerate(values):
        row = np.frombuffer(v, np.uint8)
        out[i, : len(row)] = row[::-1] if backwards else row
    return out


LEVEL = "shard long, rank int, packed binary"


def _store(array: SuffixArray, sender: np.ndarray, run: np.ndarray, whole: np.ndarray, names: list[str]) -> bytes:
    """An array with what tells its suffixes: numbers of slices (and their names), runs, and whether they are known to repeat."""
    own = array.names
    return zstandard.compress(pickle.dumps((array.after, array.before, array.low, array.high, array.left, sender[own], run[own], whole[own], names)), 1)


def index_shard(new: pa.Table, held: dict[int, bytes], length: int, gram: int) -> tuple[bytes, list[tuple[str, np.ndarray]]]:
    """One batch's stretches and a shard's levels: the array that the batch becomes, and for each slice its (run, l) pairs of repeated windows."""
    names, sender = np.unique(new["slice"].to_pylist(), return_inverse=True)
    names, senders = names.tolist(), [sender]
    runs, whole = [new["run"].to_numpy().astype(np.int64)], [new["whole"].to_numpy(zero_copy_only=False)]
    levels, n = {}, len(new)
    for rank, data in held.items():
        after, before, low, high, left, of, run, known, own = pickle.loads(zstandard.decompress(data))
        levels[rank] = SuffixArray(after, before, low, high, np.arange(n, n + len(low)), left)
        number = {name: i for i, name in enumerate(names)}
        names += [x for x in own if x not in number]
        number = {name: i for i, name in enumerate(names)}
        senders.append(np.array([number[x] for x in own], np.int64)[of])
        runs.append(run)
        whole.append(known)
        n += len(low)
    sender, run, known = np.concatenate(senders), np.concatenate(runs), np.concatenate(whole)
    found = np.zeros((n, length - gram + 1), bool)
    low, high = (new[k].to_numpy().astype(np.int64) for k in ("low", "high"))
    array = SuffixArray(_matrix(new["after"].to_pylist(), length), _matrix(new["before"].to_pylist(), length - gram + 1, True), low, high, np.arange(len(new)))
    out = add(levels, array, length, gram, found)
    found[known] = False  # known already
    row, l = np.nonzero(found)  # noqa: E741
    pair = (run.astype(np.uint64)[row] << np.uint64(16)) | l.astype(np.uint64)
    order = np.argsort(sender[row], kind="stable")
    ends = np.cumsum(np.bincount(sender[row], minlength=len(names)))
    return _store(out, sender, run, known, names), [(name, own) for name, own in zip(names, np.split(pair[order], ends[:-1]), strict=True) if len(own)]


def search(sent: DataFrame, batches: int, length: int, gram: int) -> DataFrame:
    """slice, range (-1), codes: packed (run, l) pairs of repeated windows, from an index that takes the stretches batch by batch.

    The index is a table for each of its levels in the shared folder, with a row for each shard; a level's number of
    batches is a power of two. Each batch is scanned against itself and every level, and taken up with the levels it equals in size.
    """
    levels: dict[int, DataFrame] = {}
    told = None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right["rank"].to_pylist(), right["packed"].to_pylist(), strict=True))
        shard = (left if len(left) else right)["shard"][0].as_py()
        rank, first = carry(ranks), [None, None, None]
        if len(left):
            packed_, pairs = index_shard(left, held, length, gram)
            rows = [(*first, shard, rank, packed_), *((name, -1, packed.pack(own), None, None, None) for name, own in pairs)]
        else:  # nothing new in this shard: of the levels that go up, the largest stands for all where it is alone
            up = sorted(k for k in held if k < rank)
            rows = [(*first, shard, rank, _join([held[k] for k in up]))] if up else []
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    types = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    names = ["slice", "range", "codes", "shard", "rank", "packed"]
    for i in range(batches):
        ranks = set(levels)
        new = sent.filter(F.col("batch") == i).drop("batch")
        held = sent.sparkSession.createDataFrame([], LEVEL)
        for df in levels.values():
            held = held.unionAll(df)
        done = materialize(new.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(run, "slice string, range int, codes binary, " + LEVEL), "level")
        found = done.filter("codes IS NOT NULL").select("slice", "range", "codes")
        told = found if told is None else told.unionAll(found)
        rank = carry(ranks)
        levels = {k: v for k, v in levels.items() if k > rank} | {rank: done.filter("packed IS NOT NULL").select("shard", "rank", "packed")}
    return told


def _join(stored: list[bytes]) -> bytes:
    """Stored arrays merged into one, without a scan, as they have met already."""
    if len(stored) == 1:
        return stored[0]
    array, sender, run, whole, names = None, [], [], [], []
    for data in stored:
        after, before, low, high, left, of, run_, known, own = pickle.loads(zstandard.decompress(data))
        n = sum(map(len, run))
        one = SuffixArray(after, before, low, high, np.arange(n, n + len(low)), left)
        array = one if array is None else SuffixArray.merged(array, one)
        sender.append(of + len(names))
        names = names + own
        run.append(run_)
        whole.append(known)
    return _store(array, np.concatenate(sender), np.concatenate(run), np.concatenate(whole), names)


def _crowded(found: dict[str, np.ndarray], code: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of hot anchors, and their hashes."""
    runs = np.flatnonzero((code & CROWDED) > 0)
    size = found["last"][runs] - found["first"][runs] + 1
    start = np.repeat(found["first"][runs] - np.cumsum(size) + size, size) + np.arange(size.sum())
    if not len(start):
        return start, np.zeros(0, np.uint64)
    return start, textops.spans(textops.prefix(text), start, start + length)


def ask_windows(parts: DataFrame, answers: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for name, data in zip(left["slice"].to_pylist(), left["packed"].to_pylist(), strict=True):
            text, offsets = _texts(packed.opened(data))
            found = anchors(text, offsets, length, gram)
            values, counts = packed.distinct(_crowded(found, _codes(found, _in_order(right, "codes"))[0], text, length)[1])
            made += [packed.question(name, r, values[lo:hi], counts[lo:hi]) for r, lo, hi in packed.segments(values, ranges)]
        return pa.Table.from_batches(made, schema=packed.QUESTION_SCHEMA)

    return parts.select("slice", "packed").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, packed.QUESTION)


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_HOT_OFFSET = 1 << 30  # ranges of answers about windows come after those about anchors


def covered(text: np.ndarray, offsets: np.ndarray, right: pa.Table, length: int, gram: int) -> np.ndarray:
    """Which bytes of a slice a repeated window covers; right: all answers to the slice (range, codes)."""
    found = anchors(text, offsets, length, gram)
    rows = sorted(zip(right["range"].to_pylist(), right["codes"].to_pylist(), strict=True))
    code, _ = _codes(found, [x for r, x in rows if 0 <= r < _HOT_OFFSET])
    cover = np.zeros(len(text) + 1, np.int64)
    whole = np.flatnonzero((code & WHOLE) > 0)
    np.add.at(cover, found["first"][whole], 1)
    np.add.at(cover, found["last"][whole] + length, -1)
    starts = []
    for r, x in rows:
        if r == -1:
            pair = packed.unpack(x)
            starts.append(found["at"][(pair >> np.uint64(16)).astype(np.int64)] - (pair & np.uint64(0xFFFF)).astype(np.int64))
    if hot := [packed.unpack(x) for r, x in rows if r >= _HOT_OFFSET]:
        start, values = _crowded(found, code, text, length)
        total = np.concatenate(hot)
        order = np.argsort(values)
        new = np.concatenate([[True], values[order][1:] != values[order][:-1]])
        starts.append(start[order[total[np.cumsum(new) - 1] > 1]])
    for s in starts:
        np.add.at(cover, s, 1)
        np.add.at(cover, s + length, -1)
    return np.cumsum(cover[:-1]) > 0


def remove(parts: DataFrame, answers: DataFrame, length: int, gram: int, texts: bool) -> DataFrame:
    """COLUMNS for every document, with the kept bytes if asked for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for data in left["packed"].to_pylist():
            table = packed.opened(data)
            text, offsets = _texts(table)
            gone = covered(text, offsets, right, length, gram)
            for d, a, b in zip(table["doc_id"].to_pylist(), offsets, offsets[1:], strict=False):
                g = gone[a:b]
                kept = text[a:b][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                rows.append((d, int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
        names = [*(c.split(" ")[0] for c in COLUMNS.split(", ")), *(["kept"] if texts else [])]
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
        release_memory()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return parts.select("slice", "packed").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, COLUMNS + (", kept binary" if texts else ""))


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int | None = None, texts: bool = False, slice_bytes: int = SLICE_BYTES, range_rows: int = RANGE_ROWS, shard_rows: int = SHARD_ROWS, batches: int = BATCHES, hot: int = HOT, message: int = packed.MESSAGE) -> DataFrame:
    """docs (doc_id, text) to COLUMNS and, with texts, the bytes that are kept.

    slice_bytes and range_rows are the least sizes; from about 13 GB on both grow so that messages hold `message` anchors (9 MB at 1 TB, 94 MB at 100 TB).
    """
    gram = gram or max(1, length * GRAM // LENGTH)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    density = 2 / (length - gram)  # anchors a byte, about
    grow = packed.growth(size * density, slice_bytes * density, range_rows, message)
    parts = materialize(packed.slices(docs, int(slice_bytes * grow)), "slices")
    ranges = max(1, math.ceil(size * density / (range_rows * grow)))
    answers = materialize(answer(ask(parts, ranges, length, gram), hot, ranges / RANGES_A_TASK), "answers")
    sent, crowded = answers.agg(F.sum("sent"), F.sum("crowded")).first()
    told = answers.select("slice", "range", "codes")
    if sent:
        arrived = stretches(parts, answers.select("slice", "range", "codes"), math.ceil(sent / shard_rows), length, gram)
        arrived = materialize(arrived.withColumn("batch", F.pmod(F.xxhash64("slice"), F.lit(batches)).cast("int")), "stretches")
        told = told.unionAll(search(arrived, batches, length, gram))
    if crowded:
        windows = ask_windows(parts, answers.select("slice", "range", "codes"), max(1, math.ceil(crowded * length / 2 / range_rows / 4)), length, gram)
        told = told.unionAll(packed.totals(windows).select("slice", (F.col("range") + _HOT_OFFSET).alias("range"), F.col("totals").alias("codes")))
    return remove(parts, told, length, gram, texts)
