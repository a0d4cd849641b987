"""Stupid-backoff scores of documents from n-gram counts over all documents.

Relations, packed: documents are dealt to slices of bounded bytes. Each slice explodes its
n-grams of every order (64-bit hashes) and groups them with their counts; the groups go to the partition of
the count table that owns their range of hash values. There counts of all slices are summed, and each slice gets
the totals of just the n-grams it asked for. A slice then joins totals and n-grams by position and sums
up scores per document. A frequent n-gram costs each slice one entry, however often it occurs, so no key is hot, and
the largest things a task holds are one slice, or one range of the count table.

With leave-one-out (default) a document's own occurrences are subtracted from every count, so a text is
no evidence for itself (copies of it elsewhere are). The score of a word after its context is c(ngram)/c(context) at the
highest order with a count, times alpha for each order that was skipped; a word seen nowhere else gets
alpha**order / (N + 1), with N the number of words counted.

Defined cases: words are lower-cased and white-space separated; a null or blank text has no words, log score
0 and a null mean; n-grams never cross documents; repeated rows are documents of their own; a null id is kept; an
empty table gives no rows; other columns are ignored. Two different n-grams share a 64-bit hash with a chance of about
n*n/2**65 over n distinct ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe.llm import packed, textops
from mailframe.llm.common import release_memory

ORDER, ALPHA, SLICE_BYTES, ROW_BYTES, RANGE_BYTES = 3, 0.4, 8 << 20, 1 << 20, 8 << 20
#: Bytes of a word, distinct n-grams that a word adds to its slice, and bytes of text for a task of the shuffles: all about.
WORD_BYTES, WORD_GRAMS, TASK_BYTES = 6, 2.2, 128 << 20
COLUMNS = "doc_id long, n_words long, log_score double, mean_log_score double, n_top long, n_backoff long, n_unseen long"


def ngrams(words: np.ndarray, offsets: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: hashes of the n-grams that end at each word, and the positions of those words."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    out, value = [], textops.mix64(words)
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1)
        if n > 1:  # the n-gram that ends at i: the (n-1)-gram that ends at i - 1, and word i
            longer = np.zeros_like(value)
            longer[at] = textops.mix64(value[at - 1] * textops.BASE + words[at] + np.uint64(n))
            value = longer
        out.append((value[at], at))
    return out


def _all_ngrams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    words, offsets = textops.words(texts)
    return offsets, ngrams(words, offsets, order)


def _wanted(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice's distinct n-grams of all orders, sorted, and their counts."""
    _, grams = _all_ngrams(table["text"].combine_chunks(), order)
    return packed.distinct(np.concatenate([g for g, _ in grams]))


def _slice(rows: pa.Table) -> pa.Table:
    """The documents of a slice from its rows; their order does not matter, but the rows of one slice may come in any."""
    return pa.concat_tables(packed.opened(x) for x in rows["packed"].to_pylist()).combine_chunks()


def asked(parts: DataFrame, order: int, ranges: int) -> DataFrame:
    """slice, range, values, counts: what each slice asks each range of hash values."""

    def run(rows: pa.Table) -> pa.Table:
        name = rows["slice"][0].as_py()
        values, counts = _wanted(_slice(rows), order)
        out = pa.Table.from_batches([packed.question(name, r, values[lo:hi], counts[lo:hi]) for r, lo, hi in packed.segments(values, ranges)], packed.QUESTION_SCHEMA)
        del values, counts
        release_memory()
        return out

    return parts.select("slice", "packed").groupBy("slice").applyInArrow(run, packed.QUESTION)


def score_slice(table: pa.Table, totals: np.ndarray, n_total: int, order: int, alpha: float, leave_one_out: bool) -> pa.Table:
    """Scores of the documents of one slice; totals: corpus counts of its distinct n-grams, sorted by hash."""
    offsets, grams = _all_ngrams(table["text"].combine_chunks(), order)
    n_docs, n_words = len(offsets) - 1, int(offsets[-1])
    length = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), length)
    flat = np.concatenate([g for g, _ in grams])
    by = np.argsort(flat)
    flat = flat[by]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    del flat
    number = np.empty(len(by), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    del by, new
    count = np.zeros((order + 1, n_words))  # of the n-gram that ends at a word; 0 where it doesn't reach back that far
    own_words = length[doc] if leave_one_out else np.zeros(n_words)
    count[0] = n_total - own_words
    at = 0
    for n, (g, where) in enumerate(grams, 1):
        ids = number[at : at + len(g)]
        at += len(g)
        c = totals[ids].astype(np.float64)
        if leave_one_out and len(g):
            pair = doc[where] * np.int64(len(totals)) + ids
            order_ = np.argsort(pair)
            fresh = np.flatnonzero(np.concatenate([[True], pair[order_][1:] != pair[order_][:-1]]))
            own = np.empty(len(g))
            own[order_] = np.repeat(np.diff(np.append(fresh, len(g))), np.diff(np.append(fresh, len(g))))
            c -= own
        count[n, where] = c
    del number

    def context(n: int) -> np.ndarray:
        """The count of each n-gram's first n - 1 words, which end one word before; unused at a document's start."""
        return count[0] if n == 1 else np.concatenate([[0.0], count[n - 1, :-1]])[:n_words]

    place = np.arange(n_words) - np.repeat(offsets[:-1], length)
    reach = np.minimum(place + 1, order)
    log, used = np.zeros(n_words), np.zeros(n_words, np.int64)
    for n in range(order, 0, -1):
        take = (used == 0) & (reach >= n) & (count[n] > 0)
        log[take] = np.log(count[n][take]) - np.log(context(n)[take]) + (reach[take] - n) * np.log(alpha)
        used[take] = n
    none = used == 0
    log[none] = order * np.log(alpha) - np.log(count[0][none] + 1)
    some = np.flatnonzero(length)
    total = np.zeros(n_docs)
    kinds = np.zeros((3, n_docs), np.int64)
    if len(some):
        start = offsets[:-1][some]
        total[some] = np.add.reduceat(log, start)
        for k, flag in enumerate((used == reach, (used > 0) & (used < reach), none)):
            kinds[k, some] = np.add.reduceat(flag.astype(np.int64), start)
    mean = pa.array(total / np.maximum(length, 1), mask=length == 0)
    return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(length, pa.int64()), "log_score": pa.array(total), "mean_log_score": mean, "n_top": pa.array(kinds[0]), "n_backoff": pa.array(kinds[1]), "n_unseen": pa.array(kinds[2])})


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_one_out: bool = True, slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES, message: int = packed.MESSAGE) -> DataFrame:
    """docs (doc_id, text) to COLUMNS: natural logarithms, n_top words scored at the highest order that fits.

    slice_bytes and range_bytes are the least sizes; from about 700 GB on both grow so that messages hold `message` values (93 MB at 100 TB).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_total = packed.count_words(docs)
    # dealt once and used twice: for questions, and to score what comes back (the plan reuses the exchange)
    grams = WORD_GRAMS / WORD_BYTES
    grow = packed.growth(n_total * WORD_GRAMS, slice_bytes * grams, range_bytes * grams, message)
    tasks = n_total * WORD_BYTES / TASK_BYTES
    parts = packed.dealt(packed.slices(docs, int(slice_bytes * grow), ROW_BYTES).select("slice", "packed"), "slice", tasks)
    ranges = max(1, math.ceil(n_total * WORD_BYTES / (range_bytes * grow)))
    answers = packed.totals(asked(parts, order, ranges), tasks * WORD_GRAMS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(right["range"].to_pylist(), right["totals"].to_pylist(), strict=True))
        totals = np.concatenate([packed.unpack(x) for _, x in rows]) if rows else np.zeros(0, np.uint64)
        done = score_slice(_slice(left), totals, n_total, order, alpha, leave_one_out)
        del totals
        release_memory()
        return done

    return parts.select("slice", "packed").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, COLUMNS)
