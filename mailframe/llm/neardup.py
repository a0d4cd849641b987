"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them.

Texts with equal sets of five-word shingles form a class (their similarity is 1) and are handled as one text
with a weight. A class gets `bands` keys of `rows` MinHash values each; classes that share a key are linked
to the key's smallest member (a star, so edges grow with the rows and never with the square of a bucket), and
the connected groups of that graph are candidate groups: whatever two classes share a key lie in one group.
Inside a group, every two classes are verified on their full sets. Groups are cut into blocks of bounded numbers of classes and
shingles, and every pair of blocks is counted by itself; tasks emit counts of links, and the classes' roots where a group is one block, else a
spanning forest of what they linked, never pairs. Components of the forests are the near-duplicate classes. Joins on keys that
a third of all rows may share (a class of copies, a group's root) go by hot_join().

bands and rows follow from the similarity and the recall asked for: a pair at just that similarity is missed
with probability (1 - s**rows)**bands <= 1 - recall, a closer one far less.

Defined cases: null, empty and blank texts have no shingles, link to nothing and are alone; a text of fewer
than five words is one shingle; repeated rows are copies, each with its own output row; a null id is kept
(its class id is that of its texts); an empty table gives no rows; other columns are ignored. A class without
any id that is not null has the class id null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailframe.llm import textops
from mailframe.llm.common import fresh, hot_join, materialize, release_memory, sorted_groups
from mailframe.llm.components import components

SIMILARITY, RECALL, SHINGLE, MOST_HASHES, SIDE, SET_SIZE = 0.8, 0.9999, 5, 512, 128, 1024
SLICE_BYTES, TASK_BYTES, WIDTH = 2 << 20, 32 << 20, 4096
COUNT, ROOT, EDGE = 0, 1, 2


def choose_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which some number of bands reaches the recall with at most `most` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**32, (2, n), np.uint64).astype(np.uint32) | np.uint32(1)


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys of non-empty shingle sets; equal minima in a band give equal keys."""
    n = len(offsets) - 1
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    a, b = _multipliers(bands * rows)
    minima = np.zeros((bands * rows, n), np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        at = offsets[:-1][some]
        for j in range(bands * rows):
            minima[j, some] = np.minimum.reduceat(low * a[j] + high * b[j], at)
    keys = np.zeros((n, bands), np.uint64)
    for i in range(bands):
        k = np.full(n, i + 1, np.uint64)
        for r in range(rows):
            k = textops.mix64(k * textops.BASE + minima[i * rows + r])
        keys[:, i] = k
    return keys


def _set_key(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, together a hash of the set."""
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for i in range(2):
            out[i, some] = textops.mix64(np.add.reduceat(textops.mix64(values ^ np.uint64(0xA5A5 + i)), offsets[:-1][some]) + np.diff(offsets)[some].astype(np.uint64))
    return out.view(np.int64)


def keyed_texts(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, rep, h1, h2, size, keys: hash and size of each text's shingle set, and its band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in (x for batch in batches for x in textops.slices(batch, most=SLICE_BYTES)):
            values, offsets = textops.shingles(b["text"], k)
            h1, h2 = _set_key(values, offsets)
            keys = band_keys(values, offsets, bands, rows).view(np.int64)
            size = np.diff(offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rep"], pa.array(h1), pa.array(h2), pa.array(size), flat], names=["doc_id", "rep", "h1", "h2", "size", "keys"])
            del values, offsets, keys, flat
            release_memory()

    return docs.mapInArrow(run, "doc_id long, rep long, h1 long, h2 long, size long, keys array<long>")


MEMBER = "root long, n int, block int, cid long, weight long"


def class_sets(reps: DataFrame, k: int) -> DataFrame:
    """MEMBER and shingles: the set of each representative's text, as packed 64-bit values; rows whose text isn't of its class go."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in (x for batch in batches for x in textops.slices(batch, most=SLICE_BYTES)):
            values, offsets = textops.shingles(b["text"], k)
            h1, h2 = _set_key(values, offsets)
            right = np.flatnonzero((h1 == b["h1"].to_numpy()) & (h2 == b["h2"].to_numpy()))
            sets = pa.array([values[offsets[i] : offsets[i + 1]].tobytes() for i in right], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(right)) for c in MEMBERS), sets], names=[*MEMBERS, "shingles"])
            del values, offsets, sets
            release_memory()

    return reps.select(*MEMBERS, "h1", "h2", "text").mapInArrow(run, MEMBER + ", shingles binary")


MEMBERS = [c.split(" ")[0] for c in MEMBER.split(", ")]


class _Forest:
    """Union-find over a task's own numbering."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks (or of one with itself), exact: products of 0/1 matrices over the values that two sets can share."""
    sets, n = [*left, *(right or [])], len(left)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    value, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    if right is None:
        shared = np.bincount(inverse, minlength=len(value)) > 1
    else:
        shared = (np.bincount(inverse[owner < n], minlength=len(value)) > 0) & (np.bincount(inverse[owner >= n], minlength=len(value)) > 0)
    column = (np.cumsum(shared) - 1).astype(np.int32)
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, len(right) if right is not None else n), np.float32)  # sums of at most 2**24 ones are exact
    for lo in range(0, int(shared.sum()), WIDTH):
        a, b = np.searchsorted(column, [lo, lo + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        total += m @ m.T if right is None else m[:n] @ m[n:].T
    both = total.astype(np.int64)
    if right is None:
        np.fill_diagonal(both, [len(s) for s in left])
    return both


def _verify(group: pa.Table, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """Rows of links() for one pair of blocks, or for one block with itself."""
    ids, weight, side = (group[k].to_numpy() for k in ("cid", "weight", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"]]
    size = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    both = _common([sets[i] for i in left], None if alone else [sets[j] for j in right])
    right = left if alone else right
    # in whole numbers of ten-thousandths, so that ties at the threshold don't hang on rounding
    linked = both * 10_000 >= round(similarity * 10_000) * (size[left][:, None] + size[right][None, :] - both)
    i, j = np.nonzero(np.triu(linked, 1) if alone else linked)
    i, j = left[i], right[j]
    if not len(i):
        return
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    forest = _Forest(len(ids))
    tree = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
    whole = group["n"][0].as_py() == 1  # no other task has links of this group
    for x in np.flatnonzero(links).tolist():
        yield int(ids[x]), int(links[x]), int(ids[forest.find(x)]), ROOT if whole else COUNT
    if not whole:
        for x, y in tree:
            yield int(ids[x]), 0, int(ids[y]), EDGE


def _once(group: pa.Table) -> pa.Table:
    """Each class once, by number: copies of a representative may have come along."""
    cid, first = np.unique(group["cid"].to_numpy(), return_index=True)
    return group.take(pa.array(first))


def links(members: DataFrame, tasks: int, similarity: float = SIMILARITY) -> DataFrame:
    """members: (root, p, q, n, side, cid, weight, shingles), a pair of blocks of a group in a task; rows (cid, links, other, kind).

    Rows of kind COUNT and ROOT carry counts of linked documents, those of kind ROOT the class's root as well, as one task has the
    group; rows of kind EDGE are those of a spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("kind", pa.int32())])
        out: list[tuple[int, int, int, int]] = []
        bytes_ = 0
        for group in sorted_groups(batches, ["root", "p", "q"]):
            out += _verify(_once(group), similarity)
            bytes_ += group.nbytes
            if len(out) > 20_000 or bytes_ > SLICE_BYTES:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, bytes_ = [], 0
                release_memory()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    dealt = members.repartition(tasks, "root", "p", "q").sortWithinPartitions("root", "p", "q")
    return dealt.select("root", "p", "q", "n", "side", "cid", "weight", "shingles").mapInArrow(run, "cid long, links long, other long, kind int")


def _row_keys(docs: DataFrame, name: str = "rep") -> DataFrame:
    """docs with a key that tells rows apart, unless id and text are equal."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))


def classify(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = SHINGLE, side: int = SIDE) -> DataFrame:
    """doc_id, rep, root, class_id, n_links, n_copies for each row of docs (doc_id, text); root is null without shingles.

    rep: the key of _row_keys(). Blocks of a group hold about `side` classes, or side * SET_SIZE shingles if that is fewer.
    """
    bands, rows = choose_bands(similarity, recall)
    docs = _row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    texts = materialize(keyed_texts(docs, k, bands, rows).withColumn("cid", F.xxhash64("h1", "h2")), "sets")
    classes = texts.filter("size > 0").groupBy("cid").agg(F.min("doc_id").alias("first"), F.min("rep").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("size").alias("size"))
    classes = materialize(classes, "classes")

    # a class's keys once, however many copies it has; of a key's classes all but the least point to that one
    each = texts.filter("size > 0").join(classes.select("cid", "rep"), ["cid", "rep"], "left_semi").select("cid", F.explode("keys").alias("key"))
    stars = each.select(F.col("cid").alias("a"), F.min("cid").over(Window.partitionBy("key")).alias("b")).filter("a != b")
    groups = materialize(components(stars), "groups")

    found = groups.withColumnRenamed("id", "cid").join(classes.select("cid", "rep", "h1", "h2", "weight", "size"), "cid")
    sums = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = sums.select("root", "n", F.ceil(F.greatest(F.col("n") / side, F.col("size") / (side * SET_SIZE))).cast("int").alias("blocks"))
    found = hot_join(found, blocks, "root", groups.count()).withColumnRenamed("blocks", "n")
    found = found.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int"))
    sets = class_sets(docs.select("rep", "text").join(found.drop("size"), "rep"), k)
    spread = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q"), (F.col("block") > j).cast("int").alias("side")))
    members = sets.select("root", "n", "cid", "weight", "shingles", F.explode(spread).alias("to")).select("*", "to.*")
    asked = sums.agg(F.sum(F.col("size") * F.ceil(F.greatest(F.col("n") / side, F.col("size") / (side * SET_SIZE))))).first()[0] or 0
    verified = materialize(links(members, max(1, math.ceil(asked * 8 / TASK_BYTES)), similarity), "links")

    counts = verified.filter(f"kind != {EDGE}").groupBy("cid").agg(F.sum("links").alias("links"), F.min(F.when(F.col("kind") == ROOT, F.col("other"))).alias("top"))
    roots = components(verified.filter(f"kind = {EDGE}").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    tops = classes.select("cid", "first", "weight").join(counts, "cid", "left").join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left")
    tops = materialize(tops.select("cid", "first", "weight", "links", F.coalesce("root", "top", "cid").alias("root")), "tops")
    n_classes, n_texts = tops.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    least = tops.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n"))
    done = hot_join(tops, least, "root", n_classes)
    done = materialize(done.select("cid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n_copies"), F.col("weight").alias("n")), "done")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = texts.filter("size = 0").select("doc_id", "rep", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), one.alias("n_copies"))
    return hot_join(texts.filter("size > 0").select("doc_id", "rep", "cid"), done, "cid", n_texts).drop("cid").unionAll(alone)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = SHINGLE, side: int = SIDE) -> DataFrame:
    """docs (doc_id, text) to one row per document: doc_id, class_id, n_links, n_copies.

    class_id: smallest doc_id of the documents connected by links of at least the similarity; n_links: other
    documents that this one links to (copies included); n_copies: documents of the same shingle set.
    """
    return classify(docs, similarity, recall, k, side).select("doc_id", "class_id", "n_links", "n_copies")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, k: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one document of each near-duplicate class: the one of smallest id (null ids last).

    Texts without shingles are alone and stay; of rows that repeat id and text one stays.
    """
    found = materialize(classify(docs, similarity, recall, k), "classified")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rep")).alias("m")
    rep, nth = fresh(docs, "rep", "nth")
    stay = found.filter("root is not null").groupBy("root").agg(first).select(F.col("m.rep").alias(rep))
    stay = stay.unionAll(found.filter("root is null").select(F.col("rep").alias(rep))).distinct()
    rows = _row_keys(docs, rep).join(stay, rep, "left_semi")
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(rep).orderBy(F.lit(0)))).filter(F.col(nth) == 1).select(*docs.columns)
