"""Jaccard join of word n-gram sets by rare-first prefix filtering.

Two documents link when ``100 * |A and B| >= percent * |A or B|``.

1. Equal texts are one class; a number made from its digest stands for it. One
   text of each class is settled; all that follows reads these.
2. One pass turns every such text into its sorted 64-bit n-gram hashes and counts
   all n-grams in a table of cells (about 32 n-grams to a cell, 16 million cells
   at most). The order of n-grams by their cell's count, rarest first, is global;
   any global order keeps prefix filtering exact, this one keeps it small. Counts
   are kept as rounded numbers of 8 bits a task and 16 bits in all, and summed
   over groups of 64 tasks at a time.
3. Each document hands out its prefix in that order: the n-grams of which a
   partner must hold at least one. N-grams in one prefix only go.
4. Prefix n-grams that few documents share: a join on the n-gram, with the
   length and positional filters, gives each candidate pair once. Prefix n-grams
   that many share give the pairs of each of their documents with the first one.
   The suffix filter bounds a pair's overlap by counts of both sets over
   partitions of the hash space; what passes is verified on the sets.
5. Where documents that share a frequent prefix n-gram aren't all connected by
   then, they form clusters, dealt into blocks of bounded size by set size; a pair
   of blocks is joined in one task with the same filters and a union-find forest.
   Blocks meet only if their sizes allow a link, and never two blocks of the
   cluster's largest component, which is connected already. Only forest links
   come out.
6. Components of the links by alternating large-star and small-star steps,
   settled to shared files each round; each is named by its smallest id.

Classes, n-grams, documents and roots that many rows share are salted by their
counted rows wherever rows meet them. What a cluster costs beyond that grows with
the blocks of its other components times all its blocks of like size.

Defined cases: null, empty or blank texts have no set and link with nothing;
a text of fewer words than n is one n-gram; a text of any length has its whole
set, held in one task; equal rows share a component; a null doc_id gets the
component of its class's other rows, or null; rows that share a doc_id but not
the text each follow their text; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_ids, forget, join_skewed, settle, small, text_batches

#: log2 of the least and most cells; parts in which tasks hand over their counts; tasks whose counts are summed at once.
LEAST_BITS, MOST_BITS, SLICES, TASKS = 16, 24, 64, 64
#: Documents that may share a prefix n-gram before it goes to blocks.
FEW = 16
#: Documents and n-grams that a block may hold, about.
BLOCK_DOCS, BLOCK_GRAMS = 200, 400_000
#: Words whose hashes are kept, and the longest of them in bytes.
CACHE, LONGEST = 120_000, 64

_SALT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """64-bit hashes of words; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


_words = WordHash()


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + len(out)]) * _SALT
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def partitions(sets: np.ndarray) -> np.ndarray:
    """Counts of a set over equal parts of the hash space, about two to a part."""
    bits = max(int(len(sets)).bit_length() - 2, 3)
    return np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def at_most(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the overlap of two sets, from their partition counts."""
    while len(a) > len(b):
        a = a[0::2] + a[1::2]
    while len(b) > len(a):
        b = b[0::2] + b[1::2]
    return int(np.minimum(a, b).sum())


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * (n + m) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges (u, v); root is the smallest id reachable."""
    edges = settle(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")).first()
        return r["n"], r["h"] or 0

    def with_least(e: DataFrame, least: DataFrame, n: int) -> DataFrame:
        """Edges with m, the least of each u; its numbers are sent to all tasks, or hot u are salted."""
        if n <= BROADCAST_IDS:
            return e.join(F.broadcast(least.drop("degree")), "u")
        return join_skewed(e, settle(least, "edges-least"), "u", "degree", n).drop("degree")

    degree = F.count(F.lit(1)).alias("degree")
    now = state(edges)
    while now[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("u", "m").alias("m"), "degree")
        large = with_least(both, least, 2 * now[0]).filter(F.col("v") > F.col("u"))
        large = settle(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), degree)
        ends = [F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"]
        stars = with_least(large, least, 2 * now[0]).select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v")
        old, edges = edges, settle(stars.filter("u != v").distinct(), "edges")
        forget(old, large)
        before, now = now, state(edges)
        if before == now:
            break
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(tops).distinct()


def to_code(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts as monotone codes of 8 or 16 bits: exact in the lower half, then by powers."""
    half = 1 << (bits - 1)
    steps = half // 8 if bits == 8 else half // 40
    c = counts.astype(np.float64)
    high = half + np.log2(np.maximum(c, half) / half) * steps
    return np.where(c < half, c, np.minimum(high, 2 * half - 1)).astype(np.uint8 if bits == 8 else np.uint16)


def from_code(codes: np.ndarray) -> np.ndarray:
    """About the counts that codes stand for."""
    half = 1 << (8 * codes.itemsize - 1)
    steps = half // 8 if codes.itemsize == 1 else half // 40
    c = codes.astype(np.float64)
    return np.where(c < half, c, half * np.exp2((c - half) / steps))


def _sizes(unique: DataFrame, n: int, bits: int) -> DataFrame:
    """A row per document (doc_id, n), and rows (slice, task, cells) with the codes of a task's counts of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "cells", "slice", "task"]
        waiting: list[np.ndarray] = []
        held = 0

        def count() -> None:
            if waiting:
                at = (np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.int64)
                np.add(cells, np.bincount(at, minlength=len(cells)), out=cells, casting="unsafe")
                waiting.clear()

        for batch in batches:
            found = [grams(t.as_py(), n) for t in batch.column("text")]
            waiting += found
            held += sum(map(len, found))
            if held >= 1 << 20:
                count()
                held = 0
            k = len(found)
            sizes = pa.array([len(x) for x in found], pa.int32())
            columns = [batch.column("doc_id"), sizes, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        count()
        each = len(cells) // SLICES
        data = [to_code(cells[k * each : (k + 1) * each], 8).tobytes() for k in range(SLICES)]
        task = [TaskContext.get().partitionId()] * SLICES
        columns = [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.array(data, pa.binary())]
        columns += [pa.array(range(SLICES), pa.int32()), pa.array(task, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return unique.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, cells binary, slice int, task int")


def _sets(unique: DataFrame, n: int, brief: bool = False) -> DataFrame:
    """(doc_id, n, grams, uses): each text's set, or its partition counts if brief; uses: as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t.as_py(), n) for t in batch.column("text")]
            data = [(partitions(x) if brief else x).tobytes() for x in found]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int32()), pa.array(data, pa.binary()), batch.column("uses")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "grams", "uses"])

    return unique.select("doc_id", "text", "uses").mapInArrow(run, "doc_id long, n int, grams binary, uses long")


def _cell_counts(counted: DataFrame, bits: int) -> np.ndarray:
    """The codes of each cell's count over all tasks, summed over ``TASKS`` tasks at a time."""

    def adding(kind: type) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(from_code(np.frombuffer(x, kind)) for x in rows["cells"])
            return pd.DataFrame({"slice": [key[0]], "task": [key[1]], "cells": [to_code(total, 16).tobytes()]})

        return add

    kind: type = np.uint8
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        groups = counted.groupBy("slice", F.floor(F.col("task") / TASKS).cast("int").alias("task"))
        counted = settle(groups.applyInPandas(adding(kind), "slice int, task int, cells binary"), "jaccard-cells")
        kind, tasks = np.uint16, -(-tasks // TASKS)
        if tasks <= 1:
            break
    rows = sorted(counted.select("slice", "cells").collect())  # at most 32 MB
    counts = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["cells"], np.uint16) for r in rows)])
    return counts if len(counts) else np.zeros(1 << bits, np.uint16)


def _in_order(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by its cells' counts, then by value."""
    cell = (s >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)
    return s[np.argsort(counts[cell], kind="stable")]


def _prefixes(unique: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    sent = unique.sparkSession.sparkContext.broadcast(counts)  # at most 32 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sizes, lengths = [], [], []
            for text in batch.column("text"):
                s = grams(text.as_py(), n)
                heads.append(_in_order(s, sent.value)[: len(s) + (-percent * len(s) // 100) + 1] if len(s) else s)
                sizes.append(len(heads[-1]))
                lengths.append(len(s))
            gram = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]).astype(np.int32)
            n_grams = np.repeat(np.array(lengths, np.int32), sizes)
            columns = [pa.array(gram), batch.column("doc_id").take(pa.array(rows)), pa.array(n_grams), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc_id", "n", "pos"])

    return unique.select("doc_id", "text").mapInArrow(run, "gram long, doc_id long, n int, pos int")


def _may_link(percent: int) -> Column:
    """The length and positional filters on (nu, pu) and (nv, pv)."""
    length = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    rest = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv"))
    return length & (F.lit(100 + percent) * rest >= F.lit(percent) * (F.col("nu") + F.col("nv")))


def _pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v), each once, from prefix n-grams of few documents."""
    few = shared.filter(F.col("docs") <= FEW)
    a = few.select("gram", F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("pos").alias("pu"))
    b = few.select("gram", F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("pos").alias("pv"))
    return a.join(b, "gram").filter((F.col("u") < F.col("v")) & _may_link(percent)).select("u", "v")


def _hub_pairs(many: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v) of the first document of each frequent prefix n-gram with its others."""
    first = F.min(F.struct("doc_id", "n", "pos")).alias("hub")
    hubs = settle(many.groupBy("gram").agg(first, F.count(F.lit(1)).alias("rows")), "jaccard-hubs")
    both = join_skewed(many, hubs, "gram", "rows", many.count(), narrow=True)
    both = both.select(
        F.col("hub.doc_id").alias("u"), F.col("hub.n").alias("nu"), F.col("hub.pos").alias("pu"),
        F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("pos").alias("pv"),
    )
    return both.filter((F.col("u") < F.col("v")) & _may_link(percent)).select("u", "v")


def _verified(pairs: DataFrame, unique: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the pairs that connect the same documents as all links do.

    All pairs meet the suffix filter. Of those that pass, each document's pair with
    its smallest partner is tested first, then all pairs that aren't connected yet.
    """

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("nu").to_pylist(), batch.column("nv").to_pylist()
            a, b = batch.column("gu").to_pylist(), batch.column("gv").to_pylist()
            keep = [
                at_most(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) >= least_overlap(k, j, percent)
                for x, y, k, j in zip(a, b, n, m, strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("gu").to_pylist(), batch.column("gv").to_pylist()
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def with_sets(pairs: DataFrame, brief: bool) -> DataFrame:
        uses = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("uses"))
        ids = settle(uses, "jaccard-ids")
        table = settle(_sets(unique.join(small(ids), "doc_id"), n, brief), "jaccard-needed")
        count = pairs.count()
        u = table.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("grams").alias("gu"), F.col("uses").alias("uu"))
        v = table.select(F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("grams").alias("gv"), F.col("uses").alias("uv"))
        both = join_skewed(join_skewed(pairs, u, "u", "uu", count), v, "v", "uv", count)
        return both.select("u", "v", "nu", "nv", "gu", "gv")

    left = settle(with_sets(pairs, True).mapInArrow(suffix, "u long, v long"), "jaccard-pairs")
    first = settle(left.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "jaccard-first")
    links = settle(with_sets(first, False).mapInArrow(exact, "u long, v long"), "jaccard-links")
    roots = settle(components(links), "jaccard-first-roots")
    apart = ~F.coalesce("ru", "u").eqNullSafe(F.coalesce("rv", "v"))
    rest = left.join(first, ["u", "v"], "left_anti")
    rest = _with_root(_with_root(rest, roots, left, "u", "ru"), roots, left, "v", "rv").filter(apart).select("u", "v")
    rest = settle(rest, "jaccard-rest")
    if rest.isEmpty():
        return links
    return links.unionAll(with_sets(rest, False).mapInArrow(exact, "u long, v long"))


def _with_root(rows: DataFrame, roots: DataFrame, of: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the root of ``key``, null where it has none; ``of``: a table whose rows bound theirs."""
    named = roots.select(F.col("id").alias(key), F.col("root").alias(name))
    if roots.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(named), key, "left")
    uses = of.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return join_skewed(rows, settle(named.join(uses, key), "jaccard-uses"), key, "uses", of.count(), "left").drop("uses")


def _open(many: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, doc_id, root) of frequent prefix n-grams whose documents aren't all of one root."""
    rooted = _with_root(many.select("gram", "doc_id"), roots, many, "doc_id", "root")
    rooted = settle(rooted.select("gram", "doc_id", F.coalesce("root", "doc_id").alias("root")), "jaccard-rooted")
    mixed = rooted.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("rows"))
    mixed = settle(mixed.filter("a != b").select("gram", "rows"), "jaccard-mixed")
    return settle(join_skewed(rooted, mixed, "gram", "rows", rooted.count(), narrow=True).drop("rows"), "jaccard-open")


def _dealt(open_grams: DataFrame, unique: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents of open n-grams, dealt over pairs of blocks: (pair, home, doc_id, root, grams).

    A cluster's blocks are those of its largest component and the others, by set
    size; classes of size are a little wider than what a link allows, so that links
    are within a class or between neighbours.
    """
    hubs = settle(open_grams.groupBy("gram").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("rows")), "jaccard-open-hubs")
    edges = join_skewed(open_grams.select("gram", F.col("doc_id").alias("u")), hubs, "gram", "rows", open_grams.count(), narrow=True)
    cluster = components(edges.select("u", "v")).select(F.col("id").alias("doc_id"), F.col("root").alias("cluster"))
    docs = open_grams.groupBy("doc_id").agg(F.min("root").alias("root")).join(cluster, "doc_id")
    docs = settle(docs, "jaccard-clusters")
    parts = docs.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("docs"))
    largest = parts.groupBy("cluster").agg(F.max_by("root", F.struct("docs", "root")).alias("largest"), F.sum("docs").alias("uses"))
    sided = join_skewed(docs, settle(largest, "jaccard-largest"), "cluster", "uses", docs.count(), narrow=True)
    sided = settle(sided.select("doc_id", "root", "cluster", (F.col("root") == F.col("largest")).alias("main")), "jaccard-sided")
    # A lone document of the largest component needs no block of its own kind; it is one of the others.
    sets = _sets(unique.join(small(sided.select("doc_id")), "doc_id").withColumn("uses", F.lit(1).cast("long")), n)
    size = F.floor(F.log("n") / F.lit(1.001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    sized = settle(sets.drop("uses").join(sided, "doc_id").withColumn("size", size), "jaccard-block-sets")

    kind = ["cluster", "main", "size"]
    many = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).cast("int")
    blocks = settle(sized.groupBy(*kind).agg(many.alias("blocks"), F.count(F.lit(1)).alias("uses")), "jaccard-blocks")
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in kind))
    each = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(*kind, "block", F.concat_ws("/", name, F.col("block").cast("string")).alias("home"))
    a = each.select(*(F.col(c).alias(f"{c}_a") for c in [*kind, "block", "home"]))
    b = each.select(*(F.col(c).alias(f"{c}_b") for c in [*kind, "block", "home"]))
    near = F.abs(F.col("size_a") - F.col("size_b")) <= 1
    meet = a.join(b, F.col("cluster_a") == F.col("cluster_b")).filter((F.col("home_a") <= F.col("home_b")) & near & ~(F.col("main_a") & F.col("main_b")))
    pair = F.concat_ws("+", "home_a", "home_b").alias("pair")
    homes = F.array_distinct(F.array("home_a", "home_b"))
    tasks = settle(meet.select(pair, F.explode(homes).alias("home")), "jaccard-tasks")
    placed = join_skewed(sized.withColumn("kind", name), blocks.select(name.alias("kind"), "blocks", "uses"), "kind", "uses", sized.count(), narrow=True)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("string")
    placed = placed.select("doc_id", "root", "grams", F.concat_ws("/", "kind", block).alias("home"))
    return placed.join(tasks, "home")


def _block_links(dealt: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Forest links among the documents of each pair of blocks."""
    sent = dealt.sparkSession.sparkContext.broadcast(counts)  # at most 32 MB

    def join(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        home = table.column("home").to_pylist()
        across = len(set(home)) > 1
        all_sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (len(all_sets[k]), ids[k]))
        spread = [partitions(s) for s in all_sets]
        known: dict[int, int] = {}  # documents of one component are connected from the start
        parent = [known.setdefault(r, k) for k, r in enumerate(table.column("root").to_pylist())]

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
        links: list[tuple[int, int]] = []
        for b in order:
            s = all_sets[b]
            m = len(s)
            head = _in_order(s, sent.value)[: m + (-percent * m // 100) + 1].tolist()
            tried: set[int] = set()
            for q, gram in enumerate(head):
                for a, p in seen[gram]:
                    n = len(all_sets[a])
                    if a in tried or 100 * n < percent * m or (across and home[a] == home[b]):
                        continue
                    tried.add(a)
                    need = least_overlap(n, m, percent)
                    if min(n - p, m - q) < need or root(a) == root(b):
                        continue
                    if at_most(spread[a], spread[b]) >= need and linked(all_sets[a], s, percent):
                        parent[root(a)] = root(b)
                        links.append((ids[a], ids[b]))
                seen[gram].append((b, q))
        u, v = ([x[k] for x in links] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("pair").applyInArrow(join, "u long, v long")


def _row(doc_id: Column, text_class: Column) -> Column:
    """What tells rows apart: the id and the text's class; never null."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), text_class)


def _class(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _one_of_each(rows: DataFrame, of: DataFrame, reps: DataFrame, n_rows: int) -> DataFrame:
    """(class, text): a row of the smallest id of each class, or any row where none has an id."""
    copies = join_skewed(of, reps.select("class", "rep", "rows"), "class", "rows", n_rows)
    copies = settle(copies.filter(F.col("doc_id") != F.col("rep")).select("doc_id", "class"), "jaccard-copies")
    unique = by_ids(rows.filter(F.col("doc_id").isNotNull()), copies, "left_anti", ("doc_id", "class"))
    nameless = reps.filter("rep IS NULL").select("class")
    if not nameless.isEmpty():
        unique = unique.unionByName(by_ids(rows.filter(F.col("doc_id").isNull()), nameless, "left_semi", ("class",)))
    again = settle(unique.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class"), "jaccard-again")
    if again.isEmpty():
        return unique.select("class", "text")
    once = by_ids(unique, again, "left_anti", ("class",))
    return once.unionByName(by_ids(unique, again, "left_semi", ("class",)).dropDuplicates(["class"])).select("class", "text")


def _found(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, class, node, n_shingles and component_id of every row; node tells components apart where ids repeat or are null.

    Sets, links and components go by a number of the text's class: 64 bits of its
    digest, dealt again should two classes get the same.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), _class(F.col("text")).alias("class"))
    of = settle(rows.select("doc_id", "class"), "jaccard-classes")
    n_rows = of.count()
    reps = settle(of.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "jaccard-reps")
    deal = 0
    while (c := reps.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64(F.lit(deal), "class")).alias("keys")).first())["n"] != c["keys"]:
        deal += 1
    node = F.xxhash64(F.lit(deal), "class")
    unique = settle(_one_of_each(rows, of, reps, n_rows).select(node.alias("doc_id"), "text"), "jaccard-unique")
    bits = min(max((16 * reps.count()).bit_length(), LEAST_BITS), MOST_BITS)
    made = settle(_sizes(unique, n, bits), "jaccard-sizes")
    size = settle(made.filter("slice IS NULL").select(F.col("doc_id").alias("key"), "n"), "jaccard-n")
    counts = _cell_counts(made.filter("slice IS NOT NULL").select("slice", "task", "cells"), bits)
    forget(made)

    prefix = settle(_prefixes(unique, counts, n, percent), "jaccard-prefixes")
    docs_of = settle(prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1"), "jaccard-shared-grams")
    shared = settle(join_skewed(prefix, docs_of, "gram", "docs", prefix.count()), "jaccard-shared")
    forget(prefix)
    many = settle(shared.filter(F.col("docs") > FEW).select("gram", "doc_id", "n", "pos"), "jaccard-many")
    pairs = settle(_pairs(shared, percent).unionAll(_hub_pairs(many, percent)).distinct(), "jaccard-candidates")
    forget(shared)
    links = settle(_verified(pairs, unique, n, percent), "jaccard-verified")
    roots = settle(components(links), "jaccard-components-so-far")
    open_grams = _open(many, roots)
    if not open_grams.isEmpty():
        more = settle(_block_links(_dealt(open_grams, unique, n, percent), counts, percent), "jaccard-block-links")
        stars = roots.select(F.col("id").alias("u"), F.col("root").alias("v"))  # connect what the links so far connect
        roots = components(stars.unionAll(more))

    named = reps.select("class", "rep", "rows", node.alias("key")).join(size, "key", "left")
    named = named.join(roots, F.col("key") == F.col("id"), "left")
    named = named.select("class", "rep", "rows", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "root")
    named = settle(named, "jaccard-roots")
    linked_ones, alone = named.filter("root IS NOT NULL"), named.filter("root IS NULL")
    least = settle(linked_ones.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("members")), "jaccard-least")
    linked_ones = join_skewed(linked_ones, least, "root", "members", n_rows)
    columns = ["class", "rows", "n_shingles"]
    linked_ones = linked_ones.select(*columns, F.col("root").alias("node"), "least")
    alone = alone.select(*columns, F.col("key").alias("node"), F.col("rep").alias("least"))
    out = join_skewed(of, settle(linked_ones.unionAll(alone), "jaccard-named"), "class", "rows", n_rows)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    return out.select("doc_id", "class", "node", "n_shingles", component)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _found(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (of the smallest id, or of a null one if there is no other), all columns kept.

    Rows are told apart by id and text. Texts without words are components of their
    own by id and text; of equal rows any one stays.
    """
    row = _row(F.col("doc_id"), F.col("class"))
    unit = F.when(F.col("n_shingles") == 0, row).otherwise(F.col("node").cast("string"))
    found = _found(docs, n, percent).select(row.alias("row_key"), unit.alias("unit"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("head"))
    found = settle(found, "jaccard-components")
    heads = found.filter("head").groupBy("unit", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("row_key")))  # few to a unit: all have its smallest id
    heads = settle(heads.filter("place > 1 OR copies > 1"), "jaccard-heads")
    gone = settle(found.filter("NOT head").select("row_key").unionAll(heads.select("row_key")).distinct(), "jaccard-gone")
    keyed = docs.select(_row(F.col("doc_id").cast("long"), _class(F.col("text"))).alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = by_ids(keyed, gone, "left_anti", ("row_key",))
    again = heads.filter("place = 1").select("row_key")
    if not again.isEmpty():
        left = left.unionAll(by_ids(keyed, again, "left_semi", ("row_key",)).dropDuplicates(["row_key"]))
    return left.select("row.*")
