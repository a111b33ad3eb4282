"""Best-fit packing of token sequences by bin completion.

Only the lengths of pieces matter to a packing, so the plan is made over counts
by length: at most ``capacity`` numbers, however many documents there are. Best
fit, largest first, gives the incumbent, which stands at once if it meets the
lower bound. Else a branch-and-bound search completes one bin after another:
around the largest piece left it enumerates undominated fillings as runs of
(length, number), uses each as often as the counts allow or, in later branches,
half as often down to once, and drops branches whose waste can't beat the
incumbent. Three parameters bound the search: ``nodes`` of the whole search, and
at each node the ``leaves`` that the enumeration reaches and the ``fillings`` that
are kept. The incumbent stands when they run out, so results are always whole;
``search`` returns how many bins the plan may be above the least number.

The plan says which ranks of a length go to which sequences and offsets. Pieces
are ranked within their length by bucketed prefix sums and placed by binary
search over the plan, in the tasks that hold them. Buckets grow with the number
of pieces, and a piece's bucket depends on its row as well as on its id, so that
no bucket gets a share of the table that matters.

Defined cases: a null or empty text is the closing id alone, however many there
are; equal rows and rows without an id are packed each; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their
names. A document's ids are held in one task, its pieces are 52-byte rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import settle, text_batches

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces of one length are ranked in so many buckets, at least and at most; pieces that a bucket should hold.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 256, 65_536, 4_096
#: Bounds of the search: nodes in all; fillings kept and leaves seen at a node.
NODES, FILLINGS, LEAVES = 4_000, 6, 60
#: Entries that each cache may hold, and the longest chunk (in bytes) that is kept.
CACHE, LONGEST = 200_000, 64
#: Fixed value: the vocabulary's word pattern, on lower-cased text.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Printable ASCII and Latin letters, which normalization leaves as they are but for their case.
LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u017e]+")

#: A filling: (piece length, number) runs, longest first. A plan: fillings and how often each is used.
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def load(filling: Filling) -> int:
    return sum(x * k for x, k in filling)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    total = sum(x * n for x, n in counts.items())
    return max(-(-total // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, largest first, over runs of equal bins."""
    bins: dict[int, list[tuple[Filling, int]]] = defaultdict(list)
    rooms: list[int] = []
    for x in sorted(counts, reverse=True):
        left = counts[x]
        rooms = sorted(r for r, b in bins.items() if b)
        for room in rooms[bisect_right(rooms, x - 1) :]:
            while left and bins[room]:
                filling, n = bins[room].pop()
                each = room // x
                full = min(n, left // each)
                if full:
                    bins[room - each * x].append(((*filling, (x, each)), full))
                    left -= full * each
                    n -= full
                if n and left:
                    bins[room - left * x].append(((*filling, (x, left)), 1))
                    n, left = n - 1, 0
                if n:
                    bins[room].append((filling, n))
            if not left:
                break
        each = capacity // x
        if left // each:
            bins[capacity - each * x].append((((x, each),), left // each))
        if left % each:
            bins[capacity - left % each * x].append((((x, left % each),), 1))
    return [run for runs in bins.values() for run in runs]


def _dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of ``b`` fit, part by part, into those of ``a``, largest first."""
    if load(a) < load(b):
        return False
    room = dict(a)
    for x, k in b:
        while k:
            at = min((r for r in room if r >= x), default=0)
            if not at:
                return False
            each = at // x
            full = min(room[at], k // each)  # so many of a's pieces are filled up
            left = at - (each if full else k) * x
            n = full or 1
            k -= full * each if full else k
            room[at] -= n
            if not room[at]:
                del room[at]
            if left:
                room[left] = room.get(left, 0) + n
    return True


def _leaves(counts: dict[int, int], lengths: list[int], room: int) -> Iterator[Filling | None]:
    """Maximal fillings of the room, largest pieces and largest numbers first; None for a dead end.

    A path holds (place in lengths, number, room left before it); the next leaf comes
    from using one piece less of the last length that leaves room for shorter ones.
    """
    path: list[list[int]] = []

    def deepen(room: int, top: int) -> int:
        """Go on from lengths below ``top`` with as many pieces as fit; returns the room that is left."""
        while room:
            at = min(bisect_right(lengths, room), top) - 1
            while at >= 0 and counts[lengths[at]] <= 0:
                at -= 1
            if at < 0:
                break
            k = min(room // lengths[at], counts[lengths[at]])
            path.append([at, k, room])
            room -= k * lengths[at]
            top = at
        return room

    left = deepen(room, len(lengths))
    while True:
        used = {at: k for at, k, _ in path}
        maximal = not any(x <= left and counts[x] > used.get(i, 0) for i, x in enumerate(lengths[: bisect_right(lengths, left)]))
        yield tuple((lengths[at], k) for at, k, _ in path) if maximal else None
        while path:
            at, k, before = path.pop()
            if any(counts[x] > 0 for x in lengths[:at]):
                if k > 1:
                    path.append([at, k - 1, before])
                left = deepen(before - (k - 1) * lengths[at], at)
                break
        else:
            return


def fillings(counts: dict[int, int], lengths: list[int], room: int, keep: int = FILLINGS, leaves: int = LEAVES) -> list[Filling]:
    """Undominated fillings of the room, least waste first; lengths: ascending."""
    if counts.get(room, 0) > 0:
        return [((room, 1),)]  # an exact piece dominates all else
    found: list[Filling] = []
    for f in islice(_leaves(counts, lengths, room), leaves):
        if f is not None and not any(_dominates(g, f) for g in found):
            found = [g for g in found if not _dominates(f, g)] + [f]
            if load(f) == room and len(found) >= keep:
                break
    return sorted(found, key=lambda f: (room - load(f), sum(k for _, k in f)))[:keep]


def complete(counts: dict[int, int], capacity: int, incumbent: Plan, nodes: int = NODES, keep: int = FILLINGS, leaves: int = LEAVES) -> Plan:
    """The best plan that the search finds, or the incumbent."""
    best, most, least = incumbent, sum(n for _, n in incumbent), least_bins(counts, capacity)
    if most <= least:
        return best
    total = sum(x * n for x, n in counts.items())
    left, lengths = dict(counts), sorted(counts)
    plan: Plan = []
    used = waste = 0

    def options() -> list[tuple[Filling, int]]:
        """Fillings around the largest piece, as often as counts allow; then the best one in halves of that."""
        top = next((x for x in reversed(lengths) if left[x] > 0), 0)
        if not top:
            return []
        left[top] -= 1
        found = fillings(left, lengths, capacity - top, keep, leaves)
        left[top] += 1
        out: list[tuple[Filling, int]] = []
        for f in found or [()]:
            whole = ((top, 1 + f[0][1]), *f[1:]) if f and f[0][0] == top else ((top, 1), *f)
            out.append((whole, min(left[x] // k for x, k in whole)))
        n = out[0][1] // 2
        while n:
            out.append((out[0][0], n))
            n //= 2
        return out

    stack = [options()]
    while stack and nodes and most > least:
        if not stack[-1]:
            stack.pop()
            if plan:
                f, n = plan.pop()
                for x, k in f:
                    left[x] += n * k
                used, waste = used - n, waste - n * (capacity - load(f))
            continue
        f, n = stack[-1].pop(0)
        nodes -= 1
        if waste + n * (capacity - load(f)) > (most - 1) * capacity - total:
            continue  # its waste alone rules out a better plan
        for x, k in f:
            left[x] -= n * k
        plan.append((f, n))
        used, waste = used + n, waste + n * (capacity - load(f))
        if not any(left.values()):
            if used < most:
                best, most = list(plan), used
            stack.append([])
        else:
            stack.append(options())
    return best


def search(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, keep: int = FILLINGS, leaves: int = LEAVES) -> tuple[Plan, int]:
    """A plan, and by how many bins at most it misses the least number: 0 is proven best."""
    plan = complete(counts, capacity, best_fit(counts, capacity), nodes, keep, leaves)
    return plan, sum(n for _, n in plan) - least_bins(counts, capacity)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return search(counts, capacity)[0]


def segments(plan: Plan) -> np.ndarray:
    """Sorted rows (length << 40 | first rank, first sequence, pieces of this length in each, first offset)."""
    rows, first = [], 0
    ranks: dict[int, int] = defaultdict(int)
    for filling, n in plan:
        at = 0
        for x, k in filling:
            rows.append((x << 40 | ranks[x], first, k, at))
            ranks[x] += k * n
            at += k * x
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


class Words(dict):
    """Packed ids of white-space separated chunks; tokens never reach over white space.

    A new chunk of Latin letters and marks is cut into words here and each word
    goes to the tokenizer's model once; all else goes through the whole
    tokenizer. What is kept is bounded in number and in bytes.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.bytes = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})
        self.word = regex.compile(WORD)
        self.late: dict[bytes, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.late.get(chunk)
        if found is not None:
            return found
        if chunk.isalpha():  # a word of a to z
            return self.keep(chunk, self.spell(chunk.decode()))
        if chunk[:-1].isalpha() and 32 < chunk[-1] < 127:  # a word and a mark or digit
            return self.keep(chunk, self[chunk[:-1]] + self.spell(chunk[-1:].decode()))
        text = chunk.decode()
        if not LATIN.fullmatch(text):
            return self.keep(chunk, self.ids(text))
        words = self.word.findall(text.lower())
        if len(words) == 1:
            return self.keep(chunk, self.spell(words[0]))
        return self.keep(chunk, b"".join([self[w.encode()] if w.isalpha() else self.spell(w) for w in words]))

    def spell(self, word: str) -> bytes:
        """Packed ids of one word of the pattern."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word)])

    def keep(self, chunk: bytes, packed: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            if len(self) < CACHE:
                self[chunk] = packed
            else:
                if len(self.late) >= CACHE // 4:
                    self.late.clear()
                self.late[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if "<|" in text:  # may hold a special token
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


@cache
def words(path: str) -> Words:
    """One per Python worker."""
    return Words(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        close = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, text in enumerate(texts):
                packed = known.encode(text) + close
                for k, a in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[a : a + 4 * capacity]
                    for column, value in zip(rows, (i, k, a // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            ids = batch.column("doc_id").take(pa.array(rows[0], pa.int64()))
            columns = [ids, pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    nodes: int = NODES,
    keep: int = FILLINGS,
    leaves: int = LEAVES,
) -> DataFrame:
    """The pieces of every document with sequence_id and offset; the last three parameters bound the search."""
    spark = docs.sparkSession
    mark = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # written, so it stays
    pieces = settle(cut_pieces(docs, path, capacity).withColumn("mark", mark), "pieces")

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = search(counts, capacity, nodes, keep, leaves)
    sent = spark.sparkContext.broadcast(segments(plan))

    buckets = BUCKETS
    while buckets < MOST_BUCKETS and max(counts.values(), default=0) > buckets * BUCKET_ROWS:
        buckets *= 2
    pieces = pieces.withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    starts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", before)
    within = Window.partitionBy("length", "bucket").orderBy("mark", "doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(within)).join(starts, ["length", "bucket"])
    rank = (F.col("before") + F.col("place") - 1).alias("rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, each, offset = sent.value.T
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = length << 40 | batch.column("rank").to_numpy()
            at = np.searchsorted(first, key, side="right") - 1
            gone = key - first[at]
            columns = [sequence[at] + gone // each[at], offset[at] + gone % each[at] * length]
            names = [*batch.schema.names[:5], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, columns)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(put, f"{kinds}, sequence_id long, offset long")
