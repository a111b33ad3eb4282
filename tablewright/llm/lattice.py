"""Language-model scores from the subword lattice of an existing vocabulary.

A word is scored by all its segmentations into vocabulary pieces: a forward
recursion in log space over the lattice gives its marginal probability, and the
document's is the product over its words and one end. The vocabulary's own scores
are the weights: its scores are merge ranks r, and a piece's weight is
(r + 2.7) ** -temperature. Training documents set two numbers only, the
temperature and the probability of the end, both from the pieces' expected counts
over the lattices of all training words.

That alone spells every word anew, so texts of a corpus score far below its base
scores. ``adapt`` lets training documents weigh in at three levels, each a
probability given the one below. Pieces: half of a weight is the vocabulary's at
the fitted temperature, half the piece's share of the expected uses, each
different training word counted once. Words: each training word is one more edge
over its whole lattice, of its count less a discount; what discounts free is the
weight of the lattice. Documents: a text's words are drawn from a Dirichlet
distribution around those weights, so a word used once is likelier again; its
probability depends on the numbers of uses only.

Each different word is weighed once, in a table that Spark counts and shuffles;
the recursion runs over batches of words of one length. The most used words of
that table, ``HEAD`` at most, go to all tasks; other words of a document, none of
which can be hot, meet the table by a join on the word.

Base scores are add-one unigram scores from the same word counts.

Defined cases: a null or empty text is the end alone; equal rows get equal
rows; a null doc_id counts as the text ''; texts and words of any length are
scored whole; with no training documents every count is 0, the temperature is 1
and the end is free; adapted, words then weigh what the lattice says and the end a
half, and no probability is 0, whatever was counted; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_batches

FOLDS, HELD_OUT = 7, 2
#: Words that go to all tasks, at most; levels of use for each power of two, of which whole ones go.
HEAD, LEVELS = 100_000, 16
#: Temperatures between which the fitted one is sought.
COLDEST, HOTTEST = 0.05, 8.0
#: Adapted: the vocabulary's share of the weights of pieces, and the least and largest discount of a word's count.
OWN_SHARE, DISCOUNTS = 0.5, (0.1, 0.9)
#: Adapted: how many uses of a document's own would weigh as much as the corpus.
CORPUS_USES = 1600.0
FLUSH = 250_000
#: Words that are weighed together; characters from which a word is weighed alone.
TOGETHER, LONG = 40_000, 200
MARK = "▁"


@cache
def pieces(path: str) -> tuple[dict[str, int], np.ndarray, tuple[int, ...], int]:
    """Ids by piece, the file's weights by id, ids of the 256 byte pieces, the longest piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, weight = {}, np.zeros(sp.get_piece_size())
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        weight[i] = 1 / (2.7 + max(-sp.get_score(i), 0.0))
        if not sp.is_byte(i):
            ids[sp.id_to_piece(i)] = i
    in_bytes = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    weight[list(in_bytes)] = weight[weight > 0].min()  # rarer than any other piece
    return ids, weight / weight.sum(), in_bytes, max(map(len, ids))


class Lattice:
    """Marginals, and expected piece counts, of words under log weights by id."""

    def __init__(self, path: str, logp: np.ndarray) -> None:
        self.ids, _, self.in_bytes, self.longest = pieces(path)
        self.logp = np.append(logp, -np.inf)
        self.spelled: dict[str, float] = {}

    def by_bytes(self, char: str) -> float:
        """A character that is no piece is spelled in byte pieces."""
        found = self.spelled.get(char)
        if found is None:
            found = self.spelled[char] = float(sum(self.logp[self.in_bytes[b]] for b in char.encode()))
        return found

    def edges(self, words: list[str], n: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By (from, to): piece ids (-1: none) and log weights, for words of n characters."""
        out, get = {}, self.ids.get
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                at = np.array([get(w[i:j], -1) for w in words], np.int64)
                known = at >= 0
                if j > i + 1 and not known.any():
                    continue
                value = self.logp[at]
                if j == i + 1 and not known.all():
                    value = np.where(known, value, [0.0 if k else self.by_bytes(w[i]) for w, k in zip(words, known, strict=True)])
                out[i, j] = at, value
        return out

    def forward(self, edges: dict, count: int, n: int) -> np.ndarray:
        alpha = np.full((n + 1, count), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            into = np.array([alpha[i] + edges[i, j][1] for i in range(max(0, j - self.longest), j) if (i, j) in edges])
            top = into.max(axis=0)
            alpha[j] = top + np.log(np.exp(into - top).sum(axis=0))
        return alpha

    def into(self, word: str, j: int) -> Iterator[tuple[int, int, float]]:
        """(from, piece, log weight) of the edges of a long word that end at j."""
        for i in range(max(0, j - self.longest), j):
            at = self.ids.get(word[i:j], -1)
            if at >= 0:
                yield i, at, self.logp[at]
            elif i == j - 1:
                yield i, -1, self.by_bytes(word[i])

    def long_forward(self, word: str) -> list[float]:
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            terms = [alpha[i] + x for i, _, x in self.into(word, j)]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def long_expected(self, word: str, count: float, total: np.ndarray) -> None:
        alpha = self.long_forward(word)
        beta = [-math.inf] * len(word) + [0.0]
        for j in range(len(word), 0, -1):
            for i, at, x in self.into(word, j):
                beta[i] = float(np.logaddexp(beta[i], beta[j] + x))
                total[at] += count * math.exp(alpha[i] + x + beta[j] - alpha[-1])

    def marginals(self, words: list[str]) -> np.ndarray:
        """log P of each word, a mark before it."""
        out = np.zeros(len(words))
        for rows, group, n in _by_length(words):
            if n > LONG:
                out[rows] = [self.long_forward(w)[-1] for w in group]
                continue
            out[rows] = self.forward(self.edges(group, n), len(group), n)[n]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words' counts."""
        total = np.zeros(len(self.logp))
        for rows, group, n in _by_length(words):
            if n > LONG:
                for r, w in zip(rows, group, strict=True):
                    self.long_expected(w, counts[r], total)
                continue
            edges = self.edges(group, n)
            alpha = self.forward(edges, len(group), n)
            beta = np.full((n + 1, len(group)), -np.inf)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                out = np.array([beta[j] + edges[i, j][1] for j in range(i + 1, min(n, i + self.longest) + 1) if (i, j) in edges])
                top = out.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0.0)
                beta[i] = safe + np.log(np.exp(out - safe).sum(axis=0))
            for (i, j), (at, value) in edges.items():
                use = counts[rows] * np.exp(alpha[i] + value + beta[j] - alpha[n])
                total += np.bincount(np.where(at < 0, len(self.logp) - 1, at), weights=use, minlength=len(self.logp))
        return total[:-1]


def _by_length(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """Row numbers, marked words and their length, a length at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        for k in range(0, len(rows), most):
            some = rows[k : k + most]
            if len(some):
                yield some, [MARK + words[r] for r in some], int(sizes[some[0]]) + 1


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, uses) of every word of any document; c: its count in training documents, uses: in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            only = [w for w in other if w not in trained]
            c = [*trained.values(), *([0] * len(only))]
            uses = [k + other.get(w, 0) for w, k in trained.items()] + [other[w] for w in only]
            words = pa.array([*trained, *only], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(c, pa.int64()), pa.array(uses, pa.int64())], names=["word", "c", "uses"])

        for batch in batches:
            for held_out, text in zip(batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                (other if held_out else trained).update(_words(text.as_py()))
                if len(trained) + len(other) > FLUSH:
                    yield rows()
                    trained.clear()
                    other.clear()
        yield rows()

    found = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, uses long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def best_temperature(own: np.ndarray, uses: np.ndarray) -> float:
    """The exponent of the weights under which the expected uses are likeliest; that likelihood is concave in it."""
    some = own > 0
    log_own = np.log(own[some])
    want = float(uses[some] @ log_own / uses[some].sum())
    low, high = COLDEST, HOTTEST
    for _ in range(60):
        t = (low + high) / 2
        w = np.exp(t * (log_own - log_own.max()))
        low, high = (t, high) if w @ log_own / w.sum() < want else (low, t)
    return (low + high) / 2


def scaled(own: np.ndarray, temperature: float) -> np.ndarray:
    """Log weights at a temperature; pieces of no weight keep none."""
    with np.errstate(divide="ignore"):
        logp = temperature * np.log(own)
    return logp - np.logaddexp.reduce(logp[own > 0])


def expected_uses(table: DataFrame, path: str, once: bool = False) -> np.ndarray:
    """Expected uses of each piece over all training words, or each ``once``, under the vocabulary's own weights."""
    own = pieces(path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, scaled(own, 1.0))
        total = np.zeros(len(own))
        for batch in _together(batches):
            counts = np.ones(batch.num_rows) if once else batch.column("c").to_numpy().astype(float)
            total += lattice.expected([w.decode() for w in batch.column("word").to_pylist()], counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    found = table.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double")
    uses = np.zeros(len(own))
    for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row per piece at most
        uses[r["piece"]] = r["uses"]
    return uses


def fit(table: DataFrame, path: str, n_docs: int) -> tuple[np.ndarray, float]:
    """Log weights of pieces and of the end, from the counted words."""
    own, uses = pieces(path)[1], expected_uses(table, path)
    total = float(uses.sum())
    if not total:
        return scaled(own, 1.0), 0.0
    logp = scaled(own, best_temperature(own, uses))
    return logp + math.log(total / (total + n_docs)), math.log(n_docs / (total + n_docs))


def fit_mixed(table: DataFrame, path: str) -> np.ndarray:
    """Log weights of pieces, in part the vocabulary's, in part of the different training words."""
    own, uses = pieces(path)[1], expected_uses(table, path, once=True)
    if not uses.sum():
        return scaled(own, 1.0)
    mixed = OWN_SHARE * np.exp(scaled(own, best_temperature(own, uses))) + (1 - OWN_SHARE) * uses / uses.sum()
    with np.errstate(divide="ignore"):
        return np.log(mixed)


def discount(once: int, twice: int) -> float:
    """What a word's count is lowered by, from the numbers of words counted once and twice."""
    low, high = DISCOUNTS
    return min(max(once / max(once + 2 * twice, 1), low), high)


def with_counts(marginal: np.ndarray, c: np.ndarray, less: float, words: int, different: int) -> np.ndarray:
    """Log of a word's share in ``CORPUS_USES``: counts less a discount, and the lattice by what that frees and one use more."""
    with np.errstate(divide="ignore"):
        counted = np.log(np.maximum(c - less, 0.0))
    return np.logaddexp(counted, math.log(less * different + 1) + marginal) + math.log(CORPUS_USES / (words + 1))


def log10_uses(value: float, k: int) -> float:
    """What k uses of a word with this log10 share add to a document's score; one use adds the share."""
    held = 10.0**value
    return value + (math.lgamma(held + k) - math.lgamma(held + 1)) / math.log(10)


def log10_all(n: int) -> float:
    """What n words of any kind take from a document's score."""
    return (math.lgamma(CORPUS_USES + n) - math.lgamma(CORPUS_USES)) / math.log(10)


def _least_level(counted: list) -> int:
    """The lowest level so that all words from it on are ``HEAD`` at most; counted: a row (level, n) for each."""
    least, total = 1 << 30, 0
    for row in sorted(counted, key=lambda r: -r["level"]):
        total += row["n"]
        if total > HEAD:
            break
        least = row["level"]
    return least


def score_documents(docs: DataFrame, path: str, adapt: bool = False) -> DataFrame:
    """Base and lattice scores of every document, log10, with token counts; ``adapt``: see above."""
    spark = docs.sparkSession
    text_batches(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text")
    table = settle(count_words(rows), "lm-words")
    kinds = {"v": F.col("c") > 0, "once": F.col("c") == 1, "twice": F.col("c") == 2}
    seen = table.agg(F.sum("c").alias("n"), *(F.count_if(x).alias(k) for k, x in kinds.items())).first()
    n_docs = rows.filter(~F.col("held_out")).count()
    n_words, less = seen["n"] or 0, discount(seen["once"], seen["twice"])
    total, different = n_words + n_docs, seen["v"] + (n_docs > 0)
    if adapt:
        logp, log_end = fit_mixed(table, path), math.log((n_docs + 1) / (total + 2))
    else:
        logp, log_end = fit(table, path, n_docs)
    sent_logp = spark.sparkContext.broadcast(logp)
    ten = math.log(10)
    scale = math.log10(total + different + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, sent_logp.value)
        for batch in _together(batches):
            marginal = lattice.marginals([w.decode() for w in batch.column("word").to_pylist()])
            c = batch.column("c").to_numpy()
            if adapt:
                marginal = with_counts(marginal, c, less, n_words, seen["v"])
            columns = [*batch.columns, pa.array(np.log10(c + 1.0) - scale), pa.array(marginal / ten)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "uses", "base", "marginal"])

    kinds = "word binary, c long, uses long, base double, marginal double"
    weighed = settle(table.mapInArrow(weigh, kinds), "lm-weights")
    level = F.floor(F.log2("uses") * LEVELS)
    least = _least_level(weighed.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())
    top = weighed.filter(level >= least).select("word", "c", "base", "marginal")
    sent = spark.sparkContext.broadcast(top.toArrow())  # HEAD rows at most
    end_base, end_score = math.log10(n_docs + 1) - scale, log_end / ten
    log_more = math.log10((n_words + 1) / (total + 2))  # adapted: a word comes, not the end

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, *values = (x.to_pylist() for x in sent.value.columns)
        get = dict(zip(words, zip((int(x > 0) for x in c), *values, strict=True), strict=True)).get
        names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "words", "uses"]
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text"):
                words = _words(text.as_py())
                known, base, total = int(n_docs > 0), end_base, end_score
                if adapt:
                    total += len(words) * log_more - log10_all(len(words))
                rest: dict[bytes, int] = {}
                for w, k in Counter(words).items():
                    found = get(w)
                    if found is None:
                        rest[w] = k
                    else:
                        known += k * found[0]
                        base += k * found[1]
                        total += log10_uses(found[2], k) if adapt and k > 1 else k * found[2]
                for column, value in zip(columns, (len(words) + 1, known, base, total, list(rest), list(rest.values())), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), "text")
    kinds = "row long, n_tokens long, n_known long, base double, score double, words array<binary>, uses array<long>"
    part = settle(numbered.mapInArrow(score, f"doc_id {kind}, held_out boolean, {kinds}"), "lm-documents")
    rest = part.select("row", F.explode(F.arrays_zip("words", "uses")).alias("w"))
    rest = rest.select("row", F.col("w.words").alias("word"), F.col("w.uses").alias("k"))
    value = F.col("k") * F.col("marginal")
    if adapt:  # as log10_uses; words that don't go to all tasks are used seldom
        share, more = F.pow(F.lit(10.0), F.col("marginal")), F.sequence(F.lit(1).cast("long"), F.col("k") - 1)
        again = F.aggregate(more, F.lit(0.0), lambda s, j: s + F.log10(share + j))
        value = F.col("marginal") + F.when(F.col("k") > 1, again).otherwise(0.0)
    sums = [
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.col("base")).alias("b"),
        F.sum(value).alias("s"),
    ]
    rest = rest.join(weighed.drop("uses"), "word").groupBy("row").agg(*sums)
    out = part.drop("words", "uses").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
