"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; training documents taken without
regard to their label are the unlabelled set. A linear classifier over the
presence of words minimises, in numpy,

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

with the logistic loss l and the class prior pi. When the second term turns
negative its gradient is reversed. The prior is a parameter; where it isn't given
it is the toxic share of labelled training rows, which is right if labels are a
random sample of documents.

Only the training sample is bounded, by parameters: ``positives`` and
``unlabelled`` documents in expectation, chosen by a hash of doc_id, and
``features`` different words, those that most positives hold. The sample's word
positions are what reaches the driver. Every whole text is scored where it lies,
without a shuffle.

Defined cases: null and empty texts have no words and get the intercept's
score; null doc_id counts as the text ''; equal rows get equal rows; a text of
any length is scored by all its words; with no positive labels every score is 0;
repeated labels count once; an empty table gives an empty result; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_batches

FOLDS = 5
#: Bounds of the training sample, documents and different words.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 8_000, 24_000, 20_000
#: A word becomes a feature if this many positives hold it, however small their share (languages with few
#: documents have words of their own), and if a document that holds it is likelier toxic than this, by the
#: prior and the shares of positives and unlabelled that hold it.
LEAST_DOCS, LEAST_LIKELY = 5, 0.6
STEPS, RATE, PENALTY = 200, 0.1, 3e-5

#: A to Z in lower case; ASCII marks and white space end a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


#: Word beginnings of these many bytes are features beside whole words.
PREFIXES = (3, 4, 5, 6, 7)


def words(text: str | None) -> set[bytes]:
    """The different words of a whole text, and the beginnings of longer ones."""
    whole = set((text or "").encode("utf-8", "replace").translate(_FOLD).split())
    found = set(whole)
    for k in PREFIXES:
        found.update([w[:k] for w in whole if len(w) > k])
    return found


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _unit(doc_id: Column) -> Column:
    """A number in [0, 1) from doc_id, independent of the fold."""
    return F.pmod(F.xxhash64(F.lit("toxicity"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("positive"), batch.column("text"), strict=True):
            found = list(words(text.as_py()))
            columns = [pa.array([label.as_py()] * len(found), pa.bool_()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["positive", "word"])


def risk(f: np.ndarray, is_positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores f, and the direction in each that training follows.

    That is the risk's gradient, but where the corrected negative term is below
    zero: there only that term counts, and uphill.
    """
    p, u = is_positive, ~is_positive
    share = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    as_negative = np.logaddexp(0, f)
    slack = float(as_negative[u].mean() - prior * as_negative[p].mean())
    g = np.zeros(len(f))
    g[u] = share[u] / u.sum()
    g[p] = -prior * share[p] / p.sum()
    if slack < 0:
        g = -g
    else:
        g[p] += prior * (share[p] - 1) / p.sum()
    return prior * float(np.logaddexp(0, -f[p]).mean()) + max(slack, 0.0), g


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_words: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the words and the intercept; each document is an array of word positions."""
    docs = [*positive, *unlabelled]
    sizes = np.array([len(x) for x in docs])
    row = np.repeat(np.arange(len(docs)), sizes)
    col = np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int64)
    is_positive = np.arange(len(docs)) < len(positive)
    weight, bias = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        f = np.bincount(row, weights=weight[col], minlength=len(docs)) + bias
        _, g = risk(f, is_positive, prior)
        grad = np.append(np.bincount(col, weights=g[row], minlength=n_words) + PENALTY * weight, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - float(move[-1])
    return weight, bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = MAX_POSITIVE,
    unlabelled: int = MAX_UNLABELLED,
    features: int = MAX_WORDS,
) -> tuple[dict[bytes, float], float]:
    """Weight by word and the intercept, from rows of the training folds alone."""
    rows = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    toxic = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    toxic = toxic.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = toxic.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not seen["p"]:
        return {}, -30.0
    prior = min(max(seen["p"] / seen["n"] if prior is None else prior, 1e-4), 0.5)
    chosen = toxic.filter((F.col("toxic") == 1) & (_unit(F.col("doc_id")) < positives / seen["p"])).select("doc_id")
    known = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # of bounded size
    others = rows.filter(_unit(F.col("doc_id")) < unlabelled / max(rows.count(), 1))

    sample = known.select(F.lit(True).alias("positive"), "text").unionAll(others.select(F.lit(False), "text"))
    sample = settle(sample, "toxicity-sample")
    both = [F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")]
    sizes = sample.agg(*both).first()
    counts = sample.mapInArrow(_words_of, "positive boolean, word binary").groupBy("word").agg(*both)
    lift = (F.col("p") / F.lit(max(sizes["p"], 1))) / ((F.col("u") + 3) / F.lit(max(sizes["u"], 1)))
    telling = counts.filter((F.col("p") >= LEAST_DOCS) & (lift * prior >= LEAST_LIKELY))
    at = {bytes(r["word"]): i for i, r in enumerate(telling.orderBy(F.desc("p"), "word").limit(features).collect())}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[at[w] for w in words(text.as_py()) if w in at] for text in batch.column("text")]
            columns = [batch.column("positive"), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["positive", "at"])

    got = sample.mapInArrow(places, "positive boolean, at array<int>").toArrow()  # the bounded sample
    lists = [np.asarray(x.values, np.int32) for x in got.column("at")]
    is_positive = got.column("positive").to_pylist()
    p = [x for x, k in zip(lists, is_positive, strict=True) if k]
    u = [x for x, k in zip(lists, is_positive, strict=True) if not k]
    if not p or not u:
        return {}, float(np.log(prior / (1 - prior)))
    weight, bias = train(p, u, len(at), prior)
    return {w: float(weight[i]) for w, i in at.items()}, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, **how: float | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; how: the prior and the bounds of ``fit``."""
    spark = docs.sparkSession
    text_batches(spark)
    weights, bias = fit(docs, labels, **how)
    model = spark.sparkContext.broadcast(weights)  # at most as many as features

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value
        known = set(weight)
        for batch in batches:
            f = np.array([bias + sum(weight[w] for w in sorted(words(t.as_py()) & known)) for t in batch.column("text")])
            scores = pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], scores], names=[*batch.schema.names[:2], "score"])

    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, **how: float | None) -> DataFrame:
    """The documents that the classifier doesn't call toxic, all columns kept; how: as for ``score_toxicity``."""
    spark = docs.sparkSession
    text_batches(spark)
    weights, bias = fit(docs, labels, **how)
    model = spark.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value
        known = set(weight)
        for batch in batches:
            clean = [bias + sum(weight[w] for w in sorted(words(t.as_py()) & known)) < 0 for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
