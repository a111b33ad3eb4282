import math
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tablewright.llm import lattice  # noqa: E402

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return lattice.Lattice(PATH, np.log(np.maximum(lattice.pieces(PATH)[1], 1e-300)))


def segmentations(model, word):
    """Every segmentation of a marked word, as (probability, pieces)."""
    if not word:
        yield 1.0, ()
    for k in range(1, len(word) + 1):
        at = model.ids.get(word[:k], -1)
        if at < 0 and k > 1:
            continue
        p = math.exp(model.logp[at] if at >= 0 else model.by_bytes(word[0]))
        for q, rest in segmentations(model, word[k:]):
            yield p * q, (at, *rest)


WORDS = ["the", "a", "singing", "über", "漢字", "x", "nation", "\U0001f600z", "the"]


def test_marginals_sum_over_all_segmentations(model):
    got = model.marginals(WORDS)
    for word, value in zip(WORDS, got, strict=True):
        assert value == pytest.approx(math.log(sum(p for p, _ in segmentations(model, lattice.MARK + word))))


def test_expected_counts(model):
    want = Counter()
    for word in WORDS:
        found = list(segmentations(model, lattice.MARK + word))
        total = sum(p for p, _ in found)
        for p, pieces in found:
            for at in pieces:
                want[at] += 2.0 * p / total
    want.pop(-1, None)
    got = model.expected(WORDS, np.full(len(WORDS), 2.0))
    assert {i: pytest.approx(v) for i, v in want.items() if v > 1e-12} == {i: got[i] for i in np.flatnonzero(got > 1e-12)}


def test_long_words_weigh_the_same(model, monkeypatch):
    words = ["the" * 30, "nation" * 12, "漢x" * 20]
    a, b = model.marginals(words), model.expected(words, np.ones(3))
    monkeypatch.setattr(lattice, "LONG", 5)
    assert model.marginals(words) == pytest.approx(a) and model.expected(words, np.ones(3)) == pytest.approx(b)
    assert math.isfinite(model.marginals(["ab" * 5000])[0])


def test_base_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 3)
    texts = ["The cat the\tdog", None, "", " \n", "cat cat bird", "unseen words only", "THE x the", "cat " * 500, "é É"] * 3
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "cat", 2.0), (5, "cat", 2.0)], "doc_id long, text string, score double")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts, n_docs = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    want = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        want.append((str(i), held(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6)))
    got = lattice.score_documents(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score_documents(docs.limit(0), PATH).count() == 0


def test_the_head_is_bounded(monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 10)
    rows = [{"level": k, "n": n} for k, n in ((0, 50), (3, 6), (9, 2), (7, 2))]
    assert lattice._least_level(rows) == 3 and lattice._least_level(rows[:1]) > 1000 and lattice._least_level([]) > 1000


def brute_log10(model, word):
    return math.log10(sum(p for p, _ in segmentations(model, lattice.MARK + word)))


def test_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 2)
    texts = ["the cat sat", None, "the the nation", "über x", "A cat", "漢 dog the", "unseen ones", ""] * 2
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, words binary")
    train = [(t or "").lower().split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    own = lattice.pieces(PATH)[1]
    first = lattice.Lattice(PATH, lattice.scaled(own, 1.0))
    uses = np.zeros(len(own))
    for word, k in Counter(w for ws in train for w in ws).items():
        found = list(segmentations(first, lattice.MARK + word))
        for p, ids in found:
            for at in ids:
                if at >= 0:
                    uses[at] += k * p / sum(q for q, _ in found)
    likely = lambda t: uses[own > 0] @ lattice.scaled(own, t)[own > 0]
    best = max(np.arange(0.05, 8.0, 0.005), key=likely)
    assert lattice.best_temperature(own, uses) == pytest.approx(best, abs=0.006)
    total = uses.sum() + len(train)
    fitted = lattice.Lattice(PATH, lattice.scaled(own, lattice.best_temperature(own, uses)) + math.log(uses.sum() / total))
    end = math.log10(len(train) / total)
    got = {r.doc_id: r for r in lattice.score_documents(docs, PATH).collect()}
    for i, t in enumerate(texts):
        want = end + sum(brute_log10(fitted, w) for w in (t or "").lower().split())
        assert got[i].score == pytest.approx(want, rel=1e-9), t


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    texts = ["the cat", None, "long " * 40_000, "x" * 30_000]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.score_documents(docs, PATH).collect()}
    model = lattice.Lattice(PATH, lattice.scaled(lattice.pieces(PATH)[1], 1.0))
    assert all(r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in got.values())
    assert got[ids[0]].score == pytest.approx(brute_log10(model, "the") + brute_log10(model, "cat")) and got[ids[1]].score == 0
    assert got[ids[2]].score == pytest.approx(40_000 * model.marginals(["long"])[0] / math.log(10)) and got[ids[3]].n_tokens == 2


def test_adapted_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 2)
    texts = ["the cat sat", None, "the the nation the", "über x über", "A cat", "漢 dog the", "new ones new new", "cat über über über"] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [(t or "").lower().split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, own = Counter(w for ws in train for w in ws), lattice.pieces(PATH)[1]
    first, uses = lattice.Lattice(PATH, lattice.scaled(own, 1.0)), np.zeros(len(own))
    for word in counts:
        found = list(segmentations(first, lattice.MARK + word))
        for p, ids in found:
            for at in ids:
                if at >= 0:
                    uses[at] += p / sum(q for q, _ in found)
    mixed = 0.5 * np.exp(lattice.scaled(own, lattice.best_temperature(own, uses))) + 0.5 * uses / uses.sum()
    with np.errstate(divide="ignore"):
        model = lattice.Lattice(PATH, np.log(mixed))
    n, once, twice = sum(counts.values()), sum(k == 1 for k in counts.values()), sum(k == 2 for k in counts.values())
    less = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    chance = lambda w: (max(counts[w] - less, 0) + (less * len(counts) + 1) * 10 ** brute_log10(model, w)) / (n + 1)
    end = (len(train) + 1) / (n + len(train) + 2)
    got = {r.doc_id: r.score for r in lattice.score_documents(docs, PATH, adapt=True).collect()}
    for i, t in enumerate(texts):
        want, held = math.log10(end), Counter()
        for at, w in enumerate((t or "").lower().split()):  # a word at a time, given those before it
            want += math.log10((1 - end) * (lattice.CORPUS_USES * chance(w) + held[w]) / (lattice.CORPUS_USES + at))
            held[w] += 1
        assert got[i] == pytest.approx(want, rel=1e-9), t


def test_held_out_scores_keep_near_base_scores(spark, tmp_path):
    from tablewright.llm.queries import op8_lm_scoring

    random = np.random.default_rng(8)
    parts = ["th", "er", "on", "an", "re", "ti", "sh", "wh"]
    words = np.array(["".join(random.choice(parts, random.integers(1, 4))) for _ in range(3000)])
    texts = [" ".join(words[(3000 * random.random(80) ** 3).astype(int)]) for _ in range(300)]
    texts += ["", None, "\U0001f600" * 3, "z" * 5000, "never counted ones"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op8_lm_scoring(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)


def test_adapted_scores_are_finite_whatever_was_counted(spark):
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(80) if i not in held]
    known = {"nothing": [], "ends alone": ["", None], "no word once": ["a b a b", "a b"], "each once": ["a b c"]}
    for name, texts in known.items():
        rows = [*zip(train, texts), *zip(held, ["", "a", "new a new", "q" * 3000])]  # noqa: B905
        got = lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, adapt=True).collect()
        assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got), name
