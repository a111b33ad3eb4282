"""Quality rules, toxicity and secret scans against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import quality, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c d e f g h " * 3,
    "a b c d e f g h i a b c d e f g h",
    "same same same same same same same same same same",
    "line one\nline one\n\n \nline two\nline one",
    "#*$%&|<> é ß word\x1cword",
    " ".join(f"w{i}" for i in range(200)),
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(10, 30)),
    "long " * 30_000,
]


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, "x")], "doc_id long, text string, source string, n_words string")
    got = sorted(tuple(r) for r in quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]:
        m = measures(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, "bad", "bad") for i in range(57)] + [(200 + i, good, "bad") for i in range(3)] + [(300, "bad", "one-off")] + [(400 + i, good, f"h{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in [*range(60), *range(400, 420)])
    assert not any(got[i].kept for i in [*range(100, 157), *range(200, 203), 300]) and got[200].host_failed
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 80


def test_junk_of_good_hosts_goes(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{good}\n{i}", f"h{i % 5}") for i in range(100)] + [(100 + i, f"{good} {'#$%' * 20} {i}", f"h{i}") for i in range(5)] + [(200 + i, "\n".join([good, *"aaaaa"]), f"h{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept} == set(range(100))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(100))


def test_clean_documents_of_bad_hosts_stay(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", "bad") for i in range(57)] + [(100, long, "bad"), (101, short, "bad")] + [(200 + i, short, f"h{i % 4}") for i in range(80)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100].host_failed and got[100].kept and not got[101].kept and not got[5].kept
    assert all(got[200 + i].kept and not got[200 + i].host_failed for i in range(80))


def test_small_hosts_keep_close_to_the_pooled_rate(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, good if i % 83 else "bad", f"one{i}") for i in range(1000)]  # hosts of one document
    rows += [(2000 + i, "bad" if i < 2 else good, "three") for i in range(3)] + [(3000 + i, "bad" if i % 84 == 0 else good, "large") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.quality_rules(docs).collect()
    assert not any(r.host_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == {i for i, t, _ in rows if t == "bad"}
    measured = quality.measure(docs).withColumn("host_key", F.concat(F.lit("="), F.col("host")))
    counts = {}
    for _, t, h in rows:
        n, k = counts.get(h, (0, 0))
        counts[h] = n + 1, k + (t == "bad")
    n, mean = len(rows), sum(k for _, k in counts.values()) / len(rows)
    even = mean * (1 - mean)
    spread = sum(m * (k / m - mean) ** 2 for m, k in counts.values())
    expected = lambda r: even * sum((1 - m / n) * (1 + (m - 1) * r) for m, _ in counts.values())
    low, high = 0.0, 1.0  # the correlation that explains the spread, by bisection
    for _ in range(80):
        low, high = ((low + high) / 2, high) if expected((low + high) / 2) < spread else (low, (low + high) / 2)
    strength = min(max(1 / low - 1, 1.0), 1e6) if low > 1e-9 else 1e6
    for r in quality.host_rates(measured).collect():
        m, k = counts[r.host_key[1:]]
        assert r.n == m and r.base_rate == pytest.approx((k + mean * strength) / (m + strength), rel=1e-6)
    assert quality.prior_strength(0.0, 0.0, 0, 0.0, 0.0) == quality.prior_strength(5.0, 5.0, 5, 0.2, 0.8) == 1e6


def test_verdicts_go_by_row(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(1, good, "a"), (1, "short", "a"), (None, good, "a"), (None, "short", "a"), (None, None, None)] + [(10 + i, good, None if i % 2 else "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(quality.keep_good(docs).collect(), key=repr) == sorted(docs.filter(F.col("text") == good).collect(), key=repr)


def test_toxic_words_are_learned(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        toxic = i % 6 == 0
        if toxic:
            words[5:8] = ["vile", "nasty" if i % 4 else "vile", "foulish" + "abcdef"[i % 5]]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vile nasty vile"), (None, "vile nasty foulisha")]
    labels += [(i, int(i % 6 == 0)) for i in range(0, 900, 6)] + [(5, None), (None, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, table).collect()}
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (i % 6 == 0), i
    assert got[1000].score == got[1001].score < 0.5 <= got[1002].score <= 1
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == 752
    none = toxicity.score_toxicity(docs, table.filter("toxic = 0"))
    assert none.filter("score > 1e-9").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), table).count() == 0


def test_rare_toxic_words_are_learned(spark):
    rng = np.random.default_rng(5)
    rows, labels, rare = [], [], set()
    for i in range(3000):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if i % 6 == 0:
            words[5] = "vile"
        if i % 300 == 0:  # 2 % of the positives, in words of their own
            words = [f"p{k}" for k in rng.integers(0, 300, 39)] + ["rareza"]
            rare.add(i)
        elif i % 60 == 1:
            words = [f"p{k}" for k in rng.integers(0, 300, 40)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i] for i in rare) and got == {i: int(i % 6 == 0) for i in range(3000)}


def test_risk_estimate_turns_when_negative():
    weight, bias = toxicity.train([np.array([0], np.int32)] * 5, [np.array([0], np.int32)] * 5 + [np.array([1], np.int32)] * 45, 2, 0.1)
    assert weight[0] > weight[1] and np.isfinite(weight).all() and math.isfinite(bias)


def direct_risk(f, is_positive, prior):
    """The risk by its definition, document by document."""
    loss = lambda x: math.log1p(math.exp(-x))
    p = [x for x, k in zip(f, is_positive, strict=True) if k]
    u = [x for x, k in zip(f, is_positive, strict=True) if not k]
    slack = sum(map(loss, (-x for x in u))) / len(u) - prior * sum(map(loss, (-x for x in p))) / len(p)
    return prior * sum(map(loss, p)) / len(p), slack


@pytest.mark.parametrize(("prior", "shift"), [(0.1, 0.0), (0.4, 1.0), (0.5, -2.0), (0.5, 3.0)])
def test_risk_and_its_direction_by_definition(prior, shift):
    rng = np.random.default_rng(2)
    is_positive = np.arange(12) < 5
    f = rng.normal(size=12) + np.where(is_positive, shift, -shift)
    value, g = toxicity.risk(f, is_positive, prior)
    first, slack = direct_risk(f, is_positive, prior)
    assert value == pytest.approx(first + max(slack, 0.0))
    for k in range(12):
        d = np.zeros(12)
        d[k] = 1e-5
        up, down = direct_risk(f + d, is_positive, prior), direct_risk(f - d, is_positive, prior)
        slope = (sum(up) - sum(down)) / 2e-5 if slack >= 0 else -(up[1] - down[1]) / 2e-5
        assert g[k] == pytest.approx(slope, abs=1e-6)


def test_negative_slack_occurs():
    f = np.array([4.0, 5.0, -9.0, -9.0])
    assert direct_risk(f, f > 0, 0.5)[1] < 0 and toxicity.risk(f, f > 0, 0.5)[0] == pytest.approx(direct_risk(f, f > 0, 0.5)[0])
    assert (toxicity.risk(f, f > 0, 0.5)[1][:2] > 0).all() and (toxicity.risk(f, f > 0, 0.5)[1][2:] < 0).all()


def test_bounds_and_prior_are_parameters(spark):
    rows = [(i, ("vile " if i % 4 == 0 else "calm ") + f"w{i % 7} " * 3 + ("long " * 60_000 if i == 3 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, table, prior=0.2, positives=40, unlabelled=150, features=2)
    assert 0 < len(weights) <= 2 and math.isfinite(bias)
    assert toxicity.score_toxicity(docs, table, positives=60, features=3).filter("predicted = 1 AND doc_id % 4 > 0").count() == 0


def base_spans(text):
    found = []
    patterns = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"),
        ("hex", r"[0-9a-f]+"),
    )
    for k, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= (6, 20, 24)[k]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)], [sum(k == j for _, k, _ in found) for j in range(3)]


SECRETS = [
    None,
    "",
    'é password = "hunter22" PASSWD:abc token: abcdef',
    "secret:token:abcdefgh api-key=1234567 APIKEY='1234567 api_key=\"xx\"",
    "ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "B" * 16 + " AKIA" + "B" * 15 + " xAKIAAKIA" + "7" * 20 + "z",
    "0123456789abcdef01234567 " * 3 + "g" * 10 + "f" * 23 + "G" + "a" * 24,
    "see 9f86d081-884c-7d65-9a2f-eaa0c55ad015 and aVeryLongCamelCaseIdentifierHere ====================",
    "key Zx8Qw3Er5Ty7Ui9Op1As3Df5 end",
    "token=" * 2000 + "abcdef",
    "password=" + "a1B2" * 20_000,
]


def test_base_spans_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*SECRETS, SECRETS[2]])], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    for i, t in enumerate([*SECRETS, SECRETS[2]]):
        spans, counts = base_spans(t or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == counts, t[:80] if t else t
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | ({""} - set(spans))
    assert got[8].spans == "entropy:4:28" and got[7].spans == ""
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", ["aaaa", "abcd" * 9, "Zx8Qw3Er5Ty7Ui9Op1As3Df5Zx8Q", "a" * 30 + "bcdefghijk", "x"])
@pytest.mark.parametrize("width", [4, 20, 33])
def test_window_entropy_by_brute_force(run, width):
    w = min(width, len(run))

    def bits(s):
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())

    assert secrets.window_entropy(run, width) == pytest.approx(max(bits(run[i : i + w]) for i in range(len(run) - w + 1)))


def test_redaction_leaves_nothing(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long")
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns
    assert secrets.scan_secrets(clean).filter(F.col("spans") != "").count() == 0
    kept = {r.doc_id: r for r in clean.collect()}
    assert kept[0].text is None and kept[7].text == SECRETS[7] and kept[8].text == "key [SECRET] end" and kept[8].n_chars == 16


def test_unrelated_size_columns_stay(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdefgh12"', "many"), (2, None, None)], "doc_id long, text string, n_chars string")
    got = {r.doc_id: tuple(r) for r in secrets.redact_secrets(docs).collect()}
    assert got == {1: (1, "[SECRET]\"", "many"), 2: (2, None, None)}
    docs = spark.createDataFrame([(1, "password=hunter22 x", 19)], "doc_id long, text string, n_chars int")
    assert tuple(secrets.redact_secrets(docs).first()) == (1, "[SECRET] x", 10)


KEY = "Zx8Qw3Er5Ty7Ui9Op1As3Df5Gh7Jk9Lz2Xc4Vb6N"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"AKIA{'B7' * 10}/{KEY}", "access:0:24,entropy:24:65"),
        (f"path/example/{KEY}", "entropy:13:53"),
        (f"{KEY}/sample", "entropy:0:40"),
        ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ""),
        ("deploy-9f86D0818e3a7c65b9aF", "entropy:0:27"),
        ("order-12345678901234567890", ""),
        ("QzXvBnMkLpWrTyHgFdSaZcVx", "entropy:0:24"),
        ("aVeryLongCamelCaseIdentifierHere SOME_CONSTANT_OF_THE_PROGRAM some-slug-of-plain-words", ""),
        ("password=hunter22/" + KEY, "assign:0:58"),
    ],
)
def test_what_is_random(text, want):
    assert secrets.spelled(secrets.find(text)) == want


def test_planted_secrets_are_found():
    rng = np.random.default_rng(8)
    alphabets = ["0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    prose = "The committee met on Tuesday to discuss internationalisation, self-determination and/or well-known Donaudampfschifffahrtsgesellschaft rules at https://www.host.net/some/long/path/to-a-page_of_words today. "
    found = alarms = 0
    for i in range(300):
        key = "".join(rng.choice(list(alphabets[i % 3]), 32 + i % 17))
        at = len(prose)
        spans = secrets.find(prose + key + " " + prose)
        found += any(a <= at and b >= at + len(key) for a, _, b in spans) or sum(b - a for a, _, b in secrets.find(key)) >= len(key) - 8
        alarms += len(secrets.find(prose + str(i)))
    assert found >= 297 and alarms == 0


def test_scans_are_linear_in_spans():
    import time

    took = []
    for n in (4000, 16000):
        text = f"token=abcdef {KEY} " * n
        start = time.process_time()
        assert len(secrets.find(text)) == 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]
