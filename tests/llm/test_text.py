"""BPE, packing, n-gram joins, shards, archives and the pipeline against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tablewright.llm import bpe, common, jaccard, packing, sharding, warc  # noqa: E402
from tablewright.llm.common import new_path  # noqa: E402

BYTE, WORD = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MARKS = "abcdefgh  \n\t'sltrevmd0123é漢字😀 \u0085\x1c.,!?-_ÀßñΣİ́　"


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    fixed = ["", " ", "\n\n x  ", "don't I'LL we've 's", "<|endoftext|> a<|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>b", "a" * 3000, "word " * 3000]
    return fixed + ["".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 150))) for _ in range(n)]


def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_librarys(spark):
    texts = [None, *odd_texts(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    t, got = tokenizer(BYTE), {r.doc_id: r for r in bpe.encode_documents(docs, BYTE).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), BYTE).count() == 0


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    monkeypatch.setattr(packing, "CACHE", 8)
    t, e = tokenizer(BYTE), bpe.Encoder(BYTE)
    u, w = tokenizer(WORD), packing.Words(WORD)
    for text in odd_texts(60, 2):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(w.encode(text), "<u4").tolist() == u.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(spark):
    texts = [None, *odd_texts(150, 3), "many words here " * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int")
    t, want = tokenizer(WORD), []
    for i, text in [*enumerate(texts), (3, texts[3])]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack(docs, WORD).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs.limit(0), WORD).count() == 0


def least(items, capacity):
    """Bins that an exhaustive search needs."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + items[k] <= capacity:
                bins[i] += items[k]
                place(k + 1, bins)
                bins[i] -= items[k]
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_plans_by_brute_force(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(15, 60) for _ in range(11)]
    counts = dict(Counter(items))
    plan = packing.make_plan(counts, 100)
    used = Counter()
    for filling, n in plan:
        assert packing.load(filling) <= 100
        for x, k in filling:
            used[x] += n * k
    assert used == Counter(items) and sum(n for _, n in plan) == least(items, 100)


def test_search_beats_the_incumbent():
    counts = {44: 1, 24: 2, 22: 1, 21: 1, 17: 1, 8: 2, 6: 2}
    assert sum(n for _, n in packing.best_fit(counts, 61)) == 4
    assert sum(n for _, n in packing.make_plan(counts, 61)) == packing.least_bins(counts, 61) == 3


@pytest.mark.parametrize("counts", [{1: 5000}, {2: 1500}, {1: 3000, 500: 10}, {1: 1200, 2048: 40, 1025: 7}, {3: 10**9, 7: 10**8}, {}])
def test_many_short_pieces(counts):
    plan, gap = packing.search(counts)
    used = Counter()
    for filling, n in plan:
        assert packing.load(filling) <= packing.CAPACITY
        for x, k in filling:
            used[x] += n * k
    assert used == Counter(counts) and 0 <= gap <= max(sum(n for _, n in plan) // 1000, 1)


def test_long_searches_end():
    rnd = random.Random(9)
    for counts in ({x: rnd.randint(1, 9) for x in rnd.sample(range(300, 1000), 60)}, {683: 9000, 684: 9001, 682: 5, 3: 2}, {700: 999, 650: 1000, 2: 9}):
        plan, gap = packing.search(counts, nodes=300)
        assert gap >= 0 and sum(n * k for f, n in plan for _, k in f) == sum(counts.values())


def fillings_by_brute_force(counts, room):
    """The total of the fullest filling."""
    best = {0}
    for x, n in counts.items():
        best = {b + k * x for b in best for k in range(n + 1) if b + k * x <= room}
    return max(best)


@pytest.mark.parametrize("seed", range(6))
def test_fillings_are_maximal_and_undominated(seed):
    rnd = random.Random(seed)
    counts = {x: rnd.randint(1, 4) for x in rnd.sample(range(5, 60), 7)}
    found = packing.fillings(dict(counts), sorted(counts), 100, keep=10**6, leaves=10**6)
    assert packing.load(found[0]) == fillings_by_brute_force(counts, 100)
    for f in found:
        assert all(k <= counts[x] for x, k in f) and packing.load(f) <= 100
        assert not any(counts[x] - dict(f).get(x, 0) > 0 and x <= 100 - packing.load(f) for x in counts)
        assert not any(packing._dominates(g, f) for g in found if g != f)


def test_thousands_of_empty_texts_are_packed(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("text"), F.lit(7).alias("mark"), F.lit("x").alias("bucket"))
    rows = packing.pack(docs, WORD).collect()
    assert len(rows) == 3000 and {r.length for r in rows} == {1}
    assert len({r.sequence_id for r in rows}) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 3000


def brute_components(texts, n, percent):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


def near_copies(seed, groups=6, each=14, words=60):
    rnd = random.Random(seed)
    texts = [None, "", "  ", "One", "one", "two words", "Two  words", "two words", "a b c"]
    shared = " ".join(f"shared{i}" for i in range(40))
    for g in range(groups):
        base = [f"g{g}w{rnd.randint(0, 90)}" for _ in range(words)]
        for _ in range(each):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 10**6)}"
            texts.append(" ".join(t) + (" " + shared if g % 2 else ""))
            base = t if rnd.random() < 0.5 else base
    return texts


@pytest.mark.parametrize(("n", "percent", "few", "large"), [(3, 90, 16, False), (3, 90, 3, False), (5, 80, 2, True)])
def test_components_by_brute_force(spark, monkeypatch, n, percent, few, large):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 5)
    if large:  # as on large tables: nothing is sent to all tasks, keys of few rows are hot
        monkeypatch.setattr(common, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
        monkeypatch.setattr(jaccard, "TASKS", 2)
    texts = near_copies(n + few)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, n, percent).collect())
    want = brute_components(texts, n, percent)
    assert got == want and len({c for _, k, c in want if k}) < len(texts) - 10
    kept = jaccard.keep_one(docs, n, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_components_edge_cases(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (2, "A b c D"), (None, ""), (9, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == [("2", 2, 2), ("7", 2, 2), ("7", 2, 2), ("9", 0, 9), ("None", 0, None), ("None", 2, 2)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, "x y z w"), (5, "x y z w"), (5, "k l m n o"), (8, "K l m n o")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(twice).collect()) == [(3, 2, 3), (5, 2, 3), (5, 3, 5), (8, 3, 5)]


def test_one_row_of_each_component_stays(spark):
    def kept(rows):
        return sorted((tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int")).select("doc_id", "text").collect()), key=repr)

    assert kept([(3, "x y z w", 0), (5, "x y z w", 0), (5, "k l m n o", 0), (8, "K l m n o", 0)]) == [(3, "x y z w"), (5, "k l m n o")]
    rows = [(5, "A b c d e", 0), (5, "k l m n o", 0), (7, "a b c d e", 0), (8, "K l m n o", 0), (2, "p q r", 0), (2, "p q r", 1), (4, "P q r", 0), (None, "p q r", 0)]
    rows += [(None, "u v w", 0), (None, "u v w", 1), (None, "U v w", 0), (None, "s t", 0), (9, "f g", 0), (9, "F g", 0), (1, "", 0), (1, " ", 0), (1, None, 0)]
    got = kept(rows)
    assert [(i, (t or "").lower()) for i, t in got] in ([(1, x), (1, y), *z] for x, y in [(" ", ""), ("", " ")] for z in [[(2, "p q r"), (5, "a b c d e"), (5, "k l m n o"), (9, "f g"), (None, "s t"), (None, "u v w")]])


def test_texts_of_null_ids_have_sets(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[k : k + 50]) for k in (0, 2, 4))  # a and c are linked by b alone
    docs = spark.createDataFrame([(5, a), (None, b), (None, b), (3, c), (None, "x y z w")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs).collect()), key=repr)
    assert got == [(3, 48, 3), (5, 48, 3), (None, 2, None), (None, 48, 3), (None, 48, 3)]
    assert [r.doc_id for r in jaccard.jaccard_components(docs.filter("doc_id IS NOT NULL")).filter("doc_id = component_id").collect()] != [3]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_joins(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    table = rows.filter("k != 9").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = common.join_skewed(rows, table, "k", "n", 300, how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.join(table, "k", how).collect()), key=repr)


def test_codes_of_counts_keep_their_order():
    counts = np.concatenate([np.arange(5000), 2 ** np.arange(13, 40)])
    for bits in (8, 16):
        codes = jaccard.to_code(counts, bits)
        back = jaccard.from_code(codes)
        exact = counts < 1 << (bits - 1)
        assert (np.diff(codes.astype(int)) >= 0).all() and np.array_equal(back[exact], counts[exact])
        fits = counts < 1 << (14 if bits == 8 else 39)
        assert np.allclose(back[fits], counts[fits], rtol=0.1)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(2))
        assert jaccard.at_most(jaccard.partitions(a), jaccard.partitions(b)) >= len(np.intersect1d(a, b))


def test_chains_reach_the_smallest(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 103), (103, 100), (200, 200)]
    got = {r.id: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_shards_match_the_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", None, "bé"]) and "t" * rnd.randint(0, 9), rnd.choice(["s", "s", "s", "t", None, f"u{i}"]), 0) for i in range(1000)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.interleave(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(by[k]))
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    none = sharding.interleave(nameless).collect()
    assert sorted((r.size, r.text_crc32) for r in none) == sorted((r.size, r.text_crc32) for r in got)
    assert sorted((r.shard, r.slot) for r in none) == sorted((r.shard, r.slot) for r in got)
    few = sharding.interleave(docs.filter("source IS NULL OR source IN ('s', 't')")).collect()
    for s, n in Counter(r.stratum for r in few).items():
        parts = Counter(r.shard for r in few if r.stratum == s)
        assert all(abs(parts[k] - n / 8) < 2 for k in range(8))
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.interleave(docs.repartition(7)).collect()))
    assert sharding.interleave(docs.limit(0)).count() == 0
    assert sharding.interleave(docs.limit(3)).count() == 3


def test_archives_by_brute_force(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big), (5, "http://b\r\nWARC-Type: x", big), (3, None, big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", "x\r\n\r\nWARC/1.1\r\n" * 80), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.archive_pages(pages).collect()), key=repr)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = html == big and i != 5
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_one_of_tied_pages_responds(spark):
    big, long = "<p>é</p>" * 200, "<td>x</td>" * 300_000
    rows = [(5, "b", big), (5, "a", big), (5, "a", big), (2, "c", big), (None, "d", long), (None, "e", long), (7, "f", long + "y"), (7, "f", long + "y"), (3, None, "z" * 1000), (3, None, "z" * 1000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to long")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=repr)
    n = len(long)
    want = [(5, 1800, "response", None), (5, 1800, "revisit", 5), (5, 1800, "revisit", 5), (2, 1800, "revisit", 5), (None, n, "response", None), (None, n, "response", None)]
    want += [(7, n + 1, "response", None), (7, n + 1, "revisit", 7), (3, 1000, "response", None), (3, 1000, "revisit", 3)]
    assert got == sorted(want, key=repr)
    assert {(r.record_type, r.target_uri) for r in warc.page_records(pages.filter("page_id = 5")).collect()} == {("response", "a"), ("revisit", "a"), ("revisit", "b")}


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_source(spark, compression):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", f"<p>{i}</p>" * 300) for i in range(30)], "page_id long, url string, html string")
    warc.register(spark)
    path = new_path(spark, "warc-test")
    warc.page_records(pages).repartition(3).write.format("warc").option("compression", compression).mode("append").save(path)
    files = os.listdir(path.removeprefix("file://"))
    assert len(files) == 3 and all(f.endswith(".warc.gz" if compression == "gzip" else ".warc") for f in files)
    df = spark.read.format("warc").load(path)
    assert {r.record_id: bytes(r.payload).decode() for r in df.collect()} == {f"urn:page:{r.page_id}": r.html for r in pages.collect()}
    some = spark.read.format("warc").option("payload", "false").load(path).filter((F.col("target_uri") == "http://h1/") & F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith("urn:page:1"))
    assert sorted(r.record_id for r in some.collect()) == [f"urn:page:{i}" for i in (1, 10, 13, 16, 19)] and all(r.payload is None for r in some.collect())
    warc.page_records(pages.limit(2)).coalesce(1).write.format("warc").option("compression", compression).mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 2 and len(os.listdir(path.removeprefix("file://"))) == 1
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 0


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            words[3:6] = ["vile", "nasty", "foul"]
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s0", 0) for i in range(1, 8)]
    docs += [(2000, docs[1][1] + " again", "en", "s1", 0), (2001, "too short", "en", "s1", 0), (2002, docs[2][1] + ' password = "Abc12345"' + " q" * 30 + " z" * 9, "en", None, 0), (2003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = table
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, left, str(tmp_path))
        path = f"{tmp_path}/{k}"
        left.write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == table.columns
        kept.append({r.doc_id for r in left.collect()})
    toxic = {i for i in range(0, 400, 8)}
    assert kept[0] == {d[0] for d in docs} - toxic
    assert kept[1] == kept[0] - {2001, 2003} - ({2002} - kept[1])
    assert kept[2] == kept[1] - {1000 + i for i in range(1, 8)} - {2000}
    assert kept[3] == kept[2]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == kept[3]


CLASHES = "doc_id long, text string, source string, n_chars string, row_key string, class string, kept boolean, label int, uses long"


def through_stages(spark, docs, folder):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{folder}/{k}")
        tables.append(spark.read.parquet(f"{folder}/{k}"))
    return tables


def test_pipeline_of_nothing(spark, tmp_path):
    for t in through_stages(spark, spark.createDataFrame([], CLASHES), str(tmp_path)):
        assert t.count() == 0 and "doc_id" in t.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    rnd = random.Random(11)
    prose = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(60)) for _ in range(160)]
    rows = [(i, t + (" vile nasty" if i % 5 == 0 else "")) for i, t in enumerate(prose)]
    long = " ".join(f"l{rnd.randint(0, 10**6)}" for _ in range(60_000))
    rows += [(7, prose[7])] * 3 + [(None, prose[8]), (None, prose[8]), (9, prose[11].upper()), (9, "short"), (None, None), (None, "")]
    rows += [(500, long), (501, long + " end"), (None, " ".join(f"n{k}" for k in range(70)))]
    docs = spark.createDataFrame([(i, t, "s", "many", "k", "c", False, 1, 2) for i, t in rows], CLASHES)
    *tables, pieces = through_stages(spark, docs, str(tmp_path))
    assert all(t.columns == docs.columns for t in tables)
    after = [Counter((r.doc_id, (r.text or "").lower()) for r in t.collect()) for t in tables]
    clean = Counter({k: n for k, n in after[0].items() if "vile" not in k[1]})
    assert after[1] == clean
    good = Counter({k: n for k, n in clean.items() if len(k[1].split()) >= 20})
    assert after[2] == good
    texts = {t for _, t in good} - {long + " end"}
    assert len(after[3]) == sum(after[3].values()) == len(texts) and {t for _, t in after[3]} == texts
    assert (8, prose[8]) in after[3] and (9, prose[9]) in after[3] and (9, prose[11]) in after[3] and (500, long) in after[3]
    assert after[4] == after[3]
    assert pieces.filter("piece = 0").count() == len(texts) and pieces.filter("doc_id = 500").count() > 50


def test_runs_clean_up(spark, tmp_path):
    from tablewright.scratch import clean, forget, settle, settled_so_far

    mark = settled_so_far()
    a, b, c = (settle(spark.range(k), "clean-test") for k in (3, 4, 5))
    forget(a)
    clean(spark, mark, keep=(c,))
    assert c.count() == 5 and settled_so_far() == mark + 1
    for gone in (a, b):
        with pytest.raises(Exception, match="."):
            gone.collect()
