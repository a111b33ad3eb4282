"""Host-level quality rules, in DataFrame functions only.

Each document is measured in place (no shuffle of texts or words). Failures of
each rule are counted per host and the host's rate is shrunk towards an empirical
beta prior, which is fitted over all hosts by beta-binomial moments: what hosts'
rates spread by sampling alone is taken out, so that a host of few documents
keeps close to the pooled rate. A host whose shrunk rate of any rule reaches the
limit fails. Verdicts join back to documents: documents of failed hosts are held
to strict limits, all others to the usual ones. So junk that is spread over good
hosts goes, and clean documents of bad hosts stay.

Defined cases: a null text has no words; a null host is a host of its own; null
and repeated ids change nothing, since verdicts go by row; equal rows get equal
verdicts; a text of any length is measured whole; an empty table gives an empty
result; columns other than ``doc_id``, ``text`` and the host column are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, by_ids, join_skewed, let, settle

#: Rules that are counted per host, with the SQL condition that fails a document.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
}
#: The same rules for documents of failed hosts.
STRICT = {
    "base": "n_words < 40 OR 100 * n_repeat_words > 15 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "lines": "4 * n_dup_lines > n_lines",
}
#: A host fails when a rule's shrunk failure rate reaches this.
HOST_LIMIT = 0.5
#: The prior's strength in documents, at least and at most.
WEAKEST, STRONGEST = 1.0, 1e6


def _any(rules: dict[str, str]) -> Column:
    return F.expr(" OR ".join(f"({c})" for c in rules.values()))


def _pairs(h: Column, n: Column, shift: int) -> Column:
    """Hashes of (h[i], h[i + shift]) for every i that has both; n: the size of h."""
    m = F.greatest(n - shift, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(shift + 1), m), lambda a, b: F.xxhash64(a, b))


def _repeated(h: Column) -> Column:
    """Words covered by windows of eight whose hash is in ``h`` twice or more."""

    def covered(starts: Column) -> Column:
        later = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
        gaps = F.zip_with(starts, later, lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def of_sorted(s: Column) -> Column:
        m = F.size(s)
        after = F.concat(F.slice(s, F.lit(2), m - 1), F.array(F.lit(None)))
        before = F.concat(F.array(F.lit(None)), F.slice(s, F.lit(1), m - 1))
        near = F.arrays_zip(s.alias("s"), after.alias("a"), before.alias("b"))
        twice = F.filter(near, lambda x: F.coalesce(x["s"]["h"] == x["a"]["h"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["b"]["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["s"]["i"])), covered)

    exact = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact)


def _row_key(doc_id: str, host: str, text: str) -> Column:
    """What tells rows apart that may get different verdicts; never null."""
    parts = [F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).cast("binary")) for c in (doc_id, host)]
    return F.md5(F.concat(*parts, F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, a row's key and the measures of every whole text; rows stay where they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id"), F.col(host).alias("host"), _row_key("doc_id", host, "text").alias("row_key"), text.alias("text"))
    df = df.select("doc_id", "host", "row_key", "text", F.btrim(F.col("text"), F.lit(BLANKS)).alias("t"))
    words = F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", "[\\x20\\x09-\\x0D]+", -1))
    n_words = F.size("words")

    def windows(h1: Column) -> Column:
        n = F.size(h1)
        return let(_pairs(h1, n, 1), lambda h2: let(_pairs(h2, n - 1, 2), lambda h4: _pairs(h4, n - 3, 4)))

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    h8 = let(F.transform("words", lambda w: F.xxhash64(w)), windows)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    plain = F.array_join("words", "")
    return (
        df.withColumn("words", words)
        .select(
            "doc_id",
            "host",
            "row_key",
            n_words.cast("long").alias("n_words"),
            F.length(plain).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, line_counts).alias("lines"),
            F.when(n_words < 9, F.lit(0)).otherwise(let(h8, _repeated)).cast("long").alias("n_repeat_words"),
        )
        .withColumn("n_dup_lines", F.col("lines.dup").cast("long"))
        .withColumn("n_lines", F.col("lines.n").cast("long"))
        .drop("lines")
    )


def prior_strength(n: float, squares: float, hosts: int, mean: float, spread: float) -> float:
    """Documents that the prior counts for, by beta-binomial moments.

    n: all documents; squares: the sum of hosts' squared sizes; mean: the pooled
    rate; spread: sum over hosts of size * (rate - mean)^2. With correlation r
    between a host's documents, spread is expected to be mean * (1 - mean) *
    (hosts - 1 + r * (n - squares / n - hosts + 1)); the strength is 1 / r - 1.
    """
    room = n - squares / n - hosts + 1 if n else 0.0
    even = mean * (1 - mean)
    r = (spread / even - hosts + 1) / room if room > 1e-9 and even > 0 else 0.0
    return min(max(1 / r - 1, WEAKEST), STRONGEST) if r > 1e-9 else STRONGEST


def host_rates(measured: DataFrame) -> DataFrame:
    """A row per host: n, and for each rule its failures and its rate shrunk by the prior.

    Failures are summed before the shuffle, so a host of any size costs one row
    per task. One row of sums over all hosts reaches the driver.
    """
    failures = [F.count_if(F.expr(c)).alias(f"{r}_failed") for r, c in RULES.items()]
    hosts = measured.groupBy("host_key").agg(F.count(F.lit(1)).alias("n"), *failures)
    size = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum(size).alias("n"), F.sum(size * size).alias("squares")]
    for r in RULES:
        failed = F.col(f"{r}_failed").cast("double")
        sums += [F.sum(failed).alias(f"{r}_k"), F.sum(failed * failed / size).alias(f"{r}_q")]
    all_hosts = hosts.agg(*sums).first()
    n = all_hosts["n"] or 0.0
    for r in RULES:
        mean = (all_hosts[f"{r}_k"] or 0.0) / n if n else 0.0
        spread = (all_hosts[f"{r}_q"] or 0.0) - n * mean * mean
        strength = prior_strength(n, all_hosts["squares"] or 0.0, all_hosts["hosts"], mean, spread)
        rate = (F.col(f"{r}_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        hosts = hosts.withColumn(f"{r}_rate", rate)
    return hosts


def _judged(docs: DataFrame, host: str) -> DataFrame:
    """The measures, ``base_failed``, ``host_failed`` and ``kept`` of every document."""
    host_key = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit(""))
    measured = settle(measure(docs, host).withColumn("host_key", host_key), "quality")
    failed = F.greatest(*(F.col(f"{r}_rate") for r in RULES)) >= HOST_LIMIT
    verdicts = settle(host_rates(measured).select("host_key", "n", failed.alias("host_failed")), "quality-hosts")
    rows = join_skewed(measured, verdicts, "host_key", "n", measured.count(), narrow=True)
    kept = ~_any(RULES) & ~(F.col("host_failed") & _any(STRICT))
    return rows.withColumns({"base_failed": F.expr(RULES["base"]), "kept": kept})


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures, ``base_failed``, ``kept`` and ``host_failed`` of every document."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(docs, host).select("doc_id", *measures, "base_failed", "kept", "host_failed")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns.

    Verdicts go by row, so that null and repeated ids neither save nor cost a document.
    """
    rejected = _judged(docs, host).filter(~F.col("kept")).select("row_key").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(_row_key("doc_id", host, "text").alias("row_key"), row)
    return by_ids(keyed, settle(rejected, "quality-rejected"), "left_anti", ("row_key",)).select("row.*")
