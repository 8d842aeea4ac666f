"""Operator 8: quality rules judged by host, in DataFrame functions only.

Each text is counted once.  Rule failures are summed by host, each host's failure rate is shrunk
towards the rate of all hosts by a beta prior fitted to the hosts themselves, and the verdict on the
host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_names, spread, stored, without

SPACES = r"[ \t-\r]+"  # U+0020 and U+0009 to U+000D
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time, although ``use`` names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Words in order; after trimming, a split gives no empty word but for an empty text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that the text holds twice or more, the first one included.

    The windows' 64-bit hashes are sorted with their places; equal neighbours are repeats.
    """
    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])

        def covered(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*[x["i"] + k for k in range(size)])))))

        # Most texts repeat no window: then the sorted places are not needed.
        distinct = F.size(F.array_distinct(F.transform(starts, window)))
        placed = F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("i")))
        return F.when(distinct == F.size(w) - size + 1, 0).otherwise(_once(F.array_sort(placed), covered))

    return _once(words, lambda w: F.when(F.size(w) < size, 0).otherwise(count(w))).cast("long")


def text_counts(text: Column) -> Column:
    """Struct of COUNTS of a text, null as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return _once(words_of(whole), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words")))


def base_rules(least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    """True where a document fails by itself, whatever its host."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def other_rules() -> list[Column]:
    """Further failures that count for the host: many symbols, repeated lines, odd word lengths."""
    words = F.col("n_words")
    return [10 * F.col("n_symbols") > words, 5 * F.col("n_dup_lines") > words,
            (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words)]


def host_rates(judged: DataFrame, host_col: str = "host") -> DataFrame:
    """host, n, failed, rate: failures over documents, shrunk by a beta prior fitted to all hosts by moments.

    One row of sums over hosts reaches the driver.  A prior of one document stands where the hosts vary
    more than any beta allows, and one of all documents where they vary no more than chance.
    """
    hosts = stored(judged.groupBy(host_col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")))
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"),
                     F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    alpha, beta = prior(sums["k"], sums["n"] or 0, sums["f"] or 0, sums["ff"] or 0.0, sums["nn"] or 0)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))


def prior(hosts: int, n: int, failed: int, squares: float, sizes: int) -> tuple[float, float]:
    """Alpha and beta from sums over hosts: of documents, failures, failures squared over documents, documents squared."""
    if not n:
        return 0.5, 0.5
    mean = failed / n
    spread_ = mean * (1 - mean)
    weight = float(n)
    if hosts > 1 and spread_ > 0:
        # Between-host variance of the rate, from the weighted squares about the mean.
        about = squares - n * mean * mean
        between = (about - (hosts - 1) * spread_) / (n - sizes / n)
        if between > 0:
            weight = min(float(n), max(1.0, spread_ / between - 1))
    return max(mean * weight, 1e-9), max((1 - mean) * weight, 1e-9)


def judge_counted(counted: DataFrame, most_rate: float = 0.5, host_col: str = "source") -> DataFrame:
    """Rows that carry COUNTS and a host, with base_failed, host_rate and kept."""
    any_rule = base_rules()
    for rule in other_rules():
        any_rule = any_rule | rule
    host, failed = free_names(counted, "_host", "_failed")
    judged = stored(counted.withColumns({"base_failed": base_rules(), failed: any_rule}))
    rates = host_rates(judged.select(F.col(host_col).alias(host), F.col(failed).alias("failed")), host)
    back = judged.join(spread(rates.select(host, F.col("rate").alias("host_rate"))), F.col(host_col).eqNullSafe(F.col(host)))
    return back.drop(host, failed).withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most_rate))


def judge(docs: DataFrame, most_rate: float = 0.5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS, base_failed, host_rate and kept.

    A document is kept if it does not fail by itself and its host's shrunk failure rate (over all rules)
    is at most ``most_rate``.  Null texts count as empty and so fail; documents without host form one
    host; repeated rows count each.  Input columns of those names are replaced.
    """
    clean = without(docs, *COUNTS, "base_failed", "host_rate", "kept")
    [counts] = free_names(clean, "_c")
    counted = clean.withColumn(counts, text_counts(F.col(text_col))).select(*clean.columns, f"{counts}.*")
    return judge_counted(counted, most_rate, host_col)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    docs = documents(spark, sf_dir)
    # The text is left out of what is stored between counting and judging.
    counted = docs.select("doc_id", "source", text_counts(F.col("text")).alias("c")).select("doc_id", "source", "c.*")
    judged = judge_counted(counted)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")
