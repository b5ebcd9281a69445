"""Quality rules on documents, and verdicts on the hosts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import WHITE, free_name, let, text_or_empty, word_array, written

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a run of `window` words that the text has twice or more.

    Windows are hashed and sorted with their positions; equal neighbours are repeats, and the windows' union is
    measured along their sorted positions. That is n log n in the words of a text, and each array is bound once.
    """
    shortened = lambda hashes: F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window),
        lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]).alias("h"), i.alias("p")),
    )
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def starts(ordered: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(ordered, k)["h"] == F.get(ordered, j)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(at, lambda k: F.get(ordered, k)["p"]))

    def covered(positions: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last"))
        step = lambda acc, p: F.struct(
            (acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"), p.alias("last")
        )
        return F.aggregate(positions, first, step, lambda acc: acc["sum"])

    long_enough = let(hashed, lambda h: let(F.sort_array(shortened(h)), lambda s: covered(starts(s))))
    return F.when(F.size(words) > window, long_enough).otherwise(0).cast("long")


def rule_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added."""
    text, words = free_name(df, "_text"), free_name(df, "_words")
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    counted = df.withColumn(text, text_or_empty(text_col)).withColumn(words, word_array(F.col(text)))
    return counted.select(
        *df.columns,
        let(
            F.col(words),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ).alias("_counts"),
        _without(F.col(text), WHITE).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(F.col(text), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
    ).select(
        *df.columns,
        F.col("_counts.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_counts.n_repeat_words").alias("n_repeat_words"),
        (
            (F.col("_counts.n_words") < 20) | (100 * F.col("_counts.n_repeat_words") > 30 * F.col("_counts.n_words"))
        ).alias("base_failed"),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the beta distribution with the mean and the variance of the hosts' failure rates.

    Hosts weigh by their documents; the variance expected from small counts alone is taken off first. Two numbers
    come to the driver, whatever the number of hosts. Without spread the prior is held at 1,000 documents, and
    without hosts it is (1, 1).
    """
    rate = F.col("failed") / F.col("docs")
    row = hosts.agg(
        F.sum("failed").alias("failed"),
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs") * rate * rate).alias("squares"),
        F.count(F.lit(1)).alias("hosts"),
    ).first()
    if not row["docs"]:
        return 1.0, 1.0
    mean = row["failed"] / row["docs"]
    spread = row["squares"] / row["docs"] - mean * mean
    noise = mean * (1 - mean) * row["hosts"] / row["docs"]
    between = max(spread - noise, mean * (1 - mean) / 1001, 1e-9)
    strength = max(mean * (1 - mean) / between - 1, 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, max_rate: float) -> DataFrame:
    """hosts (docs, failed) with rate, shrunk to the common prior, and host_kept: rate <= max_rate."""
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= max_rate)


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = 0.5,
    max_broadcast_hosts: int = 500_000,
) -> DataFrame:
    """(id, host, the rule counts, base_failed, host_rate, kept) for each row of df.

    A document fails the base rules with under 20 words, or with over 30 % of its words in repeated runs of
    eight. Failures are counted by host (with map-side combining, so that a host with a third of all rows costs
    nothing extra), each host's rate is shrunk by a beta prior fitted to all hosts, and the documents of a host
    whose shrunk rate is over max_rate go with it. The verdicts are broadcast while there are at most
    max_broadcast_hosts, which is counted first; beyond that they are sort-merge joined.

    Edge cases: no rows give no rows; a null text has no words and fails; null hosts are one host; repeated rows
    count as often as they stand; extra columns are not read.
    """
    narrow = df.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_body"))
    counted = written(rule_counts(narrow, "_body").drop("_body"), "rule-counts")
    hosts = written(
        counted.groupBy("_host").agg(
            F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
        ),
        "host-failures",
    )
    verdicts = host_verdicts(hosts, max_rate).select(F.col("_host").alias("_judged"), "host_rate", "host_kept")
    if hosts.count() <= max_broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    joined = counted.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")))
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias(host_col),
        *[c for c in counted.columns if not c.startswith("_")],
        "host_rate",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )
