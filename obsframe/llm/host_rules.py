"""Quality rules that judge a document by its own text and by the host that it came from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.tables import SPACE, struct, written

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text; a null text has no words and no lines with a word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - len(raw) + len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        end = 0
        for i, window in enumerate(windows):
            if window in twice:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


@F.arrow_udf(struct(**dict.fromkeys(COUNTS, T.LongType())))
def text_counts(text: pa.Array) -> pa.Array:
    rows = [counts_of(t) for t in text.to_pylist()]
    columns = list(zip(*rows)) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def own_failure(min_words: int = 50, max_repeat_share: int = 50) -> Column:
    """Too few words, or too large a percentage of them in repeated three-word windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))


def rule_failures(symbol_share: int = 10, dup_line_words: int = 20) -> Column:
    """Whether any rule of the host count fails: the document's own rules, many symbols, or repeated lines."""
    return own_failure() | (100 * F.col("n_symbols") > symbol_share * F.col("word_chars")) | (dup_line_words * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(rows: DataFrame, host: str, failed: str, max_rate: float, max_strength: float) -> DataFrame:
    """One row per host: n, failures, its rate shrunk by the beta prior that all hosts give, and the verdict.

    The prior has the mean m and variance v of the hosts' raw rates, thus strength
    m(1 - m)/v - 1, held between 1 and ``max_strength`` (all hosts alike give the latter).
    """
    hosts = rows.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("prior_mean"), F.var_pop(rate).alias("prior_variance"))
    mean, variance = F.col("prior_mean"), F.col("prior_variance")
    strength = F.when(variance > 0, F.least(F.greatest(mean * (1 - mean) / variance - 1, F.lit(1.0)), F.lit(max_strength))).otherwise(max_strength)
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    # the prior is one row of an ungrouped aggregate
    return hosts.crossJoin(F.broadcast(prior)).select(host, "host_docs", "host_failures", shrunk.alias("host_rate")).withColumn("host_failed", F.col("host_rate") > max_rate)


def judge_documents(docs: DataFrame, max_rate: float = 0.5, max_strength: float = 1000.0, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, own verdict and final verdict of every document.

    Returns doc_id, host, COUNTS, base_failed, host_rate and kept (false if base_failed or if the
    host's shrunk failure rate exceeds ``max_rate``). A null text counts as empty and fails; a null
    host is a host of its own; repeated rows are judged, and counted for the host, one by one; other
    columns of ``docs`` are left out; an empty table gives an empty result.

    The texts are read once: the counts are written as a narrow table that both the aggregate and
    the join back read. Host counts combine before the shuffle; the join moves narrow rows only.
    """
    counts = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_counts(F.col(text_col)).alias("c")).select("doc_id", "host", "c.*")
    rows = written(counts.withColumn("base_failed", own_failure()).withColumn("failed", rule_failures()))
    hosts = host_verdicts(rows, "host", "failed", max_rate, max_strength).select(F.col("host").alias("of_host"), "host_rate", "host_failed")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select("doc_id", "host", *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
