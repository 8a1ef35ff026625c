"""Host-level quality rules.

Every document is measured by text rules; rule failures are summed by host (here: ``source``); each host's failure rate is
shrunk towards the rate of all hosts with an empirical beta prior; and the host's verdict is joined back to its documents.

Defined cases: a null or empty text has no words and so fails the base rule; a null host is no host (only the text's own
rules decide); repeated rows are measured and counted one by one; an empty table gives an empty result; other columns of
the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import keyed, materialize, read_table, rolling, small_batches, text_bytes

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Further rules, which count against the host only: percent of word characters that are symbols, of lines that repeat, and the mean word length.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MEAN_WORD = 10, 30, (2, 15)
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

_SYMBOLS = b"#*$%&|<>"
_NOT_CODE_POINTS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])

SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))])


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text holds twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    h = rolling(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), window)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), len(text.translate(None, _NOT_CODE_POINTS)), symbols, lines, dup, repeat_words(words)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(x) for x in batch.column(2).to_pylist()]
        cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], schema=SCHEMA)


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row of rule measures per document, with base_failed and fails (any rule failed)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_bytes(text_col).alias("text"))
    out = rows.mapInArrow(_measure_batches, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lo, hi = MEAN_WORD
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    more = more | (F.col("word_chars") < lo * F.col("n_words")) | (F.col("word_chars") > hi * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("fails", F.col("base_failed") | more)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate: (failed + a) / (docs + a + b), the prior a, b fitted to all hosts by moments.

    The strength a + b follows from the spread of the hosts' rates beyond binomial noise, held within 1 and 10,000.
    """
    hosts = measured.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("fails").cast("long")).alias("n_failed"))
    hosts = materialize(hosts)
    all_docs = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k")).first()
    if not all_docs["n"]:
        return hosts.withColumn("shrunk_rate", F.lit(0.0))
    mean = all_docs["f"] / all_docs["n"]
    seen = hosts.agg(F.sum(F.pow(F.col("n_failed") - mean * F.col("n_docs"), 2) / F.col("n_docs")).alias("q"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2")).first()
    noise = mean * (1 - mean)
    scale = all_docs["n"] - seen["n2"] / all_docs["n"]
    spread = (seen["q"] - (all_docs["k"] - 1) * noise) / scale if scale > 0 else 0.0
    strength = min(1e4, max(1.0, noise / spread - 1)) if spread > 0 else 1e4
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def judge(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """measured (a table that can be read twice) with host_rate and kept."""
    rates = host_rates(measured).select("host", F.col("shrunk_rate").alias("host_rate"))
    return measured.join(rates, "host", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate))


def good_documents(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without those that judge() rejects. Texts are measured twice rather than shuffled."""

    @F.pandas_udf("boolean")
    def failed(texts: pd.Series) -> pd.Series:
        found = [measure(bytes(x)) for x in texts]
        return pd.Series([m[0] < MIN_WORDS or 100 * m[5] > MAX_REPEAT_PERCENT * m[0] for m in found], dtype=bool)

    bad = materialize(host_rates(measures(docs)).filter(F.col("shrunk_rate") > max_host_rate).select(F.col("host").alias("bad_host")))
    rows = keyed(docs)
    rows = rows.join(bad, F.col("row.source").cast("string") == F.col("bad_host"), "left_anti")
    return rows.filter(~failed(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measures(read_table(spark, sf_dir, "documents")))
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same measures and verdicts in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) > 8),
k AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM k) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS s FROM d),
dup AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT s) AS dups FROM l WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, host, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_lines,
        coalesce(dup.dups, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
x AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS fails FROM f),
h AS (SELECT host, count(*) AS n, sum(fails::INT) AS f FROM x WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS k, sum(n * n) AS n2 FROM h),
q AS (SELECT mean, mean * (1 - mean) AS noise,
        ((SELECT sum((f - p.mean * h.n) * (f - p.mean * h.n) / h.n) FROM h) - (k - 1) * mean * (1 - mean)) / nullif(n - n2 / n, 0) AS spread FROM p),
s AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e4, greatest(1.0, noise / spread - 1)) ELSE 1e4 END AS strength FROM q),
r AS (SELECT host, (f + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM x LEFT JOIN r USING (host)
"""
