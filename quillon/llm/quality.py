"""Host-level quality rules in DataFrame functions alone.

Each document is judged by its own rules; failures are counted by host (the ``source`` column), each host's rate is shrunk
towards the corpus by a beta prior that is fitted to all hosts by moments, and the host's verdict is joined back.  A host goes
if its posterior lies, by two standard deviations, above the rate whose odds are MAX_ODDS times those of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, sized, staged, words

MIN_WORDS = 10
#: Largest share, in hundredths, of words in repeated windows of five words.
MAX_REPEATED = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Odds of failure, as a multiple of the corpus's, above which a host goes; standard deviations that make it certain.
MAX_ODDS, CERTAIN = 4.0, 2.0
#: Hosts whose verdicts are broadcast; more are joined by sort-merge.
BROADCAST_HOSTS = 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    n_repeat_words counts the words that lie in a window of five words which occurs twice or more in the text.  Equal windows
    are found by sorting each text's window hashes with their places; texts without equal windows skip that.  Columns with the
    added names are replaced; any other name may occur.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in (keep or docs.columns) if c not in MEASURES]
    ws, lines, symbols, h, p, q, at = (fresh(docs, c) for c in ("ws", "lines", "symbols", "h", "p", "q", "at"))
    lined = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, words(F.col(text)).alias(ws), lined.alias(lines), (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias(symbols))
    w = F.col(ws)
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *keep,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.col(symbols).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        hashes.alias(h),
    )
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn(p, F.when(F.size(h) > F.size(F.array_distinct(h)), placed))
    # each window beside the one before it in the order of hashes; both of an equal pair are repeated
    pc = F.col(p)
    step = step.withColumn(q, F.zip_with(pc, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pc), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    pairs = F.filter(q, lambda z: z["x"]["h"] == z["y"]["h"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["x"]["i"], z["y"]["i"])))))
    step = step.withColumn(at, places)
    ac = F.col(at)
    # the union of the windows: each adds five words, or as many as lie before the next one
    gaps = F.zip_with(ac, F.slice(ac, F.lit(2), F.greatest(F.size(ac), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)
    step = step.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return step.select(*keep, *MEASURES[:-1], failed.alias("base_failed"))


def host_rates(judged: DataFrame, host: str = "source", max_odds: float = MAX_ODDS, certain: float = CERTAIN) -> DataFrame:
    """``host, n_docs, n_failed, rate, bad``: each host's failure rate, shrunk by the beta prior of all hosts, and the verdict.

    The prior's mean is the corpus rate and its weight follows from how much host rates vary beyond chance (moments of all
    hosts, between 1 and 10,000 documents).  A host is bad if its posterior mean less ``certain`` posterior standard deviations
    is above the rate with ``max_odds`` times the corpus's odds.  Rows without a host form one host.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    part = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * part * part).alias("sq"), F.count("*").alias("k"))
    mean = F.col("f") / F.col("n")
    chance = mean * (1 - mean)
    between = F.col("sq") / F.col("n") - mean * mean
    # weighted variance of host rates = chance * (share left to the prior + hosts / rows)
    excess = F.greatest(between - chance * F.col("k") / F.col("n"), F.lit(0.0))
    weight = F.when(excess > 0, chance / excess - 1).otherwise(F.lit(10000.0))
    prior = total.select(mean.alias("mean"), F.least(F.greatest(weight, F.lit(1.0)), F.lit(10000.0)).alias("weight"))
    size = F.col("n_docs") + F.col("weight")
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / size
    low = rate - certain * F.sqrt(rate * (1 - rate) / (size + 1))
    limit = max_odds * F.col("mean") / (1 - F.col("mean") + max_odds * F.col("mean"))
    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), (low > limit).alias("bad"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", max_odds: float = MAX_ODDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (all by default) with its measures, base_failed, host_rate and kept.

    kept is false for documents that fail the rules and for all documents of a bad host (``host_rates``).  Null and empty texts
    have no words and fail; a very long text is measured whole, in a row of its own; repeated rows count each, and ties don't
    arise; an empty table gives an empty table; rows without a host are one host.  Columns with the added names are replaced;
    working columns take names that ``docs`` doesn't have.  What is written between the steps holds ``keep``, not the text.
    """
    added = (*MEASURES, "host_rate", "kept")
    keep = [c for c in (keep or docs.columns) if c not in added]
    own, of, rate, bad = (fresh(docs, c) for c in ("own_host", "of_host", "of_rate", "of_bad"))
    rows = staged(measured(docs.select(*docs.columns, F.col(host).alias(own)), text, [*keep, own]), "measured")
    verdicts = host_rates(rows, own, max_odds).select(F.col("host").alias(of), F.col("rate").alias(rate), F.col("bad").alias(bad))
    verdicts = staged(verdicts, "hosts")
    out = rows.join(sized(verdicts, BROADCAST_HOSTS), F.col(own).eqNullSafe(F.col(of)))
    return out.select(*keep, *MEASURES, F.col(rate).alias("host_rate"), (~F.col("base_failed") & ~F.col(bad)).alias("kept"))


def op10_quality_rules(spark, sf_dir):
    out = judged(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM win WHERE n > 1) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS f FROM j GROUP BY source
), t AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS sq, count(*) AS k FROM h
), p AS (
  SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * k / n > 0
    THEN least(greatest(mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * k / n) - 1, 1.0), 10000.0) ELSE 10000.0 END AS w FROM t
), r AS (
  SELECT source, (f + mean * w) / (n + w) AS rate, n + w AS size, 4.0 * mean / (1 - mean + 4.0 * mean) AS most FROM h, p
), v AS (
  SELECT source, rate - 2.0 * sqrt(rate * (1 - rate) / (size + 1)) > most AS bad FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
