"""Host-level quality rules, in DataFrame functions alone.

Each document is measured where it is read. Failures of the base rules are counted by
host, each host's rate is shrunk towards an empirical beta prior over all hosts, and
the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.skew import join_counted
from graphstrata.runtime import materialize

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A host goes when more than this share of its documents is expected to fail.
HOST_LIMIT = 0.5
#: The prior's weight in documents where hosts can't be told apart.
NO_SPREAD = 1e12
_BLANKS = " \t\n\x0b\x0c\r"


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    trimmed = F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_BLANKS))
    out = docs.withColumn("_t", trimmed).withColumn("_words", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", r"[\x20\x09-\x0D]+")))
    return out.withColumn("n_words", F.size("_words").cast("long"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from _words.

    The hash of each window, with its position in the low bits, goes into an array of
    longs that is sorted; neighbours with equal hashes are candidates. These alone are
    compared as text, and the words that the positions left cover are counted.
    """
    hashes = ", ".join(f"get(_wh, i + {k})" for k in range(WINDOW))
    same = "shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_keys, j {}), _bits)"
    return (
        df.withColumn("_bits", F.length(F.bin("n_words")))
        .withColumn("_wh", F.expr(f"case when n_words > {WINDOW} then transform(_words, w -> xxhash64(w)) else cast(array() as array<bigint>) end"))
        .withColumn("_keys", F.expr(f"case when n_words > {WINDOW} then sort_array(transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> shiftleft(xxhash64({hashes}), _bits) | cast(i as bigint))) else cast(array() as array<bigint>) end"))
        .withColumn("_twice", F.expr(f"filter(_keys, (x, j) -> coalesce({same.format('- 1')}, false) or coalesce({same.format('+ 1')}, false))"))
        .withColumn("_text", F.expr(f"array_sort(transform(_twice, x -> named_struct('w', array_join(slice(_words, cast(x & (shiftleft(1L, _bits) - 1) as int) + 1, {WINDOW}), ' '), 'i', cast(x & (shiftleft(1L, _bits) - 1) as int))))"))
        .withColumn("_at", F.expr("array_sort(transform(filter(_text, (x, j) -> coalesce(x.w = get(_text, j - 1).w, false) or coalesce(x.w = get(_text, j + 1).w, false)), x -> x.i))"))
        .withColumn("n_repeat_words", F.expr(f"aggregate(transform(_at, (p, j) -> least({WINDOW}, coalesce(get(_at, j + 1) - p, {WINDOW}))), 0L, (s, x) -> s + x)"))
        .drop("_bits", "_wh", "_keys", "_twice", "_text", "_at")
    )


def _failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text has none of anything."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(raw, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        _with_repeats(_with_words(docs, text))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("base_failed", _failed())
    )
    return out.drop("_words", "_t", "_lines")


def rejected_hosts(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_rejected of the hosts whose shrunk failure rate is above ``limit``.

    The prior is the beta distribution with the mean of the hosts' rates and their
    variance beyond what chance alone gives hosts of so few documents; where none is left
    (one host, or all alike as far as can be told) every host has the mean rate. A null
    host is no host, and never rejected.
    """
    hosts = materialize(measured.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")))
    rate = F.col("k") / F.col("n")
    mean, spread, few = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    mean, spread, few = mean or 0.0, spread or 0.0, few or 0.0
    chance = mean * (1 - mean)
    beyond = spread - chance * few
    weight = max(chance / beyond - 1, 0.0) if beyond > 1e-9 else NO_SPREAD
    shrunk = (F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.filter(shrunk > limit).select(host, F.lit(True).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs``.

    A document is kept unless it fails a base rule or its host is rejected. Repeated
    rows count each; a null id stays null; an empty table gives an empty result; other
    columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("_host"), F.col("text").cast("string"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = materialize(measure(slim).select("_host", *columns))
    both = join_counted(measured, rejected_hosts(measured, "_host", limit), "_host", "doc_id")
    return both.select(*columns, (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they were.

    The text is measured once: rows that pass the base rules are written as they are,
    the others as a failure of their host alone. A null text has no words and fails; a
    null host is never rejected; repeated rows count each; an empty table gives an empty
    result.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col(host).cast("string").alias("_host"), F.col("text"))
    tested = _with_repeats(_with_words(packed, "text")).withColumn("base_failed", _failed()).select("_row", "doc_id", "_host", "base_failed")
    held = materialize(tested.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), F.when(~F.col("base_failed"), F.col("doc_id")).alias("doc_id"), "_host", "base_failed"))
    bad = rejected_hosts(held, "_host", limit)
    return join_counted(held.filter(~F.col("base_failed")), bad, "_host", "doc_id").filter(F.col("host_rejected").isNull()).select("_row.*")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` judged; nulls, repeats and empty tables as in ``judge``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM split WHERE len(ws) > 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM twice),
repeated AS (SELECT rid, CAST(sum(g) AS BIGINT) AS n FROM gaps GROUP BY rid),
base AS (
  SELECT split.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words FROM split LEFT JOIN repeated ON split.rid = repeated.rid),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1 / n) AS f FROM hosts),
weighed AS (SELECT m, CASE WHEN v - m * (1 - m) * f > 1e-9 THEN greatest(m * (1 - m) / (v - m * (1 - m) * f) - 1, 0) ELSE 1e12 END AS s FROM prior),
bad AS (SELECT source FROM hosts, weighed WHERE (k + m * s) / (n + s) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""
