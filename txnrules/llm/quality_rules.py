"""Document rules, and verdicts on hosts from their documents' rule failures. DataFrame functions only.

Every document gets its own rule counts from array functions over its whole text, in time n log n of its words.
Failures are then added up by host. A host's raw failure rate says little where it has few documents, so rates
are shrunk with a beta prior fitted to all hosts by moments: prior mean m = all failures / all documents; the
variance of the hosts' rates, each host weighted by its documents, less the part that sampling explains, gives the
prior's strength. A host whose shrunk rate is above HOST_LIMIT is refused, and so are all its documents.

The counts are written once as a narrow table (no text). Hosts come from a partial aggregation, so a host with a
third of all rows costs one row per task. The join back replicates each verdict over SALTS salts and salts the
documents by id, so that a hot host is spread without knowing which one it is; small host tables are broadcast
by Spark where it has measured them.

Nulls: a null text has no words and fails; a null host is a host of its own; a null id is kept. Empty and blank
texts fail the word rule. Repeated rows count as often as they occur. Columns other than the three named are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import cut, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
SALTS = 16
SPACE = r"[ \t\n\x0B\f\r]"


def rule_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cleaned = docs.select(
        F.col(key).alias("key"),
        F.col(host).alias("host"),
        F.filter(F.split(whole, SPACE + "+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
    )
    # A one-element transform binds an array once; the functions inside then index into it.
    windows = "transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i))"
    repeated = "filter(s, (x, k) -> (k > 0 AND x.g = s[k - 1].g) OR (k < size(s) - 1 AND x.g = s[k + 1].g))"
    covered = "aggregate(array_sort(transform(r, x -> x.i)), named_struct('last', -3, 'n', 0), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)"
    n_repeat = f"""
        transform(array(words), w ->
            IF(size(w) < 4, 0,
                transform(array(array_sort({windows})), s ->
                    transform(array({repeated}), r -> {covered})[0])[0]))[0]"""
    counted = cleaned.select(
        "key",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(n_repeat).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_failed."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    overall = hosts.agg(
        F.sum("n_docs").alias("n"), F.count("*").alias("k"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * p * p).alias("spp")
    ).select("n", "k", (F.col("f") / F.col("n")).alias("m"), (F.col("spp") / F.col("n")).alias("pp"))
    # Of the weighted variance of the rates, (k - 1) / n * m * (1 - m) is what binomial sampling alone explains.
    prior = overall.select(
        "m",
        F.expr(f"""
            CASE WHEN m <= 0 OR m >= 1 THEN {MAX_STRENGTH}D
                 WHEN pp - m * m - (k - 1) / n * m * (1 - m) <= 0 THEN {MAX_STRENGTH}D
                 ELSE least({MAX_STRENGTH}D, greatest({MIN_STRENGTH}D, m * (1 - m) / (pp - m * m - (k - 1) / n * m * (1 - m)) - 1)) END""").alias("strength"),
    )
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > limit).alias("host_failed"))


def judge(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """counts with host_failed and kept."""
    salted = hosts.select(F.col("host").alias("of_host"), "host_failed", "shrunk_rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    docs = counts.withColumn("salt", F.pmod(F.xxhash64("key", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = docs.join(salted, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left")
    return joined.drop("salt", "of_salt", "of_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op10_host_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict of rules and host."""
    counts = cut(rule_counts(table(spark, sf_dir, "documents")))
    return judge(counts, host_verdicts(counts)).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host").alias("source"), "host_failed"
    )


OP10_SQL = f"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM documents),
g AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
k AS (
    SELECT w.doc_id, w.source, len(ws) AS n_words,
           length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM k),
h AS (SELECT source, count(*) AS n_docs, sum(base_failed::INT) AS n_failed FROM f GROUP BY source),
o AS (SELECT sum(n_docs) AS n, count(*) AS k, sum(n_failed) / sum(n_docs) AS m,
             sum(n_docs * (n_failed / n_docs) * (n_failed / n_docs)) / sum(n_docs) AS pp FROM h),
p AS (SELECT m, CASE WHEN m <= 0 OR m >= 1 OR pp - m * m - (k - 1) / n * m * (1 - m) <= 0 THEN {MAX_STRENGTH}
             ELSE least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, m * (1 - m) / (pp - m * m - (k - 1) / n * m * (1 - m)) - 1)) END AS strength FROM o),
v AS (SELECT source, (n_failed + m * strength) / (n_docs + strength) > {HOST_LIMIT} AS host_failed FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, f.source AS source, host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
