"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps one bit for each rule that failed and the measurements behind it, in a table of
its own. Policies are versioned masks over these bits, so that a new policy, a filter on its verdict, or an ablation reads the stored bits and never
the texts. (A filter on a ledger that isn't stored would be pushed below the measures and evaluate them anew in every rule.)

Only DataFrame expressions: each document is measured in its own row, with no shuffle.

Defined cases: a null text counts as empty (no words, every measurement 0, fails `few_words`); an empty table gives an empty ledger;
repeated rows stay repeated; other columns of the input are carried on by `filter_documents` and left out by `ledger`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, as_struct, sql_text, written

SYMBOLS = "#*$%&|<>"

#: (name, SQL condition over the measurements). Bit i of fail_bits is rule i; rules are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Policy:
    """A document that fails one of the rules is rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(x) for x in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words")),
}


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document with the columns keep and MEASURES.

    Words in repeated windows: each 3-word window is hashed with its position, the sorted pairs show which windows have an equal
    neighbour, and the union of the marked windows' positions is counted. All of it happens inside the row.
    """
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.select(*keep, "__t", F.expr(f"regexp_extract_all(__t, {sql_text(WORD)}, 0)").alias("__w"))
    d = d.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(f"filter(split(__t, '\\n', -1), x -> x rlike {sql_text('[^ \\t\\n\\x0b\\f\\r]')})").alias("__lines"),
        F.expr(
            "if(size(__w) < 3, array(), sort_array(transform(sequence(0, size(__w) - 3), i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) as h, i as i))))"
        ).alias("__g"),
    )
    d = d.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("array_sort(transform(filter(__g, (x, j) -> coalesce(get(__g, j - 1).h = x.h, false) or coalesce(get(__g, j + 1).h = x.h, false)), x -> x.i))").alias("__at"),
    )
    repeat = F.expr("aggregate(__at, named_struct('n', 0L, 'last', -3), (a, v) -> named_struct('n', a.n + least(3, v - a.last), 'last', v), a -> a.n)")
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "n_lines")


def with_bits(measures: DataFrame) -> DataFrame:
    """Adds fail_bits: each rule of RULES once."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measures.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, MEASURES and fail_bits of each document."""
    return with_bits(measured(docs, text, keep))


def stored_ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger as a table in the shared folder: texts are read once, whatever policies, filters and ablations are asked for after."""
    return written(ledger(docs, text, keep), "quality-ledger")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept and policy to ledger entries; texts aren't read."""
    return entries.withColumns({"kept": passes(policy), "policy": F.lit(policy.version)})


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, how many only it, and how many would be kept without it.

    Entries are first counted by fail_bits, at most 2 to the number of rules rows, so that the shuffle doesn't grow with the documents.
    """
    names = [name for name, _ in RULES]
    by_bits = entries.groupBy("fail_bits").count()
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in policy.rules)))
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return (
        by_bits.select("count", failed.alias("failed"), rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
        )
    )


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    row = docs.select(as_struct(docs), F.col(text).alias("__text"))
    # The one-element explode keeps the filter above the measures: pushed below, it would evaluate them anew in every rule.
    measures = measured(row, "__text", ("__row",)).select("__row", F.explode(F.array(F.struct(*MEASURES))).alias("__m")).select("__row", "__m.*")
    kept = with_bits(measures).filter(passes(policy))
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the stored ledger of all documents, with the verdicts of the base policy and of v1 read from its bits."""
    entries = apply_policy(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v1"])
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(POLICIES["base"])).alias("base_failed"), "kept", "fail_bits")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM (SELECT k, i FROM m WHERE c >= 2), (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN l USING (k) LEFT JOIN p USING (k)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
