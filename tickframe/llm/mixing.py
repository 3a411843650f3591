"""Mixing sources to target weights by nested hash thresholds.

Each document has a size (its words) and a 48-bit hash of its id and text. A source with target T and size Z takes floor(T / Z) whole
copies of itself and, of one copy more, the documents whose hash lies below a threshold. The threshold is found with histograms:
sizes are summed by source and the top 8 bits of the hash, prefix sums show the bucket in which the budget ends, and only this
bucket is summed again by its next 8 bits, and so on. The documents are never sorted; choosing them is a comparison with a number.

Only DataFrame expressions. Skew: histograms are pre-aggregated in each task, so a hot source adds at most 256 rows a task and its prefix sums see 256 rows; the
thresholds (one row a source) are joined by broadcast only after a count shows at most MOST_BROADCAST of them, else by a salted join.

Defined cases: null source is a source of its own, the last; null text has size 0; sources without words have target 0 and take
nothing; an empty table gives an empty result; rows that repeat an id and text share a hash and are taken alike; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_struct, released, rows_bounded, scratch, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BITS = 8
LEVELS = 6
MOST_BROADCAST = 10_000
SALTS = 64


def row_hash(doc_id: Column, text: Column, seed: str = "mix-1") -> Column:
    """48 bits of an MD5: the same in every run, on every engine."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target for each source of sized(source, size).

    Weights repeat over the sources in code-point order, null last. Capping at cap times the size and resharing the excess by weight
    ends at target = min(cap * size, weight * level) with one common level: with the sources in order of cap * size / weight, the first
    k are capped, for the least k whose level leaves the next source uncapped. The windows below see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), turn + 1))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("limit", F.lit(float(cap)) * F.col("source_size") / F.col("w")).withColumns(
        {
            "budget": F.lit(share) * F.sum("source_size").over(everything),
            "capped_before": F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0)),
            "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    fits = (F.col("budget") - F.col("capped_before")) / F.col("w_left") <= F.col("limit")
    per = per.withColumn("level", F.min(F.when(fits, F.struct("limit", F.col("source").alias("s"), "capped_before", "w_left"))).over(everything))
    level = (F.col("budget") - F.col("level.capped_before")) / F.col("level.w_left")
    full = F.col("source_size") * F.lit(float(cap))
    target = F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("w") * level))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, copies, below, source_size, target: each document of the source is taken copies times, and once more if its hash is below."""
    some = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("copies", F.floor(some).cast("long"))
    plan = plan.withColumns({"left": F.col("target") - F.col("copies") * F.col("source_size"), "low": F.lit(0).cast("long")})
    plan = written_plan = written(plan, "mix-targets")
    inside = sized
    for level in range(LEVELS):
        span = 1 << (BITS * (LEVELS - 1 - level))
        edge = plan.select(F.col("source").alias("s"), "low")
        if level:  # only what lies in the boundary bucket goes on
            inner = with_plan(inside, edge, "source", "s").filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span * (1 << BITS)))
            inner = written(inner.drop("low"), f"mix-inside{level}")
            if level > 1:
                released(inside)
            inside = inner
        hist = inside.groupBy("source", F.floor(F.col("h") / span).cast("long").alias("b")).agg(F.sum("size").alias("size"))
        # Histograms have at most 256 rows a source; the window needs a source's buckets together and in order.
        running = F.sum("size").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("upto", running)
        hist = hist.join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        if level < LEVELS - 1:
            # The bucket in which the budget ends is left for the next level.
            done = F.col("upto") <= F.col("left")
        else:
            # The last document is taken if that brings the source nearer to its target.
            done = F.col("upto") - F.col("size") / 2 <= F.col("left")
        step = hist.groupBy("s").agg(F.max(F.when(done, F.col("b"))).alias("b"), F.max(F.when(done, F.col("upto"))).alias("used"))
        # With no bucket done, the next level is inside the first that there is.
        first = hist.filter(~done).groupBy("s").agg(F.min("b").alias("edge"))
        step = step.join(first.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1")
        plan = plan.join(step, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        # A source without rows in its bucket has met its budget before.
        low = F.coalesce(F.col("edge") * span, (F.col("b") + 1) * span, F.col("low"))
        plan = plan.withColumns({"left": F.col("left") - F.coalesce("used", F.lit(0)), "low": low}).drop("b", "used", "edge")
        before, plan = written_plan, written(plan, f"mix-level{level}")
        written_plan = plan
        released(before)
    released(inside)
    return plan.select("source", "copies", F.when(F.col("target") > 0, F.col("low")).otherwise(0).alias("below"), "source_size", "target")


def with_plan(rows: DataFrame, plan: DataFrame, left: str, right: str) -> DataFrame:
    """rows joined with its source's row of plan: by broadcast if plan is counted to be small, else with hot sources dealt over SALTS."""
    if rows_bounded(plan, MOST_BROADCAST):
        return rows.join(F.broadcast(plan), F.col(left).eqNullSafe(F.col(right))).drop(right)
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__s", (F.col("h") % SALTS).cast("int"))
    return rows.join(salted, F.col(left).eqNullSafe(F.col(right)) & (F.col("__s") == F.col("__salt"))).drop(right, "__s", "__salt")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sized rows: doc_id, source, size, h; thresholds by source). Texts are read once; the narrow rows are written."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    sized = written(narrow, "mix-sized")
    return sized, thresholds(sized, source_targets(sized, weights, share, cap))


def taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with source_size, target and times: how often the mix takes the document."""
    p = plan.withColumnRenamed("source", "__source")
    once_more = (F.col("h") < F.col("below")).cast("long")
    return with_plan(sized, p, "source", "__source").withColumn("times", F.col("copies") + once_more)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mixed documents with the columns they came with; a document taken twice is there twice.

    Documents meet the plan by their source and the hash computed anew, so texts aren't shuffled.
    """
    with scratch(docs.sparkSession):
        plan = written(mix_plan(docs, weights, share, cap)[1], "mix-plan", result=True)
    rows = docs.select(as_struct(docs), F.col("source").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    chosen = taken(rows, plan).filter(F.col("times") > 0)
    again = chosen.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times"), F.lit(cap).cast("long")))))
    return again.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the mix of all documents by weights 3, 1, 2 at 150% of all words."""
    sized, plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    times = F.least(F.col("times"), F.lit(CAP).cast("long"))
    return taken(sized, plan).select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, 2.0::DOUBLE * z / w AS lim, 1.5::DOUBLE * sum(z) OVER () AS budget, sum(w) OVER () AS tw FROM w),
b AS (
  SELECT *, coalesce(2 * sum(z) OVER o, 0)::DOUBLE AS cb, (tw - coalesce(sum(w) OVER o, 0))::DOUBLE AS wl FROM l
  WINDOW o AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT (budget - cb) / wl AS level FROM b WHERE (budget - cb) / wl <= lim ORDER BY lim, source NULLS LAST LIMIT 1),
t AS (SELECT source, z, CASE WHEN (SELECT level FROM v) IS NULL THEN z * 2.0::DOUBLE ELSE least(z * 2.0::DOUBLE, w * (SELECT level FROM v)) END AS target FROM b),
u AS (SELECT source, z, target, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END::BIGINT AS copies FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
k AS (
  SELECT r.source, r.h FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
  WHERE r.upto - r.size / 2.0 <= u.target - u.copies * u.z)
SELECT d.doc_id, d.size, u.z AS source_size, u.target,
  (d.size * least(2, u.copies + CASE WHEN k.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
