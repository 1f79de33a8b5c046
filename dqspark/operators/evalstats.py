"""Evaluation statistics: run summaries, deltas, bootstrap, trigger rates, dataset quality, votes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.binding import let
from dqspark.session import shared_dir


def half_up(col: Column, digits: int = 4) -> Column:
    return F.round(col, digits)


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, stddev (of the sample; 0 for one value), min and max, rounded to four digits."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), half_up(F.avg(v)).alias("mean"), half_up(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stddev"),
        half_up(F.min(v)).alias("min"), half_up(F.max(v)).alias("max"),
    )


def delta(df: DataFrame, arm: str, value: str, treatment: str, baseline: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the treatment less mean of the baseline, from one aggregation."""
    v = F.col(value).cast("double")
    mean = lambda name: F.avg(F.when(F.col(arm) == name, v))
    return df.groupBy(*(by or [])).agg(half_up(mean(treatment)).alias("treatment"), half_up(mean(baseline)).alias("baseline"), half_up(mean(treatment) - mean(baseline)).alias("delta"))


def percentiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles, a column p<q * 100> for each."""
    return df.groupBy(*by).agg(*[F.percentile(F.col(value).cast("double"), q).alias(f"p{round(q * 100)}") for q in qs])


def bootstrap_delta(df: DataFrame, arm: str, value: str, treatment: str, baseline: str, n: int = 1000, seed: int = 0, level: float = 0.95, key: str = "id") -> DataFrame:
    """Interval of the difference of means under resampling.

    A row's weight in a resample is drawn from Poisson(1) by a hash of its key, the resample
    and the seed (the Poisson bootstrap), so every row is read once, nothing is drawn by
    position, and the result does not depend on partitions.
    """
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), "_draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, total, term = F.lit(8), 0.0, 0.36787944117144233
    bounds = []
    for k in range(8):
        total += term
        bounds.append((total, k))
        term /= k + 1
    for bound, k in reversed(bounds):
        weight = F.when(F.col("_u") < bound, k).otherwise(weight)
    draws = df.where(F.col(arm).isin(treatment, baseline)).select(key, arm, F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_draw"))
    drawn = draws.withColumn("_u", unit).withColumn("_w", weight)
    mean = lambda name: F.try_divide(F.sum(F.when(F.col(arm) == name, F.col("_v") * F.col("_w"))), F.sum(F.when(F.col(arm) == name, F.col("_w"))))
    per_draw = drawn.groupBy("_draw").agg((mean(treatment) - mean(baseline)).alias("_d"))
    return per_draw.agg(
        half_up(F.avg("_d")).alias("delta_mean"),
        half_up(F.percentile("_d", (1 - level) / 2)).alias("ci_low"),
        half_up(F.percentile("_d", (1 + level) / 2)).alias("ci_high"),
        F.count("_d").alias("n_resamples"),
    )


def trigger_rates(runs: DataFrame, query: str, triggered: str, expected: str, threshold: float = 0.5) -> DataFrame:
    """Per query: runs, rate, and whether the rate lies on the expected side of the threshold."""
    rate = F.avg(F.col(triggered).cast("double"))
    out = runs.groupBy(query).agg(F.count(F.lit(1)).alias("runs"), half_up(rate).alias("rate"), F.bool_and(expected).alias("expected"))
    return out.withColumn("pass", F.when(F.col("expected"), F.col("rate") >= threshold).otherwise(F.col("rate") < threshold))


#: Fixed values of the dataset score: cases wanted, weights, and the number of cases up to which all pairs count.
TARGET_CASES, PAIR_CAP = 5, 100
WEIGHTS = {"schema": 0.30, "forbidden": 0.25, "uniqueness": 0.20, "diversity": 0.15, "count": 0.10}


def bigrams(text: Column) -> Column:
    """The set of word pairs; of a single word, the word."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.concat(F.get(w, k - 1), F.lit(" "), F.get(w, k)))
    return F.array_distinct(let(words, lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w)))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds _place, from 0 in an order, without bringing all rows to one task: places inside ranges, and the rows before each range."""
    shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()  # the ranges must stay as they are
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    bases = totals.select("_range", before.alias("_base"))
    return ranged.join(F.broadcast(bases), "_range").withColumn("_place", F.col("_base") + inside).drop("_range", "_base")


def diversity(df: DataFrame, order: str, text: str) -> DataFrame:
    """1 less the mean Jaccard similarity of bigram sets: over all pairs of up to PAIR_CAP texts, else around the ring in order."""
    grams = df.where(F.trim(text) != "").select(F.col(order).alias("_o"), bigrams(F.col(text)).alias("_g"))
    n = grams.count()
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    if n < 2:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("diversity"))
    if n <= PAIR_CAP:
        a, b = grams.alias("a"), grams.alias("b")
        pairs = a.join(b, F.col("a._o") < F.col("b._o")).select(share(F.col("a._g"), F.col("b._g")).alias("_s"))
    else:
        ring = numbered(grams, ["_o"])
        after = ring.select(F.pmod(F.col("_place") - 1, F.lit(n)).alias("_place"), F.col("_g").alias("_next"))
        pairs = ring.join(after, "_place").select(share(F.col("_g"), F.col("_next")).alias("_s"))
    return pairs.agg(half_up(1 - F.avg("_s")).alias("diversity"))


def dataset_quality(items: DataFrame, order: str = "id") -> DataFrame:
    """Score and components of evaluation cases: id, prompt, should_trigger (boolean, null), n_expectations, n_forbidden."""
    prompt = F.trim(F.coalesce("prompt", F.lit("")))
    expects = (F.coalesce("n_expectations", F.lit(0)) > 0) | F.col("should_trigger").isNotNull()
    n = F.count(F.lit(1))
    pos, neg = F.count_if(F.col("should_trigger")), F.count_if(~F.col("should_trigger"))
    styled = F.count("should_trigger") > 0
    trigger = F.when((pos > 0) & (neg > 0), 1.0).when((pos > 0) | (neg > 0), 0.5).otherwise(0.0)
    one = items.agg(
        n.alias("n"),
        half_up(F.count_if(F.col("id").isNotNull() & (prompt != "") & expects) / n).alias("schema"),
        half_up(F.when(styled, trigger).otherwise(F.count_if(F.col("n_forbidden") > 0) / n)).alias("forbidden"),
        half_up(F.count_distinct(F.when(prompt != "", F.lower(prompt))) / n).alias("uniqueness"),
        half_up(F.least(F.lit(1.0), n / TARGET_CASES)).alias("count"),
    )
    both = one.join(F.broadcast(diversity(items.withColumn("_p", prompt), order, "_p")))
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return both.withColumn("score", half_up(score))


def votes(judgements: DataFrame, pair: str, winner: str, swapped: str) -> DataFrame:
    """A candidate wins a pair only if it wins in both orders; else the pair is a tie.

    winner: "first" or "second" as shown; swapped: whether the candidate was shown first.
    """
    for_candidate = F.when(F.col(swapped), F.col(winner) == "first").otherwise(F.col(winner) == "second")
    wins = F.sum(for_candidate.cast("int"))
    n = F.count(F.lit(1))
    return judgements.groupBy(pair).agg(wins.alias("candidate_votes"), (n - wins).alias("champion_votes")).withColumn(
        "decision", F.when(F.col("candidate_votes") > F.col("champion_votes"), "candidate").when(F.col("candidate_votes") < F.col("champion_votes"), "champion").otherwise("tie")
    )


def stratified_split(df: DataFrame, key: str, stratum: str, holdout: float, seed: int = 0) -> DataFrame:
    """Adds split: of each stratum the floor of its share, at least one, is test, by the order of a hash of the key.

    Counts of hash prefixes tell where in the order a stratum's limit falls; only the rows of
    that one prefix are ranked, so no stratum is sorted as a whole.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_bin", F.substring("_hash", 1, 3))
    bins = hashed.groupBy(stratum, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    whole, before = Window.partitionBy(stratum), Window.partitionBy(stratum).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.select(
        stratum, "_bin", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) * holdout)).alias("_want")
    )
    # a row for each stratum; a stratum has 4096 bins at most
    limits = placed.where("_before < _want AND _before + _n >= _want").select(F.col(stratum).alias("_s"), F.col("_bin").alias("_cut"), (F.col("_want") - F.col("_before")).alias("_left"))
    marked = hashed.join(limits, hashed[stratum].eqNullSafe(F.col("_s")))
    at = marked.where(F.col("_bin") == F.col("_cut")).withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_hash", key)))
    at = at.withColumn("split", F.when(F.col("_rank") <= F.col("_left"), "test").otherwise("train"))
    rest = marked.where(F.col("_bin") != F.col("_cut")).withColumn("split", F.when(F.col("_bin") < F.col("_cut"), "test").otherwise("train"))
    return rest.select(*df.columns, "split").unionAll(at.select(*df.columns, "split"))


def differing(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows that only one of two runs has, counted with their repeats: the columns and side."""
    columns = [c for c in a.columns if c not in ignore]
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before, with their repeats, that after no longer has."""
    return before.exceptAll(after)


def preserved(before: DataFrame, after: DataFrame) -> bool:
    """Whether every row of before is still there."""
    return lost_rows(before, after).isEmpty()
