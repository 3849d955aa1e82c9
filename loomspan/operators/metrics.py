"""Evaluation metrics: errors, regressions, percentiles by nearest rank, confusion, token overlap.

Percentiles come from a histogram of whole-number errors (as many rows as distinct
errors), not from a list of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import word_tokens


def micro_macro(df: DataFrame, group: str, score: Column) -> DataFrame:
    """One row: mean of the scores, and mean of the groups' means."""
    groups = df.groupBy(group).agg(F.sum(score).alias("s"), F.count(score).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("micro"), F.avg(F.col("s") / F.col("n")).alias("macro"))


def steps(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """df and ``before``: the value of the row before it in its group."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def error_histogram(df: DataFrame, group: str, error: Column) -> DataFrame:
    """(group, error, n) of whole-number errors; nulls are left out."""
    return df.select(group, error.cast("long").alias("error")).where("error is not null").groupBy(group, "error").agg(F.count(F.lit(1)).alias("n"))


def error_summary(df: DataFrame, group: str, signed: Column) -> DataFrame:
    """Count, mean, median (of the two middles), nearest-rank p90, bias and shares above 10 and 20 of |signed| by group."""
    own = error_histogram(df, group, signed).withColumn("e", F.abs("error"))
    hist = own.groupBy(group, "e").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("error")).alias("signed"))
    upto = Window.partitionBy(group).orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    placed = hist.withColumns({"cum": F.sum("n").over(upto), "all": F.sum("n").over(every)})

    def rank(need: Column) -> Column:
        return F.min(F.when(F.col("cum") >= need, F.col("e")))

    above = lambda most: F.sum(F.when(F.col("e") > most, F.col("n")).otherwise(0)) / F.sum("n")
    return placed.groupBy(group).agg(
        F.sum("n").alias("n_errors"),
        F.round(F.sum(F.col("n") * F.col("e")) / F.sum("n"), 6).alias("mae"),
        ((rank(F.expr("(all + 1) div 2")) + rank(F.expr("all div 2 + 1"))) / 2).alias("median_error"),
        rank(F.expr("(all * 9 + 9) div 10")).alias("p90"),
        F.round(F.sum("signed") / F.sum("n"), 6).alias("bias"),
        F.round(above(10), 6).alias("over_10"),
        F.round(above(20), 6).alias("over_20"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: the four counts, and rates that are null where nothing divides them."""
    n = df.select(predicted.alias("p"), actual.alias("a")).agg(
        F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"), F.count_if(~F.col("p") & ~F.col("a")).alias("tn")
    )
    rate = lambda a, b: F.round(F.try_divide(F.expr(a), F.expr(b)), 6)
    return n.withColumns({"precision": rate("tp", "tp + fp"), "recall": rate("tp", "tp + fn"), "f1": rate("2 * tp", "2 * tp + fp + fn"), "specificity": rate("tn", "tn + fp"), "balanced": F.round((F.try_divide("tp", F.expr("tp + fn")) + F.try_divide("tn", F.expr("tn + fp"))) / 2, 6)})


def token_f1(pairs: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """(key, f1): overlap of token multisets; 1 if both texts have none, 0 if one has."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), word_tokens(F.col(c)).alias("tokens")) for i, c in enumerate((left, right))))
    rows = pairs.select(*key, F.explode(sides).alias("s")).select(*key, "s.side", F.explode_outer("s.tokens").alias("token"))
    n = rows.groupBy(*key, "token").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    real = F.col("token").isNotNull()
    sums = n.groupBy(*key).agg(*(F.sum(F.when(real, c).otherwise(0)).alias(name) for name, c in (("common", F.least("a", "b")), ("na", F.col("a")), ("nb", F.col("b")))))
    f1 = F.when((F.col("na") == 0) & (F.col("nb") == 0), 1.0).otherwise(2.0 * F.col("common") / (F.col("na") + F.col("nb")))
    return sums.select(*key, F.round(f1, 6).alias("f1"))


def paired_deltas(df: DataFrame, key: list[str], context: str, left: str, right: str, value: str, order: list[str]) -> DataFrame:
    """(key, delta): value in context left minus that in right, where a key has both; of several rows the last by order counts."""
    last = lambda which: F.max_by(value, F.when(F.col(context) == which, F.struct(*order)))
    both = df.where(F.col(context).isin(left, right)).groupBy(*key).agg(last(left).alias("l"), last(right).alias("r"))
    return both.where("l is not null and r is not null").select(*key, (F.col("l") - F.col("r")).alias("delta"))


def decision_rates(df: DataFrame, group: list[str], predicted: Column, actual: Column, valid: Column) -> DataFrame:
    """By group, counts of a yes-or-no decision as predicted, and the share of right ones where an invalid row counts as wrong."""
    own = df.select(*group, predicted.alias("p"), actual.alias("a"), valid.alias("v"))
    strict = F.when(F.col("v"), F.col("p")).otherwise(~F.col("a"))
    counts = {"tp": F.col("p") & F.col("a"), "fp": F.col("p") & ~F.col("a"), "fn": ~F.col("p") & F.col("a"), "tn": ~F.col("p") & ~F.col("a")}
    return own.groupBy(*group).agg(*(F.count_if(c).alias(k) for k, c in counts.items()), F.round(F.avg((strict == F.col("a")).cast("int")), 6).alias("strict_accuracy"))


def first_offsets(df: DataFrame, episode: list[str], frame: str, said: Column, true: Column) -> DataFrame:
    """(episode, offset): the first frame where a decision is said, less the last where it is true; null where it is never said. Episodes where it is never true are left out."""
    own = df.groupBy(*episode).agg(F.min(F.when(said, F.col(frame))).alias("first_said"), F.max(F.when(true, F.col(frame))).alias("last_true"))
    return own.where("last_true is not null").select(*episode, (F.col("first_said") - F.col("last_true")).alias("offset"))


def terminal_rates(df: DataFrame, group: list[str], predicted: Column, actual: Column) -> DataFrame:
    """(group, recall, premature, missed): shares of the rows that are, or are not, terminal; 0 where there are none."""
    n = df.select(*group, predicted.alias("p"), actual.alias("a")).groupBy(*group).agg(F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"), F.count_if(~F.col("p") & ~F.col("a")).alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, F.expr(b)), F.lit(0.0)), 6)
    return n.select(*group, rate("tp", "tp + fn").alias("recall"), rate("fp", "fp + tn").alias("premature"), rate("fn", "tp + fn").alias("missed"))


def adjacent(df: DataFrame, group: list[str], order: list[str], score: str, valid: str) -> DataFrame:
    """(group, pairs, regressions, residual): pairs of neighbours that are both valid, how often the score falls, and the mean absolute step. Neighbours are taken before invalid rows go."""
    by_time = Window.partitionBy(*group).orderBy(*order)
    both = df.withColumns({"before": F.lag(score).over(by_time), "ok": F.col(valid) & F.lag(valid).over(by_time)}).where("ok")
    step = F.col(score) - F.col("before")
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(step < 0).alias("regressions"), F.round(F.avg(F.abs(step)), 6).alias("residual"))


def copies(df: DataFrame, group: list[str], value: Column, memory: Column) -> DataFrame:
    """(group, comparable, copied, rate): how often a value is the remembered one, of the rows that have both."""
    own = df.select(*group, value.alias("v"), memory.alias("m")).where("v is not null and m is not null")
    return own.groupBy(*group).agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("v") == F.col("m")).alias("copied"), F.round(F.avg((F.col("v") == F.col("m")).cast("int")), 6).alias("rate"))


def duplicate_rate(df: DataFrame, group: list[str], normal: Column) -> DataFrame:
    """(group, rate): (values - distinct normalised values) / values."""
    once = df.select(*group, normal.alias("v")).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy(*group).agg(F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("rate"))


def event_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(event, n): values of several optional columns, counted together."""
    return df.select(F.explode(F.array_compact(F.array(*columns))).alias("event")).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def failures(df: DataFrame, group: list[str], episode: str, source: str, kept: int = 3) -> DataFrame:
    """(group, n, episodes, sources, representatives): counts of failures, and the least few episodes that stand for them; a bounded heap in every task."""
    once = df.groupBy(*group, episode).agg(F.count(F.lit(1)).alias("n"), F.min(source).alias("s"))
    nth = Window.partitionBy(*group).orderBy(episode)
    first = once.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= kept).groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(episode)), ",").alias("representatives"))
    sums = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(episode).alias("episodes"), F.count_distinct(source).alias("sources"))
    return sums.join(first, group)


def mean_interval(df: DataFrame, group: list[str], value: Column, replicas: int, seed: int = 42) -> DataFrame:
    """(group, mean, low, high): mean and its 95 % interval by a Poisson bootstrap.

    Every row has a weight in each replica that its hash decides, so no row is drawn on
    the driver and sums combine in any order: the replicas' means are sum(w x) / sum(w).
    """
    key = F.xxhash64(*df.columns, F.lit(seed))
    own = df.select(*group, value.cast("double").alias("x"), key.alias("k")).where("x is not null")
    # the weight of a Poisson variable of mean 1, from 32 bits of hash
    chance = F.pmod(F.xxhash64("k", "replica"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    weight = sum((F.when(chance >= c, 1).otherwise(0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    rows = own.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).withColumn("w", weight)
    means = rows.groupBy(*group, "replica").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")).where("m is not null")
    ends = means.groupBy(*group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return own.groupBy(*group).agg(F.avg("x").alias("mean")).join(ends, group)


def end_audit(df: DataFrame, group: list[str], episode: list[str], frame: str, said: Column, true: Column, valid: Column, caption: Column, exact: Column, error: Column) -> DataFrame:
    """By group, how ends are told: the decision's counts and the share of right ones where invalid rows count as wrong; of the first end of each episode, valid or as it was said, how far it is from the true one on the average and how often there is none; and of the true ends the mean caption score, the share of exact ones and the mean progress error.

    Episodes without a true end count in the decisions alone.
    """
    own = df.select(*group, *episode, F.col(frame).alias("__f"), said.alias("__s"), true.alias("__t"), valid.alias("__v"), caption.alias("__c"), exact.alias("__x"), error.alias("__e"))
    rates = decision_rates(own, group, F.col("__s"), F.col("__t"), F.col("__v"))
    ends = own.groupBy(*group, *episode).agg(F.max(F.when(F.col("__t"), F.col("__f"))).alias("e"), F.min(F.when(F.col("__s") & F.col("__v"), F.col("__f"))).alias("v"), F.min(F.when(F.col("__s"), F.col("__f"))).alias("r")).where("e is not null")
    mean = lambda c: F.round(F.avg(c), 6)
    firsts = ends.groupBy(*group).agg(F.count(F.lit(1)).alias("episodes"), mean(F.col("v") - F.col("e")).alias("first_end"), F.count_if(F.col("v").isNull()).alias("no_end"), mean(F.col("r") - F.col("e")).alias("first_raw_end"), F.count_if(F.col("r").isNull()).alias("no_raw_end"))
    last = own.where("__t").groupBy(*group).agg(mean(F.when(F.col("__v"), F.col("__c")).otherwise(0.0)).alias("terminal_caption"), mean((F.col("__v") & F.col("__x")).cast("int")).alias("terminal_exact"), mean(F.when(F.col("__v"), F.abs("__e")).otherwise(100)).alias("terminal_mae"))
    return rates.join(firsts, group, "left").join(last, group, "left")


def execution_summary(df: DataFrame, group: list[str], episode: list[str], order: list[str], valid: Column, progress: Column, caption: Column, kept: int = 20) -> DataFrame:
    """(group, rows, valid_rate, caption, regressions, falls): by group the share of valid rows, the mean caption score (0 for invalid rows), how often valid progress falls from one row to the next, and the largest such falls as episode@place:fall, ties by episode and place."""
    by_time = Window.partitionBy(*group, *episode).orderBy(*order)
    own = df.withColumns({"__v": valid, "__p": progress, "__c": caption}).withColumns({"__d": F.when(F.col("__v") & F.lag("__v").over(by_time), F.col("__p") - F.lag("__p").over(by_time)), "__k": F.row_number().over(by_time)})
    sums = own.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("__v").cast("int")), 6).alias("valid_rate"), F.round(F.avg(F.when(F.col("__v"), F.col("__c")).otherwise(0.0)), 6).alias("caption"), F.count_if(F.col("__d") < 0).alias("regressions"))
    worst = own.where("__d < 0").withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("__d", *episode, "__k"))).where(F.col("__n") <= kept)
    told = worst.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.concat(F.concat_ws("/", *episode), F.lit("@"), F.col("__k"), F.lit(":"), -F.col("__d")).alias("t")))), lambda x: x["t"]), " ").alias("falls"))
    return sums.join(told, group, "left")
