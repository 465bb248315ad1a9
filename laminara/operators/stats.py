"""Statistics of matches: counts and ratios, norms, residuals, scores, evaluation of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminara.functions.registry import norm

MATCH = ["src_z", "dst_z"]


def r(x: Column, digits: int = 6) -> Column:
    """Rounded, so that sums in another order give the same number; a negative zero is a zero."""
    return F.round(x, digits) + F.lit(0.0)


def match_counts(df: DataFrame, search_r: float = 30.0, min_count: int = 0) -> DataFrame:
    """Per match: rows, accepted, rejected, their ratios, and the longest accepted shift as a share of the search."""
    acc = ~F.col("rejected")
    out = df.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n"), F.count_if(acc).alias("n_acc"), F.count_if(~acc).alias("n_rej"), F.max(F.when(acc, norm())).alias("m"))
    few = F.col("n") < min_count
    return out.select(
        *MATCH, "n", "n_acc", "n_rej", F.when(few, 1.0).otherwise(F.col("n_acc") / F.greatest("n", F.lit(1))).alias("acc_ratio"),
        F.when(few, 0.0).otherwise(F.col("n_rej") / F.greatest("n", F.lit(1))).alias("rej_ratio"), (F.coalesce("m", F.lit(0.0)) / search_r).alias("edge"),
    )


#: Review rules by name.
REVIEW = (("too_few", "n", "<", 100), ("rejected_ratio", "rej_ratio", ">", 0.35), ("edge_proximity", "edge", ">", 0.80))


def review(counts: DataFrame) -> DataFrame:
    """Names of the review rules that a match fails, in order, and whether there are any."""
    from laminara.functions.registry import compare

    fails = F.array_compact(F.array(*(F.when(compare(F.col(c), op, t), F.lit(name)) for name, c, op, t in REVIEW)))
    return counts.withColumn("flags", fails).withColumn("flagged", F.size("flags") > 0)


def medians(df: DataFrame) -> DataFrame:
    acc = ~F.col("rejected")
    return df.groupBy(*MATCH).agg(F.median(F.when(acc, F.col("dv_i"))).alias("med_i"), F.median(F.when(acc, F.col("dv_j"))).alias("med_j"))


def centred(df: DataFrame) -> DataFrame:
    """Each row's distance from its match's median shift of accepted rows."""
    # The medians are one row for each match, joined back on its key.
    return df.join(medians(df), MATCH).withColumn("centred", F.hypot(F.col("dv_i") - F.col("med_i"), F.col("dv_j") - F.col("med_j")))


def scored(df: DataFrame) -> DataFrame:
    """Each row's norm as standard scores of its match's accepted rows."""
    s = df.where("not rejected").groupBy(*MATCH).agg(F.avg(norm()).alias("mean"), F.stddev_samp(norm()).alias("std"))
    return df.join(s, MATCH, "left").withColumn("score", (norm() - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))


def property_stats(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return df.groupBy(*MATCH).agg(F.count(c).alias("n"), r(F.min(c), 2).alias("min"), r(F.median(c), 2).alias("med"), r(F.max(c), 2).alias("max"), r(F.stddev_samp(c), 2).alias("std"))


def flag_outlying(stats: DataFrame, name: str = "med", sigma: float = 1.5) -> DataFrame:
    """Rows further than ``sigma`` deviations from the median; the totals are one row, broadcast."""
    total = stats.agg(F.median(name).alias("_m"), F.stddev_samp(name).alias("_s"))
    x = F.col(name)
    return stats.crossJoin(F.broadcast(total)).withColumn("flagged", (x < F.col("_m") - sigma * F.col("_s")) | (x > F.col("_m") + sigma * F.col("_s"))).drop("_m", "_s")


def drift(df: DataFrame, within: int = 5, symmetric: bool = False, bias: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cumulative shift of each section: a match's mean residual counts against the later section if it precedes it
    closely, else for the source; sections without a match count zero."""
    half = 0.5 if symmetric else 1.0
    mean = df.where("not rejected").groupBy(*MATCH).agg(F.avg("dv_i").alias("di"), F.avg("dv_j").alias("dj"))
    near = (F.col("dst_z") - F.col("src_z")).between(1, within)
    charged = mean.select(F.when(near, F.col("dst_z")).otherwise(F.col("src_z")).alias("z"), *((F.when(near, -F.col(c)).otherwise(F.col(c)) * half).alias(c) for c in ("di", "dj")))
    sections = df.select(F.col("src_z").alias("z")).unionByName(df.select(F.col("dst_z").alias("z"))).distinct()
    step = sections.join(charged.groupBy("z").agg(F.sum("di").alias("di"), F.sum("dj").alias("dj")), "z", "left").fillna(0.0)
    # Sections are few thousand at most, so one ordered window over them is small.
    w = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    return step.select("z", (F.sum("di").over(w) + bias[0]).alias("cum_i"), (F.sum("dj").over(w) + bias[1]).alias("cum_j"))


def residual_stats(df: DataFrame) -> DataFrame:
    """Per match with two or more accepted rows: root mean square, mean, deviation and maximum of norms, mean shift,
    and mean, deviation and extremes of the peak and its widths."""
    x = df.where("not rejected").withColumn("norm", norm())
    wide = [a for c in ("sigma_095", "sigma_075", "sigma_05") for a in (F.avg(c).alias(f"{c}_avg"), F.stddev_samp(c).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"))]
    return x.groupBy(*MATCH).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("rms"), F.avg("norm").alias("avg"), F.stddev_samp("norm").alias("std"), F.max("norm").alias("max"),
        F.avg("dv_i").alias("drift_i"), F.avg("dv_j").alias("drift_j"), F.avg("r_max").alias("r_avg"), F.stddev_samp("r_max").alias("r_std"), F.min("r_max").alias("r_min"), *wide,
    ).where("n > 1")


def residual_summary(df: DataFrame, within: int = 5) -> DataFrame:
    """The norms of all matches together, and the plain mean of their drifts, turned round where the source doesn't
    precede closely."""
    x = df.where("not rejected").withColumn("norm", norm())
    many = x.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n"), F.avg("dv_i").alias("di"), F.avg("dv_j").alias("dj"), F.sum(F.col("norm") * F.col("norm")).alias("s2"), F.sum("norm").alias("s1"), F.max("norm").alias("m")).where("n > 1")
    turn = F.when((F.col("dst_z") - F.col("src_z")).between(1, within), 1.0).otherwise(-1.0)
    return many.agg(F.sum("n").alias("n"), F.sqrt(F.sum("s2") / F.sum("n")).alias("rms"), (F.sum("s1") / F.sum("n")).alias("avg"), F.max("m").alias("max"), F.avg(turn * F.col("di")).alias("drift_i"), F.avg(turn * F.col("dj")).alias("drift_j"))


def evaluate(df: DataFrame, truth: Column, found: Column, limit: int = 0) -> DataFrame:
    """Per match: rows rejected by mistake, accepted by mistake and rejected by both, and the decision on the match."""
    t = df.select(*MATCH, truth.alias("t"), found.alias("f"))
    return t.groupBy(*MATCH).agg(F.count_if(F.col("f") & ~F.col("t")).alias("false_rej"), F.count_if(~F.col("f") & F.col("t")).alias("false_acc"), F.count_if(F.col("f") & F.col("t")).alias("common")).withColumn("reject", (F.col("false_rej") + F.col("common")) > limit)


def precision_recall(ev: DataFrame) -> DataFrame:
    c, fr, fa = F.sum("common"), F.sum("false_rej"), F.sum("false_acc")
    return ev.agg((c / F.nullif(c + fr, F.lit(0))).alias("precision"), (c / F.nullif(c + fa, F.lit(0))).alias("recall"), F.count_if("reject").alias("workload"))


def sweep(df: DataFrame, name: str, truth: Column, steps: int = 100, top: float = 1.0) -> DataFrame:
    """Confusion counts of ``name < threshold`` for thresholds k * top / steps. Rows are first counted by the first
    threshold that lies above them, so the thresholds never meet the rows."""
    k = F.least(F.lit(steps + 1), F.greatest(F.lit(1), F.floor(F.col(name) * (steps / top)).cast("int") + 1))
    # Floor by division may be off by one unit in the last place; the comparison itself decides.
    k = F.when(F.col(name) < k * (top / steps), F.when(F.col(name) < (k - 1) * (top / steps), k - 1).otherwise(k)).otherwise(k + 1)
    hist = df.select(F.greatest(k, F.lit(1)).alias("k"), truth.alias("t")).groupBy("k").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    all_ = hist.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    run = grid.join(F.broadcast(hist.where(F.col("k") <= steps)), "k", "left").fillna(0, ["pos", "neg"])
    run = run.select("k", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    return run.crossJoin(F.broadcast(all_)).select("k", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))


def histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """(bin, n) over bins of equal width from the least to the greatest value, the last one closed."""
    ends = df.agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    b = F.least(F.lit(bins), F.floor((F.col(name) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins).cast("int") + 1)
    return df.crossJoin(F.broadcast(ends)).where(F.col(name).isNotNull()).groupBy(F.coalesce(b, F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def plotting_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """(group, k, q): quantiles by plotting positions: at p, n p + alpha + p (1 - alpha - beta) among the sorted
    values. Counts of equal values stand for the values, so a group is never gathered in one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).count()
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("hi", F.sum("count").over(w)).withColumn("lo", F.col("hi") - F.col("count") + 1)
    n = counts.groupBy(*group).agg(F.sum("count").alias("n"))
    ps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(probs)))
    at = n.select(*group, "n", F.explode(ps).alias("s")).select(*group, "n", "s.k", (F.col("n") * F.col("s.p") + alpha + F.col("s.p") * (1 - alpha - beta)).alias("m"))
    # j is the rank below, g the part of the way to the next
    at = at.withColumn("j", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor("m")))).withColumn("g", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") - F.col("j"))))
    pick = lambda d: at.alias("a").join(ranked.select(*group, value, "lo", "hi").alias("v"), group).where((F.col("j") + d >= F.col("lo")) & (F.col("j") + d <= F.col("hi"))).select(*group, "k", "g", F.col(value).alias(f"x{d}"))
    # With one row there is no next rank; the value itself counts.
    out = pick(0).join(pick(1).drop("g"), [*group, "k"], "left")
    return out.select(*group, "k", ((1 - F.col("g")) * F.col("x0") + F.col("g") * F.coalesce("x1", "x0")).alias("q"))
