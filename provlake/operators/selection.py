"""Selection from model outputs, pools and metrics (SRT09-16, AGG10, AGG17-19, MTH01)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoint import cut


def entropy(probabilities: str) -> Column:
    """MTH01; a probability of 0 adds nothing."""
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def margin(probabilities: str) -> Column:
    """The largest probability less the second."""
    down = F.reverse(F.array_sort(probabilities))
    return F.get(down, F.lit(0)) - F.coalesce(F.get(down, F.lit(1)), F.lit(0.0))


def confidence(probabilities: str) -> Column:
    return F.array_max(probabilities)


def mean_draws(draws: str) -> Column:
    """The mean of an array of probability vectors."""
    total = F.aggregate(F.slice(F.col(draws), F.lit(2), F.size(draws)), F.get(draws, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(draws))


def mean_entropy(draws: str) -> Column:
    """The mean of the vectors' entropies."""
    each = F.transform(draws, lambda v: F.aggregate(v, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(draws)


def pick(pool: DataFrame, score: Column, n: int, key: str = "id", largest: bool = True) -> DataFrame:
    """SRT10, SRT11: the n rows of most (or least) score, ties by key: a top-n that each task makes for itself first."""
    rows = pool.withColumn("score", score)
    return rows.orderBy(F.desc("score") if largest else F.asc("score"), key).limit(n)


def least_confidence(pool: DataFrame, n: int, probabilities: str = "p", key: str = "id") -> DataFrame:
    return pick(pool, confidence(probabilities), n, key, largest=False)


def least_margin(pool: DataFrame, n: int, probabilities: str = "p", key: str = "id") -> DataFrame:
    return pick(pool, margin(probabilities), n, key, largest=False)


def most_entropy(pool: DataFrame, n: int, probabilities: str = "p", key: str = "id") -> DataFrame:
    return pick(pool, entropy(probabilities), n, key)


def most_disagreement(pool: DataFrame, n: int, draws: str = "draws", key: str = "id") -> DataFrame:
    """SRT11, BALD: entropy of the mean less mean of the entropies."""
    rows = pool.withColumn("__mean", mean_draws(draws))
    return pick(rows, entropy("__mean") - mean_entropy(draws), n, key).drop("__mean")


def random_pick(pool: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """SRT12: n rows in the order of a hash of key and seed, the same at any partitioning."""
    return pool.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def label_at_random(pool: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """SRT16: the pool with a column `labeled`, true for n random rows."""
    chosen = random_pick(pool.select(key), n, seed, key).withColumn("labeled", F.lit(True))
    return pool.join(chosen, key, "left").withColumn("labeled", F.coalesce("labeled", F.lit(False)))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """MTH01."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))


def near_centroids(pool: DataFrame, n: int, seed: int = 1, vector: str = "embedding", key: str = "id") -> DataFrame:
    """SRT13: of n k-means clusters the row nearest to each centroid."""
    rows = pool.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=n, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows)
    centers = pool.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    placed = model.transform(rows).join(F.broadcast(centers), "cluster").withColumn("distance", squared_distance(vector, "center"))
    return placed.groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias(key), F.min("distance").alias("distance"))


#: Vectors of labeled rows that one pass compares.
BLOCK = 256


def farthest_first(pool: DataFrame, n: int, labeled: int | list[int], vector: str = "embedding", key: str = "id") -> DataFrame:
    """SRT14: k-center greedy: n rows, each the farthest from the labeled ones (keys) and from those before it; (key, nth, distance).

    The labeled rows are nth 0, without distance. Each round is one pass that writes the least distance so far and compares
    with the last row found; a row a round comes to the driver, n is a parameter. The labeled rows' vectors, a parameter
    too, are compared in blocks.
    """
    labeled = [labeled] if isinstance(labeled, int) else list(labeled)
    rows = pool.select(key, F.col(vector).cast("array<double>").alias("v"))
    start = [list(r.v) for r in rows.where(F.col(key).isin(labeled)).select("v").collect()]
    rows = cut(rows.where(~F.col(key).isin(labeled)).withColumn("least", F.lit(None).cast("double")))
    nearest = lambda vectors: F.array_min(F.transform(F.lit(vectors), lambda c: squared_distance("v", c)))
    for block in (start[i : i + BLOCK] for i in range(0, len(start), BLOCK)):
        rows = cut(rows.withColumn("least", F.least("least", nearest(block))))
    out = [(k, 0, None) for k in labeled]
    for nth in range(1, n + 1):
        found = rows.select(key, "v", F.sqrt("least").alias("distance")).orderBy(F.desc_nulls_first("distance"), key).limit(1).first()
        if found is None:
            break
        out.append((found[key], nth, found["distance"]))
        if nth < n:
            rows = cut(rows.where(F.col(key) != found[key]).withColumn("least", F.least("least", nearest([list(found["v"])]))))
    return pool.sparkSession.createDataFrame(out, f"{key} long, nth int, distance double")


def best_trials(metrics: DataFrame, metric: str, n: int | None = None, largest: bool = True) -> DataFrame:
    """AGG10, SRT09: each trial's best step and its model; with n, whether it is among the n best trials.

    Of equally good steps the first; a step without metric is never the best one. NaN is larger than any number. The model is
    that of the best step that has one.
    """
    order = F.when(F.col(metric).isNotNull() & F.col("model").isNotNull(), F.struct(F.col(metric), -F.col("step") if largest else F.col("step")))
    best = metrics.groupBy("trial").agg((F.max_by if largest else F.min_by)("model", order).alias("model"), (F.max if largest else F.min)(metric).alias("best"))
    if n is None:
        return best
    top = best.orderBy(F.desc("best") if largest else F.asc("best"), "trial").limit(n).select("trial", F.lit(True).alias("in_top_n"))
    return best.join(top, "trial", "left").withColumn("in_top_n", F.coalesce("in_top_n", F.lit(False)))


def numbered_steps(metrics: DataFrame, series: str, order: str) -> DataFrame:
    """WIN03: a sequence number from 1 in each series."""
    return metrics.withColumn("SequenceNumber", F.row_number().over(Window.partitionBy(series).orderBy(order)).cast("long"))


def running_sums(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """rows with running sums (new name: column) from the largest of `order`, whose values are distinct, downwards.

    By range: each range of values sums its own rows, behind the sums of the ranges before it, so no task sees more than
    its range. The ranges are written once, as both their sums and their rows are read.
    """
    ranged = cut(rows.repartitionByRange(F.desc(order)).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    heads = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    heads = heads.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(heads), "__part")  # a row a range
    return out.select(*rows.columns, *((F.col(f"__{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()))


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    return scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))


def ranking_quality(scored: DataFrame, score: str, label: str) -> DataFrame:
    """AGG17: one row: area under the ROC curve and average precision, with equal scores taken together."""
    run = running_sums(_by_score(scored, score, label), "threshold", {"tp": "p", "fp": "n"})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))
    precision = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")
    return run.agg(area.alias("roc_auc"), precision.alias("average_precision"))


def roc_points(scored: DataFrame, score: str, label: str) -> DataFrame:
    """AGG17: threshold, true and false positives at each distinct score."""
    return running_sums(_by_score(scored, score, label), "threshold", {"tp": "p", "fp": "n"}).select("threshold", "tp", "fp")


def group_fairness(rows: DataFrame, group: str, label: str, predicted: str) -> DataFrame:
    """AGG19: by group: rates of selection, true and false positives and negatives, accuracy, and the Theil index of benefits."""
    rate = lambda hit, among: F.avg(F.when(among, hit.cast("double")))
    p, y = F.col(predicted) == 1, F.col(label) == 1
    benefit = F.col(predicted) - F.col(label) + 1
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(p.cast("double")).alias("selection_rate"), F.avg((p == y).cast("double")).alias("accuracy"),
        rate(p, y).alias("tpr"), rate(~p, ~y).alias("tnr"), rate(p, ~y).alias("fpr"), rate(~p, y).alias("fnr"),
        (F.avg(F.when(benefit > 0, benefit * F.log(benefit.cast("double"))).otherwise(0.0)) / F.avg(benefit) - F.log(F.avg(benefit))).alias("theil"),
    )


def fairness_gaps(by_group: DataFrame, group: str, privileged: object, unprivileged: object) -> DataFrame:
    """AGG19: one row: differences and ratios between two groups."""
    of = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    gap = lambda c: of(c, unprivileged) - of(c, privileged)
    return by_group.agg(
        gap("selection_rate").alias("statistical_parity_difference"), (of("selection_rate", unprivileged) / of("selection_rate", privileged)).alias("disparate_impact"),
        gap("tpr").alias("equal_opportunity_difference"), ((gap("tpr") + gap("fpr")) / 2).alias("average_odds_difference"), gap("fnr").alias("fnr_difference"),
    )


def tf_idf(docs: DataFrame, text: str = "text", n: int = 2, vocabulary: int = 3000) -> DataFrame:
    """AGG18: counts of words and n-grams, weighted by inverse document frequency; vectors in column features."""
    words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\W+").transform(docs)
    grams = NGram(n=n, inputCol="__w", outputCol="__g").transform(words) if n > 1 else words.withColumn("__g", F.array().cast("array<string>"))
    both = grams.withColumn("__all", F.concat("__w", "__g"))
    counted = CountVectorizer(inputCol="__all", outputCol="__tf", vocabSize=vocabulary).fit(both).transform(both)
    return IDF(inputCol="__tf", outputCol="features").fit(counted).transform(counted).drop("__w", "__g", "__all", "__tf")
