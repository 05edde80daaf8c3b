"""Distribution statistics. Aggregates are wide (one pass, map-side combined) and turned into long
form afterwards, on a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.severity import with_severity
from packetloom.operators.ordered import running_total
from packetloom.schemas import FEATURES
from packetloom.store import Store

# Default percentiles, and the least deviation that counts as spread.
PERCENTS = [5, 25, 50, 75, 95, 99]
MIN_STD = 1e-8


def feature_stats(
    flows: DataFrame, features: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """count, min, max, avg and population deviation of each feature per label."""
    features = features or FEATURES
    by = ["label"] if by is None else by
    fns = {"cnt": F.count, "mn": F.min, "mx": F.max, "mean": F.avg, "sd": F.stddev_pop}
    wide = flows.groupBy(*by).agg(
        *[fn(F.col(f).cast("double")).alias(f"{f}__{k}") for f in features for k, fn in fns.items()]
    )
    rows = ", ".join(
        f"'{f}', {f}__cnt, {f}__mn, {f}__mx, {f}__mean, {f}__sd" for f in features
    )
    return wide.selectExpr(
        *by,
        f"stack({len(features)}, {rows}) AS (feature, n, min_value, max_value, avg_value, std_value)",
    )


def percentiles_approx(
    flows: DataFrame, feature: str, percents: list[float] | None = None, accuracy: int = 10000
) -> DataFrame:
    """Mergeable sketch per label: one pass, bounded memory."""
    percents = percents or PERCENTS
    shares = [p / 100 for p in percents]
    sketch = flows.groupBy("label").agg(
        F.percentile_approx(F.col(feature).cast("double"), shares, accuracy).alias("v")
    )
    return sketch.select(
        "label", F.explode(F.arrays_zip(F.lit(percents).alias("percent"), F.col("v").alias("value"))).alias("z")
    ).select("label", F.col("z.percent").cast("double").alias("percent"), F.col("z.value").alias("value"))


def percentiles(
    flows: DataFrame, features: list[str], store: Store, percents: list[float] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, for any number of distinct values.

    Equal values are counted first; a running count in value order then tells which values hold
    the two ranks around each percentile. The running count is range-partitioned.
    """
    percents = percents or PERCENTS
    rows = ", ".join(f"'{f}', cast({f} as double)" for f in features)
    counts = (
        flows.selectExpr("label", f"stack({len(features)}, {rows}) AS (feature, value)")
        .where("value is not null")
        .groupBy("label", "feature", "value")
        .agg(F.count("*").alias("n"))
    )
    upto = running_total(counts, ["label", "feature"], ["value"], "n", store, "upto")
    totals = upto.groupBy("label", "feature").agg(F.max("upto").alias("total"))
    wanted = totals.withColumn("percent", F.explode(F.lit([float(p) for p in percents]))).withColumn(
        "rank", F.col("percent") / 100 * (F.col("total") - 1)
    )
    # one row per class and feature, with its percentiles as a list: small by construction, so it is
    # broadcast and the counts are not shuffled on so few keys
    wanted = wanted.groupBy("label", "feature").agg(
        F.collect_list(F.struct("percent", "rank")).alias("wanted")
    )
    hit = (
        upto.join(F.broadcast(wanted), ["label", "feature"])
        .withColumn("_from", F.col("upto") - F.col("n"))
        .withColumn(
            "w",
            F.explode(
                F.filter(
                    "wanted",
                    lambda w: (F.ceil(w["rank"]) >= F.col("_from")) & (F.floor(w["rank"]) < F.col("upto")),
                )
            ),
        )
    )
    low = F.floor("w.rank")
    share = F.col("w.rank") - low
    holds_low = (low >= F.col("_from")) & (low < F.col("upto"))
    # the smallest hit holds the lower rank, the largest the upper one
    return (
        hit.groupBy("label", "feature", F.col("w.percent").alias("percent"))
        .agg(
            F.max(F.when(holds_low, F.col("value"))).alias("lo"),
            F.max("value").alias("hi"),
            F.max(share).alias("share"),
        )
        .select(
            "label", "feature", "percent", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("value")
        )
    )


def significant_terms(
    flows: DataFrame, field: str, foreground_label: int = 1, size: int | None = 20, min_doc_count: int = 1
) -> DataFrame:
    """Values over-represented under a label: (fg - bg) * (fg / bg) of their shares."""
    is_fg = F.when(F.col("label") == foreground_label, 1).otherwise(0)
    counts = flows.groupBy(F.col(field).cast("string").alias("term")).agg(
        F.sum(is_fg).alias("doc_count"), F.count("*").alias("bg_count")
    )
    totals = flows.agg(F.struct(F.sum(is_fg).alias("fg"), F.count("*").alias("bg"))).scalar()
    fg = F.col("doc_count") / F.col("_t.fg")
    bg = F.col("bg_count") / F.col("_t.bg")
    ranked = (
        counts.where(F.col("doc_count") >= max(min_doc_count, 1))
        .withColumn("_t", totals)
        .where(fg > bg)
        .withColumn("score", (fg - bg) * (fg / bg))
        .orderBy(F.col("score").desc(), "term")
        .select("term", "doc_count", "bg_count", "score")
    )
    return ranked if size is None else ranked.limit(size)


def severity_breakdown(flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per severity level and per traffic volume class in one pass."""
    by = by or []
    keep = [F.col(c) for c in by]
    level, volume = F.col("severity_level"), F.col("traffic_volume_category")
    both = (
        with_severity(flows)
        .groupingSets([[*keep, level], [*keep, volume]], *keep, level, volume)
        .agg(F.count("*").alias("n"), F.grouping("severity_level").alias("g"))
    )
    return both.select(
        *by,
        F.when(F.col("g") == 0, "severity").otherwise("volume").alias("breakdown"),
        F.coalesce("severity_level", "traffic_volume_category").alias("category"),
        "n",
    )


AGGREGATE_FIELDS = ("src_ip", "dst_ip", "protocol", "label", "severity_level")


def bucket_counts(
    flows: DataFrame, field: str, sub_aggregates: list[Column] | None = None,
    after: str | None = None, size: int | None = None,
) -> DataFrame:
    """All buckets of a field with their counts, in key order; ``after``/``size`` give one page."""
    if field not in AGGREGATE_FIELDS:
        raise ValueError(f"Field '{field}' not allowed. Allowed: {sorted(AGGREGATE_FIELDS)}")
    source = with_severity(flows) if field == "severity_level" else flows
    out = source.groupBy(F.col(field).alias("key")).agg(
        F.count("*").alias("doc_count"), *(sub_aggregates or [])
    )
    if after is not None:
        out = out.where(F.col("key") > F.lit(after))
    out = out.orderBy("key")
    return out.limit(size) if size else out


NormStats = dict[str, tuple[float, float]]


def normalisation_stats(df: DataFrame, features: list[str]) -> NormStats:
    """{feature: (mean, population deviation)} from one aggregate; no spread counts as 1. Two numbers
    per feature, kept so that the same scaling can be applied to other data."""
    wanted = [fn(f) for f in features for fn in (F.avg, F.stddev_pop)]
    row = df.agg(*wanted).first()
    out = {}
    for i, f in enumerate(features):
        mean, std = row[2 * i] or 0.0, row[2 * i + 1] or 0.0
        out[f] = (float(mean), float(std) if std >= MIN_STD else 1.0)
    return out


def normalise(df: DataFrame, features: list[str], fitted: NormStats | None = None) -> DataFrame:
    """z = (x - mean) / std, fitted on ``df`` itself unless fitted stats are given."""
    fitted = normalisation_stats(df, features) if fitted is None else fitted
    return df.withColumns({f: (F.col(f) - F.lit(fitted[f][0])) / F.lit(fitted[f][1]) for f in features})


def class_weights(flows: DataFrame, label: str = "label", classes: int | None = None) -> DataFrame:
    """Total / (present classes * class count). Classes without rows count as one row; no rows at
    all give equal weights. With a number of ``classes`` given: total / (classes * class count), for the labels there are."""
    if classes is not None:
        seen = flows.groupBy(label).agg(F.count("*").alias("n"))
        total = flows.agg(F.count("*")).scalar()
        return seen.select(label, (total / (F.lit(float(classes)) * F.col("n"))).alias("weight"))
    classes = flows.sparkSession.range(2).select(F.col("id").cast("int").alias(label))
    highest = flows.agg(F.coalesce(F.max(F.col(label)), F.lit(1))).scalar()
    seen = flows.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    # class ids run from 0 to the highest one seen, at least two of them
    ids = (
        classes.agg(F.max(label))
        .select(F.explode(F.sequence(F.lit(0), F.greatest(highest.cast("int"), F.lit(1)))).alias(label))
    )
    all_classes = ids.join(seen, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = (
        all_classes.agg(
            F.struct(
                F.sum(F.greatest("n", F.lit(1))).alias("total"),
                F.sum((F.col("n") > 0).cast("int")).alias("present"),
            )
        ).scalar()
    )
    weight = F.col("_t.total") / (F.col("_t.present") * F.greatest("n", F.lit(1)))
    return all_classes.withColumn("_t", totals).select(
        label, F.when(F.col("_t.present") == 0, F.lit(1.0)).otherwise(weight).alias("weight")
    )


def positive_weight(flows: DataFrame) -> DataFrame:
    pos = F.sum((F.col("label") == 1).cast("long"))
    neg = F.sum((F.col("label") == 0).cast("long"))
    return flows.agg((neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def balanced_weight(train: DataFrame) -> Column:
    """Weight of a training row: positive ones weigh as much as the negative ones. Where either class is missing there is
    nothing to balance, and every row weighs 1."""
    positive = F.coalesce(F.nullif(positive_weight(train).scalar(), F.lit(0.0)), F.lit(1.0))
    return F.when(F.col("label") == 1, positive).otherwise(F.lit(1.0))


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def classification_metrics(scored: DataFrame, score: str = "prediction_score", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and log loss at a threshold; 0 where undefined."""
    p, y = F.col(score), F.col("label")
    predicted = p >= threshold
    eps = F.lit(1e-12)
    sure = F.greatest(F.least(p, 1 - eps), eps)
    loss = -F.when(y == 1, F.ln(sure)).otherwise(F.ln(1 - sure))
    counts = scored.where(p.isNotNull()).agg(
        F.sum((predicted & (y == 1)).cast("long")).alias("tp"),
        F.sum((predicted & (y == 0)).cast("long")).alias("fp"),
        F.sum((~predicted & (y == 1)).cast("long")).alias("fn"),
        F.avg(loss).alias("loss"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return counts.select(
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "loss",
    )
