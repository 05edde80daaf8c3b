"""Readable text from counterfactual differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Rules of advice: words in the name of a feature, and what to do about it.
ADVICE = [
    (("packet", "count"), "find out who sends this many packets and cap their rate"),
    (("byte", "payload"), "look into the payloads for data leaving or answers blown up"),
    (("iat", "time", "interval"), "compare the rhythm with that of scripted senders"),
]
OTHER_ADVICE = "keep watching this value"
NO_ADVICE = "nothing to do but keep watching"
MAIN_IMPACT = 0.7  # fixed value: share of the largest change above which a change counts as a main one


def fixed(c: Column, digits: int) -> Column:
    """Rounded as binary numbers are: scaled, then to the nearest whole number, halves away from zero. ``round`` with digits
    goes by the shortest decimal form instead, in which a number a little below a half is a half."""
    return F.format_string(f"%.{digits}f", F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits))


def narrative() -> Column:
    """Needs flow_id, prediction, nearest_normal_id, similarity_score, feature_diffs."""
    lines = F.transform(
        "feature_diffs",
        lambda d: F.concat(
            F.lit("* "), d["feature"], F.lit(" is "), fixed(d["original_value"], 2), F.lit(" here and "),
            fixed(d["cf_value"], 2), F.lit(" there: "), d["direction"], F.lit(" by "), fixed(d["pct_change"], 1), F.lit("%"),
        ),
    )
    head = F.array(
        F.concat("flow_id", F.lit(": "), F.coalesce("prediction", F.lit("malicious"))),
        F.concat(
            F.lit("compared with "), F.col("nearest_normal_id"), F.lit(", cosine "),
            fixed(F.coalesce("similarity_score", F.lit(0.0)), 4),
        ),
    )
    return F.when(F.size("feature_diffs") == 0, F.lit("Both flows have the same features.")).otherwise(
        F.array_join(F.concat(head, lines), "\n")
    )


def report_lines() -> Column:
    """One aligned line per difference."""
    return F.transform(
        "feature_diffs",
        lambda d: F.concat(
            F.format_string("%-20s: ", d["feature"]),
            F.lpad(fixed(d["original_value"], 2), 12, " "),
            F.lit(" -> "),
            F.lpad(fixed(d["cf_value"], 2), 12, " "),
            F.lit("  ("),
            d["direction"],
            F.lit(", "),
            fixed(d["pct_change"], 1),
            F.lit("%)"),
        ),
    )


def changes() -> Column:
    """The first six differences with their share of the largest one."""
    largest = F.greatest(F.array_max(F.transform("feature_diffs", lambda d: d["abs_diff"])), F.lit(1.0))
    return F.transform(
        F.slice("feature_diffs", 1, 6),
        lambda d: F.struct(
            d["feature"].alias("parameter"),
            fixed(d["original_value"], 2).alias("original"),
            fixed(d["cf_value"], 2).alias("modified"),
            F.least(d["abs_diff"] / largest, F.lit(1.0)).alias("impact"),
        ),
    )


def _by_impact(column: str) -> Column:
    keyed = F.transform(
        column,
        lambda c, i: F.struct(
            (-c["impact"]).alias("k"), i.alias("i"), c["parameter"].alias("parameter"),
            c["original"].alias("original"), c["modified"].alias("modified"), c["impact"].alias("impact"),
        ),
    )
    return F.array_sort(keyed)


def insights(column: str = "changes") -> Column:
    """The four strongest changes in words."""
    text = F.transform(
        F.slice(_by_impact(column), 1, 4),
        lambda c: F.concat(
            F.when(c["impact"] > MAIN_IMPACT, "main: ").otherwise("side: "), c["parameter"], F.lit(" from "), c["original"],
            F.lit(" to "), c["modified"], F.lit(", weight "), F.round(c["impact"] * 100).cast("int").cast("string"), F.lit(" of 100"),
        ),
    )
    return F.when(F.size(column) == 0, F.array(F.lit("nothing differs"))).otherwise(text)


def recommendations(column: str = "changes") -> Column:
    """What to look at for the five strongest changes: the first rule with a word that the feature's name contains."""

    def advice(c: Column) -> Column:
        name, chosen = F.lower(c["parameter"]), F.lit(OTHER_ADVICE)
        for words, text in reversed(ADVICE):
            chosen = F.when(F.rlike(name, F.lit("|".join(words))), F.lit(text)).otherwise(chosen)
        return F.concat(c["parameter"], F.lit(" ("), c["original"], F.lit(", usual "), c["modified"], F.lit("): "), chosen)

    none = F.array(F.lit(NO_ADVICE))
    return F.when(F.size(column) == 0, none).otherwise(F.transform(F.slice(_by_impact(column), 1, 5), advice))
