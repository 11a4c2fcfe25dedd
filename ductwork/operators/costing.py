"""Prices, totals, scores, ranks and criteria of planning variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.rules import Rules, half_up


def price_segments(segments: DataFrame, rules: Rules) -> DataFrame:
    """Adds dn (the smallest that carries flow, if there is no dn), cost. segments: flow, length, k [, dn]."""
    if "dn" not in segments.columns:
        segments = segments.withColumn("dn", rules.diameter_for_flow(F.col("flow")))
    return segments.withColumn("cost", rules.segment_cost(F.col("length"), F.col("dn"), F.col("k")))


def money(x: Column) -> Column:
    """A sum of prices must not hang on the order of rows: hundredths as decimals."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def variant_totals(segments: DataFrame, rules: Rules, chambers: DataFrame | None = None, tie_ins: DataFrame | None = None, unconnected: DataFrame | None = None) -> DataFrame:
    """One row per variant: n_segments, construction_cost, chamber_cost, tie_in_cost, penalty, calculated_cost, new_length, score.

    segments: variant, cost, length; chambers: variant, dn; tie_ins: variant (one row each); unconnected: variant, flow."""
    out = segments.groupBy("variant").agg(money(F.col("cost")).alias("segment_cost"), money(half_up(F.col("length"), 2)).alias("new_length"), F.count(F.lit(1)).alias("n_segments"))
    extra = [
        (chambers, lambda df: df.groupBy("variant").agg(money(rules.chamber_price(F.col("dn"))).alias("chamber_cost")), "chamber_cost"),
        (tie_ins, lambda df: df.groupBy("variant").agg((F.count(F.lit(1)) * rules.tie_in_cost).cast("double").alias("tie_in_cost")), "tie_in_cost"),
        (unconnected, lambda df: df.groupBy("variant").agg(money(rules.penalty(F.col("flow"))).alias("penalty")), "penalty"),
    ]
    for df, total, name in extra:
        out = out.join(total(df), "variant", "left") if df is not None else out.withColumn(name, F.lit(None).cast("double"))
    out = out.fillna(0.0, ["chamber_cost", "tie_in_cost", "penalty"])
    out = out.withColumn("construction_cost", half_up(F.col("segment_cost") + F.col("chamber_cost") + F.col("tie_in_cost"), 2))
    out = out.withColumn("calculated_cost", half_up(F.col("construction_cost") + F.col("penalty"), 2))
    return out.withColumn("score", rules.score(F.col("calculated_cost"), F.col("new_length")))


def rank_variants(totals: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Adds rank: by score, then cost, then variant."""
    order = Window.partitionBy(*(partition or [])).orderBy("score", "calculated_cost", "variant")
    return totals.withColumn("rank", F.row_number().over(order).cast("long"))


def criteria(segments: DataFrame, consumers: DataFrame, least_turn: float = 3.0) -> DataFrame:
    """Comparison figures per variant; ratios are null on a zero denominator.

    segments: variant, cost, length, special, crossed_type, turn; consumers: variant, flow, connected."""
    s = segments.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_segments"), money(F.when(F.col("special"), half_up(F.col("length"), 2))).alias("special_length"),
        F.countDistinct(F.when(F.col("special"), F.col("crossed_type"))).alias("crossed_types"), F.count_if(F.col("turn") >= least_turn).alias("n_turns"), money(F.col("cost")).alias("cost"),
    )
    c = consumers.groupBy("variant").agg(F.count_if("connected").alias("n_connected"), F.count_if(~F.col("connected")).alias("n_unconnected"), F.sum(F.when(F.col("connected"), F.col("flow"))).alias("flow"))
    both = s.join(c, "variant", "left")
    return both.withColumn("cost_per_consumer", F.try_divide("cost", "n_connected")).withColumn("cost_per_tph", F.try_divide("cost", F.when(F.col("flow") > 0, F.col("flow"))))


def distinct_layouts(members: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with the same set of members are one layout: layout (smallest key), n_keys, n_members. Sets are compared by their sorted hash."""
    sets = members.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ","), 256).alias("__h"), F.countDistinct(member).alias("n_members"))
    return sets.groupBy("__h").agg(F.min(key).alias("layout"), F.count(F.lit(1)).alias("n_keys"), F.min("n_members").alias("n_members")).drop("__h")


def best_per_part(parts: DataFrame) -> DataFrame:
    """The variant with the lowest score of each independent part (ties to the smaller variant): part, variant, score."""
    return parts.groupBy("part").agg(F.min(F.struct("score", "variant")).alias("b")).select("part", F.col("b.variant").alias("variant"), F.col("b.score").alias("score"))


def top_candidates(candidates: DataFrame, key: str, node: str, order: list[Column], k: int) -> DataFrame:
    """At most k candidates of each key, one per node, in order: adds rank."""
    once = candidates.withColumn("__first", F.row_number().over(Window.partitionBy(key, node).orderBy(*order))).where("__first = 1").drop("__first")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def unconnected_reason(facts: dict[str, Column]) -> Column:
    """The first reason, in order, that holds for an unconnected consumer; no_route if none does."""
    order = ("coincident_point", "no_connection_point", "flow_exceeds_capacity", "inside_forbidden_zone", "enclosed")
    out = F.lit("no_route")
    for name in reversed(order):
        if name in facts:
            out = F.when(facts[name], name).otherwise(out)
    return out


def histogram(df: DataFrame, key: str, sample: str, samples: int = 3) -> DataFrame:
    """Count per key with the first few sample ids in order. Only a bounded number of ids per key is gathered."""
    order = Window.partitionBy(key).orderBy(sample)
    first = df.select(key, sample).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= samples)
    ids = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(sample)), ",").alias("samples"))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(ids, key)
