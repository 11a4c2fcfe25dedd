"""Operator 6: mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, target / source size. Prefix sums of these in a fixed order
(size, then doc_id), moved by one random offset per source, cross some integers; a document is emitted once per integer crossed.
Ordering by size keeps the words taken within about one document's length of the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has target 0;
rows that repeat a doc_id are documents of their own; no rows give no rows. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.llm.common import SPACED_WORD, ranked


def word_count(text: Column) -> Column:
    """Number of words up to white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Per source: its words, its target and how many documents come before it.

    sizes: source, size. The targets fill up in one pass over the sources ordered by cap / weight: the first source that its
    share does not overfill sets the level of all that follow. Works on one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("__no", F.row_number().over(by_name)).withColumn("__first", F.sum("__docs").over(by_name.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("__cap", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("__cap").cast("double") / F.col("__w"), "__no")
    everything = Window.partitionBy()
    per = per.withColumn("__spent", F.coalesce(F.sum("__cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("__left", F.sum("__w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("__level", (F.sum("source_size").over(everything) - F.col("__spent")).cast("double") / F.col("__left"))
    per = per.withColumn("__place", F.row_number().over(by_level))
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__place", "__level"))
    per = per.withColumn("__set", F.min(fits).over(everything))
    target = F.when(F.col("__place") < F.col("__set.__place"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__set.__level"))
    return per.select("source", "source_size", target.alias("target"), F.coalesce("__first", F.lit(0)).alias("__first"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that the seed and the source's name fix."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """How many copies of each document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    docs: doc_id, text, source. Ranks come from a range exchange of three small columns; no task holds a whole source."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = ranked(sized, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last()])
    targets = source_targets(rows.select("source", "size"), weights, cap).withColumnRenamed("source", "__source")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
    place = (F.col("__rank") - F.col("__first")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda k: F.floor(k * rate + offset(F.col("source"), seed))
    copies = (at(place + 1) - at(place)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the documents' columns and copy (from 1); a document stands once per copy.

    Rows that agree in doc_id, source and size are interchangeable to the mix, so per such key four counts say how many rows
    get 0, 1, 2, 3 ... copies; texts move once."""
    key = F.to_json(F.struct("doc_id", "source", "size"))
    plan = mix(docs, weights, cap, seed).withColumn("__key", key)
    share = plan.groupBy("__key").agg(*[F.count_if(F.col("copies") == c).alias(f"__c{c}") for c in range(1, cap + 1)])
    columns = docs.columns
    there = docs.withColumn("__key", F.to_json(F.struct("doc_id", "source", word_count(F.col("text")).alias("size"))))
    there = there.withColumn("__k", F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text"))))
    copies, above = F.lit(0), F.lit(0)
    for c in range(cap, 0, -1):
        low, above = above, above + F.col(f"__c{c}")
        copies = F.when((F.col("__k") > low) & (F.col("__k") <= above), F.lit(c)).otherwise(copies)
    joined = there.join(share, "__key").withColumn("__copies", copies).where("__copies > 0")
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents
), per as (
  select source, sum(size)::BIGINT as source_size from sized group by source
), named as (
  select *, row_number() over (order by source nulls last) as no from per
), weighed as (
  select *, ([5, 2, 1])[((no - 1) % 3 + 1)::INT]::BIGINT as w, source_size * 3 as cap from named
), levels as (
  select *, row_number() over l as place, coalesce(sum(cap) over (l rows between unbounded preceding and 1 preceding), 0)::BIGINT as spent,
    (sum(w) over (l rows between current row and unbounded following))::BIGINT as rest, (sum(source_size) over ())::BIGINT as total
  from weighed window l as (order by cap::DOUBLE / w, no)
), filled as (
  select *, (total - spent)::DOUBLE / rest as level from levels
), chosen as (
  select place as from_place, level as at_level from filled where level * w <= cap order by place limit 1
), targets as (
  select source, source_size, case when place < from_place then cap::DOUBLE else w * at_level end as target from filled, chosen
), placed as (
  select doc_id, size, source_size, target, (row_number() over (partition by s.source order by size, doc_id nulls last) - 1)::DOUBLE as k,
    case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('mix:' || coalesce('s' || s.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE as u
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target, size * (floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT as taken from placed
"""
