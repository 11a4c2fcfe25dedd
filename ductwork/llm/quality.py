"""Operator 7: quality by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target text (documents labelled as good) and one of all
text, weigh each document by the log ratio of its probabilities. Gumbel top-k on the log weights draws, without replacement, a
share of the corpus distributed like the target. Counts cover all documents; the models have a fixed number of buckets.

Defined cases: null and empty texts have no features and log weight 0; without labelled documents all log weights are 0 and the
draw is uniform; a document labelled twice counts as target if any label says so; rows that repeat draw the same number; ties in
the draw go to the smaller doc_id; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.llm.common import ranked, sized, small_batches
from ductwork.llm.tokens import ALNUM, bounds, hashes, mix, raw, slices

BUCKETS = 1 << 14


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram."""
    data, at = raw(texts)
    starts, ends, rows = bounds(data, at, ALNUM)
    words = hashes(data, starts, ends)
    pair = rows[1:] == rows[:-1]
    pairs = mix(words[:-1][pair] * np.uint64(0xD1342543DE82EF95) + words[1:][pair])
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([rows, rows[1:][pair]])


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in target text (column __target) and in all text: sums by task, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row = features(batch.column(batch.schema.get_field_index("text")))
                good = np.array(batch.column(batch.schema.get_field_index("__target")).to_pylist(), bool)
                total[1] += np.bincount(bucket, minlength=BUCKETS)
                total[0] += np.bincount(bucket[good[row]], minlength=BUCKETS)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[kind, bucket], pa.int64())], names=["kind", "bucket", "n"])

    rows = docs.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BUCKETS))
    for r in rows.collect():  # at most 2 * BUCKETS rows
        out[r[0], r[1]] = r[2]
    return out[0], out[1]


def log_ratio(target: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """Log of the target's over all text's bucket probability, each with one added count; 0 without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((everything + 1) / (everything.sum() + BUCKETS))


def gumbel(doc_id: Column, seed: str) -> Column:
    """A Gumbel number that seed and doc_id fix."""
    u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row = features(batch.column(1))
                n = np.bincount(row, minlength=batch.num_rows)
                total = np.bincount(row, weights=held.value[bucket], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: str = "resample") -> DataFrame:
    """Per document: doc_id, n_features, log_weight, score (log weight per feature), draw (log weight + Gumbel), selected.

    selected marks the ceil(share * rows) rows with the highest draw. labels: doc_id, quality; 1 marks target text."""
    small_batches(docs.sparkSession)
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    target = docs.select("doc_id", "text").join(sized(good.withColumn("__good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("__target"))
    rows = weigh(docs, log_ratio(*bucket_counts(target)))
    score = F.when(F.col("n_features") > 0, F.col("log_weight") / F.col("n_features")).otherwise(F.lit(0.0))
    rows = rows.withColumn("score", score).withColumn("draw", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    placed = ranked(rows, [F.col("draw").desc(), F.col("doc_id").asc_nulls_last()])
    wanted = F.ceil(F.lit(share) * F.lit(placed.count()))
    return placed.select("doc_id", "n_features", "log_weight", "score", "draw", (F.col("__rank") < wanted).alias("selected"))
