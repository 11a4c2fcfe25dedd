"""Operator 9: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its byte n-grams (3 to 5, with boundary marks) and of itself; a passage of a few words
is the average of its words, short enough that one bad word is not lost in it; a linear softmax on top scores the passage. A document pools its passages by a log-mean-exp, which
leans towards the worst ones, so long texts do not dilute a few toxic words. Embeddings and softmax are trained together, by
Adam, through the pooling, which sharpens from an average as the training goes on. Unseen misspellings share the n-grams of what they misspell.

The model is fitted on a bounded sample of labelled rows: at most sample rows of each class, by hash of doc_id, with texts of at
most longest characters. A part of it is kept for calibration (a logistic fit of the score, its rows weighed so that both classes stand as
often as among all labelled rows). Passage length and step size are what `cross_validated` prefers on the rows that aren't held
out; held-out rows are only ever scored. Scoring covers every document whole.

Defined cases: null and empty texts have no passage and get the score of the bias alone; without labelled rows of both classes
every score is the base rate (0 without labels); rows that repeat get the same score; a null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwork.llm.common import small_batches
from ductwork.llm.tokens import ALNUM, LOWER, bounds, hashes, mix, raw, slices

BUCKETS = 1 << 16
DIMENSIONS = 8
#: Words of a passage and step size of the training.
PASSAGE, RATE = 2, 0.1
#: A word is a small part of a passage's average; the softmax sees the average times this and the passage's length.
GAIN = 4.0
#: A text pools its passages' scores s as log(mean(exp(SHARP * s))) / SHARP: near their average where SHARP is small, near the worst where it is large.
SHARP = 2.0
#: Lengths of the n-grams, in bytes.
SHORT, LONG = 3, 5


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner (place in starts) and bucket of every n-gram of the words and of the words themselves; ids are the words' hashes."""
    sizes = ends - starts + 2
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - at[owner]
    marked = np.full(len(owner), 1, np.uint64)
    body = (inner > 0) & (inner < sizes[owner] - 1)
    marked[body] = LOWER[data[(starts[owner] + inner - 1)[body]]].astype(np.uint64) + np.uint64(2)
    owners, buckets = [np.arange(len(starts))], [ids % np.uint64(BUCKETS)]
    h = np.zeros(len(owner), np.uint64)
    for k in range(LONG):
        n = len(owner) - k
        if n <= 0:
            break
        h = h[:n] * np.uint64(0x100000001B3) + marked[k:]
        if k + 1 >= SHORT:
            whole = owner[:n] == owner[k:]
            owners.append(owner[:n][whole])
            buckets.append(mix(h[whole] + np.uint64(k)) % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


@dataclass
class Words:
    """Words of some texts: each text's passages, each passage's words, each distinct word's subwords."""

    word: np.ndarray  # place among the distinct words
    passages: np.ndarray  # first word of each passage
    texts: np.ndarray  # text of each passage
    n_texts: int
    owner: np.ndarray
    bucket: np.ndarray
    n_words: int

    @classmethod
    def of(cls, texts: pa.Array, passage: int) -> Words:
        data, at = raw(texts)
        starts, ends, rows = bounds(data, at, ALNUM)
        ids, first, word = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        counts = np.bincount(rows, minlength=len(texts))
        place = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
        passages = np.flatnonzero(place % passage == 0)
        owners, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in range(0, len(ids), 1 << 15):
            some = first[i : i + (1 << 15)]
            owner, bucket = subwords(data, starts[some], ends[some], ids[i : i + (1 << 15)])
            owners.append((owner + i).astype(np.int32))
            buckets.append(bucket.astype(np.int32))
        return cls(word.astype(np.int32), passages, rows[passages], len(texts), np.concatenate(owners), np.concatenate(buckets), len(ids))

    def passage_means(self, value: np.ndarray) -> np.ndarray:
        """Average over a passage's words of a value of distinct words."""
        if not len(self.passages):
            return np.zeros(0)
        sizes = np.diff(np.append(self.passages, len(self.word)))
        return np.add.reduceat(value[self.word], self.passages) / sizes

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First passage of each text that has one, and for each passage the place of its text among these."""
        begin = np.flatnonzero(np.append(True, self.texts[1:] != self.texts[:-1])) if len(self.texts) else np.zeros(0, np.int64)
        return begin, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(self.texts))))

    def pooled(self, score: np.ndarray, sharp: float) -> tuple[np.ndarray, np.ndarray]:
        """Each text's pooled score, for texts with passages, and each passage's share in it."""
        begin, run = self.runs()
        if not len(begin):
            return np.zeros(0), np.zeros(0)
        top = np.maximum.reduceat(score, begin)
        power = np.exp(sharp * (score - top[run]))
        total = np.add.reduceat(power, begin)
        return top + np.log(total / np.diff(np.append(begin, len(score)))) / sharp, power / total[run]


@dataclass
class ToxicityModel:
    """The embeddings times the softmax's weight difference, one number per bucket, the bias, and the calibration's slope and shift."""

    bucket_value: np.ndarray
    bias: float
    slope: float
    shift: float
    passage: int = PASSAGE

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words.of(texts, self.passage)
        n = np.maximum(np.bincount(words.owner, minlength=words.n_words), 1)
        value = np.bincount(words.owner, weights=self.bucket_value[words.bucket], minlength=words.n_words) / n
        logit = np.full(words.n_texts, self.bias)
        logit[words.texts[words.runs()[0]]] += words.pooled(words.passage_means(value), SHARP)[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -500, 500)))


def fit(texts: list[str], labels: np.ndarray, frequency: np.ndarray | None = None, passage: int = PASSAGE, steps: int = 80, rate: float = RATE, decay: float = 3e-4, quiet: float = 1e-3, spread: float = 0.01, seed: int = 7) -> ToxicityModel:
    """Joint training by Adam over the whole sample; every fourth text is kept for the calibration. frequency: of how many labelled rows each text stands for one."""
    gain = GAIN * passage
    flat = np.zeros(BUCKETS, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(flat, 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    kept = np.arange(len(labels)) % 4 == 3
    if len(labels) < 40 or len(set(labels[kept])) < 2:
        kept[:] = False
    w = Words.of(pa.array([t for t, k in zip(texts, kept, strict=True) if not k], pa.string()), passage)
    y = labels[~kept].astype(float)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, spread, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    n_sub = np.maximum(np.bincount(w.owner, minlength=w.n_words), 1)
    sizes = np.diff(np.append(w.passages, len(w.word)))
    begin, run = w.runs()
    of_text = w.texts[begin]
    weight = np.where(y[of_text] == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("emb", emb), ("soft", soft), ("bias", bias))}

    def adam(key: str, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = state[key]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + quiet)

    for t in range(1, steps + 1):
        push = soft[1] - soft[0]
        value = gain * np.bincount(w.owner, weights=(emb @ push)[w.bucket], minlength=w.n_words) / n_sub
        score = np.add.reduceat(value[w.word], w.passages) / sizes
        pool, share = w.pooled(score, SHARP * t / steps)
        p = 1 / (1 + np.exp(-np.clip(pool + bias[1] - bias[0], -50, 50)))
        g = (p - y[of_text]) * weight  # by the difference of the two logits
        by_word = gain * np.bincount(w.word, weights=np.repeat(share * g[run] / sizes, sizes), minlength=w.n_words) / n_sub
        by_bucket = np.bincount(w.bucket, weights=by_word[w.owner], minlength=BUCKETS).astype(np.float32)
        d_push = by_bucket @ emb
        adam("emb", emb, by_bucket[:, None] * push[None, :] + decay * emb, t)
        adam("soft", soft, np.stack([-d_push, d_push]), t)
        adam("bias", bias, np.array([-g.sum(), g.sum()], np.float32), t)
    model = ToxicityModel((gain * (emb @ (soft[1] - soft[0]))).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, passage)
    if kept.any():
        model.slope, model.shift = calibrate(model, [t for t, k in zip(texts, kept, strict=True) if k], labels[kept].astype(float), None if frequency is None else frequency[kept])
    return model


def cross_validated(texts: list[str], labels: np.ndarray, passages: tuple[int, ...] = (2, 4, 8, 16), rates: tuple[float, ...] = (0.05, 0.1, 0.2), folds: int = 3) -> list[tuple[float, int, float]]:
    """(mean log loss, passage, rate), best first, over folds of labelled texts that aren't held out. Texts come in a random order.

    Passages have two words or more: the method averages words. On the 2,635 open rows of the 100 MB table, two words and 0.1 had the least loss
    (0.0698; 0.0708 with 0.2, 0.0781 with 0.05, 0.116 and more with four words or more)."""
    fold, out = np.arange(len(labels)) % folds, []
    for passage in passages:
        for rate in rates:
            loss = 0.0
            for f in range(folds):
                model = fit([t for t, k in zip(texts, fold, strict=True) if k != f], labels[fold != f], passage=passage, rate=rate)
                p = np.clip(model.scores(pa.array([t for t, k in zip(texts, fold, strict=True) if k == f], pa.string())), 1e-6, 1 - 1e-6)
                loss -= float(np.where(labels[fold == f] == 1, np.log(p), np.log(1 - p)).sum())
            out.append((loss / max(1, len(labels)), passage, rate))
    return sorted(out)


def calibrate(model: ToxicityModel, texts: list[str], y: np.ndarray, frequency: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic fit on texts not trained on, by Newton steps that are halved until they help; a small penalty keeps it finite."""
    p = np.clip(model.scores(pa.array(texts, pa.string())), 1e-9, 1 - 1e-9)
    x = np.log(p / (1 - p))
    weight = np.ones(len(y)) if frequency is None else frequency / frequency.mean()

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (v[0] - 1) ** 2 + 0.005 * v[1] ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -50, 50)))
        s = weight * q * (1 - q)
        grad = np.array([(weight * (q - y) * x).sum() + at[0] - 1, (weight * (q - y)).sum() + 0.01 * at[1]])
        step = np.linalg.solve(np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]]), grad)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-7:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, longest: int) -> DataFrame:
    """h, doc_id, text, toxic, frequency (labelled rows of the class for each one drawn): at most sample rows of each class, those with the smallest hashes of doc_id; only rows that are not held out.

    The labels are sampled first; only their few texts are then looked up."""
    open_ = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [open_.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    share = open_.groupBy("toxic").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / sample).alias("frequency"))
    chosen = F.broadcast(drawn[0].union(drawn[1]).join(F.broadcast(share), "toxic"))  # at most 2 * sample rows; two rows
    texts = docs.select("doc_id", "text").where(F.length("text") <= longest).join(chosen, "doc_id").groupBy("doc_id", "toxic", "frequency").agg(F.min("text").alias("text"))
    return texts.select(F.xxhash64("doc_id", F.lit("mixed")).alias("h"), "doc_id", "text", F.col("toxic").cast("int").alias("toxic"), "frequency")


def trained(docs: DataFrame, labels: DataFrame, sample: int = 2_000, longest: int = 40_000) -> ToxicityModel:
    """The model, fitted in one task on the bounded sample; its numbers, one per bucket, come back to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows], dtype=int), np.array([r[4] for r in rows], dtype=float))
        yield pa.RecordBatch.from_arrays([pa.array([model.bucket_value.astype(np.float32).tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))], names=["value", "bias", "slope", "shift"])

    rows = training_rows(docs, labels, sample, longest)
    r = rows.coalesce(1).mapInArrow(learn, "value binary, bias double, slope double, shift double").first()
    if r is None:
        return fit([], np.zeros(0, int))
    return ToxicityModel(np.frombuffer(bytes(r[0]), np.float32), r[1], r[2], r[3])


def with_score(docs: DataFrame, model: ToxicityModel, column: str = "__score") -> DataFrame:
    """All columns of docs and the score of the text, scanned whole."""
    small_batches(docs.sparkSession)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score = held.value.scores(batch.column(batch.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = 2_000, longest: int = 40_000, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. labels: doc_id, toxic; only its rows that are not held out are learnt."""
    rows = with_score(docs.select("doc_id", "text"), trained(docs, labels.select("doc_id", "toxic"), sample, longest))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def words_of(text: str) -> list[str]:
    """The words of one text, for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
