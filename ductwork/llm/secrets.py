"""Operator 10: secret scans with a random forest that removes false positives.

Generators propose candidates: provider-like prefixes, values assigned to secret-like names, and long runs of mixed characters.
A random forest judges each by its length, character transitions, dictionary coverage (the share of its letter trigrams that
are common in the corpus), its path (how many candidates the document's source has, and the share of secrets among those that the
formats label) and neighbouring words. It is fitted on labelled findings, at most
sample rows by hash order; without such labels, findings are labelled by format: fixed provider formats and assigned
hexadecimal values are secrets; what is placed inside addresses, numbers, or repeats few characters is not. The forest doesn't see which
generator proposed a candidate, as the formats' labels follow it.

Defined cases: null and empty texts have no candidates; findings of one class only make every probability that class; rows that
repeat give their findings again; texts are scanned whole; a null source counts as empty. Sources are counted in PATHS buckets by
hash; values fall in two folds, and a candidate takes its source's share of secrets from the other one. An empty table gives no
rows; columns besides doc_id, text and source are passed over; a text of any length is read whole, with its slice of the batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwork.llm.common import durable, small_batches
from ductwork.llm.tokens import LOWER, raw, slices

PREFIXED = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{12,20}\b|\bgh[pousr]_[0-9A-Za-z]{20,}\b|\bsk_live_[0-9A-Za-z]{16,}\b|\bxox[abp]-[0-9A-Za-z-]{10,}\b")
ASSIGNED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|auth)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Formats that label a finding when no labels are given.
PROVIDER = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}")
HEX = re.compile(r"[0-9a-f]{16,64}")
CUES = re.compile(r"(?i)password|passwd|pwd|secret|token|key|auth|credential")
SAMPLES = re.compile(r"(?i)example|sample|dummy|changeme|xxxx|placeholder")
FEATURES = ("length", "transitions", "entropy", "digits", "upper", "symbols", "coverage", "cue_before", "sample_near", "quoted", "path_candidates", "path_secrets", "neighbour_words")
#: Buckets of sources.
PATHS = 1 << 14


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and generator of each candidate; a span is proposed once, by the first generator that finds it."""
    found: dict[tuple[int, int], str] = {}
    for m in PREFIXED.finditer(text):
        found.setdefault(m.span(), "prefixed")
    for m in ASSIGNED.finditer(text):
        found.setdefault(m.span(1), "assigned")
    for m in LONG.finditer(text):
        if re.search(r"[0-9]", m[0]) or re.search(r"[a-z][A-Z]", m[0]):
            found.setdefault(m.span(), "long")
    return sorted((a, b, kind) for (a, b), kind in found.items())


def kinds_of(value: str) -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 other, per character."""
    c = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    return np.select([(c >= 97) & (c <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57)], [0, 1, 2], 3)


def trigrams(lowered: np.ndarray) -> np.ndarray:
    """Codes, below 26^3, of all runs of three letters in lower-cased bytes."""
    c = lowered.astype(np.int64) - 97
    ok = (c >= 0) & (c < 26)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return (c[:-2] * 676 + c[1:-1] * 26 + c[2:])[ok[:-2] & ok[1:-1] & ok[2:]]


def describe(text: str, start: int, end: int, common: np.ndarray) -> list[float]:
    """The features of one candidate, as FEATURES names them; those of the path are 0 until with_paths."""
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    k = kinds_of(value)
    _, counts = np.unique(list(value), return_counts=True)
    p = counts / len(value)
    grams = trigrams(LOWER[np.frombuffer(value.encode(), np.uint8)])
    words = re.findall(r"[A-Za-z\x80-\U0010ffff]{2,}", before + " " + after)
    return [
        len(value), float((k[1:] != k[:-1]).mean()) if len(k) > 1 else 0.0, float(-(p * np.log2(p)).sum()), float((k == 2).mean()), float((k == 1).mean()), float((k == 3).mean()),
        float(common[grams].sum() / max(1, len(value) - 2)), float(bool(CUES.search(before))), float(bool(SAMPLES.search(value + before))),
        float(before[-1:] in ("'", '"')), 0.0, 0.0, float(len(words)),
    ]


def common_trigrams(docs: DataFrame, share: float = 0.9) -> np.ndarray:
    """The corpus dictionary: which letter trigrams make up this share of all; one number per trigram leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(26**3, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                total += np.bincount(trigrams(LOWER[raw(batch.column(0))[0]]), minlength=26**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    out = np.zeros(26**3)
    for r in docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    order = np.argsort(-out, kind="stable")
    inside = np.cumsum(out[order]) <= share * out.sum()
    common = np.zeros(26**3, bool)
    common[order[inside]] = out[order[inside]] > 0
    return common


def path_of(source: str | None, value: str) -> int:
    """The bucket of a source, twice, plus the value's fold (0 or 1)."""
    return zlib.crc32((source or "").encode()) % PATHS * 2 + (zlib.crc32(value.encode()) & 1)


def findings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), kind, value, weak (label by format, null if unsure), path, features."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                source = batch.column(2)[r].as_py() if text else ""
                for start, end, kind in candidates(text or ""):
                    value = text[start:end]
                    out.append((batch.column(0)[r].as_py(), start, end, kind, value, weak_label(value, kind, text[max(0, start - 12) : start]), path_of(source, value), describe(text, start, end, common)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "end", "kind", "value", "weak", "path", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "source").mapInArrow(run, f"doc_id {kind}, start long, end long, kind string, value string, weak int, path int, features array<double>")


def path_counts(rows: DataFrame) -> np.ndarray:
    """Per bucket of sources and fold the candidates, those that the formats label, and the secrets among these; two rows a bucket at most reach the driver."""
    out = np.zeros((2 * PATHS, 3))
    for r in rows.groupBy("path").agg(F.count(F.lit(1)), F.count("weak"), F.sum("weak")).collect():
        out[r[0]] = r[1], r[2], r[3] or 0
    return out


def path_features(x: np.ndarray, path: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The features with those of the path filled in. The share of secrets is that of the source's other fold, so that no label tells of itself.

    It is drawn towards the share in all sources, as if each source had two more labels at that share."""
    every, other = counts.sum(axis=0), counts[path ^ 1]
    of_all = every[2] / max(1.0, every[1])
    x = x.copy()
    x[:, FEATURES.index("path_candidates")] = np.log2(1 + counts[path, 0] + other[:, 0])
    x[:, FEATURES.index("path_secrets")] = (other[:, 2] + 2 * of_all) / (other[:, 1] + 2)
    return x


def weak_label(value: str, kind: str, before: str) -> int | None:
    """1 for fixed provider formats and assigned hexadecimal values, 0 for plain numbers, samples and few repeated characters, else unsure."""
    if SAMPLES.search(value):
        return 0
    if PROVIDER.fullmatch(value) or kind == "assigned" and HEX.fullmatch(value):
        return 1
    if re.fullmatch(r"[0-9+/_=-]+", value) or len(set(value)) <= 4 or re.search(r"(?://|@)\S*$", before):
        return 0
    return 0 if kind == "long" and not re.search(r"[0-9]", value) else None


class Forest:
    """Classification trees on bootstrap samples with random feature subsets, grown in numpy; a tree is arrays of its nodes."""

    def __init__(self, trees: int = 24, depth: int = 7, least: int = 3, seed: int = 5) -> None:
        self.size, self.depth, self.least, self.seed = trees, depth, least, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.size):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[list[float]], rng: np.random.Generator) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y.mean())])  # feature, cut, left, right, share of ones
        if depth >= self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return here
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            at = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= self.least) & (len(y) - n[:-1] >= self.least))
            if not len(at):
                continue
            left, right = ones[at] / n[at], (ones[-1] - ones[at]) / (len(y) - n[at])
            impurity = n[at] * left * (1 - left) + (len(y) - n[at]) * right * (1 - right)
            k = int(np.argmin(impurity))
            gain = len(y) * y.mean() * (1 - y.mean()) - impurity[k]
            if gain > best[0]:
                best = (float(gain), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
        if best[1] < 0:
            return here
        goes = x[:, best[1]] <= best[2]
        nodes[here][:2] = best[1], best[2]
        nodes[here][2] = self._grow(x[goes], y[goes], depth + 1, nodes, rng)
        nodes[here][3] = self._grow(x[~goes], y[~goes], depth + 1, nodes, rng)
        return here

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at].astype(np.int64)
                inner = f >= 0
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]).astype(np.int64), at)
            total += share[at]
        return total / max(1, len(self.trees))


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), kind, value_sha256, probability, secret (probability at or above threshold).

    The value itself is not returned: who may read the text finds it there.
    labelled: findings() rows with an int label (1 secret, 0 not), from earlier reviews; else the weak labels teach the forest."""
    rows = durable(findings(docs, common_trigrams(docs)))
    teach = labelled if labelled is not None else rows.where("weak is not null").withColumn("label", F.col("weak"))
    some = teach.orderBy(F.xxhash64("value", "kind"), "doc_id", "start").limit(sample).select("features", "label", "path").collect()
    counts = path_counts(rows)
    y = np.array([r[1] for r in some], float)
    forest = Forest().fit(path_features(np.array([r[0] for r in some], float), np.array([r[2] for r in some]), counts), y) if len(some) else Forest()
    held = docs.sparkSession.sparkContext.broadcast((forest, counts))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts = held.value
        for batch in batches:
            x = np.array(batch.column(5).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            x = path_features(x, batch.column(6).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(forest.probability(x), pa.float64())], names=["doc_id", "start", "end", "kind", "value_sha256", "probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "start", "end", "kind", F.sha2("value", 256), "features", "path").mapInArrow(judge, f"doc_id {kind}, start long, end long, kind string, value_sha256 string, probability double")
    return out.withColumn("secret", F.col("probability") >= threshold)
