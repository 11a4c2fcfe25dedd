"""Operator 1: URL filters by a character language-model ratio.

Two smoothed Markov models of variable order, one of accepted and one of rejected URLs, score a URL; the difference of the
log-likelihoods, divided by the length, is compared with a threshold calibrated on labelled URLs that neither model has seen.
Contexts of up to ORDER bytes back off by Witten-Bell interpolation. Explicit rules, longest first, go before the model.

Both models learn from every distinct labelled URL, whole, that held_out leaves to them; every other labelled URL takes part in
the threshold. The counts are a table of packed n-grams; what a symbol after its context adds to a score is worked out in
joins, one order after the other. Pages are dealt into blocks, and a block is scored beside the n-grams it holds, so that no task
and no driver sees a whole model.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; null counts as an empty string for
the model, which scores the end symbol alone; without labelled URLs of both classes the model accepts everything; a class
without a URL to learn from, or without one held out, takes all it has for both; rows that repeat get the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.llm.common import durable, lower_ascii
from ductwork.llm.tokens import LOWER, mix, raw, slices
from ductwork.storage import deleted, stored

#: Longest context, in bytes.
ORDER = 4
#: Symbols: 256 byte values, lower-cased, and the end of a URL.
END = 256
SYMBOLS = 257
#: Stands before a URL's first symbol where a context reaches beyond it.
START = 257
#: A packed n-gram has its last symbol lowest, in base SIZE: gram % SIZE ** k are the last k symbols.
SIZE = 258
#: Symbols packed at once, more than SLICE bytes of several URLs have; a longer URL is cut at multiples of it.
PIECE, SLICE = 1 << 21, 1 << 20

#: The contract's rules (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path up to "?", "#" or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    longest = sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]))

    def add(found: Column, rule: tuple[str, str, str]) -> Column:
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        return F.when(fits, F.struct(F.lit(rule[0] + rule[1]).alias("rule"), F.lit(rule[2]).alias("verdict"))).otherwise(found)

    return reduce(add, longest, F.lit(None).cast("struct<rule:string,verdict:string>"))


@dataclass
class Chain:
    """Counts of one class: for each order, sorted hashes of contexts with their totals and kinds, and of context + symbol with counts."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, urls: list[bytes]) -> Chain:
        data, starts = symbols(urls)
        contexts, grams = [], []
        for context, gram in hashed(data, starts):
            ids, counts = np.unique(gram, return_counts=True)
            owner = np.zeros(len(ids), np.uint64)
            owner[np.searchsorted(ids, gram)] = context
            own, back = np.unique(owner, return_inverse=True)
            contexts.append((own, np.bincount(back, weights=counts), np.bincount(back).astype(float)))
            grams.append((ids, counts.astype(float)))
        return cls(contexts, grams)

    def log_probability(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability after the symbols before it."""
        p = np.full(len(data), 1.0 / SYMBOLS)
        for (own, total, kinds), (ids, counts), (context, gram) in zip(self.contexts, self.grams, hashed(data, starts), strict=True):
            n, t, c = found(own, context, total), found(own, context, kinds), found(ids, gram, counts)
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def found(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values by key, 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def symbols(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All URLs as one row of symbols, each ended by END, and where each starts."""
    data = np.concatenate([np.append(LOWER[np.frombuffer(u, np.uint8)].astype(np.int64), END) for u in urls]) if urls else np.zeros(0, np.int64)
    return data, np.cumsum([0, *(len(u) + 1 for u in urls)])[:-1]


def hashed(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0: hashes of every symbol's context and of context + symbol. A context stops at its URL's start."""
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    place = np.arange(len(data)) - begin
    context = np.full(len(data), 7, np.uint64)
    code = data.astype(np.uint64) + np.uint64(1)
    for k in range(ORDER + 1):
        if k:
            before = np.zeros(len(data), np.uint64)
            before[k:] = code[:-k]
            before[place < k] = 999
            context = mix(context * np.uint64(1009) + before)
        yield context, mix(context ^ (code * np.uint64(0x9E3779B97F4A7C15)))


@dataclass
class UrlModel:
    accepted: Chain | None
    rejected: Chain | None
    threshold: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood difference per symbol: above 0, the URL looks more like an accepted one."""
        if self.accepted is None or self.rejected is None or not urls:
            return np.zeros(len(urls))
        data, starts = symbols(urls)
        gain = self.accepted.log_probability(data, starts) - self.rejected.log_probability(data, starts)
        return np.add.reduceat(gain, starts) / np.array([len(u) + 1 for u in urls])


def fit(accepted: list[str], rejected: list[str]) -> UrlModel:
    """The model of a few URLs in memory, as the tests compare it. Every fifth URL of each class is held out for the threshold,
    the one with the best balanced accuracy (nearest 0 if several)."""
    if not accepted or not rejected:
        return UrlModel(None, None, 0.0)
    a, r = [u.encode() for u in accepted], [u.encode() for u in rejected]
    parts = [(x[::5], [u for i, u in enumerate(x) if i % 5] or x) for x in (a, r)]
    model = UrlModel(Chain.fit(parts[0][1]), Chain.fit(parts[1][1]), 0.0)
    good, bad = np.sort(model.scores(parts[0][0])), np.sort(model.scores(parts[1][0]))
    marks = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[0.0], (marks[1:] + marks[:-1]) / 2, [marks[0] - 1e-9, marks[-1] + 1e-9]])
    balance = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[balance >= balance.max() - 1e-12]
    return UrlModel(model.accepted, model.rejected, float(best[np.argmin(np.abs(best))]))


def held_out(url: Column) -> Column:
    """A fifth of the URLs, by hash, is kept from the models and calibrates the threshold."""
    return F.pmod(F.xxhash64(url), F.lit(5)) == 0


def packed(urls: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every symbol with the ORDER symbols before it, packed into one number, and its row; in pieces of at most PIECE symbols."""
    data, at = raw(urls)
    line = np.insert(LOWER[data].astype(np.int16), at[1:], END)
    first = at[:-1] + np.arange(len(at) - 1)
    for low in range(0, len(line), PIECE):
        here = np.arange(low, min(low + PIECE, len(line)))
        row = np.searchsorted(first, here, side="right") - 1
        place = here - first[row]
        gram = line[here].astype(np.int64)
        for k in range(1, ORDER + 1):
            gram += np.where(place >= k, line[np.maximum(here - k, 0)], START).astype(np.int64) * SIZE**k
        yield gram, row


def pair_counts(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of owner and gram, and how often each occurs."""
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])]))
    return owner[new], gram[new], np.diff(np.append(new, len(order)))


def grams_of(rows: DataFrame, url: str, owner: str) -> DataFrame:
    """owner (a long), gram and n, how often the gram occurs in URLs of this owner; a pair may stand in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(1).to_numpy(zero_copy_only=False)
            for gram, row in packed(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair_counts(of[row], gram)], names=["owner", "gram", "n"])

    return rows.select(url, owner).mapInArrow(count, "owner long, gram long, n long")


def gains(counts: DataFrame) -> DataFrame:
    """gram and gain: the log-probability of the gram's last symbol after its context in accepted URLs, less that in rejected ones.

    counts: distinct gram, allow, block; all that is to be scored, with 0 where a class doesn't hold it. Each order needs the one
    below: a context or a shorter gram has at most SIZE grams, so no key of a join or window holds more."""
    lower = None
    context = Window.partitionBy("__context")
    for k in range(ORDER + 1):
        level = counts.groupBy((F.col("gram") % SIZE ** (k + 1)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        level = level.withColumn("__context", F.expr(f"gram div {SIZE}"))
        if lower is None:
            level = level.withColumns({f"__{kind}": F.lit(1.0 / SYMBOLS) for kind in ("allow", "block")})
        else:
            level = level.withColumn("__shorter", F.col("gram") % SIZE**k).join(lower, "__shorter")
        p = {}
        for kind in ("allow", "block"):
            n, kinds = F.sum(kind).over(context), F.sum((F.col(kind) > 0).cast("long")).over(context)
            p[kind] = F.when(n > 0, (F.col(kind) + kinds * F.col(f"__{kind}")) / (n + kinds)).otherwise(F.col(f"__{kind}"))
        lower = level.select(F.col("gram").alias("__shorter"), *[p[kind].alias(f"__{kind}") for kind in p])
    return lower.select(F.col("__shorter").alias("gram"), (F.log("__allow") - F.log("__block")).alias("gain"))


def block_of(url: Column) -> Column:
    """Blocks of neighbouring rows with at most 8 MB of URLs, or one longer URL. Rows must be stored before it is used again."""
    at, n = F.monotonically_increasing_id(), F.coalesce(F.octet_length(url), F.lit(0))
    return F.when(n < 1 << 11, F.shiftright(at, 12) * 4).when(n < 1 << 16, F.shiftright(at, 7) * 4 + 1).otherwise(at * 4 + 2)


def scored(rows: DataFrame, url: str, block: str, gain: DataFrame) -> DataFrame:
    """The rows with __score, the length-normalised log-likelihood difference; gain: block, gram, gain of all grams of the block's URLs."""

    def score(part: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = known.column("gram").to_numpy(), known.column("gain").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for some in slices(part, url, SLICE):
            total, length = np.zeros(some.num_rows), np.zeros(some.num_rows)
            for gram, row in packed(some.column(url)):
                total += np.bincount(row, values[np.searchsorted(keys, gram)], some.num_rows)
                length += np.bincount(row, minlength=some.num_rows)
            out.append(total / length)
        return part.append_column("__score", pa.array(np.concatenate(out), pa.float64()))

    schema = rows.withColumn("__score", F.lit(0.0)).schema
    return rows.groupBy(block).cogroup(gain.groupBy(block)).applyInArrow(score, schema)


def threshold_of(marks: DataFrame) -> float:
    """The cut with the best balanced accuracy, nearest 0 if several; accepted are scores from the cut on.

    marks: score, good, bad (accepted and rejected URLs with this score). A range exchange sorts them, each range is summed up
    in itself, and the ranges' sums, one row each, come before. Cuts lie halfway between neighbouring scores, at 0 and below all."""
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = marks.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    marks = durable(marks.repartitionByRange(parts, "score").sortWithinPartitions("score").withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = marks.groupBy("__part").agg(F.sum("good").alias("__good"), F.sum("bad").alias("__bad"), F.min("score").alias("__least"))
    ranges = ranges.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__good", "__bad")], F.lead("__least").over(Window.orderBy("__part")).alias("__next"))
    inside = Window.partitionBy("__part").orderBy("score")
    below = [(F.col(f"__{c}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(f"{c}_below") for c in ("good", "bad")]
    cuts = marks.join(F.broadcast(ranges), "__part").select("score", *below, F.coalesce(F.lead("score").over(inside), "__next", F.col("score") + 2e-9).alias("next"))
    half = (F.col("score") + F.col("next")) / 2
    cuts = cuts.select("good_below", "bad_below", F.when(half > F.col("score"), half).otherwise(F.col("next")).alias("cut"))
    low = F.col("score") < 0
    all_of = marks.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("least"), *[F.coalesce(F.sum(F.when(low, F.col(c))), F.lit(0)).alias(f"{c}_low") for c in ("good", "bad")]).first()
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    value = exact("bad_below") * F.lit(all_of.good).cast("decimal(18,0)") - exact("good_below") * F.lit(all_of.bad).cast("decimal(18,0)")
    best = cuts.orderBy(value.desc(), F.abs("cut"), "cut").first()
    found = [(best.good_below, best.bad_below, best.cut), (all_of.good_low, all_of.bad_low, 0.0), (0, 0, all_of.least - 1e-9)]
    return min(found, key=lambda f: (f[0] * all_of.bad - f[1] * all_of.good, abs(f[2]), f[2]))[2]


def with_score(rows: DataFrame, url: str, label: str) -> tuple[DataFrame, float]:
    """The rows with __score, and the threshold. label: allow or block where the row's URL is labelled; else null."""
    rows = stored(rows.withColumn("__block", block_of(F.col(url))))
    labelled = rows.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(url, label, held_out(F.col(url)).alias("__held"))
    there = {(r[0], r[1]) for r in labelled.select(label, "__held").distinct().collect()}
    if {kind for kind, _ in there} != {"allow", "block"}:
        return rows.drop("__block").withColumn("__score", F.lit(0.0)), 0.0
    whole = lambda held: [kind for kind in ("allow", "block") if (kind, held) not in there]
    learnt = labelled.where(~F.col("__held") | F.col(label).isin(whole(False))).select(url, (F.col(label) == "allow").cast("long").alias("allow")).distinct()
    needed = stored(grams_of(rows, url, "__block").select(F.col("owner").alias("__block"), "gram").distinct())
    of = {"allow": F.col("n") * F.col("owner"), "block": F.col("n") * (1 - F.col("owner"))}
    seen = grams_of(learnt, url, "allow").select("gram", *[c.alias(kind) for kind, c in of.items()])
    zero = F.lit(0).cast("long")
    counts = stored(seen.unionByName(needed.select("gram", zero.alias("allow"), zero.alias("block"))).groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    done = stored(scored(rows, url, "__block", needed.join(gains(counts), "gram")).drop("__block"))
    for finished in (rows, needed, counts):
        deleted(rows.sparkSession, finished.__dict__["stored_at"])
    asked = done.where(F.col(url).isNotNull() & (held_out(F.col(url)) | F.col(label).isin(whole(True)))).where(F.col(label).isNotNull())
    good = (F.col(label) == "allow").cast("long")
    marks = asked.groupBy(url, label).agg(F.min("__score").alias("score")).select("score", good.alias("good"), (1 - good).alias("bad"))
    return done, threshold_of(marks)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score, threshold. URLs that rules decide are the labelled ones."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    split = split.select("page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), F.col("__rule.verdict").alias("__by_rule"))
    rows, threshold = with_score(split, "url", "__by_rule")
    by_model = F.when(F.col("__score") >= threshold, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("__by_rule", by_model).alias("verdict"), F.col("__score").alias("score"), F.lit(threshold).alias("threshold"))
