"""Operator 11: periodic run detection.

A run is a stretch of consecutive words with smallest period q, at least as long as `least` and as two periods, that no neighbouring
word extends keeping period q. Words are those up to white space.

Method: multi-scale minimizers. At scale s (a power of two) a gram is s / 2 words and a window s / 2 grams; the grams whose hash is the
window's minimum are its minimizers, all of them if they tie. A run of period s <= q < 2 s and two periods' length holds a window and
its copy q words on, so one of its minimizers stands q words before an equal one: equal minimizers that far apart seed an extension,
word by word, both ways. Inside a stretch whose own period is at most an eighth of s, equal grams would pair up without end; there the
ends of such stretches, known from the smaller scales, give the seeds (`between`). Periods below SHORT come from direct lag scans.
Hashes only propose: every run is confirmed by comparing words, and equal grams always have equal hashes, so no run is lost.

Texts of one slice are laid side by side with a separator that equals nothing, so one pass of array operations serves many documents;
the work is n log^2 n in the words of a slice, or of its longest text, plus the length of the runs found.

Defined cases: a null text, an empty one or one of white space has no words, no runs, and an empty text when collapsed; a null doc_id is
kept (and never changed by `planted`); rows that repeat are judged alike, each by itself; no rows give no rows; extra columns and
clashing names aren't touched, as only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwork.llm import tokens

#: Periods below this are found by direct lag scans; a power of two, at least 32, so that grams have 16 words or more.
SHORT = 32

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def stretches(words: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches with a period, of at least two periods and `least` words."""
    edges = np.concatenate(([-1], np.flatnonzero(words[period:] != words[:-period]), [len(words) - period]))
    long_enough = np.flatnonzero(np.diff(edges) - 1 + period >= max(least, 2 * period))
    return edges[long_enough] + 1, edges[long_enough + 1] + period


def doubled(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every window of `width` (a power of two) values."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Where a gram is the least of a window of `width` grams."""
    least = doubled(grams, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(doubled(np.concatenate((edge, least, edge)), width, np.maximum) == grams)


def pairs(grams: np.ndarray, at: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal grams at positions `at` that are near <= distance < far apart."""
    order = np.argsort(grams[at], kind="stable")
    value, place = grams[at][order], at[order]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for j in range(1, len(place)):
        gap = place[j:] - place[:-j]
        close = (value[j:] == value[:-j]) & (gap < far)
        if not close.any():
            break
        hit = close & (gap >= near)
        found.append((place[:-j][hit], gap[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def between(words: np.ndarray, short: list[tuple[int, int, int]], near: int, far: int) -> Iterator[tuple[int, int]]:
    """Seeds (position, distance) of runs that hold parts of two stretches (start, end, period) of one small period.

    In such a run either the two ends or the two starts lie one period apart; or the first stretch holds a whole period, and then it
    meets the second, and the period brings its end onto words that go on as the second does."""
    for i, (start, end, period) in enumerate(short):
        for start2, end2, period2 in short[i + 1 :]:
            if start2 >= end + far:
                break
            if period2 != period:
                continue
            if near <= start2 - start < far:
                yield start, start2 - start
            if near <= end2 - end < far:
                yield end - 1, end2 - end
            if start2 <= end:
                turn = next((d for d in range(near, near + period) if end - d >= start and np.array_equal(words[end - d : end - d + period], words[end : end + period])), far)
                yield from ((end - d, d) for d in range(turn, min(far, end - start + 1), period))


def reach(left: np.ndarray, right: np.ndarray) -> int:
    """How many words two sequences share at their beginning; looked at in growing blocks."""
    done, block = 0, 64
    most = min(len(left), len(right))
    while done < most:
        differ = left[done : min(done + block, most)] != right[done : min(done + block, most)]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + len(differ), 2 * block
    return most


def find(words: np.ndarray, longest: int, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of numbers, by start, then period. No run is longer than `longest` words."""
    runs: dict[tuple[int, int], int] = {}
    for period in range(1, min(SHORT, longest // 2 + 1)):
        for start, end in zip(*map(np.ndarray.tolist, stretches(words, period, least)), strict=True):
            runs.setdefault((start, end), period)
    grams, gram, scale = tokens.mix(words.astype(np.uint64)), 1, SHORT
    while 2 * scale <= longest:
        while gram < scale // 2:
            grams = tokens.mix(grams[:-gram] * np.uint64(0xD1342543DE82EF95) + grams[gram:])
            gram *= 2
        short = sorted((*k, q) for k, q in runs.items() if 4 * q <= gram <= k[1] - k[0])
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        for start, end, _ in short:
            inside[start] += 1
            inside[end - gram + 1] -= 1
        at = minimizers(grams, gram)
        at, gap = pairs(grams, at[np.cumsum(inside)[at] == 0], scale, 2 * scale)
        more = np.array(list(between(words, short, scale, 2 * scale)), dtype=np.int64).reshape(-1, 2)
        seeds = np.unique(np.concatenate((np.stack((gap, at), 1), more[:, ::-1])), axis=0)
        seeds = seeds[words[seeds[:, 1]] == words[seeds[:, 1] + seeds[:, 0]]]
        last, until = 0, 0
        for period, at_ in seeds.tolist():
            if period == last and at_ < until:
                continue
            start = at_ - reach(words[:at_][::-1], words[: at_ + period][::-1])
            last, until = period, at_ + reach(words[at_:], words[at_ + period :])
            if until - start >= period and until + period - start >= least:
                runs.setdefault((start, until + period), period)
        scale *= 2
    return sorted(((start, end, q) for (start, end), q in runs.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its own n words stands where, for a document that is made periodic; None: as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.concatenate((np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a column as numbers, the rows' offsets in them, and the word that each number means."""
    data, offsets = tokens.raw(texts)
    starts, ends, rows = tokens.bounds(data, offsets, tokens.SPACED)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    body = data[tokens.SPACED[data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
    return column.indices.to_numpy().astype(np.int64), np.searchsorted(rows, np.arange(len(texts) + 1)), column.dictionary


def scan(docs: DataFrame, least: int = 12, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed: the text without the words that any run repeats after
    its first period, joined by one space. docs: doc_id, text. change may first rearrange a document's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                yield judged(part.column(0), part.column(1), least, change)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def judged(ids: pa.Array, texts: pa.Array, least: int, change: Callable | None) -> pa.RecordBatch:
    words, offsets, meaning = numbered(texts)
    sizes, names = np.diff(offsets), ids.to_pylist()
    if change:
        for k, doc_id in enumerate(names):
            order = change(doc_id, int(sizes[k]))
            if order is not None:
                words[offsets[k] : offsets[k + 1]] = words[offsets[k] : offsets[k + 1]][order]
    # Word i of document k lies at i + k in the row of all words; after each document stands a number of its own.
    rows = np.repeat(np.arange(len(sizes)), sizes)
    side = np.empty(len(words) + len(sizes), dtype=np.int64)
    side[np.arange(len(words)) + rows] = words
    side[offsets[1:] + np.arange(len(sizes))] = len(meaning) + np.arange(len(sizes))
    runs = np.array(find(side, int(sizes.max(initial=0)), least), dtype=np.int64).reshape(-1, 3)
    first = offsets[:-1] + np.arange(len(sizes))
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    repeated = np.zeros(len(side) + 1, dtype=np.int64)
    np.add.at(repeated, runs[:, 0] + runs[:, 2], 1)
    np.add.at(repeated, runs[:, 1], -1)
    kept = np.cumsum(repeated)[np.arange(len(words)) + rows] == 0
    left = np.searchsorted(rows[kept], np.arange(len(sizes) + 1))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), meaning.take(pa.array(words[kept]))), pa.scalar(b" ", pa.large_binary()))
    fields = [runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    found = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32()), found)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), listed, collapsed.cast(pa.large_string()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of scan()'s rows: number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs with every run cut down to its first period; texts without a run stay as they are, white space included. Other columns pass through.

    docs: any columns, among them text. A text is shuffled nowhere: the kernel's column is added in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                k = part.schema.get_field_index("text")
                found = judged(pa.nulls(part.num_rows, pa.int64()), part.column(k), least, None)
                text = pc.if_else(pc.greater(pc.list_value_length(found.column(1)), 0), found.column(2), part.column(k).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], text, *part.columns[k + 1 :]], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def line_digest(runs: list[tuple[int, int, int]]) -> str:
    """The hash that digests() gives runs (start, length, period)."""
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
