"""Operator 2: n-gram Jaccard join by vertical partitioning.

All n-grams have one global order: how common they are (a count sketch of fixed size over all documents), then their hash. The
order is cut into fragments. A pair that links must share an n-gram within its prefixes, the rarest part of the order; such
candidates, under a positional bound, are verified by counting the overlap of each fragment separately and summing per pair.

Documents with the same set are one node. A first round compares each node only with the leading node of every prefix n-gram;
the components of the links found keep the second round, over all pairs that share a prefix n-gram, to pairs from different
components. Components come out whole: a pair that is never compared lies in one component already, or cannot link.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a text of fewer than n words is one
n-gram; rows that repeat a doc_id are documents of their own, and their component is the smallest doc_id of any; a null doc_id
is never the smallest. Sets are compared by 56-bit hashes of their n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.llm.common import durable, sized, small_batches, without
from ductwork.llm.tokens import SPACED, bounds, hashes, mix, raw, shingles, slices
from ductwork.operators.trees import components

#: Buckets of the count sketch, a power of two, and of its parts in the shuffle.
SKETCH = 1 << 22
PART = 1 << 13
FRAGMENTS = 4
#: Rows of one n-gram, by the sketch, that share a leading node; beyond, they are split by hash.
HOT = 5_000


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words."""
    data, at = raw(texts)
    starts, ends, rows = bounds(data, at, SPACED)
    return shingles(hashes(data, starts, ends), rows, len(texts), n)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def global_order(docs: DataFrame, n: int) -> Order:
    """The order by how many n-grams of all documents fall in each bucket. Parts are summed as they stream by; SKETCH numbers reach the driver."""

    def pack(total: dict[int, np.ndarray] | list[np.ndarray]) -> pa.RecordBatch:
        items = [(k, c) for k, c in (total.items() if isinstance(total, dict) else enumerate(total)) if c.any()]
        packed = [zlib.compress(c.astype(np.uint8 if c.max() < 256 else np.int64).tobytes(), 1) for _, c in items]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.int32()), pa.array([bool(c.max() >= 256) for _, c in items], pa.bool_()), pa.array(packed, pa.binary())], names=["part", "wide", "counts"])

    def unpack(wide: bool, counts: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(counts), np.int64 if wide else np.uint8).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(SKETCH, np.int32), [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                waiting.append(bucket(grams(batch.column(0), n)[0]).astype(np.int32))
                size += len(waiting[-1])
                if size >= SKETCH // 2:
                    total += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.int32)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.int32)
        yield pack([total[k : k + PART] for k in range(0, SKETCH, PART)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, wide, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + unpack(wide, counts)
        yield pack(total)

    form = "part int, wide boolean, counts binary"
    parts = docs.select("text").mapInArrow(count, form).repartition("part").mapInArrow(add, form).collect()
    return Order((r[0], unpack(r[1], r[2])) for r in parts)


class Order:
    """The global order of n-grams: a key's upper 8 bits grow with the sketch's count, the lower 56 are the hash's; and its cuts."""

    def __init__(self, parts: Iterable[tuple[int, np.ndarray]]) -> None:
        self.level, mass = np.zeros(SKETCH, np.uint8), np.zeros(256)
        for k, counts in parts:
            level = np.minimum(255, np.floor(np.log2(counts + 1) * 8)).astype(np.uint8)
            self.level[k * PART : (k + 1) * PART] = level
            mass += np.bincount(level, weights=counts, minlength=256)
        upto = np.cumsum(mass)
        cuts = []
        for k in range(1, FRAGMENTS):
            want = upto[-1] * k / FRAGMENTS
            at = int(np.searchsorted(upto, want))
            share = (want - (upto[at] - mass[at])) / mass[at] if at < 256 and mass[at] else 0.0
            cuts.append((min(at, 255) << 56) + int(share * ((1 << 56) - 1)))
        self.cuts = np.array(cuts, np.uint64)

    def keys(self, h: np.ndarray) -> np.ndarray:
        return (self.level[bucket(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))

    def sets(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each row, in order, and where each row begins in them (with the end)."""
        h, rows = grams(texts, n)
        keys = self.keys(h)
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        begin = 0
        for end in ends:
            keys[begin:end].sort()
            begin = end
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        return keys[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(texts)))])

    def nodes(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of each row's set, as signed long; 0 for an empty one."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys * np.uint64(0x9E3779B97F4A7C15)))])
        n = np.diff(at)
        return np.where(n > 0, mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """About how many n-grams share the bucket of a key, from its level."""
        return np.exp2((keys >> np.uint64(56)).astype(float) / 8)


def row_hash() -> Column:
    """A hash of doc_id and text: rows with the same one are the same document. A null doc_id has one, too."""
    return F.xxhash64("doc_id", "text")


def node_table(docs: DataFrame, order, n: int) -> DataFrame:
    """doc_id, n_shingles, node, row (row_hash) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, at = order.value.sets(batch.column(1), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(order.value.nodes(keys, at)), batch.column(2)], names=["doc_id", "n_shingles", "node", "row"])

    return docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, row long")


def prefix_rows(docs: DataFrame, order, n: int, share: int) -> DataFrame:
    """key, node, meta (size of the set * 2^32 + place of the key), salt, for the prefix of every document with words.

    A key whose rows are split has salts from 1 on, any other key has salt 0. Of documents with the same set, a task gives the prefix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of one input split
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, at = order.value.sets(batch.column(0), n)
                nodes = order.value.nodes(keys, at)
                fresh = np.array([not (v in seen or seen.add(v)) for v in nodes.tolist()], bool)
                size = np.where(fresh, np.diff(at), 0)
                length = np.where(size > 0, size + (-share * size) // 100 + 1, 0)
                row = np.repeat(np.arange(len(size)), length)
                place = np.arange(len(row)) - (np.cumsum(length) - length)[row]
                key = keys[at[:-1][row] + place]
                node = nodes[row]
                parts = np.maximum(1, np.ceil(order.value.estimate(key) / HOT)).astype(np.int64)
                salt = np.where(parts > 1, node % parts + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array((size[row] << 32) + place), pa.array(salt)], names=["key", "node", "meta", "salt"])

    return docs.select("text").mapInArrow(run, "key long, node long, meta long, salt int")


def can_link(a: str, b: str, share: int) -> Column:
    """The positional bound, for two metas whose first common key this could be: what is left of either set reaches the overlap."""
    size = lambda m: F.shiftright(m, 32)
    left = lambda m: F.shiftright(m, 32) - F.col(m).bitwiseAND(F.lit((1 << 32) - 1))
    return (100 + share) * F.least(left(a), left(b)) >= share * (size(a) + size(b))


def fragment_rows(docs: DataFrame, order, n: int) -> DataFrame:
    """node, frag, size (of the whole set), keys (the set's part in the fragment, as bytes). A task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of one input split
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, at = order.value.sets(batch.column(0), n)
                node, out = order.value.nodes(keys, at), []
                for r in np.flatnonzero(np.diff(at)):
                    if node[r] in seen:
                        continue
                    seen.add(int(node[r]))
                    own = keys[at[r] : at[r + 1]]
                    cut = [0, *np.searchsorted(own, order.value.cuts), len(own)]
                    out += [(node[r], f, len(own), own[cut[f] : cut[f + 1]].tobytes()) for f in range(FRAGMENTS) if cut[f] < cut[f + 1]]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["node", "frag", "size", "keys"])

    return docs.select("text").mapInArrow(run, "node long, frag int, size long, keys binary")


def overlaps(rows: DataFrame) -> DataFrame:
    """a, b, frag, total (both sizes), common: the partial overlap in one fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], names=["a", "b", "frag", "total", "common"])

    return rows.mapInArrow(run, "a long, b long, frag int, total long, common long")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, order, n: int, share: int) -> DataFrame:
    """The pairs (a, b) that link. named: node, row (the row_hash of a document that has the set). Texts of other documents are not cut again."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = durable(nodes.join(named, "node").select("row").distinct())
    parts = fragment_rows(docs.select("text", row_hash().alias("row")).join(sized(chosen), "row", "left_semi"), order, n)
    parts = durable(parts.join(sized(durable(nodes)), "node", "left_semi"))
    if parts.groupBy("node", "frag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        parts = durable(parts.dropDuplicates(["node", "frag"]))
    one = parts.select(F.col("node").alias("a"), "frag", F.col("size").alias("size_a"), F.col("keys").alias("keys_a")).join(sized(pairs), "a")
    two = one.join(parts.select(F.col("node").alias("b"), "frag", F.col("size").alias("size_b"), F.col("keys").alias("keys_b")), ["b", "frag"])
    partial = overlaps(two.select("a", "b", "frag", (F.col("size_a") + F.col("size_b")).alias("total"), "keys_a", "keys_b"))
    whole = partial.groupBy("a", "b", "total", "frag").agg(F.max("common").alias("common")).groupBy("a", "b", "total").agg(F.sum("common").alias("common"))
    return whole.where((100 + share) * F.col("common") >= share * F.col("total")).select("a", "b")


def join(docs: DataFrame, n: int = 4, share: int = 85, count_links: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links, node, comp (a node of its component), row. share: Jaccard, in percent.

    count_links: compare also pairs that lie in one component already, so that n_links is the number of other sets that the
    document's set links with; this takes work for every linked pair. Else n_links is null."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(docs, n))
    table = durable(node_table(docs, order, n))
    named = durable(table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")))

    rows = prefix_rows(docs, order, n, share).repartition("key", "salt").dropDuplicates(["key", "salt", "node"])
    first = rows.groupBy("key", "salt").agg(F.min(F.struct(F.col("meta").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "node", "meta")).alias("lead"), F.count(F.lit(1)).alias("rows"))
    posts = durable(rows.join(first.where("rows > 1 or salt > 0"), ["key", "salt"]).select("key", "node", "meta", F.col("lead.node").alias("lead"), F.col("lead.meta").alias("lead_meta")))

    star = posts.where(F.col("node") != F.col("lead")).where(can_link("meta", "lead_meta", share))
    star = durable(star.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    links = durable(verified(star, docs, named, order, n, share))
    comps = components(links.where("false") if count_links else links)

    # one exchange by key serves the two aggregations and the join with them
    known = posts.join(sized(comps), "node", "left").select("key", "node", "meta", F.coalesce("comp", "node").alias("comp")).repartition("key")
    most = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("rows")).where("comps > 1")
    known = durable(known.join(most.select("key", "major", "rows"), "key"))
    parts = F.ceil(F.col("rows") / HOT).cast("int")  # the pairs of a hot key are shared out
    x = known.where("comp <> major").select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "major", F.col("node").alias("nx"), F.col("meta").alias("mx"), F.col("comp").alias("cx"))
    y = known.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("node").alias("ny"), F.col("meta").alias("my"), F.col("comp").alias("cy"))
    cross = x.join(y, ["key", "part"]).where("cx <> cy and (cy = major or nx < ny)").where(can_link("mx", "my", share))
    cross = cross.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = durable(verified(durable(cross), docs, named, order, n, share))
    every = links.union(more)

    edges = links.union(more).select("a", "b")
    comps = components(edges)
    degree = every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    joined = named.join(comps, "node", "left").join(degree, "node", "left").where("comp is not null or copies > 1")
    joined = joined.withColumn("comp", F.coalesce("comp", "node"))
    least = joined.groupBy("comp").agg(F.min("label").alias("component"))
    special = durable(joined.join(least, "comp").select("node", "component", "comp", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return table.join(sized(special), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)).cast("long").alias("n_links"), "node", F.coalesce("comp", "node").alias("comp"), "row")


def keep_one(docs: DataFrame, n: int = 4, share: int = 85) -> DataFrame:
    """The documents, all columns, but one of each component: the one with the smallest doc_id (of rows that repeat, any one).

    A null doc_id comes last. Documents are told apart by doc_id and text together, components by their nodes."""
    columns = docs.columns
    found = durable(join(docs, n, share).where("n_shingles > 0").select("doc_id", "comp", "row"))
    groups = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    more = found.join(sized(durable(groups.where("n > 1").select("comp", F.col("first.row").alias("stays")))), "comp")
    kept = without(docs.withColumn("__row", row_hash()), durable(more.where("row <> stays").select(F.col("row").alias("__row")).distinct()), "__row")
    twice = durable(more.where("row = stays").groupBy(F.col("row").alias("__row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__row"))
    if twice.limit(1).count():
        again = kept.join(sized(twice), "__row", "left_semi").dropDuplicates(["__row"])
        kept = without(kept, twice, "__row").unionByName(again)
    return kept.select(*columns)


ORACLE = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct rid, array_to_string(list_slice(w, i, i + 3), ' ') as s from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)
), size as (select rid, count(*) as n from sh group by rid
), pair as (select a.rid as x, b.rid as y, count(*) as c from sh a join sh b on a.s = b.s and a.rid <> b.rid group by 1, 2
), link as (select x, y from pair join size p on p.rid = x join size q on q.rid = y where 100 * c >= 85 * (p.n + q.n - c)
), reach(x, y) as (select x, y from link union select r.x, l.y from reach r join link l on l.x = r.y
), lowest as (select r.x, min(doc_id) as m from reach r join d on d.rid = r.y group by r.x)
select doc_id, coalesce(size.n, 0)::BIGINT as n_shingles, least(doc_id, m) as component_id from d left join size using (rid) left join lowest on lowest.x = d.rid
"""
