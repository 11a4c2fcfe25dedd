"""Operator 12: Merkle dataset manifest.

Every document is a leaf: a hash of its columns. Within a language the leaves ascend by doc_id, every eight consecutive nodes become
their parent, and so on up to the language's subroot; the subroots, by language, likewise give the root of the whole table.

Method: concatenated-level strings. A block of 512 aligned nodes keeps its level as one hex string; fixed-width substrings of it
are hashed into the next level's string, three levels a block (fewer where the language ends earlier), so a block's digest is the
node above it, and blocks of digests form the next stage. Each stage is one exchange on (language, block), a block never holds over 512
nodes, and a hot language is many blocks. What flanks a node's substring within its run of eight are its siblings' segments. The way down
joins each block with its parent's segments, one row a block; segments of leaves are only made inside the last projection.

Defined cases: a null in any of the five columns stands as `-`; a null language is one of its own, first in order; rows without doc_id come
first; rows that repeat a doc_id are leaves of their own, ordered by their digests; an empty text isn't a null one; no rows give no rows; other
columns, whatever their names, have no part. A doc_id that is null is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.llm.common import lower_ascii, sized
from ductwork.storage import durable, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels of a block; hex digits of a digest.
FAN, LEVELS, WIDE = 8, 3, 64
BLOCK = FAN**LEVELS


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or a dash for null."""
    text = {name: value.cast("string") for name, value in columns.items()}
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text.values()]), 256)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds __place, the row's place (from 0) in its group's order, and __size, the group's size; null is a group like others.

    One range exchange on (group, order); then the sizes of the groups' shares of each partition, a row or so per partition and group, are
    summed up. A group may be larger than a task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = durable(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    shares = dealt.groupBy(F.shiftright("__at", 33).alias("__part"), F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    before = "coalesce(sum(__n) over (partition by __group order by __part rows between unbounded preceding and 1 preceding), 0)"
    shares = durable(shares.select("__part", "__group", "__from", F.expr(before).alias("__before"), F.expr("sum(__n) over (partition by __group)").alias("__size")))
    own = (F.shiftright("__at", 33) == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group"))
    place = F.col("__at") - F.col("__from") + F.col("__before")
    return dealt.join(sized(shares), own).withColumn("__place", place).drop("__at", "__part", "__group", "__from", "__before")


def parents(level: Column, n: Column) -> Column:
    """The next level's string of a level of n nodes."""
    runs = F.sequence(F.lit(0), F.floor((n - 1) / FAN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * (FAN * WIDE) + 1, F.lit(FAN * WIDE)), 256)), "")


def siblings(level: Column, at: Column) -> Column:
    """What flanks a node within its run of eight, in its level's string: struct(l, r)."""
    first = (at - at % FAN) * WIDE
    left = F.substring(level, first + 1, (at % FAN) * WIDE)
    return F.struct(left.alias("l"), F.substring(level, (at + 1) * WIDE + 1, (F.lit(FAN - 1) - at % FAN) * WIDE).alias("r"))


def levelled(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Blocks of nodes (g, place, size, depth, digest and the columns to keep): g, block, size, depth, items (digest, kept columns; in
    place order), up (levels that this block climbs), level0 .. level3 (strings; those above its top repeat it) and top, its digest.

    depth: levels that the group still has to climb; size: nodes of the group on this level."""
    block = F.floor(F.col("place") / BLOCK).cast("long")
    items = F.array_sort(F.collect_list(F.struct("place", "digest", *keep)))
    blocks = nodes.groupBy("g", block.alias("block")).agg(items.alias("items"), F.max("size").alias("size"), F.max("depth").alias("depth"))
    blocks = blocks.withColumn("up", F.least("depth", F.lit(LEVELS)).cast("int")).withColumn("n", F.size("items")).withColumn("level0", F.array_join("items.digest", ""))
    for k in range(LEVELS):
        below = F.col(f"level{k}").cast("string")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("up") > k, parents(below, F.floor((F.length(below)) / WIDE).cast("int"))).otherwise(below))
    return blocks.withColumn("top", F.col(f"level{LEVELS}"))


def segments(at: Column) -> Column:
    """The siblings of a block's item, level by level: array of struct(l, r)."""
    steps = [siblings(F.col(f"level{k}").cast("binary"), F.floor(at / FAN**k).cast("int")) for k in range(LEVELS)]
    return F.slice(F.array(*steps), F.lit(1), F.col("up"))


def depth(size: Column) -> Column:
    """Levels from a number of nodes down to one: the least d with 8^d >= size."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.lit(0).cast("int"), lambda d, k: d + F.when(F.pow(F.lit(float(FAN)), (k - 1).cast("double")) < size, 1).otherwise(0))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The stages of blocks from the nodes (g, place, size, digest, ...) up to one block a group; each is stored."""
    kept = [c for c in nodes.columns if c not in ("g", "place", "size", "digest")]
    stages = [stored(levelled(nodes.withColumn("depth", depth(F.col("size"))), kept))]
    while stages[-1].where(F.col("block") > 0).limit(1).count():
        up = F.floor((F.col("size") + BLOCK - 1) / BLOCK).cast("long")
        above = stages[-1].select("g", F.col("block").alias("place"), up.alias("size"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"), F.col("top").alias("digest"))
        stages.append(stored(levelled(above, [])))
    return stages


def descended(stages: list[DataFrame], path: DataFrame) -> DataFrame:
    """The lowest stage's blocks with path, the siblings from their tops up to the root. path: g, root, subroot, path; one row a group."""
    above = path.withColumn("block", F.lit(0).cast("long"))
    for stage in reversed(stages[1:]):
        blocks = stage.join(above.withColumnRenamed("g", "__g").withColumnRenamed("block", "__block"), F.col("g").eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__block")))
        one = F.transform("items", lambda item, i: F.struct(item["place"].alias("block"), segments(i).alias("own")))
        rows = blocks.select("g", "root", "subroot", "path", F.explode(one).alias("item"))
        above = stored(rows.select("g", "item.block", "root", "subroot", F.concat("item.own", "path").alias("path")))
    return stages[0].join(above.withColumnRenamed("g", "__g").withColumnRenamed("block", "__block"), F.col("g").eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__block"))).drop("__g", "__block")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["l"], node.cast("binary"), s["r"]), 256))


def manifest(docs: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. docs: doc_id, source, lang, n_chars, text and, if it
    is to be compared, other_text: what stands in the text's place when the document is looked at again."""
    columns = {name: F.col(name) for name in FIELDS}
    again = columns | {"text": F.col("other_text")} if "other_text" in docs.columns else columns
    same = F.col("other_text").eqNullSafe(F.col("text")) if "other_text" in docs.columns else F.lit(True)
    leaves = stored(docs.select("doc_id", F.col("lang").alias("g"), leaf(columns).alias("digest"), F.when(~same, leaf(again)).alias("other")))
    ranked = placed(leaves, "g", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    stages = climbed(ranked.withColumnsRenamed({"__place": "place", "__size": "size"}))
    subroots = stages[-1].select(F.col("g").alias("lang"), F.col("top").alias("digest"))
    ordered = placed(subroots.withColumn("__one", F.lit(0)), "__one", [F.col("lang").asc_nulls_first()])
    top = climbed(ordered.select(F.lit(0).alias("g"), F.col("__place").alias("place"), F.col("__size").alias("size"), "digest", "lang"))
    root = top[-1].select("g", F.col("top").alias("root"), F.lit("").alias("subroot"), F.array().cast("array<struct<l: binary, r: binary>>").alias("path"))
    per = F.transform("items", lambda item, i: F.struct(item["lang"].alias("g"), item["digest"].alias("subroot"), segments(i).alias("own")))
    langs = descended(top, root).select("root", "path", F.explode(per).alias("item"))
    paths = stored(langs.select("item.g", "root", "item.subroot", F.concat("item.own", "path").alias("path")))
    blocks = descended(stages, paths)

    def judged(item: Column, i: Column) -> Column:
        path = F.concat(segments(i), F.col("path"))
        proof = F.sha2(F.aggregate(path, F.lit(b""), lambda all_, s: F.concat(all_, s["l"], s["r"])), 256)
        return F.struct(item["doc_id"].alias("doc_id"), item["digest"].alias("leaf"), proof.alias("proof_sha256"), folded(F.coalesce(item["other"], item["digest"]), path).alias("folded_root"))

    rows = blocks.select("subroot", "root", F.explode(F.transform("items", judged)).alias("item"))
    return rows.select("item.doc_id", "item.leaf", "subroot", "root", "item.proof_sha256", "item.folded_root", (F.col("item.folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> DataFrame:
    """docs with other_text: the text, its A-Z lower-cased where 3 divides the unsigned crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(*FIELDS, F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")).alias("other_text"))


ORACLE = r"""
with recursive bits as (
  select doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, [ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT for i in range(1, length(doc_id::VARCHAR) + 1)]),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [k::BIGINT for k in range(8)]), lambda v, k: case when v % 2 = 1 then xor(v >> 1, 3988292384::BIGINT) else v >> 1 end)) as crc
  from documents
), seen as (
  select *, case when (4294967295 - crc) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other_text from bits
), cells as (
  select doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail, coalesce(strlen(other_text) || ':' || other_text, '-') as other_tail from seen
), leaves as (
  select doc_id, coalesce('l' || lang, '') as g, sha256(head || tail) as leaf, sha256(head || other_tail) as other from cells
), placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as n from leaves
), levels as (
  select g, 0 as level, idx // 8 as run, list(leaf order by idx) as nodes, any_value(n) as n from placed group by g, idx // 8
  union all
  select g, level + 1, run // 8, list(sha256(array_to_string(nodes, '')) order by run), any_value((n + 7) // 8) from levels where n > 1 group by g, level, run // 8
), subroots as (
  select g, nodes[1] as subroot, level as depth from levels where n = 1
), ordered as (
  select g, subroot, row_number() over (order by g) - 1 as idx, count(*) over () as n from subroots
), tops as (
  select 0 as level, idx // 8 as run, list(subroot order by idx) as nodes, any_value(n) as n from ordered group by idx // 8
  union all
  select level + 1, run // 8, list(sha256(array_to_string(nodes, '')) order by run), any_value((n + 7) // 8) from tops where n > 1 group by level, run // 8
), steps as (
  select p.g, p.idx as leaf_idx, l.level, ((p.idx // (8 ** l.level)::BIGINT) % 8)::INT as pos, l.nodes
  from placed p join levels l on l.g = p.g and l.n > 1 and l.run = p.idx // (8 ** (l.level + 1))::BIGINT
  union all
  select p.g, p.idx, s.depth + t.level, ((o.idx // (8 ** t.level)::BIGINT) % 8)::INT, t.nodes
  from placed p join subroots s using (g) join ordered o using (g) join tops t on t.n > 1 and t.run = o.idx // (8 ** (t.level + 1))::BIGINT
), flanks as (
  select g, leaf_idx, level, array_to_string(nodes[:pos], '') as l, array_to_string(nodes[pos + 2:], '') as r from steps
), paths as (
  select g, leaf_idx, list({'l': l, 'r': r} order by level) as path from flanks group by g, leaf_idx
), ready as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from tops where n = 1) as root, coalesce(t.path, []) as path, p.other
  from placed p join subroots s using (g) left join paths t on t.g = p.g and t.leaf_idx = p.idx
), climb as (
  select doc_id, leaf, subroot, root, path, other as node, 1 as k from ready
  union all
  select doc_id, leaf, subroot, root, path, sha256(path[k].l || node || path[k].r), k + 1 from climb where k <= len(path)
)
select doc_id, leaf, subroot, root, sha256(array_to_string([s.l || s.r for s in path], '')) as proof_sha256, node as folded_root, node = root as verified
from climb where k = len(path) + 1
"""
