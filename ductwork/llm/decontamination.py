"""Operator 5: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item gives windows of n consecutive words (an item of fewer words is one window). A window is contained in a document only
if all its words are, so its prefix is one token: the word that is rarest over all documents. Documents look up their words
among these anchors, keep the words around each, and a join on the anchor verifies the whole window under position and length
bounds. Only words next to anchors are shuffled, never texts.

Defined cases: null and empty texts have no words and are clean; null or empty items have no windows; items with a null item_id
mark words but are not listed; items that repeat are listed once; documents that repeat are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.llm.common import NOT_WORD, UPPER, durable, fingerprint, without

#: Words looked up as a set inside the scan; beyond, a join finds their places.
MOST_LISTED = 20_000


def words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; null has none. Texts in ASCII take the faster lower()."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NOT_WORD), "")


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows and the items that have them: win, len, items (ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).withColumn("m", F.size("w")).where("m > 0")
    cut = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, m - {n - 1})), i -> slice(w, i, {n}))")).alias("win"))
    return cut.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("win"))


def rarest(wins: DataFrame, docs: DataFrame, tries: int = 3) -> DataFrame:
    """Windows with their prefix token: anchor and off, its place (from 0). Windows with a word that no document has go.

    Of the words of a window, those in the fewest windows stand for election, longer ones first; of these the one that is
    rarest over all documents wins. Any choice is exact; this one keeps the join small."""
    each = wins.withColumn("id", F.xxhash64("win")).select("id", F.explode(F.array_distinct("win")).alias("word"))
    first = Window.partitionBy("id").orderBy("m", F.desc(F.length("word")), "word")
    tried = durable(each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("m")), "word").withColumn("k", F.row_number().over(first)).where(F.col("k") <= tries).select("id", "word"))
    vocabulary = listed(tried.select("word"))
    own = docs.select(words(F.col("text")).alias("w")).select("w", F.size("w").alias("m"))
    if vocabulary is not None:
        seen = own.where("m > 0").select(F.explode(F.expr(f"filter(w, x -> x in ({vocabulary}))")).alias("word"))
    else:
        seen = own.select(F.explode("w").alias("word")).join(tried.select("word").distinct(), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = tried.join(counts, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("best")).where("best.n > 0")
    return wins.withColumn("id", F.xxhash64("win")).join(best, "id").select("win", "items", "len", F.col("best.word").alias("anchor"), (F.array_position("win", F.col("best.word")) - 1).cast("int").alias("off"))


def listed(found: DataFrame) -> str | None:
    """The distinct words as an SQL list, or None if they are too many to look up inside a scan."""
    some = [r[0] for r in found.distinct().limit(MOST_LISTED + 1).collect()]
    return None if len(some) > MOST_LISTED else ", ".join(f"'{w}'" for w in some) or "''"


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    return judged(docs.select("doc_id", "text"), benchmark, ["doc_id"], n, share)


def judged(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int, share: int) -> DataFrame:
    """The verdict beside the kept columns; docs needs text besides them."""
    wins = durable(rarest(windows(benchmark.select("item_id", "text"), n), docs))
    anchors = listed(wins.select("anchor"))
    base = docs.select(F.monotonically_increasing_id().alias("__rid"), *keep, words(F.col("text")).alias("__w")).withColumn("__n", F.size("__w"))
    near = f"struct(i as pos, element_at(__w, i) as word, greatest(1, i - {n - 1}) as lo, slice(__w, greatest(1, i - {n - 1}), i + {n} - greatest(1, i - {n - 1})) as near)"
    if anchors is not None:
        spots = base.select("__rid", *keep, "__n", F.expr(f"transform(filter(sequence(1, greatest(__n, 1)), i -> get(__w, i - 1) in ({anchors})), i -> {near})").alias("__c"))
    else:  # too many to hold: find positions by a join, then come back to the words
        at = base.select("__rid", F.posexplode("__w").alias("p", "word")).join(wins.select(F.col("anchor").alias("word")).distinct(), "word", "left_semi")
        at = at.groupBy("__rid").agg(F.collect_list((F.col("p") + 1).cast("int")).alias("__at"))
        spots = base.join(at, "__rid", "left").select("__rid", *keep, "__n", F.expr(f"transform(coalesce(__at, array()), i -> {near})").alias("__c"))
    one = spots.select("__rid", *keep, "__n", F.explode_outer("__c").alias("c")).select("__rid", *keep, "__n", F.coalesce("c.word", F.concat(F.lit("\x00"), F.col("__rid"))).alias("__word"), "c.pos", "c.lo", "c.near")
    wins = wins.select(F.col("win").alias("__win"), F.col("items").alias("__items"), F.col("len").alias("__len"), "anchor", "off")
    start = F.col("pos") - F.col("off")
    fits = (F.col("__word") == F.col("anchor")) & (start >= 1) & (start + F.col("__len") - 1 <= F.col("__n")) & (F.slice("near", F.greatest(start - F.col("lo") + 1, F.lit(1)), F.col("__len")) == F.col("__win"))
    hits = one.join(wins, fits, "left").select("__rid", *keep, "__n", F.when(F.col("anchor").isNotNull(), F.struct(start.alias("s"), (start + F.col("__len") - 1).alias("e"))).alias("h"), "__items")
    per = hits.groupBy("__rid", *keep, "__n").agg(F.array_sort(F.collect_set("h")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("ids"))
    covered = F.expr("aggregate(h, struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(0, x.e - greatest(a.e, x.s - 1)) as n, greatest(a.e, x.e) as e), a -> a.n)").cast("long")
    n_words = F.col("__n").cast("long")
    return per.withColumn("__hit", covered).select(
        *keep, n_words.alias("n_words"), F.col("__hit").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), ((F.col("__hit") > 0) & (share * F.col("__hit") >= n_words)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, all columns. The verdict hangs on the text alone, so its fingerprint carries it back."""
    marked = docs.select(fingerprint(F.col("text")).alias("__hash"), "text")
    bad = durable(judged(marked, benchmark, ["__hash"], n, share).where("contaminated").select("__hash").distinct())
    return without(docs.withColumn("__hash", fingerprint(F.col("text"))), bad, "__hash").drop("__hash")


ORACLE = r"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), wins as (
  select distinct item_id, list_slice(w, i, i + 12) as win, least(len(w), 13) as m from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct m from wins
), spots as (
  select rid, i, m, list_slice(w, i, i + m - 1) as win from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)
), hits as (select rid, i, s.m, item_id from spots s join wins using (win)
), cover as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + m)) as p from hits) group by rid
), ids as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::VARCHAR)), ',') as ids from hits group by rid)
select doc_id, len(w)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cover using (rid) left join ids using (rid)
"""
