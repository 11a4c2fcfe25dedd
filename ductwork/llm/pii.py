"""Operator 3: personal data by boosted trees over generated candidates, in DataFrame functions only.

High-recall generators (regular expressions) propose overlapping spans. Those of the four base kinds that pass their checks are
always reported, and so are spelled-out addresses that pass the e-mail pattern once their signs are put back. Boosted trees over
format and context features judge the numbers that remain: telephone numbers without their plus, cards with other separators.

The trees learn from disguises: checked telephone and card numbers of the corpus, in their places, with the plus or the country
dropped and the separators changed, against numbers that are known to be something else (unbroken runs, dates and years, numbers called order or
version, those that fail the checks). These labels only teach: every number that touches no reported span is judged by the trees, labelled or not.
They are fitted on a bounded sample; a threshold for each kind (13 digits or more: card, else telephone) is calibrated for precision on
all such rows held out (a third, by hash); without LEAST of these nothing of that kind is added. The trees are applied as one SQL expression.
The generators propose numbers of up to 42 characters and spelled-out addresses whose parts have up to 64; the base kinds know no such bounds. Positions come from the lengths of the pieces that a split leaves, summed
per document.

Defined cases: null counts as empty; a text without digits, "@" or "(at)" is passed over at once; documents that repeat are
handled row by row; a null doc_id keeps its row; without checked numbers the trees add nothing; positions count code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.llm.boosting import Boosted, boost
from ductwork.llm.common import MOST_BROADCAST, durable, fingerprint

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive, and started only where a longer match could not have begun, so that long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider generators: numbers with separators, and addresses whose signs are spelled out.
WIDE = {
    "number": r"(?<![A-Za-z0-9+])[0-9(][0-9\x20().-]{6,40}[0-9](?![A-Za-z0-9])",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,6}|(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}){1,6})",
}
MARKS = r"[0-9@]|[(\[]at[)\]]"
#: Words before a candidate that speak for personal data.
CUES = r"(?i)(mail|call|tel|phone|fon|fax|mobil|card|visa|pay|host|addr|contact|kontakt|\bip)\W*\w*\W*$"
#: Words before a number that speak for something else; forms of years, dates and versions.
OTHER = r"(?i)\b(order|invoice|version|isbn|issn|number|no|nr|ref|id|serial|build|ticket|item|rev|article|artikel)\W*$"
YEARS = r"^\(?(1[89]|20)[0-9]{2}\)?([\x20.-]+(1[89]|20)[0-9]{2})+$|^[0-9]{1,4}[.-][0-9]{1,2}[.-][0-9]{1,4}(\x20|$)|^[0-9]{1,3}(\.[0-9]{1,3})+$"
#: Score bins of the calibration, and the held-out rows that a threshold takes.
BINS = 1000
LEAST = 20
#: Longest piece of a text that is cut at once.
PIECE = 4096
FEATURES = {
    "f_digits": "length(regexp_replace(m, '[^0-9]', ''))",
    "f_chars": "length(m)",
    "f_breaks": "length(regexp_replace(m, '[0-9]', ''))",
    "f_dots": "length(regexp_replace(m, '[^.]', ''))",
    "f_hyphens": "length(regexp_replace(m, '[^-]', ''))",
    "f_parens": "length(regexp_replace(m, '[^()]', ''))",
    "f_groups": "size(regexp_extract_all(m, '[0-9]+', 0))",
    "f_longest": "array_max(transform(regexp_extract_all(m, '[0-9]+', 0), x -> length(x)))",
    "f_last": "length(regexp_extract(m, '[0-9]+$', 0))",
    "f_joined": "case when before rlike '[A-Za-z0-9_=/-]$' or after rlike '^[A-Za-z0-9_=/-]' then 1 else 0 end",
    "f_assigned": "case when before rlike '[:=]\\\\s*\"?$' then 1 else 0 end",
    "f_cue": "case when before rlike '" + CUES.replace("\\", "\\\\") + "' then 1 else 0 end",
    "f_other": "case when before rlike '" + OTHER.replace("\\", "\\\\") + "' then 1 else 0 end",
    "f_first": "coalesce(try_cast(regexp_extract(m, '[0-9]', 0) as int), -1)",
}


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base pattern passes the kind's check."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    card = F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", n.between(9, 15)).otherwise(False)


def spelled_out(kind: Column, m: Column) -> Column:
    """Whether a match is a spelled address that passes the base pattern with its signs put back."""
    plain = F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return (kind == "spelled") & plain.rlike(f"^(?:{BASE['email']})$")


def pieces(text: Column, kind: str, pattern: str) -> Column:
    """Per match: kind, number, the length of the text since the last match, the match, and what stands around it."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("a")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("m"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["a"], F.lit(8)).alias("after")),
    )


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per candidate: kept columns, __rid, kind, m, start, end (code points), ok (base and checked), address (spelled and checked), before, after.

    A document without candidates has one row with a null kind. Only candidates are shuffled, by document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.flatten(F.array(*[pieces(text, k, p) for k, p in (BASE | WIDE).items()]))
    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), *keep, F.when(text.rlike(MARKS), every).alias("__c"))
    rows = rows.select("__rid", *keep, F.explode_outer("__c").alias("c")).select("__rid", *keep, "c.*").where("kind is null or m <> ''").repartition("__rid")
    before = Window.partitionBy("__rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    checks = {"ok": valid(F.col("kind"), F.col("m")), "address": spelled_out(F.col("kind"), F.col("m"))}
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}).drop("i", "gap")


def with_features(rows: DataFrame) -> DataFrame:
    digits = F.regexp_replace("m", "[^0-9]", "")
    passes = F.when(F.length(digits).between(13, 19), luhn(digits).cast("int")).otherwise(F.lit(0))
    return rows.withColumns({k: F.expr(v) for k, v in FEATURES.items()} | {"f_luhn": passes})


def labelled(rows: DataFrame) -> DataFrame:
    """Adds touches (the candidate is or overlaps a span that is reported anyway), the features, and label: 0 for a number that is something else, else null."""
    sure = F.col("ok") | F.col("address")
    order = Window.partitionBy("__rid").orderBy("start", "end", "kind")
    sure_end = F.max(F.when(sure, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sure_start = F.min(F.when(sure, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touches = sure | F.coalesce(sure_end > F.col("start"), F.lit(False)) | F.coalesce(sure_start < F.col("end"), F.lit(False))
    rows = with_features(rows.withColumn("touches", touches))
    other = ~F.col("f_digits").between(9, 19) | (F.col("f_groups") < 2) | (F.col("f_other") == 1) | F.col("m").rlike(YEARS)
    return rows.withColumn("label", F.when((F.col("kind") == "number") & ~F.col("touches") & other, 0))


def disguised(rows: DataFrame) -> DataFrame:
    """The checked telephone and card numbers, each in one disguise by its hash, as numbers with label 1, where they stand."""
    groups = F.regexp_extract_all("m", F.lit("[0-9]+"), F.lit(0))
    digits = F.regexp_replace("m", "[^0-9]", "")
    fours = F.regexp_extract_all(digits, F.lit("[0-9]{1,4}"), F.lit(0))
    spread = F.xxhash64("m", "before")
    by, short = F.pmod(spread, F.lit(3)), (F.pmod(spread, F.lit(2)) == 0) & (F.size(groups) > 3)
    mark = F.when(by == 0, ".").when(by == 1, "-").otherwise(" ")
    phone = F.when(by == 2, F.regexp_replace("m", r"^\+[0-9]{0,3}\x20(?=\()|^\+", "")).otherwise(F.call_function("array_join", F.when(short, F.slice(groups, 2, 9)).otherwise(groups), mark))
    card = F.when(by == 1, F.array_join(fours, " - ")).otherwise(F.array_join(fours, "."))
    hidden = rows.where("ok and kind in ('phone', 'card')").withColumn("h", by_hash()).withColumn("m", F.when(F.col("kind") == "phone", phone).otherwise(card))
    hidden = hidden.where(F.col("m").rlike(f"^(?:{WIDE['number']})$")).withColumns({"kind": F.lit("number"), "label": F.lit(1), "ok": F.lit(False)})
    return with_features(hidden.select("kind", "m", "before", "after", "label", "h"))


def by_hash() -> Column:
    return F.xxhash64("m", "before", "after")


def threshold(bins: list[tuple[int, int, int]], precision: float) -> int:
    """The lowest of the bins (bin, candidates, ones) from which on the share of ones is at least precision; above BINS if there is none."""
    n = ones = 0
    best = BINS + 1
    for at, more, hits in sorted(bins, reverse=True):
        n, ones = n + more, ones + hits
        if ones >= precision * n:
            best = at
    return best if n >= LEAST else BINS + 1


def taught(rows: DataFrame) -> DataFrame:
    """What the trees learn from: h (which tells held-out rows), label and features."""
    names = [*FEATURES, "f_luhn"]
    known = rows.where("label is not null").withColumn("h", by_hash()).select("h", "label", *names)
    return known.unionByName(disguised(rows).select("h", "label", *names))


def fit(rows: DataFrame, sample: int, precision: float) -> tuple[Boosted, dict[bool, int]]:
    """Trees from at most sample rows, half of each label, by hash; and the least score bin that counts, for cards (True) and telephone numbers, from all
    rows of the held-out third."""
    names = [*FEATURES, "f_luhn"]
    rows = taught(rows)
    held = F.pmod("h", F.lit(3)) == 2
    some = [r for label in (0, 1) for r in rows.where(~held).where(F.col("label") == label).orderBy("h", *names).limit(sample // 2).collect()]
    x = np.array([[float(r[n]) for n in names] for r in some]).reshape(len(some), len(names))
    model = boost(names, x, np.array([float(r["label"]) for r in some]))
    bins = rows.where(held).groupBy(is_card().alias("card"), score_bin(model).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()
    cuts = {}
    for card in (False, True):
        own = [(r["bin"], r["n"], r["ones"]) for r in bins if r["card"] == card]
        cuts[card] = threshold(own, precision) if any(r[2] for r in own) else BINS + 1
    return model, cuts


def is_card() -> Column:
    return F.col("f_digits") >= 13


def score_bin(model: Boosted) -> Column:
    return F.floor(F.expr(model.sql()) * BINS)


def find(docs: DataFrame, keep: list[str], sample: int = 6_000, precision: float = 0.98) -> DataFrame:
    """Per document the kept columns, spans (base and added, array of kind, start, end, base) in the order of kinds, then start."""
    rows = durable(labelled(candidates(docs, keep)))
    model, cuts = fit(rows, sample, precision)
    more = (F.col("kind") == "number") & ~F.col("touches") & (score_bin(model) >= F.when(is_card(), cuts[True]).otherwise(cuts[False]))
    rows = rows.withColumn("more", F.coalesce(more, F.lit(False)))
    chosen = Window.partitionBy("__rid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    free = F.coalesce(F.max(F.when(F.col("more"), F.col("end"))).over(chosen) <= F.col("start"), F.lit(True))
    named = F.when(F.col("kind") == "number", F.when(is_card(), "card").otherwise("phone")).when(F.col("kind") == "spelled", "email").otherwise(F.col("kind"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), named)
    rows = rows.withColumn("free", free)
    span = F.when(F.col("ok") | F.col("address") | (F.col("more") & F.col("free")), F.struct(place.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), named.alias("kind"), F.col("ok").alias("base")))
    return rows.groupBy("__rid", *keep).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, sample: int = 6_000, precision: float = 0.98) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, both as kind:start:end lists."""
    found = find(docs.select("doc_id", "text"), ["doc_id"], sample, precision)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.base and s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, sample: int = 6_000, precision: float = 0.98) -> DataFrame:
    """The documents, all columns, each span in the text replaced by its kind in brackets; n_chars, if there, follows the text.

    Spans hang on the text alone, so the text's fingerprint carries them back; texts are shuffled only if spans are too many to broadcast."""
    columns = docs.columns
    found = find(docs.select(fingerprint(F.col("text")).alias("__hash"), "text"), ["__hash"], sample, precision).where(F.size("spans") > 0)
    found = found.groupBy("__hash").agg(F.any_value("spans").alias("__spans"))
    in_order = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    apart = F.expr("aggregate(__spans, cast(array() as array<struct<s: bigint, e: bigint, k: string>>), (a, x) -> case when size(a) = 0 or x.s >= element_at(a, -1).e then concat(a, array(x)) when x.e <= element_at(a, -1).e then a else concat(a, array(named_struct('s', element_at(a, -1).e, 'e', x.e, 'k', x.k))) end)")
    found = durable(found.withColumn("__spans", in_order).withColumn("__spans", apart))
    total = found.agg(F.sum(F.size("__spans") + 4)).first()[0] or 0
    back = docs.withColumn("__hash", fingerprint(F.col("text"))).join(F.broadcast(found) if total <= MOST_BROADCAST else found, "__hash", "left")
    # a long text is cut piece by piece, so that each span costs the length of its piece only
    cut = F.expr(
        f"""array_join(transform(regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0), (c, i) -> aggregate(
        filter(__spans, x -> x.s < (i + 1) * {PIECE} and x.e > i * {PIECE}), struct('' as p, 0 as e),
        (a, x) -> struct(concat(a.p, substr(c, a.e + 1, cast(greatest(x.s - i * {PIECE} - a.e, 0) as int)), case when x.s >= i * {PIECE} then concat('[', upper(x.k), ']') else '' end) as p,
          cast(least(x.e - i * {PIECE}, {PIECE}) as int) as e),
        a -> concat(a.p, substr(c, a.e + 1)))), '')"""
    )
    back = back.withColumn("text", F.when(F.col("__spans").isNotNull(), cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        back = back.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back.select(*columns)
