"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ductwork.llm import chat, merkle, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- operator 11


def plain_runs(words, least=12):
    """All runs (start, length, period) by looking at every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(kept))


def repeated_texts(rng, count):
    for k in range(count):
        block = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 33, 40, 64, 90, 150]))]
        inner = block * rng.randrange(1, 5) + [rng.choice("xyz")] * rng.randrange(3)
        words = ([str(i) for i in range(rng.randrange(5))] + inner * rng.randrange(1, 4) + block[: rng.randrange(len(block))])[:900]
        yield k, " ".join(words)


def test_runs_of_every_period_equal_a_plain_search():
    rng = random.Random(5)
    for kind in range(120):
        short = [0] * rng.randrange(1, 5) + [1] * rng.randrange(3)
        u = short * rng.randrange(1, 25) + [2] * rng.randrange(2)
        words = np.array((u * rng.randrange(1, 6) + short * rng.randrange(9) + u)[:800], dtype=np.int64)
        if kind % 3 == 0:  # the longest stretches of a small period, twice, out of step
            x = [0, 1] * rng.randrange(20, 150)
            words = np.array(x + [0] * (kind % 2) + x[::-1], dtype=np.int64)
        want = [(s, s + n, q) for s, n, q in plain_runs(words.tolist())]
        assert runs.find(np.append(words, 99), len(words)) == want


def test_runs_query_equals_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(k, t, None, None, None) for k, t in repeated_texts(rng, 150)]
    rows += [(None, "a " * 30, "l", "s", 1), (500, None, None, None, None), (501, "", None, None, None), (502, " \t\n", None, None, None), (503, "word" * 9000, None, None, None)]
    rows += [(504, "ü b\x0bc " * 3000, None, None, None), (505, " ".join(map(str, range(30000))) * 2, None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as runs", "2 as collapsed", "3 as start")
    got = sorted(map(tuple, runs.digests(runs.scan(docs, change=runs.planted)).collect()), key=str)
    fast = lambda r: r[0] in (504, 505)
    want = [plain_digest(r[0], r[1]) for r in rows if not fast(r)]
    assert [r for r in got if not fast(r)] == sorted(want, key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[504][2:5] == (0, 9000, 3)
    assert sum(r[1] > 0 for r in got) > 50 and len(got) == len(rows)


def test_runs_of_a_long_period_across_a_long_text(spark):
    block = [str(i) for i in range(40_000)]
    text = " ".join(["start", *block, *block, *block[:7], "end"])
    row = runs.scan(spark.createDataFrame([(1, text, None, None, None)], DOCS)).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 80_007, 40_000)]
    assert row["collapsed"] == " ".join(["start", *block, "end"])


def test_collapse_keeps_other_texts_and_columns(spark):
    docs = spark.createDataFrame([(1, "a  b\n" * 20, 7), (2, "as  it\nis", 8), (3, None, 9)], "doc_id long, text string, runs int")
    assert sorted(map(tuple, runs.collapse(docs).collect())) == [(1, "a b", 7), (2, "as  it\nis", 8), (3, None, 9)]
    empty = docs.limit(0)
    assert runs.collapse(empty).count() == 0 and runs.digests(runs.scan(empty)).count() == 0


# --- operator 12


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def plain_manifest(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def lower(text):
        return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    langs = {}
    for r in rows:
        other = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(*r)
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), other, r[0]))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: plain_levels([leaf_ for _, _, leaf_, _, _ in sorted(langs[x])]) for x in order}
    top = plain_levels([per[x][-1][0] for x in order])
    for k, x in enumerate(order):
        for i, (_, _, own, other, doc_id) in enumerate(sorted(langs[x])):
            path = plain_path(per[x], i) + plain_path(top, k)
            node = other
            for left, right in path:
                node = sha(left + node + right)
            yield doc_id, own, per[x][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]


def manifest_rows():
    rng = random.Random(3)
    rows = [(k, f"Text {k} ÄB", "big", rng.choice(["s", None, ""]), k % 7) for k in range(1300)]
    rows += [(k, "Other", "mid", None, None) for k in range(9)] + [(5000, "One", "alone", "S", 3), (5001, None, None, None, None), (5002, "", None, "x", 1), (5001, None, None, None, None)]
    rows += [(6000 + k, "x" * 70_000 + "X", f"lang {k}", None, k) for k in range(11)]
    return rows + [(None, "No id", "mid", "s", 1), (None, None, "é", None, None), (7, "same id, other text", "big", "s", 2), (8, "Text 8 ÄB", "big", None, 1)]


def test_manifest_equals_a_plain_tree(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 as leaf", "'x' as g", "2 as place", "3 as digest", "'y' as root")
    got = sorted(map(tuple, merkle.manifest(merkle.tampered(docs)).collect()), key=str)
    assert got == sorted(plain_manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False} and merkle.BLOCK < 1300


@pytest.mark.parametrize("rows", [[], [(1, "Only", "en", "s", 4)], [(1, None, None, None, None), (2, "a", "en", None, 1)]])
def test_manifest_of_few_rows(spark, rows):
    got = merkle.manifest(merkle.tampered(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_finds_any_change(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", k) for k in range(600)], DOCS)
    changed = merkle.manifest(docs.selectExpr("*", "case when doc_id in (3, 599) then concat(text, ' ') else text end as other_text"))
    assert {r["doc_id"] for r in changed.where("not verified").collect()} == {3, 599}
    assert merkle.manifest(docs).where("verified").count() == 600


# --- operator 13

TURNS = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<|user|>\nhi</s>\n", "\\", "\\\\<\\|", "<|>", "<", "", None, "<\\/s>", "a\nb", "😀" * 3 + "</s", "x" * 40_000 + "<s>"]


def test_chats_come_back_as_they_were(spark):
    rows = [(c, t, role, ODD[(c + t) % len(ODD)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant", "user", None, "<|>", "a|"])]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (50, 3, "user", "same"), (50, 3, "user", "same"), (51, None, "assistant", "<|x")]
    turns = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 as message", "2 as seq", "'z' as kind")
    rendered = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    full = {r["conv_id"]: r for r in rendered.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda r: r[0])
        learnt = "".join(text for _, role, text in own if role == "assistant")
        r, f = got[conv], full[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(learnt), sha(learnt), len(f["formatted"]))
        assert f["formatted"].count("</s>") == f["formatted"].count("<|") == len(own)
        assert [f["formatted"][s["start"] : s["start"] + s["n"]] for s in f["spans"]] == [p["text"] for p in f["pieces"] if p["loss"]]
        assert "[INST]" not in f["formatted"]


def test_probe_conversation_and_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    row = chat.digests(chat.format_chats(chat.with_probe(none))).collect()
    text = "</s>[INST] ok [/INST]"
    assert [tuple(r)[:5] for r in row] == [(-7, 2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))]
    assert chat.digests(chat.format_chats(none)).count() == 0


def plain_fold(events):
    """Messages of one conversation, event by event."""
    messages = {}
    for _, message, kind, role, text in sorted(events, key=lambda e: e[0]):
        if kind == "regenerate":
            messages = {m: v for m, v in messages.items() if m < message}
        elif kind == "edit":
            messages[message] = (role or messages.get(message, (None,))[0], text or "")
        else:
            was = messages.get(message, (None, ""))
            messages[message] = (role or was[0], was[1] + (text or ""))
    return {m: v for m, v in messages.items()}


def test_deltas_edits_and_regenerations_fold_as_one_by_one(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            rows.append((conv, seq, rng.randrange(4), kind, "user", rng.choice(["a", "b ", "</s>", None])))
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    got = {}
    for r in chat.reconstruct(events).collect():
        got.setdefault(r["conv_id"], {})[r["message"]] = (r["role"], r["text"])
    for conv in range(60):
        assert got.get(conv, {}) == plain_fold([r[1:] for r in rows if r[0] == conv]), conv


def test_chat_formatting_uses_no_python_workers(spark):
    plan = chat.digests(chat.format_chats(chat.with_probe(spark.createDataFrame([], TURNS))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
