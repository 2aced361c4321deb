"""The operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, language, line_dedup, mixing, near_copies, quality, repeats, simhash, tokens, urls, warc
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sp(spark):
    return ship(spark)


def words_of(text):
    return (text or "").encode().split()


def corpus(n=60, seed=0):
    """Texts with shared passages, copies, near copies, repeats, ties, nulls, and odd white space."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", *[f"w{i}" for i in range(400)], "Été", "naïve"]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        own = [r.choice(vocab) for _ in range(r.randrange(3, 150))]
        kind = i % 6
        if kind == 1:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        if kind == 2 and texts:
            own = (r.choice(texts) or "x").split()
        if kind == 3:
            own = own[:20] * 4
        if kind == 4 and texts:
            own = (r.choice(texts) or "x").split()
            own[len(own) // 2 :][:1] = ["changed"]
        texts.append(r.choice([" ", "\n", "  ", " \t"]).join(own))
    texts += [None, "", " \n\t ", "one", "a b", passage, passage, "x " * 3000]
    return texts


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, ["en", "de", None][k % 3], "big" if k % 2 else f"s{k % 5}", None) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [(1, None), (1, None), (None, "a b c d e"), (2, ""), (2, "other text"), (None, None), (3, "x y z " * 40), (3, "x y z " * 40)]


def edges(spark):
    """Null ids and texts, repeated rows, a repeated id, and columns with clashing names."""
    rows = [(i, t, "src", "a", "b") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, id string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# components


def test_components(sp):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(0, k) for k in range(300, 380)] + [(500 + k, 501 + k) for k in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(sp.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(sp.createDataFrame([], "src long, dst long")).count() == 0


# 1 line dedup


def brute_lines(docs, size=3):
    first, gone = {}, defaultdict(set)
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k : k + size])
            if any(x.strip() for x in w) and first.setdefault(w, (i, k)) != (i, k):
                gone[i].update(range(k, k + size))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t is not None else "" for i, t in docs}


def test_line_dedup(sp):
    r = random.Random(2)
    block = ["top", "menu", "login", "about"]
    texts = []
    for i in range(40):
        lines = [f"line {r.randrange(30)}" for _ in range(r.randrange(0, 9))]
        at = r.randrange(len(lines) + 1)
        texts.append("\n".join(lines[:at] + (block if i % 3 else []) + lines[at:]))
    texts += [None, "", "\n\n\n\n", "a\na\na\na\na", "\n \n\n"]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(sp, texts)).collect()}
    assert {i: r["kept_text"] for i, r in got.items()} == brute_lines(docs)
    assert got[43]["kept_text"] == "a" and [(x["first"], x["n"]) for x in got[43]["removed"]] == [(1, 4)]
    assert line_dedup.dedup_lines(empty(sp)).count() == 0
    out = line_dedup.dedup_lines(edges(sp)).collect()
    assert len(out) == len(EDGES) and all(r["n_removed"] == 0 for r in out)


# 2 mixing


def test_mixing_reaches_the_target(sp):
    texts = [f"w{i} " * (5 + i % 7) for i in range(900)]
    rows = [(i, t, "en", "big" if i < 600 else f"s{i % 4}", None) for i, t in enumerate(texts)] + [(2000, None, "en", None, None), (2001, "a b", "en", None, None)]
    docs = sp.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, target_entropy_share=0.9, max_repeats=None).collect()
    sizes = {i: len(words_of(t)) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    total, copies = Counter(), Counter(r["id"] for r in out)
    for i, n in sizes.items():
        total[source[i]] += n
    whole = sum(total.values())
    p = np.array([total[s] / whole for s in total if total[s]])

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum(), w

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid)[0] > 0.9 * np.log(len(p)) else (low, mid)
    for s, w in zip((s for s in total if total[s]), entropy(high)[1]):
        budget = round(w * whole)
        own = [i for i in sizes if source[i] == s]
        used = sum(copies[i] * sizes[i] for i in own)
        assert budget <= used <= budget + max(sizes[i] for i in own)
        counts = {copies[i] for i in own if sizes[i]}
        assert max(counts) - min(counts) <= 1
        # each copy's place is the share of the budget before it: copies follow each other without a gap, pass by pass
        at = 0
        for r in sorted((r for r in out if r["source"] == s and r["n_tokens"]), key=lambda r: r["place"]):
            assert r["place"] == pytest.approx(at / budget, abs=1e-12) and r["pass"] == at // total[s]
            at += r["n_tokens"]
    assert sorted(r["pass"] for r in out if r["id"] == 2000) == list(range(copies[2000]))  # no tokens: in every whole pass
    orders = [[r["id"] for r in sorted(out, key=lambda r: r["place"]) if r["source"] == "s1" and r["pass"] == k] for k in (0, 1)]
    assert set(orders[1]) <= set(orders[0])  # the second pass is a part of one
    other = mixing.mix(docs, target_entropy_share=0.9, max_repeats=None, seed=9).where("source = 's1' and pass = 0").orderBy("place").collect()
    assert sorted(r["id"] for r in other) == sorted(orders[0]) and [r["id"] for r in other] != orders[0]
    again = mixing.mix(docs, target_entropy_share=0.9, max_repeats=None).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_mixing_limits_and_edges(sp):
    shares = sp.createDataFrame([(0.9,), (0.1,)], "p double")
    a = mixing.find_exponent(shares, None, 2.0)
    w = np.array([0.9, 0.1]) ** a
    assert (w / w.sum() / [0.9, 0.1]).max() == pytest.approx(2.0, abs=1e-6)
    assert mixing.find_exponent(shares, None, None) == 0.0 and mixing.find_exponent(shares, 0.0, None) == 1.0
    assert mixing.mix(empty(sp)).count() == 0
    assert {r["id"] for r in mixing.mix(edges(sp)).collect()} <= {i for i, _ in EDGES}
    out = mixing.mix_documents(edges(sp), max_repeats=None)
    assert out.columns == edges(sp).columns and out.count() == len(EDGES)


# 3 decontamination


def test_decontamination(sp):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (5, 8, 14, 30, 60, 60)] + ["short one", "tiny", "", None]
    texts = []
    for i in range(80):
        own = [r.choice(vocab) for _ in range(r.randrange(0, 300))]
        item = items[i % 6].split()
        if i % 4 == 0:
            own[10:10] = item
        if i % 4 == 1:
            item[len(item) // 2] = "other"
            own[5:5] = item
        if i % 4 == 2:
            own[3:3] = item[: len(item) * 9 // 10]
        texts.append(" ".join(own).upper() if i % 5 == 0 else " ".join(own))
    texts += [None, "", "a short one here", "Tiny", "x\tshort\n ONE"]
    known = sp.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def grams(t, n):
        w = (t or "").lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for j, t in enumerate(items):
        n = min(5, len((t or "").split()))
        own = grams(t, n) if n else set()
        want |= {(i, j, len(own & grams(d, n))) for i, d in enumerate(texts) if own and len(own & grams(d, n)) >= 0.8 * len(own)}
    for sent in (500_000, 40):  # sent to the tasks, and joined
        got = decontaminate.find_contaminated(frame(sp, texts), known, sent_shingles=sent)
        assert {(r["doc_id"], r["item_id"], r["contained"]) for r in got.collect()} == want
    kept = decontaminate.drop_contaminated(frame(sp, texts), known)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in want} and kept.columns == frame(sp, texts).columns
    assert decontaminate.find_contaminated(empty(sp), known).count() == 0
    assert decontaminate.find_contaminated(frame(sp, texts), known.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edges(sp), known).count() == len(EDGES)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_decontamination_of_odd_items(sp, sent):
    """Items without an id, of one id and different lengths, and documents that come twice."""
    items = [(None, "no name but a text of its own"), (7, "two words"), (7, "and a longer text with the same name"), (8, None)]
    docs = [(1, "x NO name but a text of its own y"), (2, "here are two words"), (3, "and a longer text with the same name"), (3, "and a longer text with the same name"), (4, "nothing"), (None, "two words")]
    df = sp.createDataFrame([(i, t, "s", "k", "r") for i, t in docs], "doc_id long, text string, row_key string, k string, row string")
    known = sp.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contaminated(df, known, sent_shingles=sent).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["containment"]) for r in got), key=str) == sorted([(1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0), (3, 7, 1.0), (None, 7, 1.0)], key=str)
    kept = decontaminate.drop_contaminated(df, known, sent_shingles=sent)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(4, "nothing", "s", "k", "r")]


# 4 SimHash


def brute_fingerprint(text, k=3):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    k = min(k, len(w))
    hashes = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(sp):
    texts = corpus()
    prints = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == prints
    ids = [3 * i + 5 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in simhash.simhash_components(frame(sp, texts, ids)).collect()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == dict(zip(ids, prints))
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert [got[i]["component_id"] for i in ids] == [ids[min(k for k, h in enumerate(group) if h == g)] for g in group]


def test_spark_and_the_library_hash_alike(sp):
    assert sp.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_links_within_two_bits_are_all_found(sp):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:20]:
        prints |= {b ^ 1 << r.randrange(64) for _ in range(3)} | {b ^ 1 << r.randrange(63) ^ 1 << 63 for _ in range(3)} | {b ^ 7 << r.randrange(60)}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = components.connected_components(simhash.near_links(sp.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    label = {x["node"]: x["component"] for x in found}
    group = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and group[b] < group[a]:
                    group[a], changed = group[b], True
    assert all(label.get(p, p) == g for p, g in group.items())


def test_simhash_edges(sp):
    got = simhash.simhash_components(edges(sp)).collect()
    assert len(got) == len(EDGES)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["fp"] != 0] == [None]
    assert simhash.simhash_components(empty(sp)).count() == 0


def test_near_copies_leave_one(sp):
    r = random.Random(6)
    vocab = [f"k{i}" for i in range(3000)]
    texts, groups = [], []
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.randrange(80, 400))]
        for c in range(4):
            own = list(base)
            for _ in range(c * len(own) // 120):
                own[r.randrange(len(own))] = r.choice(vocab)
            texts.append(" ".join(own))
            groups.append(g)
    out = near_copies.keep_one_of_each(frame(sp, texts))
    kept = [x["doc_id"] for x in out.collect()]
    # the last copies of some groups are below 0.8, so brute force leaves more than one row of these
    assert sorted(kept) == sorted(brute_groups([t.split() for t in texts])) and {groups[i] for i in kept} == set(range(25))
    assert out.columns == frame(sp, texts).columns
    dup = near_copies.keep_one_of_each(edges(sp)).collect()
    assert Counter((x["doc_id"], x["text"]) for x in dup).most_common(1)[0][1] == 1
    assert near_copies.keep_one_of_each(empty(sp)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def brute_groups(texts):
    """The first text of each component of pairs at 0.8 or more."""
    sets = [{tuple(w.lower() for w in t[i : i + min(5, len(t))]) for i in range(max(1, len(t) - 4))} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return set(group)


def edited(r, base, low, high):
    """`base` with words exchanged until its five-word similarity is in [low, high)."""
    while True:
        own = list(base)
        while jaccard(base, own) >= high:
            own[r.randrange(len(own))] = f"new{r.randrange(10**9)}"
        if jaccard(base, own) >= low:
            return own


def test_near_copies_just_above_the_threshold(sp):
    r = random.Random(7)
    pairs = [(b, edited(r, b, 0.8, 0.83)) for b in ([f"k{r.randrange(3000)}" for _ in range(r.randrange(100, 500))] for _ in range(300))]
    out = near_copies.keep_one_of_each(frame(sp, [" ".join(t) for p in pairs for t in p]))
    assert {x["doc_id"] for x in out.collect()} == set(range(0, 600, 2))


def test_near_copies_are_those_of_brute_force(sp):
    r = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"k{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        texts += [base, edited(r, base, 0.8, 0.83), edited(r, base, 0.77, 0.8), edited(r, base, 0.6, 0.8)]
        texts.append(edited(r, texts[-3], 0.8, 0.85))  # reaches the base over a chain only
    few = [f"v{i}" for i in range(30)] * 4
    texts += [r.sample(few, len(few)) for _ in range(20)]  # the same words in another order
    hot = [f"h{r.randrange(3000)}" for _ in range(150)]
    texts += [edited(r, hot, low, low + 0.1) for low in (0.5, 0.6, 0.7, 0.8, 0.85) for _ in range(40)]
    texts += [["A", "b"], ["a", "B"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], ["a"]]
    r.shuffle(texts)
    out = near_copies.keep_one_of_each(frame(sp, [" ".join(t) for t in texts])).collect()
    want = brute_groups(texts)
    assert {x["doc_id"] for x in out} == want and len(out) == len(want)


def test_dense_cells_lose_no_link(sp, monkeypatch):
    """Sets that share a band by the hundred, few of them near copies, in cells of several blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    r = random.Random(12)
    hot = [f"h{r.randrange(3000)}" for _ in range(120)]
    texts = [edited(r, hot, 0.6, 0.75) for _ in range(150)]
    texts += [edited(r, t, 0.8, 0.85) for t in texts[:40]]
    texts += [edited(r, hot, 0.9, 1.01) for _ in range(60)]
    r.shuffle(texts)
    want = brute_groups(texts)
    out = near_copies.keep_one_of_each(frame(sp, [" ".join(t) for t in texts])).collect()
    assert {x["doc_id"] for x in out} == want and len(out) == len(want) > 100


def test_rows_of_dense_cells_grow_with_their_texts(sp, monkeypatch):
    """Many edits of one text that are mostly too far apart: what is sent to be compared grows with the texts, not with their pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    sent = []
    compare = near_copies.blocks_to_compare

    def counted(*args):
        out = compare(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "blocks_to_compare", counted)
    r = random.Random(13)
    hot = [f"h{r.randrange(3000)}" for _ in range(90)]
    for n in (200, 800):
        texts = [list(hot) for _ in range(n)]
        for t in texts:
            for k in r.sample(range(90), 5):
                t[k] = f"h{r.randrange(3000)}"
        out = near_copies.keep_one_of_each(frame(sp, [" ".join(t) for t in texts])).count()
        assert n * 0.5 < out <= n
    assert 0 < sent[1] <= 4**1.1 * max(sent[0], 200)


# 5 language


def test_language(sp, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def brute_grams(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(clean.split())} "
    return Counter(g for n in (1, 2, 3) for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " ")


def brute_ranks(counts):
    """Most frequent first; ties in the order of the n-grams' code points, shorter ones first."""
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[: language.TOP]


def test_language_by_brute_force(sp):
    r = random.Random(15)
    alphabets = {"x": "abcdefgh", "y": "efghijkl", "z": "äößéab", "w": "ابتثab"}
    texts = [
        (lang, " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 120))))
        for lang, letters in alphabets.items() for _ in range(12)
    ]
    texts += [("x", "aaa bb"), ("y", "Über Das-Ding 12"), ("x", None), ("y", "12 !!"), (None, "abc abc"), ("z", ""), ("w", "ef"), ("twin", "same"), ("copy", "same")]
    df = sp.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    counts = defaultdict(Counter)
    for i, (lang, t) in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and t is not None:
            counts[lang] += brute_grams(t)
    counts = {k: c for k, c in counts.items() if c}
    profiles = {lang: {g: k for k, g in enumerate(brute_ranks(c))} for lang, c in counts.items()}
    known = language.learn_profiles(df.where(~language.held_out())).collect()
    text_of = lambda gram: "".join(chr((gram & (2**64 - 1)) >> s & 0x1FFFFF) for s in (42, 21, 0)).lstrip("\0")
    assert {(x["lang"], text_of(x["gram"]), x["rank"]) for x in known} == {(lang, g, k) for lang, p in profiles.items() for g, k in p.items()}
    got = {x["doc_id"]: x for x in language.learn_and_identify(df).collect()}
    for i, (_, t) in enumerate(texts):
        own = brute_ranks(brute_grams(t or ""))
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - k) if g in p else language.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)  # ties: the first by name
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 - apart[best] / (language.TOP * len(own)), abs=1e-12)
    none = language.identify(df, language.learn_profiles(df.limit(0))).collect()
    assert {(x["lang_pred"], x["score"]) for x in none} == {("und", 0.0)}
    assert language.learn_and_identify(empty(sp)).count() == 0


def test_language_ties(sp):
    """Languages with one profile, and n-grams of one frequency at the end of a profile."""
    words = " ".join(a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")  # more n-grams of one frequency than a profile holds
    df = sp.createDataFrame([(0, words, "b"), (1, words, "a"), (2, words, "b"), (3, words, "a")], "doc_id long, text string, lang string")
    ranks = {lang: [] for lang in "ab"}
    for x in language.learn_profiles(df).orderBy("rank").collect():
        ranks[x["lang"]].append(x["gram"])
    assert ranks["a"] == ranks["b"] and len(ranks["a"]) == language.TOP
    got = language.identify(df, language.learn_profiles(df)).collect()
    assert {(x["lang_pred"], x["score"]) for x in got} == {("a", 1.0)}


# 6 tokens


def test_tokens_round_trip(sp, tmp_path):
    from tokenizers import Tokenizer

    texts = [*corpus(30), "It's a — test…!? Don't 'Tis we'll", "a.b.c!! <|endoftext|> É. é. x²y", "İ. <|STARTOFTEXT|> ﬁ. ǅ! naïve, word. x.　", "é́. ñ,, ß!"]
    tool = Tokenizer.from_file(tokenizer_path())
    ids = [[*e.ids, 2] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = frame(sp, texts, [7 * i % 101 for i in range(len(texts))])
    shards = tokens.write_shards(docs, str(tmp_path), tokenizer_path(), text_bytes_per_shard=2000)
    assert shards.count() > 1
    got = sorted(tokens.read_shards(shards).collect(), key=lambda r: r["start"])
    order = sorted(range(len(texts)), key=lambda i: 7 * i % 101)
    start = 0
    paths = {r["shard"]: r["path"] for r in shards.collect()}
    for r, i in zip(got, order):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (7 * i % 101, start, len(ids[i]))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        assert tokens.Shard(paths[r["shard"]]).ids(r["frame"]).tolist() == ids[i]
        start += len(ids[i])


def test_tokens_checksums_and_edges(sp, tmp_path):
    row = tokens.write_shards(edges(sp), str(tmp_path), tokenizer_path()).first()
    got = sorted(tokens.read_shards(tokens.write_shards(edges(sp), f"{tmp_path}/b", tokenizer_path())).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 2, 3, 3]
    data = bytearray(open(row["path"], "rb").read())
    shard = tokens.Shard(row["path"])
    data[int(shard.begins[7]) + int(shard.sizes[7]) - 3] ^= 0x55
    open(f"{tmp_path}/bad", "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  (zstandard's own error, or the checksum's)
        tokens.Shard(f"{tmp_path}/bad").ids(7)
    assert tokens.write_and_read(empty(sp), tokenizer_path()).count() == 0


def test_seek_table_is_the_public_format(sp, tmp_path):
    import zstandard

    row = tokens.write_shards(frame(sp, ["a b", "c"]), str(tmp_path), tokenizer_path()).first()
    data = open(row["path"], "rb").read()
    with open(row["path"], "rb") as f:  # readers of plain zstandard skip what isn't data
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [i for k in range(2) for i in tokens.Shard(row["path"]).ids(k).tolist()]
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")


def test_tokenizers_that_keep_case_or_join_punctuation_are_run_on_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    letters = [chr(i) for i in range(33, 127)]
    cases = {"case": (None, pre_tokenizers.Whitespace()), "joined": (normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit())}
    for name, (normalizer, split) in cases.items():
        tool = Tokenizer(models.BPE(unk_token="?"))
        if normalizer:
            tool.normalizer = normalizer
        tool.pre_tokenizer = split
        tool.train_from_iterator(["word. word. end. the end."] * 9, trainers.BpeTrainer(vocab_size=200, initial_alphabet=letters, special_tokens=["?"]))
        tool.save(f"{tmp_path}/{name}.json")
        assert not tokens.WordEncoder(f"{tmp_path}/{name}.json").check()
    assert tokens.WordEncoder(tokenizer_path()).check()


# 7 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(sp):
    r = random.Random(8)
    rows = [(i, f"http://h/{i} é", r.choice(["same", "", "<p>é</p>", "x" * 70000, f"own {i} " * r.randrange(1, 900), None])) for i in range(80)]
    got = {x["page_id"]: x for x in warc.archive_and_read(pages(sp, rows)).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        body = (h or "").encode()
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
        assert got[i]["payload"] == (body if want[2] == "response" else None)


def test_warc_ranges_share_out_every_record_once(sp, tmp_path):
    r = random.Random(9)
    noise = bytes(r.getrandbits(8) for _ in range(3000)) + warc.GZIP_MAGIC * 50
    records = [warc.record(i, "u", noise[: r.randrange(3000)] + warc.GZIP_MAGIC, "D", None) for i in range(60)]
    import gzip

    # level 0 keeps the magic numbers inside members visible
    data = b"".join(gzip.compress(x, 0, mtime=0) if i % 2 else warc.member(x) for i, x in enumerate(records))
    path = f"{tmp_path}/a.warc.gz"
    open(path, "wb").write(data)
    for size in (1, 7, 100, 1000, 10**6):
        with warc.open_at(path) as f:
            if size == 1:
                starts = [at for at, _, _ in warc.records_starting_in(f, 0, len(data))]
                assert len(starts) == 60
                continue
            found = [x for a in range(0, len(data), size) for x in warc.records_starting_in(f, a, min(a + size, len(data)), 64)]
        assert [d for _, _, d in found] == records


@pytest.mark.parametrize("size", [50, 700, 10**6])
def test_warc_other_records_and_damage(sp, tmp_path, size):
    """Archives of others: version 1.0, warcinfo, request and metadata records, digests that aren't SHA-1, and damaged bytes."""
    old = warc.record(1, "http://a/", b"<p>", warc.payload_digest(b"<p>"), None).replace(b"WARC/1.1", b"WARC/1.0", 1)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:x-y>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoft: x\r\n\r\n\r\n"
    request = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Type: application/http\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Payload-Digest: md5:00\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    last = warc.record(2, "http://b/", b"q" * 900, warc.payload_digest(b"q" * 900), None)
    whole = [warc.member(x) for x in (info, old, request, other, last)]

    def read(parts, **options):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}.warc.gz"
        open(path, "wb").write(b"".join(parts))
        files = sp.createDataFrame([(path, sum(map(len, parts)))], "path string, bytes long")
        return sorted(((r["record_type"], r["page_id"], r["payload_bytes"]) for r in warc.read_warc(files, size, **options).collect()), key=str)

    good = [("metadata", None, 2), ("request", None, 0), ("response", 1, 3), ("response", 2, 900), ("warcinfo", None, 9)]
    assert read(whole) == good
    bad = bytearray(whole[1])
    bad[-6] ^= 0x40  # the CRC
    spoilt = [whole[0], bytes(bad), *whole[2:]]
    with pytest.raises(Exception, match="no record in bytes"):
        read(spoilt)
    assert read(spoilt, on_damage="row") == sorted([x for x in good if x[1] != 1] + [("damaged", None, len(bad))], key=str)
    assert read([b"junk", *whole, whole[4][:20]], on_damage="row") == sorted([*good, ("damaged", None, 4), ("damaged", None, 20)], key=str)
    wrong = warc.member(last.replace(b"qqqq", b"qqqz", 1))
    with pytest.raises(Exception, match="another digest"):
        read([wrong])
    assert [x[0] for x in read([wrong, whole[1]], on_damage="row")] == ["damaged", "response"]


def test_warc_edges(sp):
    rows = [(1, None, "p"), (1, None, "p"), (None, "u", "p"), (None, "u", "q"), (5, "u\r\nX: y", "z")]
    got = sorted(((x["page_id"], x["record_type"], x["refers_to"]) for x in warc.archive_and_read(pages(sp, rows)).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None), (5, "response", None)], key=str)
    assert warc.archive_and_read(pages(sp, []).limit(0)).count() == 0


# 8 quality


def brute_quality(text):
    t = text or ""
    w = [x.decode() for x in words_of(t)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


def test_quality(sp):
    texts = [*corpus(), "a b c " * 40, "W#*$ " * 60, "l1 x\nl1 x\n\n \nl1 x", "UPPER CASE ONLY " * 30]
    got = {r["doc_id"]: r for r in quality.quality_report(frame(sp, texts)).collect()}
    judged = {r["doc_id"]: r["rejected_by"] for r in quality.judge(frame(sp, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert r["kept"] == (judged[i] is None) and not (r["kept"] and r["base_failed"])
    orders = [list(quality.RULES), list(reversed(quality.RULES))]
    verdicts = [{r["doc_id"] for r in quality.judge(frame(sp, texts), rules=o).where("rejected_by is null").collect()} for o in orders]
    assert verdicts[0] == verdicts[1] == {i for i, v in judged.items() if v is None}


def test_quality_edges(sp):
    assert quality.quality_report(empty(sp)).count() == 0 and quality.judge(edges(sp)).count() == len(EDGES)
    assert {r.name for r in quality.order_rules(empty(sp))} == {r.name for r in quality.RULES}


# 9 URLs


def test_rules_and_hosts(sp):
    rows = [
        (1, "http://A.Com/en/x?q#f", None), (2, "https://example.com/en/71", None), (3, "http://x.net/de/8", None), (4, "http://www.example.net/de/88", None),
        (5, "ftp://org/es/", None), (6, "nowhere", None), (7, None, None), (8, "http://notcom/en/", None), (9, "http://h.com?x=://b.org/es/", None), (9, "http://h.com?x=://b.org/es/", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages(sp, rows)).collect()}
    assert got == {
        1: ("a.com", "/en/x", "com/en/", "block"), 2: ("example.com", "/en/71", "example.com/en/7", "allow"), 3: ("x.net", "/de/8", "net/de/", "allow"),
        4: ("www.example.net", "/de/88", "example.net/de/8", "block"), 5: ("org", "/es/", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notcom", "/en/", None, "allow"), 9: ("h.com", "", None, "allow"),
    }
    many = [*urls.PRODUCTION_RULES, *[f"allow host{i}.test/a" for i in range(80)]]
    joined = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages(sp, rows), many).collect()}
    assert joined == got
    with pytest.raises(ValueError):
        urls.parse_rules(["deny x"])


def test_many_rules_of_one_domain(sp, monkeypatch):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("/abé") for _ in range(r.randrange(n)))
    hosts = ["com", "b.com", "a.b.com", "com.b", "org", "xcom"]
    lines = [f"{r.choice(['block', 'allow'])} {r.choice(hosts)}{'/' + some(5) if r.random() < 0.95 else ''}" for _ in range(300)]
    rows = [(i, f"http://{r.choice([*hosts, 'c.a.b.com', 'B.Com', ''])}/{some(9)}?q", None) for i in range(400)] + [(400, None, None), (401, "com/a", None), (402, "x://com", None)]

    def judged(host, path):
        own = [(len(x.name), x.name, x.verdict) for x in urls.parse_rules(lines) if host and (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        return max(own)[1:] if own else (None, "allow")

    got = urls.filter_urls(pages(sp, rows), lines).collect()
    wanted = {x["page_id"]: judged(x["host"], x["path"]) for x in got}
    assert len(got) == len(rows) and len(set(wanted.values())) > 40
    assert {x["page_id"]: (x["rule"], x["verdict"]) for x in got} == wanted
    monkeypatch.setattr(urls, "COMPILED_RULES", 1000)
    by_id = lambda found: sorted(found, key=lambda x: x["page_id"])
    assert by_id(urls.filter_urls(pages(sp, rows), lines).collect()) == by_id(got)


def test_decisions_reach_aliases(sp):
    link = lambda u: f'<html><link href="{u}" rel="canonical"></html>'
    rows = [
        (1, "http://bad.com/en/1", ""), (2, "http://a.test/", link("http://BAD.com/en/1#x")), (3, "http://b.test/", '<meta http-equiv="refresh" content="0; url=http://a.test/">'),
        (4, "http://c.test/", link("http://bad.com/en/2")), (5, "http://d.test/", link("http://c.test/")), (6, "http://example.com/en/7", link("http://d.test/")), (7, "http://e.test/", "<p>"),
    ]
    redirects = sp.createDataFrame([("http://f.test/", "http://b.test/"), (None, "x"), ("http://e.test/", "http://e.test/")], "src string, dst string")
    rows += [(8, "http://f.test/", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages(sp, rows), redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    assert urls.filter_urls(pages(sp, rows).limit(0)).count() == 0


def test_alias_targets_are_resolved(sp):
    links = {
        "/new?a=1&amp;b=2": "http://x.org/new?a=1&b=2", "c.html": "http://x.org/p/q/c.html", "../c/./d/..": "http://x.org/p/c/", "//Other.net/x": "http://other.net/x",
        "?k=v#f": "http://x.org/p/q/a?k=v", "https://y.org/z": "https://y.org/z", "/../r?u=http://n.org/": "http://x.org/r?u=http://n.org/", "..": "http://x.org/p/", "mailto:a@b": None, "#top": None,
    }
    page = "http://X.org/p/q/a?old#f"
    tags = [f'<link rel="canonical" href="{t}">' for t in links] + ['<meta http-equiv=refresh content="0; url=/again">', "<META HTTP-EQUIV='refresh' CONTENT='1;URL=more'>"]
    rows = [(1, page, "".join(tags)), (2, "http://b.org/1", '<base href="/deep/er/"><link rel=canonical href=x>'), (3, "no scheme", '<link rel=canonical href="/x">'), (4, "http://h.org", '<link rel=canonical href="x">'), (5, None, None)]
    # the bare #top of a page names the page without its fragment, which isn't an edge
    got = urls.alias_edges(sp.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {("http://x.org/p/q/a?old", u) for u in links.values() if u} | {("http://x.org/p/q/a?old", f"http://x.org/{u}") for u in ("again", "p/q/more")}
    assert {tuple(r) for r in got} == want | {("http://b.org/1", "http://b.org/deep/er/x"), ("http://h.org", "http://h.org/x")}
    pages = [(1, "http://ads.com/en/1", None), (2, "http://ok.org/a", '<link rel="canonical" href="//ads.com/en/1">')]
    out = urls.filter_urls(sp.createDataFrame(pages, "page_id long, url string, html string"), ["block com/en/"]).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "block"}


# 10 substrings


def brute_repeats(texts, window):
    all_words = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize(("window", "first"), [(35, 18), (35, 5), (10, 3), (2, 1)])
def test_repeats(sp, window, first):
    texts = corpus()
    got = {r["doc_id"]: r["kept_text"] for r in repeats.remove_repeats(frame(sp, texts), window=window, first=first).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, window)


def test_repeats_edges(sp):
    got = repeats.remove_repeats(edges(sp)).collect()
    assert len(got) == len(EDGES) and sorted(r["n_removed"] for r in got)[-2:] == [120, 120]
    assert repeats.remove_repeats(empty(sp)).count() == 0
    assert repeats.levels(35, 5) == [5, 9, 18, 35]


# all of them


def test_names_that_clash_and_long_texts(sp):
    """A text of 10 MB, and columns named like those that the operators derive."""
    r = random.Random(20)
    vocab = [f"word{i}" for i in range(60000)]
    long = "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(110000))
    assert len(long) > 10_000_000
    short = " ".join(r.choice(vocab) for _ in range(100))
    extra = ["k", "row", "sid", "rejected_by", "__key", "__row_key", "row_key", "runs", "copies", "body", "fp", "group"]
    rows = [(i, t, "en", "s", 1, *extra) for i, t in enumerate([long, short, f"{long} end", None, ""])]
    docs = sp.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in extra)).repartition(5)
    same = lambda df, ids: df.columns == docs.columns and sorted((x["doc_id"], tuple(x[c] for c in extra)) for x in df.collect()) == [(i, tuple(extra)) for i in ids]
    assert same(quality.keep_accepted(docs), [0, 1, 2])
    assert same(near_copies.keep_one_of_each(docs), [0, 1, 3])
    items = sp.createDataFrame([(1, " ".join(short.split()[3:30]))], "item_id long, text string")
    assert same(decontaminate.drop_contaminated(docs, items), [0, 2, 3, 4])
    assert same(mixing.mix_documents(docs), range(5))
    assert [x["n_removed"] for x in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 0, 109999, 0, 0]
    assert [x["n_words"] - x["n_removed"] for x in repeats.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 100, 1, 0, 0]
    assert [x["component_id"] for x in simhash.simhash_components(docs).orderBy("doc_id").collect()] == [0, 1, 0, 3, 3]
    assert language.learn_and_identify(docs).count() == 5
    assert [x["n_tokens"] > 1 for x in tokens.write_and_read(docs, tokenizer_path()).orderBy("doc_id").collect()] == [True, True, True, False, False]
    web = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in extra])
    assert [x["payload_bytes"] for x in warc.archive_and_read(web).orderBy("page_id").collect()] == [len(long), len(short), len(long) + 4, 0, 0]
    assert urls.filter_urls(web).count() == 5
