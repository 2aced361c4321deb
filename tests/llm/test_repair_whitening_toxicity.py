"""Conversation repair, whitening and toxicity against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import conversations, toxicity, whitening
from tessera.llm.oracles import ORACLES
from tessera.llm.shared import ship

CONVERSATIONS = "conv_id long, turn long, role string, text string, id string, key string"


@pytest.fixture(scope="module")
def sp(spark):
    return ship(spark)


def chats(n=60, seed=0):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Hello.", "Fine!  ", "Cut of", "Cut ", "", " \t\n", "Why?\n", None, "né, a.", "a.\r"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None, 1]), role, text, "x", "y"))
    rows += [(None, 1, "user", "Null id.", "x", "y"), (None, 2, "assistant", "Yes.", "x", "y"), *[(900, 1, "user", "same", "x", "y")] * 7]
    rows += [(901, k, "user" if k % 2 else "assistant", "long " * 20000 + ".", "x", "y") for k in range(5)]
    return rows


def best_edits(rows):
    """(cost, audit, repaired) by trying every edit at every place."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def whole(roles):
        initials = "".join(r[:1] or "_" for r in roles)
        rest = initials[1:] if initials[:1] == "s" else initials
        return (initials == "" or rest != "") and rest == "ua" * (len(rest) // 2)

    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(maxsize=None)
    def after(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follow[state]:
                    c, a, t = after(i, follow[state][role[0]], inserted + 1)
                    found.append((c + 3, "I" + a, (role + ":",) + t))
        if i < len(rows):
            c, a, t = after(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if kinds[i] in ("", "truncated"):
                more = 3 if kinds[i] else 0
                for edit, role, cost in (("K", rows[i][0], more), ("R", "user", 3 + more), ("R", "assistant", 3 + more)):
                    if role[:1] in follow[state]:
                        c, a, t = after(i + 1, follow[state][role[:1]], 0)
                        found.append((c + cost, edit + a, (role + ":" + rows[i][1],) + t))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = after(0, "", 0)
    assert whole([x.split(":")[0] for x in lines])
    return cost, audit, "\n".join(lines), kinds


def expected(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        group = groups.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        group += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = {t for t, _, _ in group if t is not None}
        cost, audit, said, kinds = best_edits([(r, t) for _, r, t in group])
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("length", [conversations.LONG, 3])
def test_repair(sp, length):
    """Length 3: most conversations are dealt over several parts."""
    rows = chats(60 if length > 3 else 25)
    damaged = conversations.damage(sp.createDataFrame(rows, CONVERSATIONS))
    got = {r["id"]: tuple(r[n] for n in NAMES) for r in conversations.repair_report(damaged, length).collect()}
    assert got == expected(rows)


def test_repair_sql_agrees(sp):
    rows = chats(seed=5)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    names = [d[0] for d in con.execute(ORACLES["op11_conversation_repair"]).description]
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in (dict(zip(names, row)) for row in con.execute(ORACLES["op11_conversation_repair"]).fetchall())}
    assert got == expected(rows)


def test_repaired_rows_are_whole_conversations(sp):
    rows = conversations.damage(sp.createDataFrame(chats(), CONVERSATIONS))
    for r in conversations.repair(rows).collect():
        initials = "".join(x["role"][0] for x in r["repaired"])
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and (rest or not initials)


def test_repair_of_empty_tables(sp):
    rows = conversations.damage(sp.createDataFrame([], CONVERSATIONS))
    assert conversations.repair_report(rows).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = conversations.damage(sp.createDataFrame([(gone, 1, "user", "x.", "", "")], CONVERSATIONS))
    assert [tuple(r) for r in conversations.repair_report(rows).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_automaton_has_few_states():
    automaton = conversations.Automaton()
    r = random.Random(2)
    for _ in range(300):
        automaton.scan([r.choice("dsua?SUAX") for _ in range(50)])
    assert len(automaton.vectors) < 200


# whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, id string"


def vectors(n=300, dims=20, seed=0):
    g = np.random.default_rng(seed)
    base = g.normal(size=(n, 5)) @ g.normal(size=(5, dims)) + 3 + 0.3 * g.normal(size=(n, dims))
    rows = [(i, v.astype(np.float32).tolist(), 0, 1, "a") for i, v in enumerate(base)]
    odd = [[1.0] * (dims - 1) + [x] for x in (None, float("nan"), float("inf"))] + [None, []]
    return rows + [(n + k, v, None, None, None) for k, v in enumerate(odd)] + [(7, rows[7][1], 0, 1, "b")] * 200 + [(None, rows[3][1], 0, 1, "c")]


def test_whitening_by_brute_force(sp):
    rows = vectors()
    got = whitening.whiten(sp.createDataFrame(rows, VECTORS).repartition(5)).toPandas()
    good = [(r[0], np.floor(np.asarray(r[1], dtype=np.float64) * 64) + 1_000_000) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    fit = np.unique([x for _, x in good], axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert len(got) == 16 * len(good) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    for vec in (0, 7, 123):
        x = next(x for i, x in good if i == vec)
        own = got[got["vec_id"] == vec].drop_duplicates("component").sort_values("component")
        assert [int(d) for d in own["deviation"]] == [int(((n * x - total) ** 2).sum())] * 16
        want = ((x - total / n) @ axes / np.sqrt(values))[::-1][:16]
        np.testing.assert_allclose(np.abs(own["whitened"]), np.abs(want), rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(own["explained"], (values / values.sum())[::-1][:16], rtol=1e-9)


def test_merged_moments_are_those_of_all_rows():
    rows = np.random.default_rng(1).integers(0, 50, size=(1000, 6)) + 10**6
    parts = [whitening.Moments.of(rows[a:b]) for a, b in ((0, 1), (1, 300), (300, 1000))]
    whole = parts[0].merged(parts[1]).merged(parts[2])
    np.testing.assert_allclose(whole.scatter / whole.n, np.cov(rows.T, bias=True), rtol=1e-12)
    assert whole.sums.tolist() == rows.sum(axis=0).tolist()


def test_deviations_beyond_64_bits():
    known = whitening.Whitener(10**10, np.array([3, 5], dtype=object) * 10**15, np.zeros((2, 1)), np.zeros(1))
    x = np.array([[1_000_000, 7]])
    assert known.deviations(x) == [(10**16 - 3 * 10**15) ** 2 + (7 * 10**10 - 5 * 10**15) ** 2]


def test_whitening_edges(sp):
    assert whitening.whiten(sp.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(sp.createDataFrame([(1, [1.0, 2.0], 0, 1, "")] * 3, VECTORS)).collect() == []  # no variance
    flat = sp.createDataFrame([(i, [float(i), 2.0, float(i)], 0, 1, "") for i in range(5)], VECTORS)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.whiten(sp.createDataFrame([(1, [1.0], 0, 1, ""), (2, [1.0, 2.0], 0, 1, "")], VECTORS))


# toxicity

DOCS = "doc_id long, text string, lang string, source string, id string, label int"


def insults(n=1500, seed=0):
    """Texts of made-up words; every sixth has one of a few insults in about a tenth of its places."""
    r = random.Random(seed)
    parts = ["ba", "ko", "tir", "mel", "su", "nar", "e", "vin", "lo", "gas"]
    vocab = ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(20, 200))]
        if i % 6 == 0:
            words = [r.choice(["zwerxq", "plonkhead", "Gruzzle"]) if r.random() < 0.1 else w for w in words]
        docs.append((i, " ".join(words), "en", "s", "x", 5))
        labels.append((i, 1, int(any(w in ("zwerxq", "plonkhead", "Gruzzle") for w in words))))
    return docs, labels


def test_toxicity_of_held_out_rows(sp):
    docs, labels = insults()
    extra = [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (None, "12 34", None, None, None, None), (5002, docs[0][1] * 200, "", "", "", 0), (5002, docs[1][1] * 200, "", "", "", 0)]
    got = toxicity.learn_and_score(sp.createDataFrame(docs + extra, DOCS), sp.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.03 * sum(1 - t for t, _ in held)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (5000, 5001, None))
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 5002) == [0, 1]


def test_toxicity_ignores_held_out_labels(sp):
    docs, labels = insults(600)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    frame = sp.createDataFrame(docs, DOCS)
    scores = [sorted(map(tuple, toxicity.learn_and_score(frame, sp.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels(sp):
    docs, labels = insults(30)
    frame = sp.createDataFrame(docs, DOCS)
    none = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    one = sp.createDataFrame([(i, q, 0) for i, q, _ in labels] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for given in (none, one):
        assert {(r["score"], r["predicted"]) for r in toxicity.learn_and_score(frame, given).collect()} == {(0.0, 0)}
    assert toxicity.learn_and_score(sp.createDataFrame([], DOCS), none).collect() == []


def test_windows_are_words():
    offsets, found = toxicity.windows(pa.array(["A b, C d e f g", None, "12", "Été x"]))
    assert offsets.tolist() == [0, 2, 2, 2, 3]
    assert found.to_pylist() == [b" a b c d e f ", b" g ", " été x ".encode()]
