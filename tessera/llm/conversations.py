"""Repair of conversation structure at the least cost (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize, require
from tessera.llm.words import whole_groups

#: Costs of rerole, delete, insert, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Conversations of more rows than this are dealt over many tasks.
LONG = 100_000

#: States by the role initials so far: none, s, ..u, ..a; those of 0 and 3 are whole conversations.
_STATES, _WHOLE = range(4), (0, 3)
_LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"
#: The state after a user's or assistant's row; a state has one such row at most.
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 40

#: What a row is to the costs: "d" if it must go, else its role's initial ("?" if none of s, u, a), in upper case ("X") if truncated.
Symbol = str
Vector = tuple[int, ...]


def _arcs(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that take in a row, by the edit's letter."""
    out = [("D", DELETE, state)]
    if symbol != "d":
        more, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        wanted, after = _NEXT[state]
        if role == wanted:
            out.append(("K", more, after))
        elif role == "s" and state == 0:
            out.append(("K", more, 1))
        out.append(("R", REROLE + more, after))
    return out


def _with_inserts(costs: Sequence[int]) -> Vector:
    """Costs to the end from each state, if rows may be inserted first; two at most are of use."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[_NEXT[q][1]]) for q, c in enumerate(out)]
    return tuple(out)


#: Costs to the end where no row is left.
_END = _with_inserts([0 if q in _WHOLE else _FAR for q in _STATES])


class Automaton:
    """The weighted repair automaton, read from the last row to the first and made deterministic as far as it is met.

    A state is the vector of the costs to the end from each of the four states, less its least entry; the
    entry that was taken off is the transition's weight. The vectors that occur are few, so after some rows the
    scan only looks transitions up."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.table: dict[tuple[int, Symbol], tuple[int, int]] = {}

    def number(self, vector: Vector) -> tuple[int, int]:
        """(state, weight) of a vector of costs."""
        least = min(vector)
        vector = tuple(min(c - least, _FAR) for c in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def step(self, state: int, symbol: Symbol) -> tuple[int, int]:
        found = self.table.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            found = self.number(_with_inserts([min(w + after[to] for _, w, to in _arcs(symbol, q)) for q in _STATES]))
            self.table[state, symbol] = found
        return found

    def scan(self, symbols: Sequence[Symbol], end: Vector = _END) -> tuple[list[int], int]:
        """(states before each row and after the last, weight of all): the costs to the end before
        row i are those of its state, but for a constant."""
        state, total = self.number(end)
        states = [state]
        for symbol in reversed(symbols):
            state, weight = self.step(state, symbol)
            total += weight
            states.append(state)
        states.reverse()
        return states, total

    def trace(self, symbols: Sequence[Symbol], states: Sequence[int], start: int, last: bool = True) -> tuple[str, list[str | None], int]:
        """(edits, roles, state reached) from state `start` along tight arcs, the least letter first. An edit
        leads to one state, so the first choice of a letter never has to be taken back. roles has None for a row that keeps its own.
        last: no rows follow, so rows are inserted at the end, too; otherwise these belong to what follows."""
        edits, roles, q = [], [], start
        for i, symbol in enumerate(symbols):
            here, after, moved = self.vectors[states[i]], self.vectors[states[i + 1]], self.step(states[i + 1], symbol)[1]
            while True:
                tight = {e: to for e, w, to in _arcs(symbol, q) if w + after[to] - moved == here[q]}
                if INSERT + here[_NEXT[q][1]] == here[q]:
                    tight["I"] = _NEXT[q][1]
                edit = min(tight)
                edits.append(edit)
                if edit != "D":
                    roles.append(None if edit == "K" else _ROLE[_NEXT[q][0]])
                q = tight[edit]
                if edit != "I":
                    break
        while last and q not in _WHOLE:
            role, q = _NEXT[q]
            edits.append("I")
            roles.append(_ROLE[role])
        return "".join(edits), roles, q


_AUTOMATON = Automaton()


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, gone): rows damaged by a hash of id and turn, modulo 20: 0 gone (kept as a mark that the
    conversation exists), 1 emptied, 2 without full stops, exclamation and question marks, 3 repeated, 4 a user's. Null
    ids and turns count as one space in the hash, null roles and texts are one space."""
    require(conversations, id_col, turn_col, role_col, text_col)
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("code") != 0, F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    role = F.when(F.col("code") == 4, "user").when(F.col("code") != 0, F.col("role"))
    return rows.select("id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), times.alias("time")).drop("time")


def _summary(turns: list, roles: list[str], faults: str) -> dict:
    """What is counted of consecutive rows; faults has b, d, t or a space for each."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {
        "least": min(known, default=None), "most": max(known, default=None), "distinct": len(set(known)),
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def _symbols(roles: list[str], faults: str) -> list[Symbol]:
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "?" for r in roles]
    # an upper-case "?" would be itself, so rows of other roles that are truncated are "X"
    return ["d" if f in "bd" else (i.upper() if i != "?" else "X") if f == "t" else i for i, f in zip(initials, faults)]


def _edited(roles: list[str], texts: list[str], edits: str, new_roles: list[str | None]) -> list[dict]:
    """The repaired rows."""
    out, i, made = [], 0, iter(new_roles)
    for e in edits:
        if e != "D":
            role = next(made)
            out.append({"role": role or roles[i], "text": "" if e == "I" else texts[i]})
        i += e != "I"
    return out


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROWS = "array<struct<role:string,text:string>>"


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with a key that is never null: (none, key, id, turn, role, text)."""
    return rows.select(F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "id", "turn", "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of conversations whose rows fit a task: a
    row a conversation, with its repaired rows. `rows` is (id, turn, role, text, gone) as of damage().

    A conversation's rows are taken by turn, nulls first, then role and text, so equal turns have one order. A null id is an id like any
    other; a conversation of which all rows are gone has zeros, no edits and no rows. One exchange; a task holds one conversation."""
    keyed = _ordered(rows)
    schema = rows.select("id").schema.simpleString().removeprefix("struct<id:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for group in whole_groups(batches, 2):
            _, _, ids, turns, roles, texts = [c.to_pylist() for c in group.columns]
            there = [i for i, r in enumerate(roles) if r is not None]
            turns, roles, texts = ([x[i] for i in there] for x in (turns, roles, texts))
            faults, seen = "", set()
            for said in zip(roles, texts):
                bare = said[1].strip(_SPACE)
                faults += "b" if not bare else "d" if said in seen else "t" if bare[-1] not in ".!?" else " "
                seen.add(said)
            facts, symbols = _summary(turns, roles, faults), _symbols(roles, faults)
            states, total = _AUTOMATON.scan(symbols)
            edits, new_roles, _ = _AUTOMATON.trace(symbols, states, 0)
            gaps = facts["most"] - facts["least"] + 1 - facts["distinct"] if facts["distinct"] else 0
            cost = total + _AUTOMATON.vectors[states[0]][0]
            held.append((ids[0], gaps, facts["blank"], facts["duplicate"], facts["truncated"], facts["illegal"], cost, edits, _edited(roles, texts, edits, new_roles)))
            if len(held) == 512:
                yield _batch(held, ids_type)
                held = []
        if held:
            yield _batch(held, ids_type)

    ids_type = _arrow_type(rows)
    dealt = keyed.repartition("none", "key").sortWithinPartitions("none", "key", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, f"id {schema}, {_REPORT}, repaired {_ROWS}")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def _batch(held: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
    names = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    types = [ids_type, *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(types)], names)


# conversations of any length, dealt over many tasks


def _matrix(symbols: Sequence[Symbol]) -> list[int]:
    """Costs of consecutive rows from each state (row) to each (column), which compose by min and plus."""
    columns = []
    for q in _STATES:
        states, total = _AUTOMATON.scan(symbols, tuple(0 if p == q else _FAR for p in _STATES))
        columns.append([total + c for c in _AUTOMATON.vectors[states[0]]])
    return [columns[q][p] for p in _STATES for q in _STATES]


def repair_long(rows: DataFrame, length: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conversations too long for a task: what repair() reports, and (id, part, place, role, text).

    Rows are sorted globally in parts of about `length`. Rows said before are found by an aggregate of hashes of 128 bits. Each part
    is a matrix of 4 by 4 costs; these compose from the last part to the first into the costs that each part ends with, with which a part
    is traced from all four states, and the states that the parts really start in are composed from the first to the last.
    A composing task holds a small row for each part of a conversation, never its rows."""
    whose = ["none", "key"]
    order = [*whose, F.col("turn").asc_nulls_first(), "role", "text"]
    kept = _ordered(rows.where("not gone"))
    n = max(1, -(-kept.count() // length))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32())).append_column("place", pa.array(range(place, place + batch.num_rows), pa.int64()))
            place += batch.num_rows

    schema = kept.schema.add("part", "integer").add("place", "long")
    placed = materialize(kept.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "conversation-rows")
    hashed = placed.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "role", "text")})
    first = hashed.groupBy(*whose, "h", "g").agg(F.min(F.struct("part", "place")).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(bare == "", "b").when(F.struct("part", "place") != F.col("first"), "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise(" ")
    flagged = hashed.join(first, [*whose, "h", "g"]).select(*whose, "part", "place", "turn", F.substring("role", 1, 1).alias("role"), fault.alias("fault"))

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        roles, faults = group["role"].tolist(), "".join(group["fault"])
        symbols = _symbols(roles, faults)
        facts = _summary([None if pd.isna(t) else int(t) for t in group["turn"]], roles, faults)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in ("none", "key", "part")}, **facts, "symbols": "".join(symbols), "matrix": _matrix(symbols)}])

    facts = "least long, most long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    parts = materialize(flagged.groupBy(*whose, "part").applyInPandas(summarise, f"none boolean, key string, part int, {facts}, symbols string, matrix array<long>"), "conversation-parts")

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part").reset_index(drop=True)
        vector, ends = _END, []
        for m in reversed(group["matrix"].tolist()):
            ends.append(list(vector))
            vector = _with_inserts([min(m[4 * p + q] + vector[q] for q in _STATES) for p in _STATES])
        known = group[group["distinct"] > 0]
        least, most = known["least"].tolist(), known["most"].tolist()
        distinct = int(known["distinct"].sum()) - sum(a == b for a, b in zip(most, least[1:]))
        gaps = int(max(most) - min(least) + 1 - distinct) if distinct else 0
        borders = sum(a + b not in _LEGAL for a, b in zip(group["last"], group["first"][1:]))
        sums = {k: int(group[k].sum()) for k in ("blank", "duplicate", "truncated")}
        return group[["none", "key", "part"]].assign(end=ends[::-1], gaps=gaps, **sums, illegal=int(group["illegal"].sum()) + borders, cost=int(vector[0]))

    totals = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    ends = materialize(parts.drop("symbols").groupBy(*whose).applyInPandas(compose, f"none boolean, key string, part int, end array<long>, {totals}"), "conversation-ends")

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for none, key, part, symbols, end in zip(*[frame[k] for k in ("none", "key", "part", "symbols", "end")]):
                states, _ = _AUTOMATON.scan(symbols, tuple(int(c) for c in end))
                found = [_AUTOMATON.trace(symbols, states, q, last=False) for q in _STATES]
                yield pd.DataFrame([(none, key, part, q, to, edits, made) for q, (edits, made, to) in enumerate(found)], columns=["none", "key", "part", "start", "to", "edits", "roles"])

    ways = materialize(
        parts.select(*whose, "part", "symbols").join(ends.select(*whose, "part", "end"), [*whose, "part"])
        .mapInPandas(trace, "none boolean, key string, part int, start int, to int, edits string, roles array<string>"), "conversation-ways",
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        to, q, out = {(p, s): t for p, s, t in zip(group["part"], group["start"], group["to"])}, 0, []
        numbers = sorted(set(group["part"]))
        for p in numbers:
            out.append((group["none"].iloc[0], group["key"].iloc[0], p, q, p == numbers[-1]))
            q = to[p, q]
        return pd.DataFrame(out, columns=["none", "key", "part", "start", "is_last"])

    starts = ways.drop("edits", "roles").groupBy(*whose).applyInPandas(walk, "none boolean, key string, part int, start int, is_last boolean")
    tail = F.when(F.col("is_last") & (F.col("to") == 1), 2).when(F.col("is_last") & (F.col("to") == 2), 1).otherwise(0)
    added = F.slice(F.array(F.lit("user"), F.lit("assistant")), 3 - tail, tail)
    taken = ways.join(starts, [*whose, "part", "start"]).select(
        *whose, "part", F.concat("edits", F.repeat(F.lit("I"), tail)).alias("edits"), F.concat("roles", added).alias("roles")
    )
    taken = materialize(taken, "conversation-edits")
    ids = placed.groupBy(*whose).agg(F.first("id").alias("id"))
    audit = taken.groupBy(*whose).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    report = ends.drop("part", "end").distinct().join(audit, whose).join(ids, whose).select("id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def edit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        found = _edited(group["role"].tolist(), group["text"].tolist(), group["edits"].iloc[0], list(group["roles"].iloc[0]))
        out = pd.DataFrame(found, columns=["role", "text"])
        return out.assign(none=group["none"].iloc[0], key=group["key"].iloc[0], part=group["part"].iloc[0], place=range(len(out)))[["none", "key", "part", "place", "role", "text"]]

    texts = placed.select(*whose, "part", "place", "role", "text").join(taken, [*whose, "part"])
    repaired = texts.groupBy(*whose, "part").applyInPandas(edit, "none boolean, key string, part int, place long, role string, text string")
    discard(parts)
    return report, repaired.join(ids, whose).select("id", "part", "place", "role", "text")


def _digests(repaired: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, repaired_sha256): a digest of one conversation is made in order by one task, which reads its rows one batch at a time."""
    lines = repaired.select(F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "part", "place", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], ["none", "key", "sha"])
        for batch in batches:
            for none, key, line in zip(*[batch.column(k).to_pylist() for k in (0, 1, 4)]):
                if now != (none, key):
                    if now:
                        yield done()
                    now, digest = (none, key), hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
        if now:
            yield done()

    made = lines.repartition("none", "key").sortWithinPartitions("none", "key", "part", "place").mapInArrow(run, "none boolean, key string, sha string")
    found = whole.withColumns({"none": F.col("id").isNull(), "key": F.coalesce(F.col("id").cast("string"), F.lit(""))}).join(made, ["none", "key"], "left")
    return found.withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))).drop("none", "key", "sha")


def repair_report(rows: DataFrame, length: int = LONG) -> DataFrame:
    """repair()'s report of every conversation, with the SHA-256 of its repaired rows as `role:text` lines. Conversations of
    more than `length` rows, found by a count, go by repair_long(), all others by repair(); both give the same result."""
    require(rows, "id", "turn", "role", "text", "gone")
    counts = rows.where("not gone").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > length).select("id")
    long_ids = materialize(counts, "long-conversations")
    digest = F.sha2(F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").cast("binary"), 256)
    with_digest = lambda report: report.withColumn("repaired_sha256", digest).drop("repaired")
    if long_ids.isEmpty():
        discard(long_ids)
        return with_digest(repair(rows))
    of_long = F.col("id").eqNullSafe(F.col("long_id"))
    marked = long_ids.withColumnRenamed("id", "long_id")
    report, repaired = repair_long(rows.join(marked, of_long, "left_semi"), length)
    return with_digest(repair(rows.join(marked, of_long, "left_anti"))).unionByName(_digests(repaired, report))
