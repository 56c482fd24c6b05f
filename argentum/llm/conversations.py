"""Repair of conversations' structure (operator 11).

A conversation should read `(s?(ua)+)?` by its roles' initials. Edits: keep a row (0), give it the role user or
assistant (3), delete it (4; blank and duplicate rows must go), insert an empty row of user or assistant (3);
a truncated row that stays adds 3. The cheapest edits are wanted, of equal ones those whose initials (D, I, K, R)
come first.

1. Each row becomes a symbol of role and first fault, a conversation its symbols in order: a signature. Equal rows
   of one turn are counted before they are shuffled; rows of 256 turns make a piece, pieces make the signature.
2. Different signatures are sorted by ranges. In a range they are inserted into a prefix trie one after another: of
   the trie only the path to the last signature is kept, one layer of the dynamic program a node, so that a shared
   prefix is computed once. A layer has the cheapest edits so far for each state of the pattern: cost, place among the
   layer's edit strings, and where it came from. Layers that differ by a constant cost are one layer with one
   table of steps. A terminal node walks back and emits its answer.
3. Answers are joined to their conversations, and a conversation's rows run through its edits in order.

Rows are taken by turn, null first; rows of one turn by a digest of role and text. A null role or text is one space.
A null conv_id is a conversation too. Rows that aren't live only name their conversation. A conversation without
live rows has zeros, empty edits and the digest of an empty string; gaps that no long holds are null. A signature is
one string and a digest needs its rows in order: one task streams a conversation's rows, holding its edits alone.
An empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A symbol is SYMBOLS[4 * fault + role].
SYMBOLS = "abcdefghijklmnop"
ROLES = "sua"  # and others
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
LEGAL = {"su", "ua", "au"}
#: What follows a role in the pattern: states are nothing yet, s, u and a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = (0, 3)
#: Turns of a piece, as bits.
PIECE_BITS = 8

_steps: dict[tuple, tuple] = {}
FIRST = ((0, 0, 0),)  # states, their costs above the layer's least, and places among its strings


def step(layer: tuple, symbol: str) -> tuple:
    """(next layer, what its least cost adds, state -> (state before, letters)): the cheapest ways over one more row.

    Strings of a layer end in a letter that isn't I, and each row has one such letter: none begins another, so their order is kept
    whatever follows. Insertions belong to the row after them; more than two in one place lead nowhere new.
    """
    if (layer, symbol) in _steps:
        return _steps[layer, symbol]
    fault, role = divmod(SYMBOLS.index(symbol), 4)
    extra = TRUNCATED * (fault == CUT_OFF)
    best: dict[int, tuple] = {}
    for state, cost, place in layer:
        at, inserted = state, 0
        while inserted <= 2:
            paid = cost + INSERT * inserted
            ways = [("D", at, paid + DELETE)]
            if fault in (SOUND, CUT_OFF):
                if role < 3 and (at, ROLES[role]) in NEXT:
                    ways.append(("K", NEXT[at, ROLES[role]], paid + KEEP + extra))
                ways.append(("R", INSERTED[at], paid + REROLE + extra))
            for letter, to, price in ways:
                way = (price, place, "I" * inserted + letter, state)
                if to not in best or way < best[to]:
                    best[to] = way
            at, inserted = INSERTED[at], inserted + 1
    # A state from which all that follows is reached cheaper from another one is dropped; the rest are a bounded number of layers.
    far = 1 << 30
    cost = [best[q][0] if q in best else far for q in range(4)]
    done = min(cost[3], cost[2] + INSERT)  # the pattern is complete
    keep = [cost[0] <= done + DELETE, cost[1] <= done, cost[2] <= cost[3] + INSERT, cost[3] <= cost[2] + INSERT]
    best = {q: w for q, w in best.items() if keep[q]}
    least = min(w[0] for w in best.values())
    order = {w: i for i, w in enumerate(sorted({w[1:3] for w in best.values()}))}
    after = tuple((q, best[q][0] - least, order[best[q][1:3]]) for q in sorted(best))
    out = _steps[layer, symbol] = (after, least, {q: (w[3], w[2]) for q, w in best.items()})
    return out


#: Neighbours by their symbols that the pattern never has.
WRONG = {(x, y) for i, x in enumerate(SYMBOLS) for j, y in enumerate(SYMBOLS) if "sua?"[i % 4] + "sua?"[j % 4] not in LEGAL}


class Trie:
    """The path to the last signature that was inserted; ascending signatures reach each node once. A node takes 16 bytes."""

    def __init__(self):
        self.last = ""
        self.path = [(FIRST, 0, {})]
        self.costs = array("q", [0])
        self.layers = 0

    def answer(self, signature: str) -> tuple:
        """(blank, duplicate, truncated, illegal, cost, audit) of a signature."""
        shared, top = 0, min(len(self.last), len(signature))
        if signature[:top] == self.last[:top]:
            shared = top
        while top - shared > 1:  # the prefixes agree up to shared, not up to top
            middle = (shared + top) // 2
            shared, top = (middle, top) if signature[:middle] == self.last[:middle] else (shared, middle)
        path, costs = self.path, self.costs
        del path[shared + 1 :], costs[shared + 1 :]
        for symbol in signature[shared:]:
            node = step(path[-1][0], symbol)
            path.append(node)
            costs.append(costs[-1] + node[1])
        self.layers += len(signature) - shared
        self.last = signature
        ends = []
        for state, more, place in path[-1][0]:
            at = state
            for inserted in range(3):
                if at in ENDS:
                    ends.append((costs[-1] + more + INSERT * inserted, place, inserted, state))
                at = INSERTED[at]
        total, _, inserted, state = min(ends)
        letters = ["I" * inserted]
        for node in reversed(path[1:]):
            state, some = node[2][state]
            letters.append(some)
        faults = [sum(map(signature.count, SYMBOLS[4 * f : 4 * f + 4])) for f in (BLANK, DUPLICATE, CUT_OFF)]
        illegal = sum(map(WRONG.__contains__, zip(signature, signature[1:], strict=False)))
        return *faults, illegal, total, "".join(reversed(letters))


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def answers(signatures: DataFrame, parts: int = 0) -> DataFrame:
    """signature, its counts of faults, cost and edits, for each different signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            some = batch.column(0).to_pylist()
            columns = list(zip(*[trie.answer(s) for s in some], strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())], [x.split()[0] for x in ANSWER.split(", ")])

    some = signatures.select("signature").distinct()
    dealt = some.repartitionByRange(parts, "signature") if parts else some.repartitionByRange("signature")
    return dealt.sortWithinPartitions("signature").mapInArrow(run, ANSWER)


def _digest(role: Column, text: Column) -> Column:
    """Tells rows with different roles or texts apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps from conv_id, turn, role, text, digest, copies; rows without copies only name their conversation."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    each = rows.select("conv_id", F.when(F.col("copies") > 0, F.col("turn")).alias("turn"), F.when(F.col("copies") > 0, F.col("digest")).alias("digest"), "copies", (4 * fault + role).alias("kind"))
    same = each.groupBy("conv_id", "turn", "digest").agg(F.first("kind").alias("kind"), F.sum("copies").alias("copies"))
    # The first of all equal rows of a conversation stands, the others are duplicates.
    first = same.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    a, b = same.alias("a"), first.alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.digest").eqNullSafe(F.col("b.digest")))
    again = F.col("b.first.turn").eqNullSafe(F.col("a.turn"))
    symbol = lambda kind: F.substring(F.lit(SYMBOLS), kind + 1, F.lit(1))
    own, other = symbol(F.col("kind")), symbol(F.when(F.col("kind") >= 4 * BLANK, F.col("kind")).otherwise(4 * DUPLICATE + F.col("kind") % 4))
    some = F.when(F.col("copies") == 0, "").when(again, F.concat(own, F.repeat(other, (F.col("copies") - 1).cast("int")))).otherwise(F.repeat(other, F.col("copies").cast("int")))
    row = F.struct(F.col("a.turn").isNotNull().alias("known"), F.col("a.turn").alias("turn"), F.col("a.digest").alias("digest"), some.alias("some"))
    text = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["some"]), "")
    pieces = both.select(F.col("a.conv_id").alias("conv_id"), row.alias("row")).groupBy("conv_id", F.shiftright("row.turn", PIECE_BITS).alias("piece"))
    pieces = pieces.agg(text("row").alias("some"), F.min("row.turn").alias("low"), F.max("row.turn").alias("high"), F.count_distinct("row.turn").alias("turns"))
    pieces = pieces.withColumn("row", F.struct(F.col("piece").isNotNull().alias("known"), "piece", "some"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce(wide(F.max("high")) - wide(F.min("low")) + 1 - wide(F.sum("turns")), F.lit(0))
    return pieces.groupBy("conv_id").agg(text("row").alias("signature"), gaps.try_cast("long").alias("gaps"))


def repair(rows: DataFrame, live: str | None = None, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, n_repaired, repaired_sha256 of conversations (conv_id, turn, role, text).

    live: a boolean column; where it isn't true, the row only names its conversation. copies: how often a row stands, side by side.
    """
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    there = F.coalesce(F.col(live), F.lit(False)) if live else F.lit(True)
    n = F.when(there, F.coalesce(F.col(copies), F.lit(0)) if copies else F.lit(1)).otherwise(0).cast("long")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("copies"), _digest(role, text).alias("digest"))
    found = cut(signatures(rows), "signatures")
    head = found.join(answers(found), "signature")
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One stream: a conversation's answer, then its rows.
    stream = head.select("conv_id", F.lit(0).alias("part"), none("turn", "long"), none("digest", "binary"), none("role", "string"), none("text", "string"), none("copies", "long"), *counts, "audit")
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "digest", "role", "text", "copies", *[none(c, "long") for c in counts], none("audit", "string"))
    stream = stream.unionByName(body)

    def table(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, *[pa.int64()] * len(counts), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    names = ["conv_id", *counts, "audit", "n_repaired", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repaired | None = None
        for batch in batches:
            done = []
            data = batch.to_pydict()
            answer = zip(data["conv_id"], *[data[c] for c in counts], data["audit"], strict=True)
            for part, role, text, times, own in zip(data["part"], data["role"], data["text"], data["copies"], answer, strict=True):
                if part == 0:
                    if now:
                        done.append(now.end())
                    now = Repaired(own)
                else:
                    for _ in range(times):
                        now.row(role, text)
            key = batch.schema.field("conv_id").type
            if done:
                yield table(done, key)
        if now:
            yield table([now.end()], key)

    order = ["conv_id", "part", F.col("turn").asc_nulls_first(), "digest"]
    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {', '.join(c + ' long' for c in counts)}, audit string, n_repaired long, repaired_sha256 string")


class Repaired:
    """Runs a conversation's rows through its edits; only the digest is kept."""

    def __init__(self, answer: tuple):
        self.answer, self.audit = answer, answer[-1]
        self.at, self.n = 0, 0
        self.first = (len(self.audit) - self.audit.count("D")) % 2  # an odd number of rows begins with s
        self.digest = hashlib.sha256()

    def add(self, role: str | None, text: str) -> None:
        if role is None:
            role = ("user", "assistant")[(self.n - self.first) % 2]
        self.digest.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        self.n += 1

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.add(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.add(role if edit == "K" else None, text)

    def end(self) -> tuple:
        self.insertions()
        return *self.answer, self.n, self.digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of `conv_id:turn` modulo 20 (nulls: one space): conv_id, turn, role, text, live, copies.

    0: the row goes; 1: its text is empty; 2: its text is without [.!?]; 3: it stands twice; 4: its role is user.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    role = F.when(fate == 4, "user").otherwise(some("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("live"), F.when(fate == 3, 2).otherwise(1).alias("copies"))
