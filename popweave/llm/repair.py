"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of order.

The role initials of a repaired conversation read ``(s?(ua)+)?``.  Edits: Keep (0), Rerole to user or
assistant (1), Delete (2; required for blank and repeated turns), Insert an empty user or assistant turn (5);
a cut-off turn that stays costs 5 more.  The audit is the string of the edits' initials, the cheapest one,
of equally cheap ones the least in ASCII order.

Only a conversation's signature (one letter per turn for role and fault) decides its audit.  Signatures share
their ends in an automaton: a node is a letter and the node behind it, so equal suffixes of all conversations
are one node, and its cost-to-go and best first edits are found once per state of the grammar.  Distinct
signatures are range-sorted by their reversed letters, so that those with equal ends meet in one task.

A long conversation is cut into chunks of ``CHUNK`` turns.  Its chunks are read from the last to the first,
each going on at the node where the next one begins and giving its edits for every state it may be entered
in; reading them forwards then picks one.  Texts meet their edits by chunk, in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.operators.hot import spread_join
from popweave.operators.ranks import value_rank
from popweave.session import cut

#: Turns of a chunk.
CHUNK = 512
#: Nodes that a task holds before it begins its automaton anew.
MOST_NODES = 1 << 19
#: Characters of repaired text that travel together, besides a single turn.
PIECE_CHARS = 1 << 20

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT_OFF = 5
#: States of the grammar: nothing yet, after system, after user, after assistant; what may follow in each.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The user or assistant turn that may follow, and where it leads.
NEXT = tuple(("a", 3) if "a" in f else ("u", 2) for f in FOLLOW)
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: Characters that are not seen.
BLANKS = " \t\n\x0b\x0c\r"
#: Signature letters: role initials (x: any other) of sound turns, in capitals of cut-off ones; d must go.
MUST_GO = "d"


class Automaton:
    """Suffixes of signatures as nodes.  Node 0 is the end; ``cost``, ``edits`` and ``to`` hold, by state, the
    cost-to-go, the edits up to and with the node's letter, and the state behind them."""

    def __init__(self):
        self.known: dict[tuple[str, int], int] = {}
        self.behind, self.cost, self.edits, self.to = [-1], [], [], []
        ends = [(0, "") if q in ENDS else None for q in range(4)]
        while None in ends:
            ends = [e or (ends[NEXT[q][1]] and (ends[NEXT[q][1]][0] + COST[INSERT], INSERT + ends[NEXT[q][1]][1])) for q, e in enumerate(ends)]
        self._put([(c, e, 0) for c, e in ends])

    def _put(self, best: list[tuple[int, str, int]]) -> None:
        self.cost.append([b[0] for b in best])
        self.edits.append([b[1] for b in best])
        self.to.append([b[2] for b in best])

    def node(self, letter: str, behind: int) -> int:
        found = self.known.get((letter, behind))
        if found is None:
            found = self.known[letter, behind] = len(self.cost)
            self.behind.append(behind)
            self._put(self._best(letter, self.cost[behind]))
        return found

    @staticmethod
    def _best(letter: str, after: list[int]) -> list[tuple[int, str, int]]:
        """Cost, edits and next state from each state; candidates differ in their first edit, so least is least."""
        plain = []
        for q in range(4):
            options = [(COST[DELETE] + after[q], DELETE, q)]
            if letter != MUST_GO:
                more = CUT_OFF if letter.isupper() else 0
                kept, (_, moved) = FOLLOW[q].get(letter.lower()), NEXT[q]
                if kept is not None:
                    options.append((COST[KEEP] + more + after[kept], KEEP, kept))
                options.append((COST[REROLE] + more + after[moved], REROLE, moved))
            plain.append(min(options))
        best = plain
        for _ in range(2):  # a third insertion leads to where one leads
            best = [min(plain[q], (best[NEXT[q][1]][0] + COST[INSERT], INSERT + best[NEXT[q][1]][1], best[NEXT[q][1]][2])) for q in range(4)]
        return best

    def head(self, signature: str, behind: int = 0) -> int:
        for letter in reversed(signature):
            behind = self.node(letter, behind)
        return behind

    def walk(self, node: int, state: int, turns: int) -> tuple[str, int]:
        """The edits of so many turns from a node, and the state behind them; with the end's, where it is reached."""
        out = []
        for _ in range(turns):
            out.append(self.edits[node][state])
            node, state = self.behind[node], self.to[node][state]
        return "".join(out) + (self.edits[0][state] if node == 0 else ""), state

    def restart(self, node: int) -> tuple[Automaton, int]:
        """A new automaton with the costs of one node, as which another conversation part goes on."""
        new = Automaton()
        new.behind.append(-1)
        new._put([(c, "", q) for q, c in enumerate(self.cost[node])])
        return new, 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SOLVED = pa.schema([("sig", pa.string()), ("audit", pa.string()), ("cost", pa.int64())])
_CHUNKS = pa.schema([("k", pa.string()), ("chunk", pa.int64()), ("audits", pa.list_(pa.string())), ("outs", pa.list_(pa.int64())), ("cost", pa.int64())])
_PARTS = pa.schema([("k", pa.string()), ("chunk", pa.int64()), ("state", pa.int64()), ("audit", pa.string()), ("cost", pa.int64())])


def _solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of whole signatures."""
    automaton = Automaton()
    for batch in it:
        rows = []
        for sig in batch.column(0).to_pylist():
            if len(automaton.cost) > MOST_NODES:
                automaton = Automaton()
            head = automaton.head(sig)
            rows.append((sig, automaton.walk(head, 0, len(sig))[0], automaton.cost[head][0]))
        if rows:
            yield _batch(rows, _SOLVED)


def _backwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of chunks, read from the last to the first of each conversation, for every state."""
    automaton, key, head = Automaton(), None, 0
    for batch in it:
        rows = []
        for k, chunk, sig in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if k != key:
                key, head = k, 0
            if len(automaton.cost) > MOST_NODES:
                automaton, head = (Automaton(), 0) if head == 0 else automaton.restart(head)
            head = automaton.head(sig, head)
            found = [automaton.walk(head, q, len(sig)) for q in (range(4) if chunk else (0,))]
            rows.append((k, chunk, [f[0] for f in found], [f[1] for f in found], automaton.cost[head][0]))
        if rows:
            yield _batch(rows, _CHUNKS)


def _forwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk in the state in which it is entered."""
    state = 0
    for batch in it:
        rows = []
        for k, chunk, audits, outs, cost in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            state = state if chunk else 0
            rows.append((k, chunk, state, audits[state], cost))
            state = outs[state]
        if rows:
            yield _batch(rows, _PARTS)


def _audits(chunks: DataFrame) -> DataFrame:
    """For each chunk (k, chunk, chunks, sig): the state in which it is entered, its edits, the whole cost."""
    whole, long = chunks.where("chunks = 1"), chunks.where("chunks > 1")
    distinct = whole.groupBy("sig").agg(F.reverse("sig").alias("_back"))
    solved = distinct.repartitionByRange("_back").sortWithinPartitions("_back").select("sig").mapInArrow(_solve, "sig string, audit string, cost long")
    short = spread_join(whole, solved, ["sig"]).select("k", "chunk", F.lit(0).cast("long").alias("state"), "audit", "cost")
    back = long.select("k", "chunk", "sig").repartition("k").sortWithinPartitions("k", F.desc("chunk")).mapInArrow(
        _backwards, "k string, chunk long, audits array<string>, outs array<bigint>, cost long")
    chosen = back.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(_forwards, "k string, chunk long, state long, audit string, cost long")
    return short.unionByName(chosen)


_TURNS = pa.schema([("k", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()),
                    ("role", pa.string()), ("text", pa.string())])


def _edited(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns, from the edits of a chunk (pos 0) followed by its turns."""
    edits, state, seq, chunks, at, last = "", 0, 0, 0, 0, 0

    def inserted(k, chunk):
        nonlocal at, state, seq
        while at < len(edits) and edits[at] == INSERT:
            role, state = NEXT[state]
            yield (k, chunk, chunks, seq, INSERT, ROLE[role], "")
            at, seq = at + 1, seq + 1

    for batch in it:
        rows, size = [], 0
        for k, chunk, pos, role, text, audit, begin, total in zip(*[c.to_pylist() for c in batch.columns]):
            if pos == 0:
                edits, state, chunks, at, seq = audit, begin, total, 0, 0
                last = len(edits.rstrip(INSERT))
            else:
                rows.extend(inserted(k, chunk))
                edit, at = edits[at], at + 1
                if edit == KEEP:
                    state = FOLLOW[state][role[:1]]
                elif edit == REROLE:
                    role, state = ROLE[NEXT[state][0]], NEXT[state][1]
                if edit != DELETE:
                    rows.append((k, chunk, chunks, seq, edit, role, text))
                    seq, size = seq + 1, size + len(text)
            if at >= last:
                rows.extend(inserted(k, chunk))
            if size > PIECE_CHARS:
                yield _batch(rows, _TURNS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _TURNS)


def repaired_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's repaired turns, as ``role:text`` joined by line ends; those with a turn only.

    Takes ``turns`` of ``repair_conversations`` as they come: a chunk's turns stand together, in order.  Chunks
    of a long conversation send their joined turns in pieces, which one task hashes as a stream.
    """
    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.string()), ("chunk", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("sha", pa.string())])
        at, digest, held, piece = None, None, [], 0

        def close(last):
            out = []
            if at is not None:
                if digest is not None and last:
                    out.append((*at, 0, None, digest.hexdigest()))
                elif held:
                    out.append((*at, piece, "\n".join(held), None))
            return out

        for batch in it:
            rows, size = [], 0
            for k, chunk, chunks, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                line = f"{role}:{text}"
                if (k, chunk) != at:
                    rows += close(True)
                    at, held, piece, size = (k, chunk), [], 0, 0
                    digest = hashlib.sha256(line.encode("utf-8", "replace")) if chunks == 1 else None
                elif digest is not None:
                    digest.update(b"\n" + line.encode("utf-8", "replace"))
                if digest is None:
                    held.append(line)
                    size += len(line)
                    if size > PIECE_CHARS:
                        rows += close(False)
                        held, piece, size = [], piece + 1, 0
            if rows:
                yield _batch(rows, schema)
        rows = close(True)
        if rows:
            yield _batch(rows, schema)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, digest = pa.schema([("k", pa.string()), ("sha", pa.string())]), None, None
        for batch in it:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        rows.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(text.encode("utf-8", "replace"))
                else:
                    digest.update(b"\n" + text.encode("utf-8", "replace"))
            if rows:
                yield _batch(rows, schema)
        if key is not None:
            yield _batch([(key, digest.hexdigest())], schema)

    out = turns.select("k", "chunk", "chunks", "role", "text").mapInArrow(pieces, "k string, chunk long, piece long, text string, sha string")
    long = out.where("text is not null").repartition("k").sortWithinPartitions("k", "chunk", "piece").select("k", "text").mapInArrow(stream, "k string, sha string")
    return out.where("sha is not null").select("k", "sha").unionByName(long)


class Repair(NamedTuple):
    """``conversations``: conv_id, k, gaps, blank, duplicate, truncated, illegal, cost, audit of those with turns.
    ``turns``: k, chunk, chunks, seq, edit, role, text of the repaired turns, in order of (chunk, seq)."""

    conversations: DataFrame
    turns: DataFrame


def conversation_key(conv: Column) -> Column:
    """The conversation as text; a space where it is null."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults, cheapest audit and repaired turns of every conversation.

    Turns are ordered by turn (null first), then by a digest of role and text.  The first fault that fits
    counts: blank (nothing but spaces, tabs and line ends), duplicate (role and text of an earlier turn),
    truncated (the last other character is not one of ``.!?``).  ``gaps`` are turn numbers missing between the
    least and the greatest, ``illegal`` neighbours whose role initials are not su, ua or au.  Null roles and
    texts are one space; a role that does not begin with s, u or a cannot be kept.  Rows without a
    conversation are one conversation.  An empty table has none.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    seen = F.rtrim(text, F.lit(BLANKS))
    rows = turns.select(
        conversation_key(F.col(conv_col)).alias("k"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("hash"),
        (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("open"))
    rows = cut(value_rank(rows, ["k"], "turn", ["hash"], "pos").withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("long")), "turns")
    again = rows.groupBy("k", "hash").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = spread_join(rows.select("k", "hash", "pos", "chunk", F.left("role", F.lit(1)).alias("initial"), "blank", "open"), again, ["k", "hash"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    sound = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(sound)).otherwise(sound)
    marks = marks.withColumn("fault", fault).withColumn("letter", letter)
    # the first turn of a chunk also closes the chunk before, for neighbours across the cut
    copies = F.when((F.col("pos") > 1) & ((F.col("pos") - 1) % CHUNK == 0), F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))
    marks = marks.withColumn("own", F.col("chunk")).withColumn("chunk", F.explode(copies))
    mine = F.col("own") == F.col("chunk")
    chunks = marks.groupBy("k", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", F.when(mine, F.col("letter")).otherwise("").alias("letter")))).alias("s"),
        *[F.count_if(mine & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")])
    pair = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.concat(F.element_at("s", i)["initial"], F.element_at("s", i + 1)["initial"]))
    illegal = F.when(F.size("s") > 1, F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0).cast("long")
    signed = cut(chunks.select("k", "chunk", F.array_join(F.col("s")["letter"], "").alias("sig"), "blank", "duplicate", "truncated", illegal.alias("illegal")), "signatures")
    faults = signed.groupBy("k").agg(F.count(F.lit(1)).alias("chunks"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    parts = cut(_audits(spread_join(signed.select("k", "chunk", "sig"), faults.select("k", "chunks"), ["k"])), "audits")
    audit = parts.groupBy("k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda s: s["audit"]), "").alias("audit"),
        F.min_by("cost", "chunk").alias("cost"))
    spans = rows.groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    known = faults.join(audit, "k").join(spans, "k").select(
        F.when(F.col("k") != " ", F.col("k")).cast(turns.schema[conv_col].dataType).alias("conv_id"), "k", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    nothing = F.lit(None).cast("string")
    total = spread_join(parts, faults.select("k", "chunks"), ["k"])
    both = rows.select("k", "chunk", "pos", "role", "text", nothing.alias("audit"), F.lit(None).cast("long").alias("state"), F.lit(None).cast("long").alias("chunks")).unionByName(
        total.select("k", "chunk", F.lit(0).cast("long").alias("pos"), nothing.alias("role"), nothing.alias("text"), "audit", "state", "chunks"))
    edited = both.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "pos").mapInArrow(
        _edited, "k string, chunk long, chunks long, seq long, edit string, role string, text string")
    return Repair(known, edited)
