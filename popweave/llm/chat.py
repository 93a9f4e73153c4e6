"""Chat formatting with a prefix tree.

Conversations are sorted by the hashes of their turns, so that those with equal initial turns are
neighbours; a streaming pass then merges them into trees.  A shared turn is emitted once, depth-first;
each emitted turn has its place in the packed sequence, the position id of its first character (as if
only its ancestors stood before it) and the intervals of its ancestors, which are all it may attend to.
A packed sequence ends at the first end of a conversation beyond ``PACK_CHARS``; the next one begins with
the shared turns anew.  Only digests of open turns are held, so a conversation may be of any length.

Template of a turn: ``<s>role``, a line end, the text (between ``[INST] `` and `` [/INST]`` unless the
assistant speaks), ``</s>``.  Control strings inside texts get a backslash after their first character,
backslashes are doubled, so every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
#: Characters after which a packed sequence ends with the conversation that is open.
PACK_CHARS = 1 << 16
#: Turns whose hashes sort the conversations; longer shared beginnings merge where they are neighbours.
SORTED_TURNS = 64

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its (escaped) text stands in it."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    before, after = ("", "") if role == ASSISTANT else ("[INST] ", " [/INST]")
    start = len(head) + len(before)
    return f"{head}{before}{body}{after}</s>", start, start + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = formatted.removeprefix("<s>").removesuffix("</s>").partition("\n")
    role = _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], head)
    if role != ASSISTANT:
        body = body.removeprefix("[INST] ").removesuffix(" [/INST]")
    return role, unescape(body)


_DDL = ("pack long, seq long, parent long, depth long, start long, end long, position long, "
        "attends array<struct<start: long, end: long>>, loss_start long, loss_end long, text string, conv_id long")


class _Packer:
    """One partition's conversations, in order, into packed sequences."""

    def __init__(self, partition: int):
        self.pack = partition << 33
        self.seq = self.at = 0
        # open turns: digest, seq, start, end, position after it, intervals of it and its ancestors
        self.open: list[tuple] = []
        self.depth = 0  # turns of the running conversation so far
        self.forked = False
        self.rows: list[tuple] = []

    def turn(self, role: str, text: str) -> None:
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "replace")).digest()
        d = self.depth
        self.depth += 1
        if not self.forked and d < len(self.open) and self.open[d][0] == digest:
            return  # shared with the conversation before
        if not self.forked:
            del self.open[d:]
            self.forked = True
        formatted, a, b = format_turn(role, text)
        up = self.open[-1] if self.open else (b"", -1, 0, 0, 0, ())
        start, end = self.at, self.at + len(formatted)
        spans = up[5]
        own = (*spans[:-1], (spans[-1][0], end)) if spans and spans[-1][1] == start else (*spans, (start, end))
        loss = (start + a, start + b) if role == ASSISTANT else (None, None)
        self.rows.append((self.pack, self.seq, up[1], d, start, end, up[4],
                          [{"start": s, "end": e} for s, e in spans], *loss, formatted, None))
        self.open.append((digest, self.seq, start, end, up[4] + len(formatted), own))
        self.seq += 1
        self.at = end

    def close(self, conv_id) -> None:
        """Ends the running conversation."""
        leaf = self.open[self.depth - 1]
        self.rows.append((self.pack, self.seq, leaf[1], self.depth, None, None, leaf[4], [], None, None, None, conv_id))
        self.seq += 1
        self.depth, self.forked = 0, False
        if self.at > PACK_CHARS:
            self.pack += 1
            self.seq = self.at = 0
            self.open = []

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=_COLUMNS).astype(
            {c: "Int64" for c in ("pack", "seq", "parent", "depth", "start", "end", "position", "loss_start", "loss_end", "conv_id")})


_COLUMNS = ["pack", "seq", "parent", "depth", "start", "end", "position", "attends", "loss_start", "loss_end", "text", "conv_id"]


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """The packed trees, in order of (pack, seq).

    A row with ``text`` is an emitted turn: its parent's seq (-1 at a root), its depth, its characters
    [start, end) in the packed sequence, the position id of its first character, the ancestors' intervals
    it attends to (besides itself, causally) and the interval under the loss mask.  A row with ``conv_id``
    (or without text) says that this conversation ends at ``parent``; its ``position`` is its formatted length.

    Turns are ordered by turn, then role and text.  Null roles and texts are empty; rows of a null
    conversation id are one conversation.  Equal conversations share all turns and end at one leaf.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = Window.partitionBy("conv").orderBy("turn", "role", "hash")
    keys = (rows.select("conv", "turn", "role", F.xxhash64("role", "text").alias("hash"))
            .withColumn("n", F.row_number().over(first)).where(F.col("n") <= SORTED_TURNS)
            .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("k"))
            .select(F.col("conv").alias("key_conv"), F.transform("k", lambda x: x["hash"]).alias("key")))
    keyed = rows.join(keys, F.col("conv").eqNullSafe(F.col("key_conv"))).drop("key_conv")
    order = ["key", "conv", "turn", "role", "text"]

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, current, began = _Packer(TaskContext.get().partitionId()), None, False
        for part in it:
            for conv, role, text in zip(part["conv"], part["role"], part["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if began and conv != current:
                    packer.close(current)
                current, began = conv, True
                packer.turn(role, text)
            if packer.rows:
                yield packer.take()
        if began:
            packer.close(current)
            yield packer.take()

    return (keyed.repartitionByRange("key", "conv").sortWithinPartitions(*order)
            .select("conv", "role", "text").mapInPandas(pack, _DDL))


def read_back(packed: DataFrame) -> DataFrame:
    """Each conversation read from the packed trees: its turns and loss text as digests, and its lengths.

    Rows of a pack are streamed depth-first with one running digest per open turn.
    """
    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, states = None, []
        for part in it:
            out = []
            for r in part.itertuples(index=False):
                if r.pack != pack:
                    pack, states = r.pack, []
                if r.text is not None:
                    d = int(r.depth)
                    del states[d:]
                    turns, loss, n_loss, chars = states[-1] if states else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                    turns, loss = turns.copy(), loss.copy()
                    role, text = parse_turn(r.text)
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    if not pd.isna(r.loss_start):
                        under = unescape(r.text[int(r.loss_start - r.start):int(r.loss_end - r.start)])
                        loss.update(under.encode("utf-8", "replace"))
                        n_loss += len(under)
                    states.append((turns, loss, n_loss, chars + len(r.text)))
                else:
                    turns, loss, n_loss, chars = states[int(r.depth) - 1]
                    out.append((None if pd.isna(r.conv_id) else int(r.conv_id), int(r.depth), turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return packed.repartition("pack").sortWithinPartitions("pack", "seq").select(
        "pack", "depth", "start", "loss_start", "loss_end", "text", "conv_id").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
