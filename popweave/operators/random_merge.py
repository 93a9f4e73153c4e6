"""Seeded random merge: pair rows of two tables inside common groups.

Both sides are ranked in random order inside a group and equal ranks are
paired.  A cascade repeats this with coarser groups for what is left; it ranks
and counts in every round and pairs once, at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from popweave.functions.seeded import order_key
from popweave.operators.hot import listed_hot_groups, null_safe, renamed, rows_at_once, spread_join, tasks_for
from popweave.operators.ranks import bucket_piece, digest_bucket, random_rank
from popweave.session import cut, discard, folders, scratch_path, spread


@dataclass
class Side:
    """One table of a merge: its rows, its key, and an optional priority order."""

    df: DataFrame
    pk: str
    sort: list = field(default_factory=list)


@dataclass
class Round:
    """Group keys of one pass.  A key is a column name found on both sides or a
    (name, primary, secondary) triple of SQL texts or Columns; a null key makes
    a row wait for a later pass.  Passes with the same ``level`` belong together:
    the last of them is the one in which secondary rows serve again."""

    name: str
    keys: list
    level: str = ""


def _keys(rnd: Round, side: int) -> dict[str, Column]:
    named = {}
    for i, key in enumerate(rnd.keys):
        value = key if isinstance(key, str) else key[1 + side]
        column = F.expr(value) if isinstance(value, str) else value
        named[f"_g{i}"] = column.cast("string")
    return named


def merge_round(primary: Side, secondary: Side, rnd: Round, seed: int) -> DataFrame:
    """One pass as a full outer join on (group, rank), all columns kept.

    Rows with a null key match nothing and come through unpaired.  Every
    (group, rank) is unique on both sides, so the join spreads evenly however
    large a group is.
    """
    on = [*_keys(rnd, 0), "_rank"]
    ranked = [random_rank(side.df.withColumns(keys) if keys else side.df, list(keys), side.pk, seed, side.sort, "_rank")
              for side, keys in ((primary, _keys(rnd, 0)), (secondary, _keys(rnd, 1)))]
    return ranked[0].join(ranked[1], on, "full").drop(*on)


def random_merge(primary: Side, secondary: Side, rnd: Round, seed: int) -> DataFrame:
    """One round with a ``merge_state`` of both / left_only / right_only."""
    merged = merge_round(primary, secondary, rnd, seed)
    has_p, has_s = F.col(primary.pk).isNotNull(), F.col(secondary.pk).isNotNull()
    return merged.withColumn("merge_state", F.when(has_p & has_s, "both").when(has_p, "left_only").otherwise("right_only"))


@dataclass
class CascadeResult:
    """Pairs of a cascade and the rows of both sides that stayed alone."""

    pairs: DataFrame
    primary_left: DataFrame
    secondary_left: DataFrame
    rounds: int


#: Most counts of pieces that are broadcast.
FEW_PIECES = 100_000
#: Most possible groups of a round for which they are counted first, so that rows of groups with one side only stay put.
FEW_GROUPS = 10_000
#: Most rounds that one shuffle serves.
CHAIN = 4


class _Cascade:
    """Both sides of a cascade as one table of keys: ``_p`` or ``_s`` (the row's key), its priorities, and the
    key columns of all rounds as text."""

    def __init__(self, primary: Side, secondary: Side, rounds: list[Round]):
        texts = [[(f"{k0} {k1}", k0, k1) for k0, k1 in zip(_keys(rnd, 0).values(), _keys(rnd, 1).values())] for rnd in rounds]
        uses: dict[str, list[int]] = {}
        for i, keys in enumerate(texts):
            for text, *_ in keys:
                uses.setdefault(text, []).append(i)
        # Keys that always come together are one column.
        together: dict[tuple, dict[str, tuple]] = {}
        for keys in texts:
            for text, k0, k1 in keys:
                together.setdefault(tuple(uses[text]), {})[text] = (k0, k1)
        exprs = [tuple(_one_text([pair[i] for pair in keys.values()]) for i in (0, 1)) for keys in together.values()]
        self.columns = [[f"_k{j}" for j, used in enumerate(together) if i in used] for i in range(len(rounds))]  # of each round
        self.order = []
        tables = []
        for i, (side, key) in enumerate(((primary, "_p"), (secondary, "_s"))):
            sort = [(f"{key}o{j}", c, asc) for j, (c, asc) in enumerate(side.sort)]
            self.order += [(name, asc) for name, _, asc in sort]
            tables.append(side.df.select(F.col(side.pk).alias(key), *[F.col(c).alias(name) for name, c, _ in sort],
                                         *[e[i].alias(f"_k{j}") for j, e in enumerate(exprs)]))
        self.spark = primary.df.sparkSession
        self.path = scratch_path(self.spark, "cascade")
        # Open and settled rows on disk as (step that reads them, side, folder), and whether the first rows still stand.
        self.waiting, self.settled, self.fresh = [], [], True
        self.all = cut(tables[0].unionByName(tables[1], allowMissingColumns=True), "cascade-rows")
        values = F.explode(F.array(F.struct(F.lit("").alias("c"), F.lit("").alias("v")), *[
            F.struct(F.lit(f"_k{j}").alias("c"), F.col(f"_k{j}").alias("v")) for j in range(len(exprs))]))
        sides = [F.count_if(F.col("_p").isNotNull()).alias("np"), F.count_if(F.col("_p").isNull()).alias("ns")]
        seen = cut(self.all.select("_p", values.alias("_t")).select("_p", "_t.*").where("v is not null").groupBy("c", "v").agg(*sides), "values")
        total, both = F.col("np") + F.col("ns"), (F.col("np") > 0) & (F.col("ns") > 0)
        found = seen.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max(total).alias("n"), F.sum(total).alias("rows"), F.sum("np").alias("np"), F.sum("ns").alias("ns"),
                                      F.count_if(both).alias("k2"), F.max(F.when(both, total)).alias("n2"), F.sum(F.when(both, total)).alias("rows2")).collect()
        # A row for each key column: how many values it has, the rows of the most frequent one, and all its rows.
        self.seen = {r["c"]: (r["k"], r["n"], r["rows"]) for r in found}
        self.total = self.seen.get("", (0, 0, 0))[1]
        self.sides = next(((r["np"], r["ns"]) for r in found if not r["c"]), (0, 0))
        # A value that one side lacks never pairs, so it is no key.
        self.rows, sparse = self.all, {r["c"]: r for r in found if r["c"] and r["k2"] <= FEW_PIECES and 10 * (r["rows2"] or 0) < 9 * r["rows"]}
        for c, r in sparse.items():
            self.seen[c] = (r["k2"], r["n2"] or 0, r["rows2"] or 0)
            shared = F.broadcast(seen.where((F.col("c") == c) & both).select(F.col("v").alias(c), F.lit(True).alias("_shared")))  # at most FEW_PIECES rows
            self.rows = self.rows.join(shared, c, "left").withColumn(c, F.when(F.col("_shared"), F.col(c))).drop("_shared")
        self.rows = self.rows.select(*self.all.columns)

    def group(self, number: int) -> tuple[Column, Column]:
        """Whether a row has all keys of a round, and its group there."""
        keys = [F.col(c) for c in self.columns[number]]
        group = F.array(*keys) if keys else F.expr("cast(array() as array<string>)")
        return _known(self.columns[number]), group

    def rank(self, rows: DataFrame, number: int, seed: int) -> DataFrame:
        """Rows with ``_group``, ``_rank`` in their side of the group and ``_limit``, the rows of the other side.

        All rows have the round's keys.  Hot groups are found by an action and cut into pieces by leading digest
        bits; one count of their rows by side, priorities and piece gives the rows in front of each piece and the
        sizes of the group.  All other groups are numbered and sized where they meet, as all are where none is
        hot.  Groups and digests are made where rows meet and are not shuffled.
        """
        by = self.columns[number] or ["_no_key"]
        keyed = rows if self.columns[number] else rows.withColumn("_no_key", F.lit(0))
        hot = listed_hot_groups(keyed, by)
        if hot is None:
            return self.meet(rows, number, seed)
        _, group = self.group(number)
        digest, first, is_hot = order_key(["_p", "_s"], seed), F.col("_p").isNotNull(), F.col("_piece").isNotNull()
        marks = F.broadcast(renamed(hot, by))
        dealt = keyed.join(marks, null_safe(keyed, marks, [(c, f"_r_{c}") for c in by]), "left").drop(*[f"_r_{c}" for c in by])
        dealt = dealt.withColumn("_bucket", F.when(F.col("_pieces").isNotNull(), digest_bucket(digest)))
        dealt = dealt.withColumn("_piece", bucket_piece("_bucket", "_pieces")).drop("_bucket", "_pieces")
        front = [name for name, _ in self.order]
        directed = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in self.order]
        counts = cut(dealt.where(is_hot).withColumn("_first", first).groupBy(*by, "_first", *front, "_piece").agg(F.count(F.lit(1)).alias("_n")), "pieces")
        ahead = W.partitionBy(*by, "_first").orderBy(*directed, "_piece").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*by)
        offsets = counts.select(*by, "_first", *[F.col(c).alias(f"_f{c}") for c in front], "_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                                F.sum(F.when(F.col("_first"), 0).otherwise(F.col("_n"))).over(whole).alias("_ns"), F.sum(F.when(F.col("_first"), F.col("_n")).otherwise(0)).over(whole).alias("_np"))
        # Without priorities fewer than 4 x spread rows; with them, as many as the hot groups have.
        if not front or counts.count() <= FEW_PIECES:
            offsets = F.broadcast(offsets)
        fronts = {f"_f{c}": F.when(is_hot, F.col(c)) for c in front}
        place = [*by, "_piece", *fronts]
        met = (dealt.withColumns(fronts) if fronts else dealt).repartition(tasks_for(self.spark, self.total), *place).withColumns({"_first": first, "_order": F.unhex(digest)})
        numbered = met.withColumn("_rank", F.row_number().over(W.partitionBy(*place, "_first").orderBy(*directed, "_order", "_p", "_s")).cast("long")).drop("_order")
        here = W.partitionBy(*place)
        numbered = numbered.withColumn("_limit", F.when(F.col("_first"), F.count_if(~F.col("_first")).over(here)).otherwise(F.count_if("_first").over(here)))
        on = [*by, "_first", "_piece", *fronts]
        marked = renamed(offsets, on)
        ranked = numbered.join(marked, null_safe(numbered, marked, [(c, f"_r_{c}") for c in on]), "left")
        others = F.when(F.col("_first"), F.col("_ns")).otherwise(F.col("_np"))
        return ranked.select(*rows.columns, group.alias("_group"), "_first", (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("_rank"), F.coalesce(others, "_limit").alias("_limit"))

    def meet(self, rows: DataFrame, number: int, seed: int) -> DataFrame:
        """``rank`` where no group is hot: the rows of a group meet in one task, and only keys travel."""
        cols = self.columns[number]
        _, group = self.group(number)
        met = rows.repartition(tasks_for(self.spark, self.total), *cols) if cols else rows.repartition(1)
        keyed = met.withColumns({"_first": F.col("_p").isNotNull(), "_order": F.unhex(order_key(["_p", "_s"], seed))})
        directed = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in self.order]
        by = [F.col(c) for c in cols] or [F.lit(0)]
        ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "_first").orderBy(*directed, "_order", "_p", "_s")).cast("long"))
        other = W.partitionBy(*by)
        limit = F.when(F.col("_first"), F.count_if(~F.col("_first")).over(other)).otherwise(F.count_if("_first").over(other))
        return ranked.select(*rows.columns, group.alias("_group"), "_first", "_rank", limit.alias("_limit"))

    def bounds(self, cols: list[str]) -> tuple[int, int]:
        """At most so many groups, and so many rows in one, by the frequencies of single keys."""
        seen = [self.seen.get(c, (0, 0, 0)) for c in cols]
        return math.prod(k for k, *_ in seen), min([self.total, *[n for _, n, _ in seen]])

    def kept(self, number: int) -> list[str]:
        """The columns that rounds from this one on need."""
        later = {c for cs in self.columns[number:] for c in cs}
        return [c for c in self.all.columns if c in later or not c.startswith("_k")]

    def chain(self, number: int) -> tuple[int, list[str]]:
        """How many rounds from this one on can be served by one shuffle, and the keys of it.

        They share keys by which no group is hot, so the rows of all their groups meet in the same task.  Rounds
        whose groups are counted first stay alone.
        """
        most = rows_at_once(self.spark, self.total)
        counted = lambda i: self.bounds(self.columns[i])[0] <= FEW_GROUPS and self.total > most
        shared, n = self.columns[number], 1
        while not counted(number) and n < CHAIN and number + n < len(self.columns) and not counted(number + n):
            common = [c for c in shared if c in self.columns[number + n]]
            if not common or self.bounds(common)[1] > most:
                break
            shared, n = common, n + 1
        return n, shared

    def plan(self, apart: bool) -> None:
        """Lists the steps of the cascade: first round, number of rounds, and the keys by which its rows meet."""
        self.steps = []
        while (i := sum(n for _, n, _ in self.steps)) < len(self.columns):
            self.steps.append((i, *((1, self.columns[i]) if apart else self.chain(i))))

    def present(self, step: int | None = None) -> bool:
        """Whether both sides have open rows, of those that may take part in a step."""
        sides = {side for label, side, _ in self.waiting if step is None or label <= step}
        return all(side in sides or (self.fresh and self.sides[side] > 0) for side in (0, 1))

    def open_rows(self, number: int, step: int | None = None, side: int | None = None) -> DataFrame:
        """Open rows with the keys of rounds from ``number`` on, of those that may take part in a step, of one side."""
        names = self.kept(number)
        paths = [path for label, of, path in self.waiting if (step is None or label <= step) and side in (None, of)]
        schema = StructType([f for f in self.all.schema.fields if f.name in names])
        parts = [self.spark.read.schema(schema).parquet(*paths)] if paths else []
        if self.fresh or not parts:
            mine = F.lit(side is None) | (F.col("_p").isNotNull() if side == 0 else F.col("_p").isNull())
            parts.append(self.rows.where(mine if self.fresh else F.lit(False)).select(*names))
        return reduce(DataFrame.unionByName, parts)

    def store(self, state: DataFrame, step: int, name: int) -> None:
        """Writes the rows of a step: settled ones for good, open ones where the next step finds whose keys they have.

        The rows the step has read are deleted.
        """
        settled = len(self.steps) + 1
        later = [F.when(_known(shared), F.lit(i)) for i, (_, _, shared) in enumerate(self.steps) if i > step]
        label = F.when(F.col("_done"), F.lit(settled)).otherwise(F.coalesce(*later, F.lit(len(self.steps))))
        folder = f"{self.path}/match_round={name}"
        state.withColumn("_to", 2 * label + F.when(F.col("_p").isNotNull(), 0).otherwise(1)).drop("_done").write.partitionBy("_to").parquet(folder)
        for label, _, path in self.waiting:
            if label <= step:
                discard(self.spark, path)
        self.waiting, self.fresh = [x for x in self.waiting if x[0] > step], False
        for found in folders(self.spark, folder):
            label, side = divmod(int(found.removeprefix("_to=")), 2)
            (self.settled if label == settled else self.waiting).append((label, side, f"{folder}/{found}"))

    def run(self, step: int, name: int, seed: int) -> None:
        """One round: settled rows are written for good, others where the next step that can use them finds them.

        Nothing is written where no group has rows of both sides.  Rows meet by group where the frequencies of
        single keys, or the counts of groups where there are few, show that no group is hot; else hot groups are
        cut up by ``rank``.
        """
        number = self.steps[step][0]
        cols = self.columns[number]
        ready, group = self.group(number)
        most = rows_at_once(self.spark, self.total)
        groups, largest = self.bounds(cols)
        rows = self.open_rows(number, step)
        if groups <= FEW_GROUPS and self.total > most:
            sides = rows.where(ready).groupBy(*cols).agg(F.count_if(F.col("_p").isNotNull()).alias("_np"), F.count_if(F.col("_p").isNull()).alias("_ns"))
            found = cut(sides.where("_np > 0 and _ns > 0"), "groups")
            largest = found.agg(F.max(F.col("_np") + F.col("_ns"))).first()[0] or 0
            if not largest:
                return
            # At most FEW_GROUPS rows; a round without keys has one group.
            ready = ready & F.col("_met") if cols else ready
            rows = rows.join(F.broadcast(found.select(*cols, F.lit(True).alias("_met"))), cols, "left") if cols else rows
        open_to = F.coalesce(ready, F.lit(False))
        names = [c for c in rows.columns if c != "_met"]
        here, rest = rows.where(open_to).select(*names), rows.where(~open_to).select(*names)
        ranked = (self.meet if largest <= most else self.rank)(here, number, seed)
        done = F.coalesce(F.col("_rank") <= F.col("_limit"), F.lit(False))
        keep = self.kept(number + 1)
        state = ranked.withColumn("_done", done).select(*keep, F.when(done, F.col("_group")).alias("_group"), F.when(done, F.col("_rank")).alias("_rank"),
                                                        F.lit(name).alias("match_round"), "_done")
        self.store(state.unionByName(rest.select(*keep).withColumn("_done", F.lit(False)), allowMissingColumns=True), step, name)

    def run_chain(self, step: int, name: int, seed: int) -> None:
        """The rounds of a step, the first of them called ``name``, in one shuffle: each ranks and counts, where rows
        have met by the shared keys, what the rounds before it left open.  Digests are made of rows whose group
        has both sides."""
        number, count, shared = self.steps[step]
        rows = self.open_rows(number, step)
        late = self.fresh or any(label < step for label, *_ in self.waiting)
        here = rows.where(_known(shared))
        directed = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in self.order]
        state = here.repartition(tasks_for(self.spark, min(self.seen[c][2] for c in shared)), *shared).withColumns({
            "_first": F.col("_p").isNotNull(), "match_round": F.lit(None).cast("int"),
            "_group": F.lit(None).cast("array<string>"), "_rank": F.lit(None).cast("long")})
        uses = lambda c: -sum(c in self.columns[number + k] for k in range(count))
        for k in range(count):
            ready, group = self.group(number + k)
            state = state.withColumn("_open", F.col("match_round").isNull() & ready)
            # Keys that most rounds share stand first, so that the order of one round serves the next one.
            by = sorted(self.columns[number + k], key=lambda c: (c not in shared, uses(c), c))
            sized = W.partitionBy(*by)
            state = state.withColumns({"_np": F.count_if(F.col("_open") & F.col("_first")).over(sized), "_ns": F.count_if(F.col("_open") & ~F.col("_first")).over(sized)})
            state = state.withColumn("_open", F.col("_open") & (F.col("_np") > 0) & (F.col("_ns") > 0))
            of = lambda c: F.when(F.col("_open"), c)
            state = state.withColumns({"_side": of(F.col("_first")), "_order": of(F.unhex(order_key(["_p", "_s"], seed + k))), "_op": of(F.col("_p")), "_os": of(F.col("_s"))})
            state = state.withColumn("_at", F.row_number().over(W.partitionBy(*by, "_side").orderBy(*directed, "_order", "_op", "_os")).cast("long"))
            done = F.col("_open") & (F.col("_at") <= F.when(F.col("_first"), F.col("_ns")).otherwise(F.col("_np")))
            state = state.withColumns({"_group": F.when(done, group).otherwise(F.col("_group")), "_rank": F.when(done, F.col("_at")).otherwise(F.col("_rank")),
                                       "match_round": F.when(done, F.lit(name + k)).otherwise(F.col("match_round"))})
        keep = self.kept(number + count)
        state = state.select(*keep, "_group", "_rank", "match_round", F.col("match_round").isNotNull().alias("_done"))
        if late:
            rest = rows.where(~_known(shared)).select(*keep).withColumn("_done", F.lit(False))
            state = state.unionByName(rest, allowMissingColumns=True)
        self.store(state, step, name + count - 1)

    def settled_rows(self, side: int) -> DataFrame:
        """The settled rows of a side: key, round, group and rank."""
        key = ("_p", "_s")[side]
        schema = StructType([self.all.schema[key], *[StructField(n, t) for n, t in (
            ("match_round", IntegerType()), ("_group", ArrayType(StringType())), ("_rank", LongType()))]])
        paths = [path for _, of, path in self.settled if of == side]
        if paths:
            return self.spark.read.schema(schema).parquet(*paths)
        return self.all.where("false").select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def _one_text(keys: list[Column]) -> Column:
    """Key texts as one text, null where one is null; different keys give different texts."""
    return keys[0] if len(keys) == 1 else F.concat(*[F.concat(F.length(k).cast("string"), F.lit(":"), k) for k in keys])


def merge_cascade(primary: Side, secondary: Side, rounds: list[Round], seed: int, reuse: str | None = None,
                  stop_early: bool = False, first_round: int = 1) -> CascadeResult:
    """Pairs (primary key, secondary key, match_round) over all rounds.

    A row pairs in a round exactly when its rank in its group is not above the rows that the other side has
    there, so a round only ranks and counts keys: no row meets another one.  Settled rows keep round, group and
    rank; one equi join at the end makes the pairs of all rounds.  Each round reads the open rows that have its
    keys and writes them where the next round whose keys they have finds them, so rows that take no part in a round
    are not moved, the plan stays short and a lost executor repeats one round at most; what a round has read is
    deleted.  Key values that one side lacks count as missing where that spares rows.  Neighbouring rounds that share
    keys by which no group is hot are one shuffle and one write together; a round is left out where one side has no
    row for it.

    ``reuse='cycles'`` lets secondary rows serve again: after the rounds, each
    level from fine to coarse gives the rows that are left a secondary row of
    their group in its last round, as many times as needed.  Rows stay alone
    only where no level's group has a secondary row; the number of jobs is that
    of rounds and levels, whatever the sizes of the tables.
    ``reuse='modulo'`` does so for the last round's group only.

    ``primary_left`` and ``secondary_left`` read the given tables again.
    """
    shared = set(primary.df.columns) & set(secondary.df.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    cascade = _Cascade(primary, secondary, rounds)
    cascade.plan(stop_early)
    number = first_round - 1
    for step, (_, count, _) in enumerate(cascade.steps):
        if cascade.present(step):
            (cascade.run_chain if count > 1 else cascade.run)(step, number + 1, seed + number + 1)
        number += count
        if stop_early and not cascade.present():
            break
    on = ["match_round", "_group", "_rank"]
    pairs = cascade.settled_rows(0).join(cascade.settled_rows(1), on).select(F.col("_p").alias(primary.pk), F.col("_s").alias(secondary.pk), "match_round")
    p, s = cascade.open_rows(len(rounds), side=0).select("_p"), cascade.open_rows(len(rounds), side=1).select("_s")
    last_of_level = list({rnd.level: i for i, rnd in enumerate(rounds)}.values())
    for i in {"cycles": last_of_level, "modulo": [len(rounds) - 1]}.get(reuse, []):
        number += 1
        wrapped = cut(_wrap_around(cascade, p, i, seed + number).select(
            F.col("_p").alias(primary.pk), F.col("_s").alias(secondary.pk), F.lit(number).alias("match_round")), "wrap")
        pairs = pairs.unionByName(wrapped)
        p = p.join(wrapped.select(F.col(primary.pk).alias("_p")), "_p", "left_anti")
    return CascadeResult(pairs, primary.df.join(p.select(F.col("_p").alias(primary.pk)), primary.pk, "left_semi").select(*primary.df.columns),
                         secondary.df.join(s.select(F.col("_s").alias(secondary.pk)), secondary.pk, "left_semi").select(*secondary.df.columns), number)


def _wrap_around(cascade: _Cascade, left: DataFrame, number: int, seed: int) -> DataFrame:
    """Give row r of a group the secondary row ((r - 1) mod n) + 1 of the group."""
    ready, group = cascade.group(number)
    ranked = []
    # rows that are left keep the keys of later rounds only, so they are read with all keys again
    for rows, key in ((cascade.all.join(left.select("_p"), "_p", "left_semi"), "_p"), (cascade.all.where("_s is not null"), "_s")):
        sort = [(c, asc) for c, asc in cascade.order if c.startswith(key)]
        grouped = rows.where(ready).select(key, *[c for c, _ in sort], group.alias("_group"))
        ranked.append(random_rank(grouped, ["_group"], key, seed, sort, "_rank").select("_group", "_rank", key))
    sizes = ranked[1].groupBy("_group").agg(F.max("_rank").alias("_size"))
    sized = spread_join(ranked[0], sizes, ["_group"])
    wrapped = sized.withColumn("_rank", F.pmod(F.col("_rank") - 1, F.col("_size")) + 1)
    return spread_join(wrapped, ranked[1], ["_group", "_rank"])


def match_flag(new_value: Column, not_set, has_primary: Column, has_secondary: Column, keys_known: Column,
               already_set: Column, number) -> Column:
    """State code of a row around a round.

    -777 set before, -888 a required key is missing, round where both sides
    gave the value, round + .5 where only the primary side did, 0 unused.
    """
    value_set = F.coalesce(new_value != F.lit(not_set), F.lit(False))
    number = F.lit(float(number))
    return (F.when(already_set, F.lit(-777.0))
            .when(~keys_known, F.lit(-888.0))
            .when(value_set & has_primary & has_secondary, number)
            .when(value_set & has_primary & ~has_secondary, number + 0.5)
            .otherwise(F.lit(0.0)))
