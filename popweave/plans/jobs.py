"""Job tables, candidate job lists, and job selection, for all blocks at once."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popweave.functions.ids import geo_part
from popweave.functions.seeded import order_key
from popweave.operators.checks import margin_fitness, margin_table
from popweave.operators.hot import split_hot, spread_join, tasks_for
from popweave.operators.joins import unique_here
from popweave.operators.ranks import random_rank
from popweave.operators.reshape import exclusive_columns, expand_rows, job_type_equations, stem_columns
from popweave.operators.select import select_jobs, weighted_sample
from popweave.session import cut, discard, folders, scratch_path

SEGMENTS = ["Age", "Earnings", "SuperSector"]
# The exclusive job types that together make up all jobs.
EXCLUSIVE_TYPES = ("JT03", "JT05", "JT07", "JT09", "JT10", "JT11")


def with_job_ids(df: DataFrame, traits: list[str]) -> DataFrame:
    """Job ids from the segments, and from the segments plus all traits."""
    text = lambda c: F.col(c).cast("string")
    od = F.concat(F.lit("jidod"), text("jobtype"), *[text(s) for s in SEGMENTS])
    return df.withColumn("jobidod", od).withColumn(
        "jobidac", F.concat(F.col("jobidod"), F.lit("jobidac"), *[text(c) for c in sorted(traits)]))


def with_missing_education(df: DataFrame) -> DataFrame:
    """Education is not asked below age 30: its count is the youngest age count."""
    return df.withColumn("CD00", F.col("CA01"))


def person_columns(df: DataFrame) -> DataFrame:
    """Ethnicity code as a Hispanic flag, job traits under person names."""
    flag = F.when(F.col("Ethnicity") == 2, 1).when(F.col("Ethnicity") == 1, 0)
    return df.withColumn("hispan", flag).drop("Ethnicity").withColumnsRenamed({"Race": "race", "Sex": "sex"})


def coarse_home(df: DataFrame, home: str, km: str, out: str) -> DataFrame:
    """Home area of a commute: tract, county beyond the mean distance, state beyond 500 km."""
    mean = df.agg(F.avg(km)).scalar()
    block = F.col(home)
    return df.withColumn(out, F.when(F.col(km) > 500, geo_part(block, "state"))
                         .when(F.col(km) > mean, geo_part(block, "county")).otherwise(geo_part(block, "tract")))


def job_tables(counts: DataFrame, keys: list[str], primary_federal: bool = False) -> DataFrame:
    """Exclusive job types per key as long rows, zero counts dropped.

    ``counts`` is wide with one column per overlapping job type.
    """
    wide = exclusive_columns(counts, keys, job_type_equations(primary_federal))
    return wide.unpivot(keys, list(EXCLUSIVE_TYPES), "jobtype", "jobcount").filter(F.col("jobcount") != 0)


def county_job_tables(files: DataFrame, crosswalk: DataFrame, counts: dict[str, list[str]], primary_federal: bool = False) -> DataFrame:
    """Job files of all families as exclusive long tables of the study area.

    ``files`` is the result of ``read_job_families`` and ``counts`` names its counts; ``crosswalk`` has a row per
    ``block`` of the area.  Every job type goes with its sign into the exclusive types it is part of: the lines
    of an id meet once, and one row holds all its exclusive counts.  Then work files keep work blocks of the
    area, pair files pairs with either end in it, home files home blocks of the area and those that the kept
    pairs name; the counts are opened and zero counts dropped.  ``od`` and ``seg_stem`` name the table: one for
    pairs, and one for each segment stem of work and home files.
    """
    equations = job_type_equations(primary_federal)
    places = range(max(len(names) for names in counts.values()))
    keys = ["od", "segpart", "year", "w_geocode", "h_geocode"]
    part = {kind: F.lit(None) for kind in EXCLUSIVE_TYPES}
    for kind in EXCLUSIVE_TYPES:
        for source, sign in equations[kind].items():
            part[kind] = F.when(F.col("jobtype") == source, F.lit(sign)).otherwise(part[kind])
    met = files.select(*keys, "jobtype", *[f"n{i}" for i in places]).repartition(*keys).withColumns({f"_{kind}": part[kind] for kind in EXCLUSIVE_TYPES})
    # Most counts of an id are zero; the others are one list of numbers: the count (below 2**57), and below it its place.
    every = [(kind, i) for kind in EXCLUSIVE_TYPES for i in places]
    bits = len(every).bit_length()
    sums = met.groupBy(*keys).agg(*[F.sum(F.col(f"_{kind}") * F.col(f"n{i}")).alias(f"{kind}_{i}") for kind, i in every])
    packed = F.array(*[F.coalesce(F.col(f"{kind}_{i}"), F.lit(0)) * 2**bits + at for at, (kind, i) in enumerate(every)])
    tallies = cut(sums.select(*keys, F.filter(packed, lambda x: F.shiftright(x, bits) != 0).alias("_counts")), "tallies")
    area = crosswalk.select("block").where("block is not null").distinct()
    here = lambda df, geo: spread_join(df, area.withColumnRenamed("block", geo), [geo], "left_semi")
    marks = area.select(F.col("block").alias("w_geocode"), F.lit(True).alias("_here"))
    pairs = cut(spread_join(tallies.filter("od = 'od'"), marks, ["w_geocode"], "left"), "pairs")
    inside = pairs.filter("_here").drop("_here")
    kept = inside.unionByName(cut(here(pairs.filter("_here is null").drop("_here"), "h_geocode"), "homeward"))
    homes = kept.select(F.col("h_geocode").alias("block")).unionByName(area).distinct()
    home = spread_join(tallies.filter("od = 'rac'"), homes.withColumnRenamed("block", "h_geocode"), ["h_geocode"], "left_semi")
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    at = F.col("_count").bitwiseAND(2**bits - 1).cast("int")
    opened = lambda df, family: df.select(*keys, F.explode("_counts").alias("_count")).select(
        *keys, F.get(texts([kind for kind, _ in every]), at).alias("jobtype"), F.get(texts([(*counts[family], *[None] * len(places))[i] for _, i in every]), at).alias("name"),
        F.shiftright("_count", bits).alias("jobcount"))
    studied = {"od": kept, "wac": here(tallies.filter("od = 'wac'"), "w_geocode"), "rac": home}
    long = reduce(DataFrame.unionByName, [opened(studied[family], family) for family in studied if family in counts]).filter("name is not null")
    return long.withColumn("seg_stem", F.when(F.col("od") == "od", "na").otherwise(F.substring("segpart", 1, 2)))


def append_out_of_state(residence: DataFrame, pairs: DataFrame, work_state: Column, home_state: Column,
                        home: str, outside: DataFrame) -> DataFrame:
    """Residence rows of home blocks that lie in another state than the work
    block, appended once per block and row."""
    wanted = pairs.filter(work_state != home_state).select(home).distinct()
    extra = spread_join(outside, wanted, [home], "left_semi")
    extra = spread_join(extra, residence.select(home).distinct(), [home], "left_anti").dropDuplicates()
    return residence.unionByName(extra, allowMissingColumns=True)


def three_way_match(od: DataFrame, wac: DataFrame, rac: DataFrame, traits: list[str], state: dict) -> DataFrame:
    """Candidates of each origin-destination job.

    Work-side and home-side jobs of a pair must share job id, counter, year and
    traits; pairs from another state without such a job fall back to the pair's
    own segments.  The counters of a pair are opened only at the end, so the
    joins see each pair once, and pairs and jobs without a home-side job are
    left out before the two are joined.  The job fails where a side repeats a job.
    """
    pair = ["w_geocode", "h_geocode", "jobidod"]
    # Each side's ids are keys of its table; the joins below are one to many from the pairs.
    same = ["jobidod", "jobidac", "jobidac_counter", "year", *traits]
    wac, rac = unique_here(wac, ["w_geocode", *same]), cut(unique_here(rac, ["h_geocode", *same]), "home side")
    counters = cut(od.groupBy(*pair).agg(F.max("jobidod_counter").alias("_jobs"), *[F.min(c).alias(c) for c in ("jobtype", "year")]), "pairs")
    work = wac.select("w_geocode", "jobidod", "jobidac", "jobidac_counter", "year", *traits)
    home = rac.select("h_geocode", "jobidod", "jobidac", "jobidac_counter", "year", *traits)
    lived = counters.drop("year").join(home.select("h_geocode", "jobidod").distinct(), ["h_geocode", "jobidod"], "left_semi")
    held = work.join(home.select(*same).distinct(), same, "left_semi")
    # Stored, as its hot keys are counted before it is joined.
    at_work = cut(spread_join(lived, held, ["w_geocode", "jobidod"]), "at work")
    matched = cut(spread_join(at_work, home, ["h_geocode", "jobidod", "jobidac", "jobidac_counter", "year", *traits]), "matched")
    away = F.expr(state["work"]) != F.expr(state["home"])
    alone = counters.filter(away).join(matched.select(*pair).distinct(), pair, "left_anti")
    both = matched.unionByName(alone, allowMissingColumns=True)
    return expand_rows(both, "_jobs", "jobidod_counter")


def _two_job_codes(stems: dict[str, str]) -> Column:
    """All segment combinations of a key, from its counts; at most 27."""
    lists = []
    for segment in SEGMENTS:
        stem = stems[segment]
        codes = [F.when(F.col(f"{stem}0{i}") != 0, F.lit(str(i))) for i in (1, 2, 3)]
        lists.append(F.array_compact(F.array(*codes)))
    return F.flatten(F.transform(lists[0], lambda a: F.flatten(F.transform(lists[1], lambda b: F.transform(lists[2], lambda c: F.concat(a, b, c))))))


def pair_options(expected: DataFrame, keys: list[str], stems: dict[str, str]) -> DataFrame:
    """All segment combinations of two-job keys and the combination that
    completes each: the first goes with the last, and so on."""
    rows = expected.filter(F.col("S000") == 2).select(*keys, _two_job_codes(stems).alias("_all"))
    rows = rows.select(*keys, F.posexplode("_all").alias("at", "code"), "_all")
    other = F.element_at("_all", (F.size("_all") - F.col("at")).cast("int"))
    return rows.select(*keys, F.concat(F.lit("jidod"), F.col("jobtype"), "code").alias("jobidod"),
                       F.concat(F.lit("jidod"), F.col("jobtype"), other).alias("partner"), "at",
                       (F.size("_all") - 1 - F.col("at")).alias("partner_at"))


def drop_impossible_pairs(candidates: DataFrame, expected: DataFrame, keys: list[str], stems: dict[str, str]) -> DataFrame:
    """Candidates of two-job keys whose completing candidate is missing are
    dropped; the rest carry the pair they belong to.  Keys with another number
    of jobs keep all candidates.

    ``expected`` has a key once.  Where a key is not hot its candidates meet its
    combinations and each other in one shuffle; only the rows of hot keys are
    dealt out and compared by joins.  ``candidates`` is read twice.
    """
    cold, hot = split_hot(candidates, keys)
    kept = _pairs_met(cold, expected, keys, stems)
    return kept if hot is None else kept.unionByName(_pairs_dealt(cut(hot, "hot candidates"), expected, keys, stems))


def _pair_columns() -> dict[str, Column]:
    """The pair of a two-job candidate and its number there: the later option is counted first."""
    ahead = F.col("at") <= F.col("partner_at")
    return {"jobidod_pair": F.when(ahead, F.concat("jobidod", "partner")).otherwise(F.concat("partner", "jobidod")),
            "jobidod_counter": F.when(ahead, 2).otherwise(1)}


def _pairs_met(candidates: DataFrame, expected: DataFrame, keys: list[str], stems: dict[str, str]) -> DataFrame:
    """``drop_impossible_pairs`` where the candidates of a key meet in one task."""
    totals = expected.select(*keys, F.col("S000").alias("_jobs"), F.when(F.col("S000") == 2, _two_job_codes(stems)).alias("_all"))
    met = candidates.join(totals, keys)
    job_id = lambda code: F.concat(F.lit("jidod"), F.col("jobtype"), code)
    at = F.array_position(F.transform("_all", job_id), F.col("jobidod")).cast("int")  # from 1, 0 where it is no option
    met = met.withColumn("at", at)
    met = met.withColumn("_present", F.collect_set(F.when(F.col("at") > 0, F.col("at"))).over(W.partitionBy(*keys)))
    met = met.withColumn("partner_at", F.size("_all") + 1 - F.col("at"))
    met = met.filter((F.col("_jobs") != 2) | ((F.col("at") > 0) & F.array_contains("_present", F.col("partner_at"))))
    met = met.withColumn("partner", F.when(F.col("_jobs") == 2, job_id(F.try_element_at("_all", F.col("partner_at")))))
    two, pair = F.col("_jobs") == 2, _pair_columns()
    kinds = {"jobidod_counter": F.when(two, pair["jobidod_counter"]).otherwise(F.col("jobidod_counter")),
             "jobidod_pair": F.when(two, pair["jobidod_pair"]).when(F.col("_jobs") == 1, "S000=1").otherwise("S000>2")}
    return met.withColumns(kinds).select(*keys, *[c for c in candidates.columns if c not in keys], "jobidod_pair")


def _pairs_dealt(candidates: DataFrame, expected: DataFrame, keys: list[str], stems: dict[str, str]) -> DataFrame:
    """``drop_impossible_pairs`` for hot keys."""
    sized = cut(spread_join(candidates, expected.select(*keys, F.col("S000").alias("_jobs")), keys), "sized")
    present = candidates.select(*keys, F.col("jobidod").alias("partner")).distinct()
    possible = pair_options(expected, keys, stems).join(present, [*keys, "partner"], "left_semi")
    two = spread_join(sized.filter("_jobs = 2"), possible, [*keys, "jobidod"]).withColumns(_pair_columns())
    other = sized.filter("_jobs <> 2").withColumn("jobidod_pair", F.when(F.col("_jobs") == 1, "S000=1").otherwise("S000>2"))
    columns = [c for c in other.columns if c != "_jobs"]
    return two.select(*columns).unionByName(other.select(*columns))


def select_by_fit(candidates: DataFrame, expected: DataFrame, block: list[str], choice: list[str], pair: list[str],
                  pk: str, want: str, certain: Column, traits: list[str], seeds: int, first_seed: int = 1) -> DataFrame:
    """The best of many seeded selections per block, by distance to its margins.

    ``expected`` is long (block keys, trait, code, n).  Every seed is one random
    selection of the whole table; only the winning seed of a block is kept.
    """
    return select_by_fits(candidates, [expected], block, choice, pair, pk, want, certain, traits, seeds, [first_seed]).drop("_split")


def select_by_fits(candidates: DataFrame, expected: list[DataFrame], block: list[str], choice: list[str], pair: list[str],
                   pk: str, want: str, certain: Column, traits: list[str], seeds: int, first_seeds: list[int]) -> DataFrame:
    """``select_by_fit`` for several margin tables at once, each with its own
    seeds; ``_split`` is the number of the table."""
    ranges = [[first + k for k in range(seeds)] for first in first_seeds]
    pairs = F.array(*[F.struct(F.lit(i).alias("split"), F.lit(seed).alias("seed")) for i, r in enumerate(ranges) for seed in r])
    seeded = lambda df: df.withColumn("_draw", F.explode(pairs)).withColumns({"_split": F.col("_draw.split"), "seed": F.col("_draw.seed")}).drop("_draw")
    # Rows meet by pair before they are repeated for each seed; only hot pairs are cut up.
    cold, hot = split_hot(candidates, pair) if set(pair) <= set(choice) else (None, candidates)
    parts = [] if cold is None else [select_jobs(seeded(cold.repartition(*pair)), choice, pair, pk, want, certain, None, "seed", together=True)]
    parts += [] if hot is None else [select_jobs(seeded(hot), choice, pair, pk, want, certain, None, "seed")]
    chosen = cut(reduce(DataFrame.unionByName, parts).filter("select_job = 1"), "selected")
    made = margin_table(chosen, [*block, "_split", "seed"], traits)
    targets = reduce(DataFrame.unionByName, [
        table.withColumns({"_split": F.lit(i), "seed": F.explode(F.array(*[F.lit(s) for s in r]))}) for i, (table, r) in enumerate(zip(expected, ranges))])
    fit = margin_fitness(made, targets, [*block, "_split", "seed"])
    best = fit.groupBy(*block, "_split").agg(F.min(F.struct("fitness", "seed")).alias("_best"))
    best = best.select(*block, "_split", F.col("_best.seed").alias("seed"), F.col("_best.fitness").alias("fitness"))
    return spread_join(chosen, best, [*block, "_split", "seed"])


def select_jobs_by_agreement(candidates: DataFrame, margins: dict[str, DataFrame], block: list[str], choice: list[str],
                             pair: list[str], pk: str, want: str, traits: list[str], seeds: int) -> DataFrame:
    """Selection against two splits of the margins, repeated block by block.

    A job chosen under both splits becomes certain and its rivals for the same
    choice are dropped.  A block is worked on until a pass makes none of its
    jobs certain and drops none, or no choice of it is open; then its rows are
    set aside, so a pass costs what is still open.  Passes end: a block's pool
    never grows, and in one that stays jobs only become certain.  A final
    selection runs on what is left.  Choices lie inside a block; the result of
    a block does not depend on other blocks.

    Where blocks are pairs and none is hot, the rows of a block meet in one
    task, with its margins, and a pass is one shuffle and one write.
    """
    spark = candidates.sparkSession
    first, second = margins.values()
    # Blocks only get smaller, so one look at the start shows whether any has to be cut up.
    if set(block) == set(pair) <= set(choice) and split_hot(candidates, pair)[1] is None:
        return _agreement_met(candidates, [first, second], block, choice, pk, want, traits, seeds)
    pool, settled = candidates.withColumn("_sure", F.col("prob_selected") == 1), []
    for step in count():
        runs = select_by_fits(pool, [first, second], block, choice, pair, pk, want, F.col("_sure"), traits, seeds, _first_seeds(step))
        agreed = runs.groupBy(pk, *choice).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2")
        winners = agreed.groupBy(*choice).agg(F.min(pk).alias("_winner"))
        won = F.col(pk) == F.col("_winner")
        path = scratch_path(spark, "agreement")
        spread_join(pool, cut(winners, "winners"), choice, "left").withColumns({
            "_gone": F.coalesce(~won, F.lit(False)), "_new": F.coalesce(won & ~F.col("_sure"), F.lit(False)),
            "_sure": F.col("_sure") | F.coalesce(won, F.lit(False))}).drop("_winner").write.parquet(path)
        marked = spark.read.parquet(path)
        choices = marked.groupBy(*{*block, *choice}).agg(F.max("_sure").alias("_sure"), F.max(F.col("_gone") | F.col("_new")).alias("_moved"))
        active = cut(choices.groupBy(*block).agg(F.max("_moved").alias("_moved"), F.min("_sure").alias("_closed")).filter("_moved and not _closed").select(*block), "active")
        left = marked.filter(~F.col("_gone")).drop("_gone", "_new")
        settled.append(cut(spread_join(left, active, block, "left_anti"), "settled"))
        if active.isEmpty():
            discard(spark, path)
            break
        pool = cut(spread_join(left, active, block, "left_semi"), "pool")
        discard(spark, path)
    rest = reduce(DataFrame.unionByName, settled)
    return select_by_fit(rest, _larger_margins([first, second], block), block, choice, pair, pk, want, F.col("_sure"), traits, seeds, LAST_SEED).drop("_sure")


#: First seed of the final selection.
LAST_SEED = 9001


def _first_seeds(step: int) -> list[int]:
    """First seeds of a pass for both splits; the thousand of the final selection is left out."""
    return [1 + 1000 * (k + (k >= 9)) for k in (2 * step, 2 * step + 1)]


def _larger_margins(margins: list[DataFrame], block: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, margins).groupBy(*block, "trait", "code").agg(F.max("n").alias("n"))


def _with_margins(rows: DataFrame, margins: list[DataFrame], block: list[str]) -> DataFrame:
    """Rows and margins in one table; a margin is a row of its own with the number of its table in ``_split``."""
    targets = reduce(DataFrame.unionByName, [table.select(*block, F.lit(i).alias("_split"), F.col("trait").alias("_trait"), F.col("code").cast("string").alias("_code"),
                                                          F.coalesce("n", F.lit(0)).alias("_n")) for i, table in enumerate(margins)])
    return rows.unionByName(targets.groupBy(*block, "_split", "_trait", "_code").agg(F.sum("_n").alias("_n")), allowMissingColumns=True)


#: Most sums, one for each value of a trait and seed, by which selections are held against their margins.
FEW_SUMS = 64


def _trait_codes(rows: DataFrame, margins: list[DataFrame], traits: list[str]) -> list[tuple[str, str | None]] | None:
    """All (trait, code) of rows and margins, None where they are many (found by an action)."""
    made = margin_table(rows, [], traits).select("trait", "code")
    asked = [table.select("trait", F.col("code").cast("string").alias("code")).where(F.col("trait").isin(traits)) for table in margins]
    found = reduce(DataFrame.unionByName, [made, *asked]).distinct().take(FEW_SUMS + 1)
    return [(r["trait"], r["code"]) for r in found] if len(found) <= FEW_SUMS else None


def _even(rows: DataFrame, block: list[str], choice: list[str], want: str, sure: Column) -> bool:
    """Whether one row for each choice is what every block wants, whatever the seed."""
    sized = rows.groupBy(*dict.fromkeys([*block, *choice])).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(sure).alias("_sures"), F.min(want).alias("_low"), F.max(want).alias("_high"))
    blocks = sized.groupBy(*block).agg(F.count(F.lit(1)).alias("_choices"), F.count_if((F.col("_sures") > 0) & (F.col("_rows") > 1)).alias("_forced"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return blocks.where("_forced > 0 or _choices <> _low or _choices <> _high").isEmpty()


def _best_met(rows: DataFrame, block: list[str], choice: list[str], pk: str, want: str, traits: list[str], ranges: list[list[int]],
              codes: list[tuple[str, str | None]] | None, even: bool) -> DataFrame:
    """``select_by_fits`` of rows with their margins that have met by block: for split i ``_run{i}``, whether the best
    seed chose the row, and ``_best{i}``, its fitness and seed.

    Rows are not repeated for the seeds, and where blocks are ``even`` and the ``codes`` of the traits are known they
    are sorted once, by choice and key.  A choice with one row has no draw, and turns are taken only where a seed's first
    choices are not as many as wanted.
    """
    draws = [(i, seed) for i, seeds in enumerate(ranges) for seed in seeds]
    rest = [c for c in choice if c not in block]
    here, own = W.partitionBy(*block), W.partitionBy(*block, "_margin", *rest)
    names = rows.columns
    digest = lambda seed, where: F.when(where, F.unhex(order_key(pk, seed)))
    out = rows.withColumns({"_id": F.monotonically_increasing_id(), "_margin": F.col("_split").isNotNull()})
    kept = [*names, "_id", "_margin"]
    by_sums = codes is not None and len(codes) * len(draws) <= FEW_SUMS
    for j, trait in enumerate(traits if by_sums else ()):
        # The number of a row's code, made once: sums of long conditions would not be compiled.
        code = F.when(F.col("_split").isNull(), F.col(trait).cast("string")).otherwise(F.col("_code"))
        number = reduce(lambda when, x: when.when(code.eqNullSafe(F.lit(x[1][1]).cast("string")), x[0]), [x for x in enumerate(codes) if x[1][0] == trait], F.when(F.lit(False), -1))
        out = out.withColumn(f"_x{j}", F.when(F.col("_split").isNull() | F.coalesce(F.col("_trait") == trait, F.lit(False)), number))
        kept.append(f"_x{j}")
    # Rows are in order of choice and key from here on, which serves all windows of an even pass.
    out = out.withColumn("_copy", F.count(F.lit(1)).over(W.partitionBy(*block, "_margin", *rest, pk))).withColumn("_rivals", (F.count(F.lit(1)).over(own) > 1) & (F.col("_copy") > 0))
    out = out.select(*kept, *[F.struct(digest(seed, F.col("_rivals") & ~F.col("_margin")).alias("o"), F.col(pk).alias("k"), F.col("_id").alias("i")).alias(f"_o{k}")
                              for k, (_, seed) in enumerate(draws)])
    out = out.select(*kept, *[F.min(f"_o{k}").over(own)["i"].alias(f"_first{k}") for k in range(len(draws))])
    out = out.select(*kept, *[F.when(~F.col("_margin") & ((F.col("_id") == F.col(f"_first{k}")) | F.col("_sure")), 1).otherwise(0).alias(f"_c{k}") for k in range(len(draws))])
    if not even:
        out = out.withColumns({f"_have{k}": F.sum(f"_c{k}").over(here) for k in range(len(draws))})
    for k, (_, seed) in enumerate(() if even else draws):
        uneven = ~F.col("_margin") & F.coalesce(F.col(f"_have{k}") != F.col(want), F.lit(False))
        out = out.withColumns({"_uneven": uneven, "_taken": F.when(uneven, F.col(f"_c{k}"))})
        of = lambda c: F.when(F.col("_uneven"), c)
        turn = F.row_number().over(W.partitionBy(*block, "_taken").orderBy(digest(seed, F.col("_uneven")), of(F.col(pk)), of(F.col("_id"))))
        # A top-up takes the rows right after those already chosen for the block.
        chosen = (F.when(~F.col("_uneven"), F.col(f"_c{k}")).when((F.col("_taken") == 1) & (F.col("_turn") > F.col(want)), 0)
                  .when((F.col("_taken") == 0) & (F.col("_turn") <= F.col(want) - F.col(f"_have{k}")), 1).otherwise(F.col(f"_c{k}")))
        out = out.withColumn("_turn", turn).withColumn(f"_c{k}", chosen).drop("_turn", "_taken", "_uneven", f"_have{k}")
    gaps = [[] for _ in draws]
    asked = lambda mine, split: F.when(mine & (F.col("_split") == split), F.col("_n"))
    if by_sums:
        value = lambda k, split: F.when(F.col("_margin"), F.when(F.col("_split") == split, -F.col("_n"))).otherwise(F.col(f"_c{k}"))
        out = out.withColumns({f"_v{k}": value(k, split) for k, (split, _) in enumerate(draws)})
        for i, (trait, _) in enumerate(codes):
            for k in range(len(draws)):
                gaps[k].append(F.abs(F.coalesce(F.sum(F.when(F.col(f"_x{traits.index(trait)}") == i, F.col(f"_v{k}"))).over(here), F.lit(0))))
    for j, trait in enumerate(() if by_sums else traits):
        mine = F.coalesce(F.col("_trait") == trait, F.lit(False))
        out = out.withColumn("_of", F.when(mine, F.col("_code")).when(~F.col("_margin"), F.col(trait).cast("string")))
        same = W.partitionBy(*block, "_of")
        made = {f"_d{j}_{k}": F.sum(f"_c{k}").over(same) - F.coalesce(F.sum(asked(mine, split)).over(same), F.lit(0)) for k, (split, _) in enumerate(draws)}
        out = out.withColumns({"_one": F.min("_id").over(same), **made})
        out = out.withColumns({name: F.when(F.col("_id") == F.col("_one"), F.abs(name)).otherwise(0) for name in made}).drop("_one", "_of")
        for k in range(len(draws)):
            gaps[k].append(F.sum(f"_d{j}_{k}").over(here))
    # Margins of traits that no row has are missed by every seed.
    other = F.when(F.col("_margin") & ~F.coalesce(F.col("_trait").isin(traits), F.lit(False)), F.abs("_n"))
    missed = lambda split: F.sum(F.coalesce(F.when(F.col("_split") == split, other), F.lit(0))).over(here)
    fit = [reduce(lambda a, b: a + b, gaps[k], missed(split)).alias(f"_fit{k}") for k, (split, _) in enumerate(draws)]
    out = out.select(*kept, *[f"_c{k}" for k in range(len(draws))], *fit)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in block])
    for i, seeds in enumerate(ranges):
        at = [k for k, (split, _) in enumerate(draws) if split == i]
        fits = [F.struct(F.col(f"_fit{k}").alias("fitness"), F.lit(draws[k][1]).alias("seed")) for k in at]
        out = out.withColumn(f"_best{i}", F.least(*fits) if len(fits) > 1 else fits[0])
        won = reduce(lambda a, b: a | b, [(F.col(f"_best{i}.seed") == draws[k][1]) & (F.col(f"_c{k}") == 1) for k in at])
        out = out.withColumn(f"_run{i}", known & ~F.col("_margin") & F.coalesce(won, F.lit(False)))
    return out.drop(*[f"{x}{k}" for x in ("_c", "_fit") for k in range(len(draws))], *[f"_x{j}" for j in range(len(traits))])


def _agreement_met(candidates: DataFrame, margins: list[DataFrame], block: list[str], choice: list[str], pk: str, want: str, traits: list[str], seeds: int) -> DataFrame:
    """``select_jobs_by_agreement`` where the rows of a block fit one task."""
    spark = candidates.sparkSession
    tasks = tasks_for(spark, candidates.count())
    sure = candidates.withColumn("_sure", F.col("prob_selected") == 1)
    codes, even = _trait_codes(candidates, margins, traits), _even(sure, block, choice, want, F.col("_sure"))
    pool = _with_margins(sure, margins, block)
    state, settled, last = pool.schema, [], []
    here, rest = W.partitionBy(*block), [c for c in choice if c not in block]
    own = W.partitionBy(*block, "_margin", *rest)
    all_known = lambda keys: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    read = lambda paths: spark.read.schema(state).parquet(*paths) if paths else pool.where("false")
    for step in count():
        ranges = [[first + k for k in range(seeds)] for first in _first_seeds(step)]
        runs = _best_met(pool.repartition(tasks, *block), block, choice, pk, want, traits, ranges, codes, even)
        runs = runs.withColumn("_agreed", F.sum(F.col("_run0").cast("int") + F.col("_run1").cast("int")).over(W.partitionBy(*block, "_margin", *rest, pk)) == 2)
        runs = runs.withColumn("_winner", F.min(F.when(F.col("_agreed"), F.col(pk))).over(own))
        won = F.when(all_known(choice), F.col(pk) == F.col("_winner"))
        marked = runs.withColumns({"_gone": F.coalesce(~won, F.lit(False)), "_new": F.coalesce(won & ~F.col("_sure"), F.lit(False)),
                                   "_sure": F.col("_sure") | F.coalesce(won, F.lit(False))})
        marked = marked.withColumns({"_known": F.max("_sure").over(own), "_one": F.min("_id").over(own), "_left": F.count_if(~F.col("_gone")).over(own),
                                     "_sures": F.count_if(F.col("_sure") & ~F.col("_gone")).over(own)})
        of = lambda c: F.when(~F.col("_margin"), c)
        marked = marked.withColumns({
            "_moved": F.max(of(F.col("_gone") | F.col("_new"))).over(here), "_closed": F.min(of(F.col("_known"))).over(here),
            "_forced": F.count_if(of((F.col("_sures") > 0) & (F.col("_left") > 1))).over(here), "_choices": F.count_if(of(F.col("_id") == F.col("_one"))).over(here),
            "_low": F.min(of(F.col(want))).over(here), "_high": F.max(of(F.col(want))).over(here)})
        active = F.coalesce(all_known(block) & F.col("_moved") & ~F.col("_closed"), F.lit(False))
        uneven = F.coalesce((F.col("_forced") > 0) | (F.col("_choices") != F.col("_low")) | (F.col("_choices") != F.col("_high")), F.lit(False))
        # 0 and 2: settled blocks, 1 and 3: active ones; 2 and 3: blocks in which turns have to be taken.
        marked = marked.withColumn("_at", active.cast("int") + 2 * uneven.cast("int")).where(~F.col("_gone") & (active | ~F.col("_margin")))
        path = scratch_path(spark, "agreement")
        marked.select(*state.names, "_at").write.partitionBy("_at").parquet(path)
        for done in last:
            discard(spark, done)
        found = [name for name in folders(spark, path) if name.startswith("_at=")]
        last = [f"{path}/{name}" for name in found if name in ("_at=1", "_at=3")]
        settled += [f"{path}/{name}" for name in found if name in ("_at=0", "_at=2")]
        if not last:
            break
        even, pool = "_at=3" not in found, read(last)
    columns = candidates.columns
    both = _larger_margins(margins, block)
    final = _with_margins(read(settled).select(*columns, "_sure"), [both], block).repartition(tasks, *block)
    final = _best_met(final, block, choice, pk, want, traits, [[LAST_SEED + k for k in range(seeds)]], codes, not any(path.endswith("_at=2") for path in settled)).where("_run0")
    return final.select(*block, F.col("_best0.seed").alias("seed"), *[c for c in columns if c not in block], F.lit(1).alias("select_job"), F.col("_best0.fitness").alias("fitness"))


def jobs_from_margins(wide: DataFrame, block: str, total: str, stems: dict[str, str], seed: int) -> DataFrame:
    """One row per job whose trait margins equal the block's counts.

    For each trait the counted values are opened into rows, ordered at random
    inside the block and given to the block's jobs by number.  Where a trait has
    fewer values than jobs the rest stay null; surplus values are rows of their
    own, with job numbers beyond the block's total.
    """
    jobs = expand_rows(wide.select(block, total), total, "job")
    for i, (stem, name) in enumerate(stems.items()):
        values = wide.unpivot([block], stem_columns(wide, stem), "_code", "_n").filter("_n > 0")
        values = values.withColumn(name, F.regexp_replace("_code", f"^{stem}", "").cast("int")).drop("_code")
        opened = expand_rows(values, "_n", "_copy")
        ranked = random_rank(cut(opened, "values"), [block], [block, name, "_copy"], seed + i, out="job").select(block, "job", name)
        jobs = jobs.unionByName(ranked, allowMissingColumns=True)
    # A block and job has at most one value of each trait.
    return jobs.groupBy(block, "job").agg(*[F.max(name).alias(name) for name in stems.values()])


def repair_margins(jobs: DataFrame, pk: str, block: str, trait: str, expected: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Jobs whose ``trait`` meets the expected counts as far as both agree, and what is left over.

    ``expected`` has (block, code, n).  In each block the jobs beyond a code's
    count (in random order, and all with a null or unexpected code) are moved to
    the codes that lack jobs: surplus jobs are numbered through the codes, the
    missing ones too, and the k-th surplus job fills the k-th missing place, by
    the running totals alone.  The second table lists (block, code, gap) where
    counts still differ: positive where jobs are too many, negative where they
    lack.  Rows of a null block form one block.
    """
    code = F.col(trait).cast("string")
    made = jobs.groupBy(block, code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    wanted = expected.select(block, F.col("code").cast("string").alias("code"), "n")
    gaps = cut(made.select(block, "code", F.col("n").alias("have"), F.lit(0).cast("long").alias("want")).unionByName(
        wanted.select(block, "code", F.lit(0).cast("long").alias("have"), F.col("n").cast("long").alias("want"))).groupBy(block, "code").agg(
        F.sum("have").alias("have"), F.sum("want").alias("want")), "gaps")
    # A block has few codes; null is a code of surplus only.
    through = W.partitionBy(block).orderBy(F.col("code").asc_nulls_first())
    over, lack = F.greatest(F.col("have") - F.col("want"), F.lit(0)), F.greatest(F.col("want") - F.col("have"), F.lit(0))
    lined = gaps.withColumns({"_first": F.sum(over).over(through) - over, "_upto": F.sum(lack).over(through), "_lack": lack})
    open_places = lined.filter("_lack > 0").groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_upto", "code"))).alias("_places"))
    # Ranks are made once; the block's places travel with the code's start, so rows meet one table.
    ranked = cut(random_rank(jobs.withColumn("_code", code), [block, "_code"], pk, seed, out="_turn"), "turns")
    starts = lined.filter(over > 0).join(open_places.withColumnRenamed(block, "_b"), F.col(block).eqNullSafe(F.col("_b")), "left").select(
        F.col(block).alias("_b"), F.col("code").alias("_c"), "want", "_first", "_places")
    kept = attach(ranked, starts, [(block, "_b"), ("_code", "_c")])
    surplus = F.col("_first").isNotNull() & (F.col("_turn") > F.col("want"))
    moved = kept.withColumn("_k", F.when(surplus, F.col("_first") + F.col("_turn") - F.col("want")))
    place = F.try_element_at(F.filter("_places", lambda p: p["_upto"] >= F.col("_k")), F.lit(1))["code"]
    kind = jobs.schema[trait].dataType
    out = moved.withColumn(trait, F.when(F.col("_k").isNotNull() & place.isNotNull(), place.cast(kind)).otherwise(F.col(trait)))
    totals = lined.groupBy(block).agg(F.sum("_lack").alias("_holes"), F.max("_first").alias("_f"), F.sum(over).alias("_extra"))
    ends = lined.join(totals.withColumnRenamed(block, "_b"), F.col(block).eqNullSafe(F.col("_b"))).drop("_b")
    used = F.least("_holes", "_extra")
    left = over - F.greatest(F.least(used - F.col("_first"), over), F.lit(0))
    unfilled = lack - F.greatest(F.least(used - (F.col("_upto") - lack), lack), F.lit(0))
    report = ends.select(block, "code", (left - unfilled).alias("gap")).filter("gap <> 0")
    return out.select(*jobs.columns), report


def attach(rows: DataFrame, table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows with the columns of a table that has a key once; null matches null, hot keys are dealt out."""
    keys = [f"_j{i}" for i in range(len(pairs))]
    named = lambda df, side: df.withColumns({k: F.coalesce(F.concat(F.lit("v"), F.col(p[side]).cast("string")), F.lit("n")) for k, p in zip(keys, pairs)})
    return spread_join(named(rows, 0), named(table, 1).drop(*[p[1] for p in pairs]), keys, "left").drop(*keys)


def combine_segments(lists: DataFrame, block: str, ids: list[str], segment: str, segments: list[str], lead: str, seed: int) -> DataFrame:
    """Jobs present once in every segment, topped up to the size of the lead
    segment by a weighted draw from the others."""
    counts = lists.groupBy(block, *ids).agg(*[F.count(F.when(F.col(segment) == s, 1)).alias(f"_{s}") for s in segments])
    total = reduce(lambda a, b: a + b, [F.col(f"_{s}") for s in segments])
    scored = counts.withColumn("prob", total / F.lit(len(segments))).drop(*[f"_{s}" for s in segments])
    scored = cut(scored, "segments")
    kept = scored.filter("prob = 1")
    need = (lists.filter(F.col(segment) == lead).groupBy(block).agg(F.count(F.lit(1)).alias("_need"))
            .unionByName(kept.groupBy(block).agg((-F.count(F.lit(1))).alias("_need")))
            .groupBy(block).agg(F.sum("_need").alias("_need")))
    pool = spread_join(scored.filter("prob <> 1"), need, [block])
    keyed = pool.withColumn("_pk", F.concat_ws("|", *[F.col(c).cast("string") for c in (block, *ids)]))
    drawn = weighted_sample(keyed, [block], "_pk", "prob", "_need", seed).drop("_pk", "_need")
    return kept.unionByName(drawn)
