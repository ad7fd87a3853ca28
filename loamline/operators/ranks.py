"""Order statistics and resampled sums of cells of any size.

A cell's values never meet in one task: equal ones are counted where they are, and what is sought is narrowed down in passes of counts by range
until so few different values are left that their order can be told."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_VALUES = 1 << 16  #: different values of a cell that are ordered in one task
SLOTS = 1024


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def _beside(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what ``cells`` has for their keys, null keys too."""
    own = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in cells.columns if c not in keys])
    return rows.join(own, _same(rows, own, keys)).drop(*[f"_{k}" for k in keys])


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the folder named in spark.checkpoint.dir; where it is unset, in one of our own on a local master, else an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loamline-"))
    return df.checkpoint()


def nth_values(rows: DataFrame, keys: list[str], value: Column, places: DataFrame, limit: int = CELL_VALUES) -> DataFrame:
    """(keys, _pick, _value, _within) for ``places`` (keys, _pick, _place): the value at a place, from 1, of a cell's values in order, and the
    place among the rows that have it. Nulls and what is no number take no place; a place beyond the last has no row."""
    counted = rows.select(*keys, value.alias("_value")).where(F.col("_value").isNotNull())
    if dict(counted.dtypes)["_value"] in ("double", "float"):
        counted = counted.where(~F.isnan("_value"))
    counted = counted.groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    whole = counted.groupBy(*keys).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.count("*").alias("_different"))
    sought = _beside(places.select(*keys, "_pick", F.col("_place").cast("long").alias("_place")), whole, keys)
    cell = Window.partitionBy(*keys, "_pick")
    if whole.where(F.col("_different") > limit).isEmpty():
        wide = False
    else:
        wide, sought = True, cut(sought)
    while wide:
        near = _beside(counted, sought, keys).where("_value BETWEEN _low AND _high")
        share = (F.col("_value").cast("double") - F.col("_low")) / F.nullif(F.col("_high").cast("double") - F.col("_low"), F.lit(0.0))
        slot = F.when(F.col("_different") > limit, F.least(F.floor(share * SLOTS), F.lit(SLOTS - 1))).otherwise(0)
        slot = F.when((F.col("_value") == F.col("_high")) & (F.col("_different") > limit), SLOTS).otherwise(F.coalesce(slot, F.lit(0)))
        sums = near.groupBy(*keys, "_pick", "_place", slot.alias("_slot")).agg(
            F.sum("_n").alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.count("*").alias("_different"))
        upto = sums.withColumn("_upto", F.sum("_n").over(cell.orderBy("_slot")))
        found = upto.where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_n")))
        sought = cut(found.select(*keys, "_pick", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place"), "_low", "_high", "_different"))
        wide = not sought.where(F.col("_different") > limit).isEmpty()
    near = _beside(counted, sought, keys).where("_value BETWEEN _low AND _high").withColumn("_upto", F.sum("_n").over(cell.orderBy("_value")))
    found = near.where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_n")))
    return found.select(*keys, "_pick", "_value", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_within"))


def medians(rows: DataFrame, keys: list[str], value: Column, name: str, limit: int = CELL_VALUES) -> DataFrame:
    """(keys, name): the middle value of each cell, of an even number the mean of both; cells without values have no row."""
    number = value.cast("double")
    sizes = rows.groupBy(*keys).agg(F.count_if(number.isNotNull() & ~F.isnan(number)).alias("_n"))
    middle = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    places = sizes.where("_n > 0").select(*keys, F.posexplode(middle).alias("_pick", "_place"))
    return nth_values(rows, keys, number, places, limit).groupBy(*keys).agg(F.avg("_value").alias(name))


def middle_rows(rows: DataFrame, keys: list[str], value: Column, tie: str, limit: int = CELL_VALUES) -> DataFrame:
    """The row in the middle of each cell by a value and then ``tie``, of an even number the upper one; of rows equal in both, any one."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    places = sizes.select(*keys, F.lit(0).alias("_pick"), (F.floor(F.col("_n") / 2) + 1).alias("_place"))
    own = rows.withColumn("_sought", value)
    found = nth_values(own, keys, F.col("_sought"), places, limit)
    level = _beside(own, found, keys).where(F.col("_sought") == F.col("_value")).drop("_pick", "_value")
    inner = found.select(*keys, "_pick", F.col("_within").alias("_place"))
    named = nth_values(level, keys, F.col(tie), inner, limit).select(*keys, F.col("_value").alias("_tie"))
    return _beside(level, named, keys).where(F.col(tie) == F.col("_tie")).dropDuplicates(keys).select(*rows.columns)


# -- resampling


ROW_BLOCK = 1 << 8  #: rows with a table of the sums of all their pairs, so that two draws are one random number of 16 bits and one look-up
ROWS_FROM = 4  #: drawing how often a different row is taken is as long as drawing about so many rows
FEW = 64  #: different rows whose counts are drawn one after the other
CLASS_ROWS, CLASS_RATE = 16, 10_000  #: rows with as many copies that a table is made for, and up to which mean count
DRAWN_AT_ONCE = 1 << 16


def weighted_sums(values: np.ndarray, counts: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums (draws x columns) of ``values`` (different rows x columns) over samples of so many draws each, with replacement, from rows that are there ``counts`` times.

    Rows of few copies are drawn one by one, of many copies by their counts. Independent Poisson counts are multinomial, given their sum: nearly all draws of a sample are made as such, with a mean low enough that
    their sum seldom passes the sample's size (then it is drawn anew), and the rest is drawn row by row: together that is multinomial, exactly."""
    if len(counts) > FEW and counts.sum() <= ROWS_FROM * len(counts):
        return _row_sums(np.repeat(values, counts.astype(np.int64), axis=0), draws, rng)
    least, total = float(draws.min()) if len(draws) else 0.0, counts.sum()
    mean = least - 4 * np.sqrt(least)
    if len(counts) <= FEW or mean <= 0:
        out, step = np.empty((len(draws), values.shape[1])), max(1, 2_000_000 // len(counts))
        for first in range(0, len(draws), step):
            out[first : first + step] = rng.multinomial(draws[first : first + step], counts / total) @ values
        return out
    sizes, classes = np.unique(counts, return_inverse=True)
    held = np.column_stack([values, np.ones(len(values))])  # the last sum is how many rows were drawn
    own = [(size * mean / total, held[classes == k]) for k, size in enumerate(sizes)]
    out, todo = np.empty((len(draws), held.shape[1])), np.arange(len(draws))
    while len(todo):
        out[todo] = _poisson_sums(own, len(todo), rng)
        todo = todo[out[todo, -1] > draws[todo]]
    _add_rows(out, values, counts.astype(np.int64), draws - out[:, -1].astype(np.int64), rng)
    return out[:, :-1]


def _row_sums(rows: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``weighted_sums`` of rows that are all as likely: how many draws fall in each block is multinomial, and within it each is drawn."""
    out = np.zeros((len(draws), rows.shape[1]))
    different = [len(np.unique(c)) for c in rows.T]
    rows = rows[np.lexsort(rows.T[np.argsort(different, kind="stable")[::-1]])]  # by the column of fewest values first, of which most blocks then have one
    for group, taken in _dealt(rows, draws, ROW_BLOCK * ROW_BLOCK, rng):
        for block, drawn in _dealt(group, taken, ROW_BLOCK, rng):
            _add_drawn(out, block, drawn, rng)
    return out


def _dealt(rows: np.ndarray, draws: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of ``rows``, each with how many of each sample's draws fall in it."""
    firsts = np.arange(0, len(rows), size)
    taken = rng.multinomial(draws, np.minimum(size, len(rows) - firsts) / len(rows))
    return ((rows[first : first + size], drawn) for first, drawn in zip(firsts, taken.T, strict=True))


def _add_drawn(out: np.ndarray, block: np.ndarray, drawn: np.ndarray, rng: np.random.Generator) -> None:
    """Add to each sample (row of ``out``) the sum of its ``drawn`` rows of a block, two by two and then the odd one."""
    fixed = (block == block[0]).all(axis=0)
    out[:, fixed] += drawn[:, None] * block[0, fixed]
    loose, n = np.flatnonzero(~fixed), len(block)
    tables = {c: np.add.outer(block[:, c], block[:, c]).ravel() for c in loose}
    pairs, step = drawn // 2, max(1, int(DRAWN_AT_ONCE // max(1.0, drawn.mean() / 2)))
    for first in range(0, len(drawn) if tables else 0, step):
        own = pairs[first : first + step]
        some, ends = np.flatnonzero(own), own.cumsum()
        if len(some):
            picked = _sixteen_bits(int(ends[-1]), rng) if n == ROW_BLOCK else rng.integers(0, n * n, int(ends[-1]))
            for c, table in tables.items():
                out[first + some, c] += np.add.reduceat(table.take(picked, mode="wrap"), (ends - own)[some])
    odd = np.flatnonzero(drawn % 2)
    last = rng.integers(0, n, len(odd))
    for c in tables:
        out[odd, c] += block[last, c]


def _sixteen_bits(size: int, rng: np.random.Generator) -> np.ndarray:
    return rng.bit_generator.random_raw(-(-size // 4)).view(np.uint16)[:size].astype(np.intp)


def _poisson_sums(classes: list[tuple[float, np.ndarray]], samples: int, rng: np.random.Generator) -> np.ndarray:
    """Sums (samples x columns) of rows taken Poisson many times, for classes (mean, rows)."""
    out = np.zeros((samples, classes[0][1].shape[1]))
    for rate, rows in classes:
        drawn = _poisson(rate, rng) if len(rows) >= CLASS_ROWS and rate <= CLASS_RATE else lambda n, rate=rate: rng.poisson(rate, n).astype(float)
        step = max(1, DRAWN_AT_ONCE // len(rows))
        for first in range(0, samples, step):
            n = min(step, samples - first)
            out[first : first + n] += drawn(n * len(rows)).reshape(n, len(rows)) @ rows
    return out


def _poisson(rate: float, rng: np.random.Generator) -> Callable[[int], np.ndarray]:
    """Draws Poisson numbers by inversion: 16 random bits tell nearly always which it is, and where a border lies between, more bits do."""
    low, high = max(0, int(rate - 12 * np.sqrt(rate)) - 30), int(rate + 12 * np.sqrt(rate)) + 30
    upto = np.cumsum([np.exp(k * np.log(rate) - rate - math.lgamma(k + 1)) for k in range(low, high + 1)])
    upto /= upto[-1]
    ends = np.searchsorted(upto, np.arange((1 << 16) + 1) / (1 << 16), side="right")
    table = np.where(ends[:-1] == ends[1:], ends[:-1] + low, -1).astype(float)

    def draw(n: int) -> np.ndarray:
        bits = _sixteen_bits(n, rng)
        out = table.take(bits, mode="wrap")
        open_ = np.flatnonzero(out < 0)
        out[open_] = np.minimum(np.searchsorted(upto, (bits[open_] + rng.random(len(open_))) / (1 << 16), side="right"), len(upto) - 1) + low
        return out

    return draw


def _add_rows(out: np.ndarray, values: np.ndarray, counts: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> None:
    """Add to each sample (row of ``out``) ``draws`` rows of ``values``, drawn one by one."""
    upto, total = counts.cumsum(), int(counts.sum())
    rows = np.repeat(np.arange(len(counts)), counts) if total <= 1 << 22 else None
    step = max(1, int(DRAWN_AT_ONCE // max(1.0, draws.mean())))
    for first in range(0, len(draws), step):
        own = draws[first : first + step]
        some, ends = np.flatnonzero(own), own.cumsum()
        if len(some):
            picked = rng.integers(0, total, int(ends[-1]))
            picked = np.searchsorted(upto, picked, side="right") if rows is None else rows[picked]
            for c in range(values.shape[1]):
                out[first + some, c] += np.add.reduceat(values[picked, c], (ends - own)[some])


def resampled_sums(rows: DataFrame, keys: list[str], columns: list[str], resamples: int, seed: int, limit: int = CELL_VALUES, *, cells: DataFrame | None = None) -> DataFrame:
    """(keys, _b, sums by column) of ``resamples`` samples with replacement of each cell, or of each of ``cells`` (keys), as many rows as it has.

    Equal rows are counted first. The different ones are dealt into parts of about ``limit``; how many draws each sample takes from each part is
    one multinomial draw per cell, and within a part they are spread over its rows by another: together that is one over all rows, and no task
    holds more than a part. Numbers follow from the seed and the keys alone."""
    kinds = dict(rows.dtypes)
    counted = rows.groupBy(*keys, *columns).agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.count("*") / limit).alias("_parts"))
    if cells is not None:
        sizes = _beside(sizes, cells, keys)
    dealt = _beside(counted, sizes, keys).withColumn("_part", F.pmod(F.xxhash64(*columns), F.col("_parts"))).drop("_parts")
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_total"))
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    cell_seed = F.xxhash64(F.lit(seed), *keys)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        rng, total = np.random.default_rng(int(pdf["_seed"].iloc[0]) & 0xFFFFFFFF), pdf["_total"].to_numpy()
        taken = rng.multinomial(total.sum(), total / total.sum(), resamples).T
        return pdf.drop(columns=["_total"]).assign(_draws=list(taken))

    draws = totals.withColumn("_seed", cell_seed).groupBy(*keys).applyInPandas(spread, f"{fields}, _part long, _seed long, _draws array<long>".lstrip(", "))

    def sums(values: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values(columns)
        rng = np.random.default_rng([int(own["_seed"].iloc[0]) & 0xFFFFFFFF, int(own["_part"].iloc[0])])
        out = weighted_sums(values[columns].to_numpy(float), values["_n"].to_numpy(float), np.asarray(own["_draws"].iloc[0]), rng)
        frame = pd.DataFrame(out, columns=columns).assign(_b=np.arange(len(out)))
        for k in keys:
            frame[k] = own[k].iloc[0]
        return frame[[*keys, "_b", *columns]]

    schema = f"{fields}, _b long, ".lstrip(", ") + ", ".join(f"`{c}` double" for c in columns)
    by = [*keys, "_part"]
    # a stated number of tasks: parts are few bytes and much work, so what is chosen by bytes would draw them all in one
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # several a core, as parts fall on tasks by hash
    dealt, draws = dealt.repartition(tasks, *by), draws.repartition(tasks, *by)
    parts = dealt.groupBy(*by).cogroup(draws.groupBy(*by)).applyInPandas(sums, schema)
    return parts.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in columns])


def intervals(sums: DataFrame, keys: list[str], statistic: Callable[[], Column]) -> DataFrame:
    """(keys, low, high): 2.5 % and 97.5 % of a statistic of resampled sums; where some are infinite, the value at or below the place."""
    value = sums.select(*keys, statistic().alias("_s"))
    exact = F.percentile("_s", [0.025, 0.975])
    lower = F.percentile_approx("_s", [0.025, 0.975], 1_000_000)  # as many as there are samples, so exact
    both = F.when(F.max("_s") == float("inf"), lower).otherwise(exact)
    return value.groupBy(*keys).agg(both.alias("_i")).select(*keys, F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"))
