"""Samples that match target category proportions: the cube method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.columns import null_safe_join, type_name
from strandloom.session import cut

EPS = 1e-9
#: Balance values of a stratum that meet at a time.
CHUNK = 64


def flight(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities ``p`` to 0 or 1 within ``a @ p = constant`` until no direction is left.

    Units come one by one. Those held so far have independent constraint columns, kept in reduced form; a unit whose column depends on theirs gives a direction in which the constraints
    don't change, and p moves to one of the two points where that line leaves the unit cube, with the odds that keep every unit's expectation. Whoever is decided leaves.
    """
    p = p.copy()
    reduced, held = np.eye(a.shape[0]), np.full(a.shape[0], -1)  # the column of the unit held by a row is that row's unit vector

    def hold(unit: int, y: np.ndarray, r: int) -> None:
        reduced[r] /= y[r]
        for other in np.flatnonzero(np.abs(y) > 1e-12):
            if other != r:
                reduced[other] -= y[other] * reduced[r]
        held[r] = unit

    for new in np.flatnonzero((p > EPS) & (p < 1 - EPS)):
        y = reduced @ a[:, new]
        free = np.flatnonzero((held < 0) & (np.abs(y) > 1e-8))
        if len(free):
            hold(new, y, free[np.abs(y[free]).argmax()])
            continue
        rows = np.flatnonzero((held >= 0) & (np.abs(y) > 1e-10))
        some, u = np.r_[held[rows], new], np.r_[-y[rows], 1.0]
        x = p[some]
        up = np.where(u > 0, (1 - x) / u, -x / u).min()
        down = np.where(u > 0, x / u, (x - 1) / u).min()
        x = x + up * u if rng.random() < down / (up + down) else x - down * u
        p[some] = x = np.clip(np.where(x < EPS, 0, np.where(x > 1 - EPS, 1, x)), 0, 1)
        gone = rows[(x[:-1] == 0) | (x[:-1] == 1)]
        held[gone] = -1
        if 0 < x[-1] < 1 and len(gone):
            hold(new, y, gone[np.abs(y[gone]).argmax()])
    return p


def land(p: np.ndarray, must: np.ndarray, wish: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides all units: flights under all constraints, then with one wish less each time, at last under ``must`` alone."""
    for n in range(len(wish), -1, -1):
        p = flight(p, np.vstack([must, wish[:n]]), rng)
    return (p > 0.5).astype(int)


@dataclass
class Drawn:
    """``cells``: the drawn units. ``report``: one row for each target row. ``balance``: residual imbalance by balancing value."""

    cells: DataFrame
    report: DataFrame
    balance: DataFrame


def balanced_sample(units: DataFrame, targets: DataFrame, unit: str = "cell_id", stratum: str = "sample_id", category: str = "main_cell_type", balance: str = "prep_batch", part_rows: int = 20_000, seed: int = 5) -> Drawn:
    """From each stratum a sample with ``max(round(target_share * sample_size), min_cells)`` units of each category, or all there are.

    ``units`` holds one row for each unit with its stratum, category and a column to balance on. Within a category all units have the same
    probability quota / available. The category counts are met exactly; the values of ``balance`` come out as close to their expectation as
    whole units allow, and what remains is reported.

    Flights: (1) the units of one stratum, category and balance value are exchangeable; in each hashed part of them (one for every ``part_rows`` units of the category) the flight's
    outcome is: of n units in random order the first floor(n p) are in, the next stays undecided with the rest of the probability, the others are
    out. So a category or stratum with a third of all rows is spread over many tasks, and a part hands on one unit at most.
    (2) What is left of a stratum, category and value meets, one unit of each part at most. (3) What is left of a stratum meets: at most one unit for each category
    and value; they fly under all constraints, then land. In a stratum with more than ``CHUNK`` balance values these first meet in chunks of so many neighbouring values, and what the chunks leave
    lands with a constraint for each chunk, so a task's work is bounded whatever the column holds. Random order is by hash with ``seed``: repeated runs give the same sample.

    Targets: null shares, minimums and sizes count as 0; names are compared in lower case with blanks and underscores alike; rows without stratum
    or category are ignored; of several rows for one category the largest wish holds. Units without category or stratum are never drawn; a null balance value is
    a value. Repeated units count once. Other columns are left out.
    """
    wanted = F.greatest(F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0))).cast("bigint"), F.coalesce("min_cells", F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    rows = targets.select(F.col(stratum).alias("stratum"), type_name(category).alias("category"), "target_share", "min_cells", "sample_size", wanted.alias("wanted")).where("stratum IS NOT NULL AND category IS NOT NULL")
    goal = rows.groupBy("stratum", "category").agg(F.max("wanted").alias("wanted"))
    pool = units.select(F.col(unit).alias("unit"), F.col(stratum).alias("stratum"), F.col(category).alias("category"), F.col(balance).cast("string").alias("value")).where("unit IS NOT NULL AND stratum IS NOT NULL AND category IS NOT NULL")
    pool = cut(pool.groupBy("unit", "stratum", "category").agg(F.min("value").alias("value")))
    stock = pool.groupBy("stratum", "category").agg(F.count("*").alias("available"))
    plan = cut(goal.join(stock, ["stratum", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("quota", F.least("wanted", "available")))

    inside = pool.join(plan.where("quota > 0").select("stratum", "category", (F.col("quota") / F.col("available")).alias("p"), F.ceil(F.col("available") / part_rows).alias("parts")), ["stratum", "category"])
    part = inside.withColumn("salt", F.pmod(F.xxhash64("unit", F.lit(seed + 1)), F.col("parts")))
    w = Window.partitionBy("stratum", "category", "value", "salt")
    first = part.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("unit", F.lit(seed)), "unit"))).withColumn("mass", F.count("*").over(w) * F.col("p"))
    whole = F.floor(F.col("mass") + EPS)
    part_of_one = F.col("mass") - whole
    first = first.withColumn("p", F.when(F.col("r") <= whole, 1.0).when((F.col("r") == whole + 1) & (part_of_one > EPS), part_of_one).otherwise(0.0))
    first = cut(first.where("p > 0").select("stratum", "category", "value", "unit", "p"))
    sure = first.where("p = 1").select("stratum", "category", "value", "unit")

    def rng_of(*key) -> np.random.Generator:
        return np.random.default_rng([seed, *"|".join(map(str, key)).encode()])

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        pdf["p"] = flight(pdf["p"].to_numpy(), np.ones((1, len(pdf))), rng_of(*key))
        return pdf[pdf["p"] > EPS]

    def flags(c: pd.Series) -> np.ndarray:
        return (c.fillna("\0").to_numpy()[None, :] == np.sort(c.fillna("\0").unique())[:, None]).astype(float)

    def within_chunk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        pdf["p"] = flight(pdf["p"].to_numpy(), np.vstack([flags(pdf["category"]), flags(pdf["value"])]), rng_of(*key))
        return pdf[pdf["p"] > EPS]

    def decide(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        wish = pdf["value"] if pdf["chunk"].nunique() == 1 else pdf["chunk"].astype(str)
        pdf["p"] = land(pdf["p"].to_numpy(), flags(pdf["category"]), flags(wish), rng_of(*key)).astype(float)
        return pdf[pdf["p"] > 0].drop(columns="chunk")

    tasks = 4 * units.sparkSession.sparkContext.defaultParallelism  # so many, however few bytes they get: the work is in the flights
    kind = "stratum string, category string, value string, unit string, p double"
    rest = first.where("p < 1").select("stratum", "category", "value", "unit", "p").withColumn("__n", F.count("*").over(Window.partitionBy("stratum", "category", "value")))
    several = rest.where("__n > 1").drop("__n").groupBy("stratum", "category", "value").applyInPandas(meet, kind)
    met = cut(rest.where("__n = 1").drop("__n").unionAll(several))
    number = F.dense_rank().over(Window.partitionBy("stratum").orderBy("value")) - 1
    left = met.where("p < 1 - 1e-9").withColumn("chunk", F.floor(number / CHUNK).cast("int")).withColumn("__chunks", F.max("chunk").over(Window.partitionBy("stratum")))
    chunked = left.where("__chunks > 0").drop("__chunks").repartition(tasks, "stratum", "chunk").groupBy("stratum", "chunk").applyInPandas(within_chunk, kind + ", chunk int")
    left = cut(left.where("__chunks = 0").drop("__chunks").unionAll(chunked))
    flown = left.where("p >= 1 - 1e-9").select(*sure.columns)
    landed = left.where("p < 1 - 1e-9").repartition(tasks, "stratum").groupBy("stratum").applyInPandas(decide, kind)
    cells = cut(sure.unionAll(met.where("p >= 1 - 1e-9").select(*sure.columns)).unionAll(flown).unionAll(landed.select(*sure.columns)))

    got = cells.groupBy("stratum", "category").agg(F.count("*").alias("drawn"))
    about = plan.drop("wanted").join(got, ["stratum", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    total = about.groupBy("stratum").agg(F.sum("drawn").alias("drawn_total"))
    report = rows.join(about, ["stratum", "category"]).join(total, "stratum").select(
        F.col("stratum").alias(stratum), F.col("category").alias(category), "target_share", "sample_size", "wanted", "available", "drawn",
        F.when(F.col("drawn_total") > 0, F.col("drawn") / F.col("drawn_total")).otherwise(0.0).alias("drawn_share"),
        (F.col("wanted") - F.col("drawn")).alias("missing"),
    )
    hoped = inside.groupBy("stratum", "value").agg(F.sum("p").alias("expected"))
    in_fact = cells.groupBy("stratum", "value").agg(F.count("*").alias("drawn"))
    residual = null_safe_join(hoped, in_fact, ["stratum", "value"], "left").select(F.col("stratum").alias(stratum), F.col("value").alias(balance), "expected", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    residual = residual.withColumn("residual", F.col("drawn") - F.col("expected"))
    return Drawn(cells.select(F.col("stratum").alias(stratum), F.col("category").alias(category), F.col("value").alias(balance), F.col("unit").alias(unit)), report, residual)
