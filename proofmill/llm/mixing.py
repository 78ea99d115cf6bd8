"""Mixing sources to target weights by iterative proportional fitting (operator 3, DataFrame only).

Documents are counted once into cells (source, language, topic) with their
tokens.  Raking multiplies the cells' weights by target / actual share of each
margin in turn until all margins agree within TOLERANCE, however many sweeps
that takes; sums are partial before they are shuffled, and cells are few against
documents.  Targets that no weights meet (margins that contradict each other
where cells are empty) end when a sweep moves at most STILL of all tokens: a
warning says so, and the column `residual` holds the largest relative distance
of a factor from one.

Probabilities are calibrated to a budget: a document is sampled with
min(1, scale x weight of its cell), and the scale is the one at which the
expected tokens are SHARE of all, so no single rare cell sets how much is kept.
The draw is a hash of the id, so a rerun or another partitioning picks the same
rows.

The topic is the column `topic` where the documents have one; else a coarse kind
of text made from the text itself (`topic_of`).

Defined cases: nulls in a margin column are the value "(none)"; null and empty
texts have no tokens and take their cell's weight; repeated rows are decided
alike; a null id is decided by the text; cells whose target is zero get weight
zero; other columns, whatever their names, are ignored by `mixing_weights` and
kept by `sample_mix`; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import whole_row, written

TOLERANCE = 1e-4
#: Part of all tokens that a sweep moves at most once the weights have come to rest.
STILL = 1e-6
SWEEPS_A_WRITE = 4
#: Part of all tokens that the sample is expected to hold.
SHARE = 0.75
#: Target shares are the token shares to this power, made to add up to one.
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.9}
BROADCAST_CELLS = 50_000
NONE = "(none)"


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\t-\r ]+"), ""))


def topic_of(text: Column) -> Column:
    """A coarse kind of text that the corpus gives no column for."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) == 0, "empty")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("License")) | F.contains(t, F.lit("license")), "legal")
        .when(F.contains(t, F.lit("!!")) | F.contains(t, F.lit("$$$")), "noise")
        .when(F.length(t) < 1000, "short")
        .when(F.length(t) < 6000, "medium")
        .otherwise("long")
    )


def _cells(docs: DataFrame, dims: dict[str, Column], text_col: str) -> DataFrame:
    keyed = docs.select(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"_{d}") for d, c in dims.items()], token_count(F.col(text_col)).alias("_n"))
    return keyed.groupBy(*[f"_{d}" for d in dims]).agg(F.sum("_n").cast("double").alias("mass")).withColumn("weight", F.lit(1.0))


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target tokens of each value of a margin; they add up to all tokens."""
    margin = cells.groupBy(f"_{dim}").agg(F.sum("mass").alias("m"))
    powered = F.when(F.col("m") > 0, F.pow("m", F.lit(power))).otherwise(0.0)
    sums = margin.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("all"), F.coalesce(F.sum(powered), F.lit(0.0)).alias("powers")).first()
    return margin.select(f"_{dim}", (powered * (sums["all"] / (sums["powers"] or 1.0))).alias("target"))


def _swept(cells: DataFrame, dims: list[str], n: int, small: bool) -> DataFrame:
    """cells after n sweeps; of each sweep i its weights w<i>, largest distance of a factor from one off<i>, and the mass moved<i>."""
    for i in range(1, n + 1):
        cells = cells.withColumn("before", F.col("weight"))
        for dim in dims:
            moved = F.sum(F.col("mass") * F.col("weight"))
            if small:
                cells = cells.withColumn("actual", moved.over(Window.partitionBy(f"_{dim}")))
            else:
                cells = cells.drop("actual").join(cells.groupBy(f"_{dim}").agg(moved.alias("actual")), f"_{dim}")
            cells = cells.withColumn(f"f_{dim}", F.when(F.col("actual") > 0, F.col(f"goal_{dim}") / F.col("actual")).otherwise(1.0)).withColumn("weight", F.col("weight") * F.col(f"f_{dim}"))
        off = [F.abs(F.col(f"f_{d}") - 1) * (F.col("weight") > 0).cast("int") for d in dims]
        cells = cells.withColumns({f"w{i}": F.col("weight"), f"off{i}": F.greatest(*off) if len(off) > 1 else off[0], f"moved{i}": F.col("mass") * F.abs(F.col("weight") - F.col("before"))})
    return cells.drop("before", "actual", *[f"f_{d}" for d in dims])


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int | None = None, tolerance: float = TOLERANCE, still: float = STILL) -> tuple[DataFrame, float]:
    """Cells with the weights that bring every margin to its target (a table of value and target tokens), and what is left.

    Sweeps go on until every factor is within tolerance of one, or until a sweep
    moves no more than `still` of all tokens: then no weights meet the targets,
    and a warning says how far off they stay.
    """
    dims, columns = list(targets), cells.columns
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    for dim, target in targets.items():
        cells = cells.join(target.select(f"_{dim}", F.col("target").alias(f"goal_{dim}")), f"_{dim}", "left").fillna(0.0, [f"goal_{dim}"])
    # A small table is one partition: its sweeps are windows without a shuffle.  A large one sums its margins before it shuffles them.
    placed = lambda df: df.coalesce(1) if small else df
    cells = written(placed(cells))
    mass, done = cells.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0], 0
    worst = 0.0
    while sweeps is None or done < sweeps:
        n = SWEEPS_A_WRITE if sweeps is None else min(SWEEPS_A_WRITE, sweeps - done)
        after = written(_swept(placed(cells), dims, n, small))
        seen = after.agg(*[F.coalesce(F.max(f"off{i}"), F.lit(0.0)) for i in range(1, n + 1)], *[F.coalesce(F.sum(f"moved{i}"), F.lit(0.0)) for i in range(1, n + 1)]).first()
        for i in range(1, n + 1):
            worst, done, rests = seen[i - 1], done + 1, seen[n + i - 1] <= still * mass
            if worst <= tolerance or rests:
                break
        cells = after.select(*[c for c in cells.columns if c != "weight"], F.col(f"w{i}").alias("weight"))
        if worst <= tolerance or rests:
            break
    if worst > tolerance:
        warnings.warn(f"raking has not met its targets after {done} sweeps: a factor is still {worst:.3g} from one", stacklevel=2)
    return cells.select(*columns), worst


def sampling_scale(cells: DataFrame, share: float) -> float | None:
    """The scale at which the mass of min(1, scale x weight) is `share` of all mass; None where every weight must count in full.

    With the m largest weights capped, the expected mass is a line in the scale,
    and the least of these lines is the true one: the scale is the largest of
    those at which the lines reach the budget.
    """
    level = F.floor(F.log2("weight") * 64).cast("int")
    kept = cells.filter("weight > 0 and mass > 0").select(level.alias("level"), "weight", "mass", (F.col("mass") * F.col("weight")).alias("moved"))
    found = sorted(((r.level, r.m, r.w) for r in kept.groupBy("level").agg(F.sum("mass").alias("m"), F.sum("moved").alias("w")).collect()), reverse=True)  # some thousand levels at most
    budget = share * (cells.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0])
    if not found or sum(m for _, m, _ in found) <= budget:
        return None
    levels, m, w = (np.array(x) for x in zip(*found, strict=True))
    above = cells.sparkSession.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(levels, np.cumsum(m) - m, np.cumsum(w) - w, strict=True)], "level int, m0 double, w0 double")
    order = Window.partitionBy("level").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = kept.withColumns({"m1": F.sum("mass").over(order), "w1": F.sum("moved").over(order)}).join(F.broadcast(above), "level")
    left = float(w.sum()) - F.col("w0") - F.col("w1")
    scale = capped.filter(left > 1e-9 * float(w.sum())).agg(F.max((F.lit(budget) - F.col("m0") - F.col("m1")) / left)).first()[0]
    return max(budget / float(w.sum()), scale if scale is not None else 0.0)


def _probabilities(docs: DataFrame, dims: dict[str, Column], text_col: str, targets: dict[str, DataFrame] | None, temper: dict[str, float], share: float) -> DataFrame:
    cells = written(_cells(docs, dims, text_col))
    goals = targets or {d: tempered_targets(cells, d, temper.get(d, 1.0)) for d in dims}
    raked, residual = rake(cells, {d: written(g) for d, g in goals.items()})
    scale = sampling_scale(raked, share)
    chance = F.least(F.lit(1.0), F.col("weight") * scale) if scale is not None else (F.col("weight") > 0).cast("double")
    table = raked.select(*[F.col(f"_{d}").alias(f"_cell_{d}") for d in dims], "weight", chance.alias("probability"), F.lit(residual).alias("residual"))
    return F.broadcast(table) if table.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else table


def _dims(docs: DataFrame, columns: dict[str, Column] | None, text_col: str) -> dict[str, Column]:
    return columns or {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic") if "topic" in docs.columns else topic_of(F.col(text_col))}


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the seed and the id alone (on the text where there is no id): 48 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _decided(docs: DataFrame, dims: dict[str, Column] | None, id_col: str, text_col: str, targets: dict[str, DataFrame] | None, temper: dict[str, float], share: float, seed: int, kept: dict[str, Column]) -> DataFrame:
    """The kept columns of each row with its cell, weight, probability and draw."""
    dims = _dims(docs, dims, text_col)
    table = _probabilities(docs, dims, text_col, targets, temper, share)
    rows = docs.select(*[c.alias(name) for name, c in kept.items()], *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"_cell_{d}") for d, c in dims.items()], _draw(id_col, text_col, seed).alias("_draw"))
    return rows.join(table, [f"_cell_{d}" for d in dims])


def mixing_weights(docs: DataFrame, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, share: float = SHARE, seed: int = 1) -> DataFrame:
    """One row for each input row: its margins, tokens, weight, probability, whether it is sampled, and the raking's residual."""
    rows = _decided(docs, dims, id_col, text_col, targets, temper, share, seed, {"_id": F.col(id_col), "_tokens": token_count(F.col(text_col)).cast("long")})
    margins = [c.removeprefix("_cell_") for c in rows.columns if c.startswith("_cell_")]
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_cell_{d}").alias(d) for d in margins], F.col("_tokens").alias("n_tokens"), "weight", "probability", (F.col("_draw") < F.col("probability")).alias("sampled"), "residual")


def sample_mix(docs: DataFrame, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, share: float = SHARE, seed: int = 1) -> DataFrame:
    """The sampled rows of docs, all columns as they are."""
    rows = _decided(docs, dims, id_col, text_col, targets, temper, share, seed, {"_row": whole_row(docs)})
    return rows.filter(F.col("_draw") < F.col("probability")).select("_row.*")
