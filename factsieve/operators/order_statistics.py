"""Exact percentiles in two passes over the values, the same way at every size.

The first pass takes a bounded sketch of each column (``percentile_approx``) and from it, for
every wanted level, two values that enclose its rank with a margin of several times the
sketch's error. The second pass counts rows: values inside a bracket one by one, all others by
the gap between brackets they fall in, with the gap's extremes. Running totals over these counts
place every rank exactly; that the sketch varies between runs does not change the result.

A bracket holds at most ``BRACKET_SHARE`` of the rows (more only where they are equal, and
equal values are one count), so no task ever sorts a larger share of a group's values.
Counts are added up before the shuffle, so a hot group or value costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.operators.attach import attach, known_keys, scalar_row

# Error of the sketch as a share of the rows; its buffer has about so many entries.
ACCURACY = 50_000
MARGIN = 4 / ACCURACY
BRACKET_SHARE = 2 * MARGIN + 4 / ACCURACY

# Stored sketches: their size parameter, the rank error that holds in 99 % of cases (as their library
# states it), and a margin of several times that. A sketch of fewer values than its size is exact.
STORED_SIZE = 65_535
STORED_ERROR = 2.296 / STORED_SIZE**0.9021
STORED_MARGIN = 4 * STORED_ERROR


def before(keys: list[str], order: str, count: str = "_n") -> str:
    """Running total of a count over the rows ahead of this one."""
    within = f"PARTITION BY {', '.join(quoted(keys))} " if keys else ""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum({count}) OVER ({within}ORDER BY {order} {frame}), 0L)"


def quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def measured(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Group keys and the value as double ``_v``, without missing ones."""
    rows = known_keys(df, by).select(*by, F.col(value).cast("double").alias("_v"))
    return rows.filter("_v IS NOT NULL AND NOT isnan(_v)")


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    kind: str = "interpolated",
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Exact percentiles of one column, one output column per entry of ``probs``.

    ``kind='discrete'`` returns the first value whose rank reaches ``p * n`` (SQL
    ``percentile_disc``); ``'interpolated'`` returns the linear blend of the two values
    around ``p * (n - 1)``. NULL and NaN values, and NULL group keys, are left out. With stored
    ``sketches`` by group (and part) the rows are read once, for the counting pass.
    """
    by = list(by or [])
    levels = sorted(set(probs.values()))
    rows = measured(df, value, by)
    if sketches is None:
        brackets = rows.groupBy(*by).agg(F.expr(f"{_sketch('_v', levels)} AS _ends"))
    else:
        brackets = known_keys(sketches, by).groupBy(*by).agg(F.expr(f"{_stored_ends(value, levels)} AS _ends"))
    placed = attach(rows, brackets, by).selectExpr(*quoted(by), "_v", f"{_place('_v', '_ends', levels)} AS _at")
    counts = placed.groupBy(*by, "_at._gap", "_at._own").agg(*_counts())
    return _pick(counts, by, probs, kind)


def part_sketches(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One row per part (a day, a load, a group) with a mergeable sketch of every column, to be stored.

    Appended data adds rows for its own parts. Percentiles that are given the stored sketches
    take their brackets from the merged ones, and read the values only to count them.
    """
    values = [F.expr(f"nanvl(CAST(`{c}` AS DOUBLE), NULL)") for c in columns]
    return df.groupBy(*parts).agg(
        *[F.kll_sketch_agg_double(v, F.lit(STORED_SIZE)).alias(c) for v, c in zip(values, columns)]
    )


def column_quantiles(
    df: DataFrame, wanted: dict[str, tuple[str, float]], kind: str, sketches: DataFrame | None = None
) -> DataFrame:
    """Percentiles of several columns in the same two passes: one row, one column per name.

    ``wanted`` maps an output name to ``(column, p)``. The first pass is one aggregate row;
    the second counts the places of all columns in one grouping.
    """
    columns: dict[str, list[float]] = {}
    for column, p in wanted.values():
        columns.setdefault(column, []).append(p)
    columns = {column: sorted(set(levels)) for column, levels in sorted(columns.items())}
    names = {column: f"c{i}" for i, column in enumerate(columns)}
    values = df.selectExpr(*[f"nanvl(CAST(`{c}` AS DOUBLE), NULL) AS {name}" for c, name in names.items()])
    if sketches is None:
        ends = values.agg(*[F.expr(f"{_sketch(names[c], levels)} AS {names[c]}") for c, levels in columns.items()])
    else:
        ends = sketches.agg(*[F.expr(f"{_stored_ends(c, levels)} AS {names[c]}") for c, levels in columns.items()])
    held = values.withColumn("_ends", scalar_row(ends))
    places = ", ".join(
        f"named_struct('_column', '{names[c]}', '_v', {names[c]}, '_at', {_place(names[c], f'_ends.{names[c]}', levels)})"
        for c, levels in columns.items()
    )
    stacked = held.selectExpr(f"inline(array({places}))").filter("_v IS NOT NULL")
    counts = stacked.groupBy("_column", "_at._gap", "_at._own").agg(*_counts())
    every = {f"p{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    level_name = {p: name for name, p in every.items()}
    own_levels = {names[c]: levels for c, levels in columns.items()}
    found = _pick(counts, ["_column"], every, kind, own_levels)
    return found.agg(
        *[
            F.expr(f"max(CASE WHEN _column = '{names[column]}' THEN {level_name[p]} END) AS `{name}`")
            for name, (column, p) in wanted.items()
        ]
    )


def _counts() -> list[Column]:
    return [F.expr("count(*) AS _n"), F.expr("min(_v) AS _low"), F.expr("max(_v) AS _high")]


def _ends(levels: list[float], margin: float) -> str:
    """The ranks of all brackets' ends: two per level, in the order of the levels."""
    return ", ".join(f"{min(max(p + side, 0.0), 1.0)!r}D" for p in levels for side in (-margin, margin))


def _sketch(value: str, levels: list[float]) -> str:
    return f"percentile_approx({value}, array({_ends(levels, MARGIN)}), {ACCURACY})"


def _stored_ends(column: str, levels: list[float]) -> str:
    merged = f"kll_merge_agg_double(`{column}`, {STORED_SIZE})"
    found = f"kll_sketch_get_quantile_double({merged}, array({_ends(levels, STORED_MARGIN)}))"
    return f"CASE WHEN kll_sketch_get_n_double({merged}) > 0 THEN {found} END"


def _place(value: str, ends: str, levels: list[float]) -> str:
    """Between which ends a value lies, and the value itself where that is inside a bracket."""
    entered = " + ".join(f"CAST({value} >= {ends}[{2 * i}] AS INT)" for i in range(len(levels)))
    left = " + ".join(f"CAST({value} > {ends}[{2 * i + 1}] AS INT)" for i in range(len(levels)))
    own = f"CASE WHEN {entered} > {left} THEN {value} END"
    return f"named_struct('_gap', {entered} + {left}, '_own', {own})"


def _ranks(probs: dict[str, float], kind: str) -> dict[str, tuple[str, float]]:
    """1-based ranks each percentile needs, by a name of their own, with the level."""
    ranks: dict[str, tuple[str, float]] = {}
    for name, p in probs.items():
        if kind == "discrete":
            ranks[f"{name}_at"] = f"greatest(ceil({float(p)!r}D * _total), 1L)", p
        else:
            ranks[f"{name}_at"] = f"floor((_total - 1) * {float(p)!r}D) + 1", p
            ranks[f"{name}_next"] = f"ceil((_total - 1) * {float(p)!r}D) + 1", p
    return ranks


def _pick(
    counts: DataFrame,
    by: list[str],
    probs: dict[str, float],
    kind: str,
    own_levels: dict[str, list[float]] | None = None,
) -> DataFrame:
    """The values at the wanted ranks, from counts in value order.

    A rank falls on a value of a bracket, or is the first or last of a gap. Any other place would
    mean that a sketch was worse than it promises; that is an error, not a wrong result.
    """
    keys = quoted(by)
    whole = f"sum(_n) OVER ({'PARTITION BY ' + ', '.join(keys) if keys else ''}) AS _total"
    ordered = counts.selectExpr("*", f"{before(by, '_gap, _own')} AS _start", whole)
    picked = []
    for name, (rank, p) in _ranks(probs, kind).items():
        miss = "raise_error('a percentile lies outside its bracket')"
        if own_levels is not None:  # levels that only other columns want may fall anywhere
            wanted = ", ".join(f"'{c}'" for c, levels in own_levels.items() if p in levels)
            miss = f"CASE WHEN _column IN ({wanted}) THEN CAST({miss} AS DOUBLE) END"
        value = (
            f"CASE WHEN {rank} <= _start OR {rank} > _start + _n THEN NULL WHEN _own IS NOT NULL THEN _own "
            f"WHEN {rank} = _start + 1 THEN _low WHEN {rank} = _start + _n THEN _high ELSE CAST({miss} AS DOUBLE) END"
        )
        picked.append(F.expr(f"max({value}) AS `{name}`"))
    found = ordered.groupBy(*by).agg(*picked, F.expr("max(_total) AS _total"))
    return found.selectExpr(*keys, *[_blend(name, p, kind) for name, p in probs.items()])


def _blend(name: str, p: float, kind: str) -> str:
    low, high = f"`{name}_at`", f"`{name}_next`"
    if kind == "discrete":
        return f"{low} AS `{name}`"
    place = f"(_total - 1) * {float(p)!r}D"
    share = f"({place} - floor({place}))"
    return (
        f"CASE WHEN {share} < 0.5D THEN {low} + ({high} - {low}) * {share} "
        f"ELSE {high} - ({high} - {low}) * (1D - {share}) END AS `{name}`"
    )
