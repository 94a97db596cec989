"""Column expressions and grouped kernels that the feature families share. Missing is NULL, never NaN."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

KEY = "cookie_id"
ORDER = ("event_ts", "event_id")


def by_time() -> Window:
    return Window.partitionBy(KEY).orderBy(*ORDER)


def ref(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds of a time stamp since 1970; one without zone is taken as it stands, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_timestamp(column)
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(`{column}` AS TIMESTAMP_NTZ))")


def number_of(df: DataFrame, column: str) -> Column:
    """A whole number that stands for a value: itself, or the 64-bit hash of what is no whole number."""
    return ref(column).cast("long") if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(ref(column))


def share(of: Column) -> Column:
    """How often ``of`` holds, among the rows where it is known."""
    return F.avg(of.cast("double"))


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    a, b = (F.expr(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def summarise(df: DataFrame, facts: dict[str, str], key: str = KEY) -> DataFrame:
    """One row per key; ``facts`` are SQL aggregates by name."""
    return df.groupBy(key).agg(*(F.expr(e).alias(n) for n, e in facts.items()))


def derive(df: DataFrame, facts: dict[str, str | Column], keep: Iterable[str] = ()) -> DataFrame:
    return df.select(KEY, *keep, *((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in facts.items()))


def value_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per visitor and named expression: distinct values ``_u``, rows ``_n``, entropy in nats ``_h``, the top value's rows ``_top``.

    All expressions share one aggregation by (visitor, expression, value); unknown values do not count.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.expr(e).cast("string").alias("v")) for i, e in enumerate(columns.values())))).alias("x")
    counts = df.select(KEY, each).select(KEY, "x.*").where("v IS NOT NULL").groupBy(KEY, "i", "v").agg(F.count("*").alias("c"))
    facts = []
    for i, name in enumerate(columns):
        c = f"CASE WHEN i = {i} THEN c END"
        facts += [f"count({c}) AS {name}_u", f"coalesce(sum({c}), 0) AS {name}_n", f"ln(sum({c})) - sum({c} * ln({c})) / sum({c}) AS {name}_h", f"max({c}) AS {name}_top"]
    return counts.groupBy(KEY).agg(*(F.expr(f) for f in facts))


def corr(x: str, y: str, where: str = "TRUE") -> Column:
    """Pearson's correlation from sums; NULL for under 3 pairs or a constant side."""
    ok = f"({where}) AND {x} IS NOT NULL AND {y} IS NOT NULL"
    n, sx, sy, sxx, syy, sxy = (F.expr(f"sum(CASE WHEN {ok} THEN double({e}) END)") for e in ("1", x, y, f"{x}*{x}", f"{y}*{y}", f"{x}*{y}"))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when((n > 2) & (spread > 1e-9), (n * sxy - sx * sy) / F.sqrt(spread))


def rounded(x: str | Column, digits: int) -> Column:
    """A double rounded as DuckDB and C round it: scaled in binary first, halves away from zero.

    Spark's ``round`` takes the shortest decimal that stands for the double, so 0.0653125, which lies a hair below that
    number, would go up.
    """
    x = ref(x) if isinstance(x, str) else x
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def beside(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; ``right`` has the keys and new columns."""
    names = {k: f"_of_{i}" for i, k in enumerate(keys)}
    same = [ref(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def running(df: DataFrame, value: str | tuple[str, ...], sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, pieces: int | None = None) -> DataFrame:
    """``df`` with running sums over all rows of its ``by`` in the order of ``value``, which is distinct there.

    NULL stands first, or last if descending, and NaN above infinity, as Spark sorts; a NULL in ``by`` is a group.

    A range sort deals the rows out in pieces of about equal numbers, whatever their values, and is written, as another
    run might cut elsewhere. Sums of the pieces, a row for each (``by``, piece), tell what lies before each, and only
    within a piece a window is taken. So no task holds all the rows of a group.
    """
    keys, values = list(by), [value] if isinstance(value, str) else list(value)
    order = [F.desc(ref(v)) if descending else F.asc(ref(v)) for v in values]
    dealt = [*(ref(k) for k in keys), *order]
    rows = df.repartitionByRange(pieces, *dealt) if pieces else df.repartitionByRange(*dealt)
    rows = written(rows.withColumn("_piece", F.spark_partition_id()), "running")
    told = rows.groupBy(*keys, "_piece").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # rows are pieces
    told = told.select(*keys, "_piece", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = beside(rows, told, [*keys, "_piece"]).withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop("_piece", *(f"_before_{n}" for n in sums))


def percent_ranks(df: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the average rank of ``value`` over the group's size, ties sharing their mean rank; NULL for NULL.

    NaN is the greatest value, above infinity.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    told = running(counts, value, {"_upto": "_c"}, by)
    total = told.groupBy(*by).agg(F.sum("_c").alias("_n"))
    told = (beside(told, total, by) if by else told.join(F.broadcast(total))).select(*by, value, ((F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2) / F.col("_n")).alias(name))
    return beside(df, told, [*by, value], "left")


def runs(df: DataFrame, flag: str, keep: str = "flag") -> DataFrame:
    """Lengths of runs of rows for which ``flag`` holds, per visitor in time order: gaps and islands."""
    marked = df.withColumn("flag", F.coalesce(F.expr(flag), F.lit(False)))
    island = F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("island", island).where("flag").groupBy(KEY, "island").agg(F.count("*").alias("n"))


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """``merge`` of many wide tables as one statement, so that their columns are resolved once and not at every join."""
    spark, names = first.sparkSession, [f"_table_{uuid.uuid4().hex}" for _ in (first, *others)]
    try:
        for name, table in zip(names, (first, *others)):
            table.createOrReplaceTempView(name)
        return spark.sql(f"SELECT * FROM {names[0]}" + "".join(f" LEFT JOIN {n} USING ({KEY})" for n in names[1:]))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Left join of small per-visitor results."""
    for other in others:
        first = first.join(other, KEY, "left")
    return first
