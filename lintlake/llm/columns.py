"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
NO_SPACE = r"[^ \t-\r]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words between white space as an array; of a null or empty text none."""
    return F.filter(F.split(text_of(text), SPACE), lambda part: part != "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda sum_, value: sum_ + value)


def boxed(table: DataFrame, **columns: Column | str) -> DataFrame:
    """The rows as one column `row`, beside the columns an operator works on.

    Whatever other columns the table has, their names cannot clash with an operator's own.
    """
    named = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"), *named)


def held_out(doc_id: str | Column) -> Column:
    """Whether a document belongs to the fold that no model is trained on."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def running(table: DataFrame, keys: list[str], part: str, order: list, amount: Column, name: str):
    """Add `name`: the sum of the amounts before each row in its line (`keys`, by part, order).

    A line that holds most rows is spread over its parts; one row per part is gathered.
    """
    sums = table.groupBy(*keys, part).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_{k}") for k in (*keys, part)],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, part)]
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = table.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return (
        inner.join(sums, same, "left")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_before", "_within", *[f"_{k}" for k in (*keys, part)])
    )


#: Rows of texts that an executor's JVM and Python hold at a time, for operators that store
#: what they read within the call.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(run: Callable) -> Callable:
    """Run an operator whose first argument is its table with small Arrow batches, so that
    what Spark and Python hold of the texts stays small beside what the work needs."""

    @wraps(run)
    def wrapped(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(_BATCH_SETTING)
        conf.set(_BATCH_SETTING, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            return run(docs, *args, **kwargs)
        finally:
            conf.set(_BATCH_SETTING, before)

    return wrapped
