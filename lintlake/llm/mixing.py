"""Mix sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words. Slot i lies at a point of the golden-ratio
sequence, which cumulative target shares map to a source; so every stretch of the mix has the
shares nearly. A source's documents, shuffled by a hash, are laid end to end and cut into
blocks of a slot's size, as often over as its target asks; the n-th slot of a source takes its
n-th block. Long lines are numbered in parts: a part's sums first, then the rows within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.columns import running, text_of, words_of
from lintlake.sources.store import keep, release

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
REPEATS = 2  # how often a source may be taken at most
SLOT_WORDS = 1024
_GOLDEN = 0.6180339887498949
_PARTS = 4096
_RUN = 65536


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last. A target is the source's share
    by weight, at most `repeats` times its size, and what is over is shared again by weight.
    That is one level for all that are not cut: sorted by the level at which each is cut, the
    first that a level of all from there on does not reach settles it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    most = (F.col("source_size") * repeats).cast("double")
    weighed = sources.withColumns(
        {"weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), turn), "most": most}
    )
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))
    level = left / F.sum("weight").over(ahead)
    levels = weighed.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    # From the first that holds on levels only fall, so it is the largest of those that hold.
    settled = levels.withColumn("level", F.max(reached).over(everything))
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.lit(0.0))
    return settled.select("source", F.col("source_size").cast("bigint"), target.alias("target"))


def schedule(wanted: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(position, source, block): which block of which source each slot of the mix takes.

    `wanted` has source and target. As many slots as all targets need are dealt out; a source
    that the sequence leaves a few short gets its last blocks at the end of the mix.
    """
    spark = wanted.sparkSession
    blocks = F.ceil(F.round("target") / slot_words)
    counts = wanted.select("source", blocks.alias("blocks")).where("blocks > 0")
    slots, n_sources = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shares = counts.withColumn("upto", upto / F.lit(max(slots, 1))).withColumn(
        "from", (F.col("upto") - F.col("blocks") / F.lit(max(slots, 1)))
    )
    first, last = F.floor(F.col("from") * _PARTS), F.floor(F.least("upto", F.lit(0.9999999)) * _PARTS)
    cells = shares.withColumn("cell", F.explode(F.sequence(first, last)))
    point = F.pmod((F.col("id") + 1) * F.lit(_GOLDEN), F.lit(1.0))
    dealt = (
        spark.range(slots)
        .withColumn("point", point)
        .withColumn("cell", F.floor(F.col("point") * _PARTS))
        .join(cells, "cell")
        .where("point >= from AND point < upto")
        .select("id", "source", "blocks", F.floor(F.col("id") / _RUN).alias("run"))
    )
    ranked = running(dealt, ["source"], "run", ["id"], F.lit(1), "block").where("block < blocks")
    ranked = ranked.select(F.col("id").alias("position"), "source", F.col("block").cast("bigint"))
    # Blocks beyond a source's last slot, in a row behind the others.
    had = ranked.groupBy("source").agg((F.max("block") + 1).alias("had"))
    short = (
        counts.join(had.withColumnRenamed("source", "_source"),
                    F.col("source").eqNullSafe(F.col("_source")), "left")
        .where(F.coalesce("had", F.lit(0)) < F.col("blocks"))
        .select("source", F.explode(F.sequence(F.coalesce("had", F.lit(0)).cast("bigint"),
                                               F.col("blocks").cast("bigint") - 1)).alias("block"))
        .select((F.lit(slots) + F.col("block")).cast("bigint").alias("position"), "source", "block")
    )
    return ranked.unionByName(short)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        slot_words: int = SLOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """The sized documents and the mix.

    Sized: doc_id, source, size, source_size, target, place (unique in its source and part),
    part, start. The mix: position, source, block, part, place, doc_id, words, one row for each
    document's piece in a slot. Reruns give the same mix. A null text has no words; a document
    without words is in no slot. Repeated rows are documents of their own; only rows equal in id
    and text lie in one part whatever their number. An empty table gives an empty mix.
    """
    sizes = keep(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.size(words_of(F.col(text))).cast("bigint").alias("size"),
            # By id and text, so that rows without an id, or of one, are spread over all parts.
            F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                              F.md5(text_of(text).cast("binary"))).cast("binary")).alias("mark"),
        )
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = keep(targets(totals))
    lined = sizes.withColumn(
        "part", F.conv(F.substring("mark", 1, 3), 16, 10).cast("int")
    )
    order = ["mark", "doc_id", "size"]
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy(*order))
    laid = running(lined.withColumn("place", place), ["source"], "part", ["place"], F.col("size"), "start")
    goal = wanted.withColumnRenamed("source", "_source")
    sized = keep(
        laid.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "mark")
    )
    release(sizes)
    times = F.greatest(F.ceil(F.col("target") / F.col("source_size")), F.lit(1))
    rounds = F.explode(F.sequence(F.lit(0), times - 1))
    passes = sized.where("size > 0").withColumn("round", rounds)
    low = F.col("round") * F.col("source_size") + F.col("start")
    passes = passes.withColumn("low", low).withColumn(
        "high", F.least(F.col("low") + F.col("size"), F.round("target").cast("bigint"))
    ).where("low < high")
    first, last = F.floor(F.col("low") / slot_words), F.floor((F.col("high") - 1) / slot_words)
    pieces = passes.withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least("high", (F.col("block") + 1) * slot_words) - F.greatest("low", F.col("block") * slot_words)
    pieces = pieces.select("source", "block", "part", "place", "doc_id", words.alias("words"))
    slots = schedule(wanted, slot_words).select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "position"
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    return sized, pieces.join(slots, same).drop("_source", "_block")


def taken(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words in the mix) and
    first_slot, the place in the mix where it is first taken, null if it is not."""
    sized, mixed = mix(docs, **names)
    words = mixed.groupBy(
        F.col("source").alias("_source"), F.col("part").alias("_part"), F.col("place").alias("_place")
    ).agg(F.sum("words").alias("taken"), F.min("position").alias("first_slot"))
    same = (
        F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("part") == F.col("_part"))
        & (F.col("place") == F.col("_place"))
    )
    return sized.join(words, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot"
    )


def sql(documents: str = "documents") -> str:
    """The same rows in SQL: what the blocks of a source cover is one range of its line, and the
    schedule's points say which slot takes the block in which a document begins."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'),
             lambda x: x <> ''))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mark FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
        (source_size * 2)::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
t AS (SELECT source, source_size, coalesce(least(most, weight * max(CASE WHEN level <= most / weight THEN level END) OVER ()), 0) AS target FROM l),
b AS (SELECT source, ceil(round(target) / {SLOT_WORDS})::BIGINT AS blocks FROM t WHERE round(target) > 0),
c AS (SELECT source, blocks, sum(blocks) OVER (ORDER BY source NULLS LAST)::DOUBLE / sum(blocks) OVER () AS upto,
        blocks::DOUBLE / sum(blocks) OVER () AS share, (sum(blocks) OVER ())::BIGINT AS slots FROM b),
i AS (SELECT unnest(range((SELECT coalesce(sum(blocks), 0)::BIGINT FROM b))) AS id),
k AS (SELECT id, source, blocks, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS block
      FROM (SELECT id, ((id + 1) * {_GOLDEN}::DOUBLE) % 1.0::DOUBLE AS point FROM i)
      JOIN c ON point >= upto - share AND point < upto),
h AS (SELECT source, max(block) + 1 AS had FROM k WHERE block < blocks GROUP BY source),
z AS (SELECT source, block, id AS position FROM k WHERE block < blocks
      UNION ALL SELECT source, block, slots + block FROM (
        SELECT c.source, slots, unnest(range(coalesce(had, 0), blocks)) AS block
        FROM c LEFT JOIN h ON c.source IS NOT DISTINCT FROM h.source)),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS goal,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(goal - start, size), 0) + greatest(least(goal - source_size - start, size), 0))::BIGINT AS taken,
       CASE WHEN size > 0 AND start < goal THEN position END AS first_slot
FROM p LEFT JOIN z ON p.source IS NOT DISTINCT FROM z.source AND p.start // {SLOT_WORDS} = z.block
"""
