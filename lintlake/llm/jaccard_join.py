"""Documents whose word n-grams overlap: an exact Jaccard join by signature trees.

Equal sets make one class. A shingle found in one class only cannot be common to two, so only
classes with enough shared shingles go on; they are rows of some tens of thousands of shingles
packed by hash range, so that counting moves little more than the hashes. Sets that link must
share one of their rarest shingles (the prefix); sharing one, with sizes near, puts classes in
one group. Groups are cut into blocks, and pairs of blocks are joined by signature trees, whose
links make the components. Nothing is sampled and no group is capped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import signature_tree, tokens
from lintlake.llm.columns import NO_SPACE, boxed, in_small_batches, running
from lintlake.llm.graph import components
from lintlake.sources.store import keep, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 75
#: Shingles that one task counts, that one block of a group holds, and that are packed at a time,
#: about.
BUCKET = 2_000_000
BLOCK = 2_000_000
CHUNK = 1 << 19
#: A batch reports shingles that so many of its classes have. Shingles that make more than one
#: in MOST_COMMON of all are known to every task, eight megabytes at most.
FREQUENT = 4
MOST_COMMON = 1_000_000
#: Of a group of several blocks one class in so many is compared across blocks first.
SAMPLE = 32

_CLASSES = "doc_id bigint, tag bigint, n bigint, class bigint, frequent array<struct<token:bigint,uses:bigint>>"
_PACKED = "bucket bigint, tokens binary, uses binary, classes binary, sizes binary, counts binary"
_SETS = "class bigint, n bigint, tokens array<bigint>, prefix array<bigint>"
_LINKS = "u bigint, v bigint"
U8, U4 = np.uint64, np.uint32


def _shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingles, sorted, end to end, and where each text's begin."""
    hashes, bounds = tokens.words(*tokens.text_bytes(column), tokens.spaced_words(lower=True))
    made = tokens.grams(hashes, n)
    counts = np.diff(bounds)
    sets, mask = [], tokens.starts(bounds, n, len(made))
    made, ends = made[mask], np.concatenate([[0], np.cumsum(np.maximum(counts - n + 1, 0))])
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        made[low:high].sort()
    first = np.ones(len(made), bool)
    first[1:] = made[1:] != made[:-1]
    first[ends[:-1][ends[:-1] < len(made)]] = True
    sizes = np.add.reduceat(np.append(first, False).astype(np.int64), ends[:-1]) if len(counts) else counts
    sizes[np.diff(ends) == 0] = 0
    made = made[first]
    # A text of fewer words is one shingle.
    short = np.flatnonzero((counts > 0) & (counts < n))
    if short.size:
        whole = np.array(
            [tokens.grams(hashes[bounds[k] : bounds[k + 1]], counts[k])[0] for k in short], U8
        )
        made = np.insert(made, np.concatenate([[0], np.cumsum(sizes)])[short], whole)
        sizes[short] = 1
    return made, np.concatenate([[0], np.cumsum(sizes)])


def _classes(made: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of every set; empty sets get 0."""
    sums = np.concatenate([np.zeros(1, U8), np.cumsum(tokens.mixed(made), dtype=U8)])
    sizes = np.diff(bounds)
    return np.where(sizes > 0, tokens.mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(U8)), U8(0))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(U8, copy=False).view(np.int64))


def _document_classes(shingle: int):
    """Size and class of every document; with the first of a batch the batch's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.small_batches(batches, "text"):
            made, bounds = _shingles(batch.column("text"), shingle)
            classes = _classes(made, bounds)
            first = np.zeros(len(classes), bool)
            first[np.unique(classes, return_index=True)[1]] = True
            values, uses = np.unique(made[np.repeat(first, np.diff(bounds))], return_counts=True)
            values, uses = values[uses >= FREQUENT], uses[uses >= FREQUENT]
            ends = np.full(len(classes) + 1, len(values), np.int32)
            ends[0] = 0
            entries = pa.StructArray.from_arrays([_signed(values), pa.array(uses)], names=["token", "uses"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(bounds)), _signed(classes),
                 pa.ListArray.from_arrays(pa.array(ends), entries)],
                names=["doc_id", "tag", "n", "class", "frequent"],
            )

    return run


def _common_tokens(classes: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles so frequent that one task should not count them, with their uses, sorted.

    At most 1 / MOST_COMMON of all each, hence no more than MOST_COMMON of them.
    """
    uses = classes.select(F.inline("frequent")).groupBy("token").agg(F.sum("uses").alias("uses"))
    rows = uses.where(F.col("uses") >= max(total / MOST_COMMON, 64)).toArrow()
    token, uses = rows["token"].to_numpy().view(U8), rows["uses"].to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(uses[order], np.iinfo(U4).max).astype(U4)


def _pack(bucket: np.ndarray, owner: np.ndarray, token: np.ndarray, uses: np.ndarray) -> tuple:
    """Shingles sorted by bucket and owner as one row per bucket: shingles, their uses (or
    none), the owners and how many shingles each has."""
    run = np.ones(len(token), bool)
    run[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(run)
    counts = np.diff(np.append(heads, len(token))).astype(U4)
    present, at = np.unique(bucket, return_index=True)
    rows = np.searchsorted(heads, np.append(at, len(token)))
    owners = owner[heads]
    return present.tolist(), [
        (token[a:b].tobytes(), uses[a:b].tobytes(), owners[p:q].tobytes(), b"", counts[p:q].tobytes())
        for a, b, p, q in zip(at, np.append(at[1:], len(token)), rows[:-1], rows[1:])
    ]


def _batch(buckets: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]],
        names=["bucket", "tokens", "uses", "classes", "sizes", "counts"],
    )


def _part(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U8(32)) * U8(buckets) >> U8(32)).astype(np.int64)


def _by_class(
    classes: np.ndarray,
    sizes: np.ndarray,
    counts: np.ndarray,
    token: np.ndarray,
    uses: np.ndarray,
    buckets: int,
) -> tuple:
    """A row for each bucket of classes: the classes, their sizes, and their common shingles,
    `counts` for each, which lie by class."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    order = np.argsort(classes)
    bucket = _part(classes[order], buckets)
    present, at = np.unique(bucket, return_index=True)
    rows = []
    for low, high in zip(at, np.append(at[1:], len(order))):
        own = order[low:high]
        some = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in own])
        rows.append(
            (token[some].tobytes(), uses[some].tobytes(), classes[own].tobytes(),
             sizes[own].astype(U4).tobytes(), counts[own].astype(U4).tobytes())
        )
    return (-1 - present).tolist(), rows


def _packed(shingle: int, buckets: int, common: tuple[np.ndarray, np.ndarray]):
    """Each class that a task meets, once, packed for about CHUNK shingles at a time.

    Its size and its common shingles, with the uses that are known, go by the class, in buckets
    below 0; other shingles go by their own hash, to be counted.
    """

    def packed(held: list) -> pa.RecordBatch:
        made, sizes, classes = (np.concatenate(part) for part in zip(*held))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(common[0], made)
        known = at < len(common[0])
        known[known] = common[0][at[known]] == made[known]
        counts = np.bincount(owner[known], minlength=len(sizes))
        names, rows = _by_class(classes, sizes, counts, made[known], common[1][at[known]], buckets)
        token, owner = made[~known], owner[~known]
        bucket = _part(token, buckets)
        order = np.argsort(bucket, kind="stable")
        more, others = _pack(bucket[order], classes[owner[order]], token[order], np.empty(0, U4))
        return _batch(names + more, rows + others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total = set(), [], 0
        for batch in tokens.small_batches(batches, "text"):
            made, bounds = _shingles(batch.column("text"), shingle)
            classes = _classes(made, bounds)
            sizes = np.diff(bounds)
            new = np.zeros(len(classes), bool)
            for k, key in enumerate(classes.tolist()):
                if key and key not in seen:
                    tokens.remember(seen, key)
                    new[k] = True
            held.append((made[np.repeat(new, sizes)], sizes[new], classes[new]))
            total += len(held[-1][0])
            if total >= CHUNK:
                yield packed(held)
                held, total = [], 0
        if total:
            yield packed(held)

    return run


def _shared_tokens(buckets: int):
    """Of a bucket the shingles that two classes or more have, packed by bucket of the class.

    A bucket is sorted in parts of about a million shingles.
    """

    def shared(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        many = same[1:] | same[:-1]
        token, owner = token[many], owner[many]
        # A class that several tasks met counts once.
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[first], owner[first]
        _, index, uses = np.unique(token, return_inverse=True, return_counts=True)
        uses = np.minimum(uses, np.iinfo(U4).max).astype(U4)[index]
        two = uses > 1
        return token[two], owner[two], uses[two]

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() < 0:
            return table.set_column(0, "bucket", pc.subtract(-1, table.column("bucket")))
        token, classes, counts = (
            tokens.packed(table.column(name), kind)
            for name, kind in (("tokens", U8), ("classes", U8), ("counts", U4))
        )
        run_ = np.repeat(np.arange(len(classes), dtype=U4), counts)
        parts = -(-len(token) // (1 << 20)) or 1
        part = ((token & U8(0xFFFFFFFF)) * U8(parts) >> U8(32)).astype(np.uint16)
        found = [shared(token[mine], classes[run_[mine]]) for mine in (part == k for k in range(parts))]
        token, owner, uses = (np.concatenate(column) for column in zip(*found))
        # Buckets are ranges of the class's hash, so classes sort the buckets too.
        order = np.argsort(owner, kind="stable")
        token, owner, uses = token[order], owner[order], uses[order]
        return pa.Table.from_batches([_batch(*_pack(_part(owner, buckets), owner, token, uses))])

    return run


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(values))


def _sets(percent: int):
    """Classes that may link at all: their shared shingles, and the rarest of them as prefix."""

    def run(table: pa.Table) -> pa.Table:
        token, uses, classes, counts = (
            tokens.packed(table.column(name), kind)
            for name, kind in (("tokens", U8), ("uses", U4), ("classes", U8), ("counts", U4))
        )
        owner = np.repeat(classes, counts)
        # Sizes come with the classes' own rows.
        sized = [row.as_py() for row in table.column("sizes")]
        named = [row.as_py() if size else b"" for row, size in zip(table.column("classes"), sized)]
        known, at = np.unique(np.frombuffer(b"".join(named), U8), return_index=True)
        sizes = np.frombuffer(b"".join(sized), U4)[at].astype(np.int64)
        order = np.lexsort((token, uses, owner))
        token, owner = token[order], owner[order]
        # A common shingle comes from every task that met the class.
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[first], owner[first]
        new = np.ones(len(token), bool)
        new[1:] = owner[1:] != owner[:-1]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(token)))
        n = sizes[np.searchsorted(known, owner[heads])]
        # The prefix is the n - ceil(percent * n / 100) + 1 rarest; shingles of its own come first.
        prefix = n + (-percent * n) // 100 + 1 - (n - counts)
        may = prefix > 0
        kept = np.repeat(may, counts)
        rank = np.arange(len(token)) - np.repeat(heads, counts)
        front = kept & (rank < np.repeat(prefix, counts))
        return pa.table(
            [_signed(owner[heads][may]), pa.array(n[may]), _lists(token[kept], counts[may]),
             _lists(token[front], np.minimum(prefix, counts)[may])],
            names=["class", "n", "tokens", "prefix"],
        )

    return run


def groups(members: DataFrame, percent: int) -> DataFrame:
    """(class, group) for classes that share a mark with another of near size.

    `members` has mark, class and n, and may hold a mark in any number of classes. Sizes fall
    into bins so wide that sets which can link lie in the same bin or in the next; each class
    is linked to the least class of its mark and bin, and this to that of the next bin.
    """
    # A little wider, so that rounding never puts two such sets further apart.
    width = float(np.log(100 / percent)) * 1.000001
    binned = members.withColumn("bin", F.floor(F.log("n") / width).cast("int"))
    # Equal pairs of class and bin come from many marks; what is linked is made distinct early.
    least = binned.groupBy("mark", "bin").agg(F.min("class").alias("least"), F.count("*").alias("uses"))
    least = keep(least)
    inside = binned.join(least.where("uses > 1"), ["mark", "bin"]).select(F.col("class").alias("u"), F.col("least").alias("v"))
    after = least.select("mark", (F.col("bin") - 1).alias("bin"), F.col("least").alias("next"))
    across = least.join(after, ["mark", "bin"]).select(F.col("least").alias("u"), F.col("next").alias("v"))
    edges = inside.unionByName(across).where("u <> v").distinct()
    linked = components(edges)
    roots = linked.select(F.col("root").alias("class"), F.col("root").alias("group")).distinct()
    return linked.select(F.col("node").alias("class"), F.col("root").alias("group")).unionByName(roots)


def _tree_links(percent: int, load=None):
    """Links within the block pairs of a task, which come one after the other."""

    def joined(rows: list[tuple]) -> list[tuple[int, int]]:
        sides, keys, sizes, sets = (list(column) for column in zip(*rows))
        sizes = np.array(sizes, np.int64)
        if load is not None:
            sizes, sets = load(sets)
        pairs = signature_tree.links(sizes, sets, np.array(sides, np.int8), percent)
        return [(keys[a], keys[b]) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, found = None, [], []
        for batch in batches:
            sets = batch.column("tokens")
            if load is None:
                flat, ends = sets.values.to_numpy(zero_copy_only=False).view(U8), sets.offsets.to_numpy()
                sets = [flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:])]
            else:
                sets = sets.to_pylist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "low", "high", "side", "class", "n")))
            for (*pair, side, key, n), tokens_ in zip(keys, sets):
                if pair != current:
                    if len(rows) > 1:
                        found += joined(rows)
                    current, rows = pair, []
                rows.append((side, key, n, tokens_))
            if len(found) >= 10_000:
                yield _edges(found)
                found = []
        if len(rows) > 1:
            found += joined(rows)
        yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _placed(light: DataFrame, block: int) -> DataFrame:
    """Add to (class, group, n, weight) the block: by size, of about so much weight."""
    laid = running(light, ["group"], "n", ["class"], F.col("weight"), "before")
    return laid.select("class", "group", "n", "weight", F.floor(F.col("before") / block).alias("block"))


def _block_links(low: DataFrame, high: DataFrame | None, sets: DataFrame, percent: int, load) -> DataFrame:
    """Links between the blocks of `low` and those of `high` in the same group, where sizes are
    near enough, or of each block of `low` with itself."""
    sets = sets.select("class", "tokens")
    if high is None:
        own = [F.col("block").alias(name) for name in ("low", "high")]
        pairs = low.select("group", *own, F.lit(0).alias("side"), "class", "n")
    else:
        def ends(placed: DataFrame, name: str) -> DataFrame:
            least, most = F.min("n").alias(f"{name}_least"), F.max("n").alias(f"{name}_most")
            return placed.groupBy("group", F.col("block").alias(name)).agg(least, most)

        near = (
            ends(low, "low")
            .join(ends(high, "high"), "group")
            .where(
                (100 * F.col("low_most") >= percent * F.col("high_least"))
                & (100 * F.col("high_most") >= percent * F.col("low_least"))
            )
            .select("group", "low", "high")
        )
        columns = ["group", "low", "high", "side", "class", "n"]
        left = low.withColumnRenamed("block", "low").join(near, ["group", "low"]).withColumn("side", F.lit(0))
        right = high.withColumnRenamed("block", "high").join(near, ["group", "high"]).withColumn("side", F.lit(1))
        pairs = left.select(columns).unionByName(right.select(columns))
    dealt = pairs.join(sets, "class").repartition("group", "low", "high")
    return dealt.sortWithinPartitions("group", "low", "high").mapInArrow(_tree_links(percent, load), _LINKS)


def _component(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Add to each class the component that links have put it in so far."""
    found = components(links).select(F.col("node").alias("class"), "root")
    return placed.join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))


def verified_links(
    sets: DataFrame, grouped: DataFrame, percent: int, block: int = BLOCK, load=None
) -> DataFrame:
    """Links (u, v) that connect all classes which similar pairs within groups connect.

    `sets` has class, n and tokens, an array of hashes or what `load` makes them of; `grouped`
    has class and group. A group is laid out by size in blocks of about `block` tokens.

    Groups of one block are done when that is joined with itself. In larger ones a sample of
    every block's components is joined next, which connects most of what belongs together;
    last, all that is not in its group's largest component is joined with the whole group. So
    every similar pair has been compared or was connected before, and a group of very many
    near copies costs about its size, not its square.
    """
    weight = F.col("n") if load else F.size("tokens").cast("bigint")
    light = grouped.join(sets.select("class", "n", weight.alias("weight")), "class")
    placed = keep(_placed(light, block))
    links = keep(_block_links(placed, None, sets, percent, load))
    large = placed.where("block > 0").select("group").distinct()
    if large.isEmpty():
        return links
    inside = keep(_component(placed.join(large, "group", "left_semi"), links))
    first = inside.groupBy("group", "block", "root").agg(F.min("class").alias("class")).select("class", "group")
    drawn = inside.where(F.xxhash64("class") % SAMPLE == 0).select("class", "group")
    light = inside.select("class", "group", "n", "weight")
    sample = first.unionByName(drawn).distinct().join(light, ["class", "group"])
    sample = keep(_placed(sample, block))
    links = keep(links.unionByName(_block_links(sample, sample, sets, percent, load)))
    inside = keep(_component(inside.drop("root"), links))
    heavy = inside.groupBy("group", "root").agg(F.sum("weight").alias("all")).groupBy("group")
    heavy = heavy.agg(F.max_by("root", F.struct("all", "root")).alias("main"))
    strays = inside.join(heavy, "group").where("root <> main").select("class", "group", "n", "weight")
    strays = keep(_placed(strays, block))
    rest = _block_links(strays, inside.select("class", "group", "n", "weight", "block"), sets, percent, load)
    # Stored, so that what reads it next adds no second Python worker to the task that makes it.
    return links.unionByName(keep(rest))


@in_small_batches
def _rooted(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, tag, n and root, the component's class, null without shingles."""
    chosen = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text")
    )
    classes = keep(chosen.mapInArrow(_document_classes(shingle), _CLASSES))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    common = _common_tokens(classes, total)
    packed = chosen.select("text").mapInArrow(_packed(shingle, buckets, common), _PACKED)
    # As many tasks as buckets, so that what a task reads does not grow with the corpus.
    dealt = packed.repartition(buckets, "bucket").groupBy("bucket")
    shared = dealt.applyInArrow(_shared_tokens(buckets), _PACKED)
    sets = keep(shared.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sets(percent), _SETS))
    members = sets.select(F.explode("prefix").alias("mark"), "class", "n")
    grouped = keep(groups(members, percent))
    found = components(verified_links(sets, grouped, percent, block))
    release(sets, grouped)
    linked = found.select(F.col("node").alias("class"), "root")
    rooted = classes.join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return rooted.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, tag, n_shingles, component_id.

    The component is the smallest doc_id that links reach. Two documents link when percent of
    the union of their shingles is common to them. A text of fewer words is one shingle; a null
    text or one without words has none, links with nothing and is its own component. `tag`
    hashes the text. Repeated rows are of one class; an empty table gives an empty one. The
    `limits` are shingle, percent and block.
    """
    rooted = _rooted(docs, doc_id, text, **limits)
    # Stored, so that the join below is of two plain tables and a class of very many copies splits.
    least = keep(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
    return rooted.join(least, "root", "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One document of each component, with all its columns as they are: the one of least id.

    A null id comes after all others. Among rows of that id the one with the least hash of its
    text stays, among those with equal texts the one whose columns hash least. Components are
    told apart by their texts, so unrelated texts of one id, or of none, all stay; so does every
    row without shingles.
    """
    rooted = _rooted(docs, doc_id, text, **limits)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tag")
    first = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("first"))
    stays = keep(first.select("first.doc_id", "first.tag"))
    worded = F.coalesce(F.col(text).rlike(NO_SPACE), F.lit(False))
    rows = boxed(docs, _id=F.col(doc_id).cast("bigint"), _tag=F.xxhash64(F.col(text)), _worded=worded)
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag"))
    left = rows.where("_worded").join(stays, same, "left_semi")
    once = Window.partitionBy("_id", "_tag").orderBy(F.xxhash64("row"))
    left = left.withColumn("_turn", F.row_number().over(once)).where("_turn = 1")
    return left.select("row.*").unionByName(rows.where("NOT _worded").select("row.*"))


def sql(documents: str = "documents") -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'),
       lambda x: x <> '') AS w FROM {documents}),
s AS (SELECT DISTINCT r, hash(array_to_string(w[k:k + {SHINGLE - 1}], ' ')) AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM c JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
