"""Merkle manifest of a table: a digest for every row, a tree of digests for every source, and one root.

The place of a row among those of its source comes from bitmaps instead of a sort: the ids of a source are bits in words of
64, of which only those in use are kept, under a directory of counts; the rank of an id is what the directory counts before
its word plus the bits set before its own. Rows then go to arrays of slots, keyed by their place, each of which is
six levels of the tree, and the arrays' digests are the slots of the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wherescore.operators.joins import spread_join
from wherescore.operators.prefix import numbered
from wherescore.sources.scratch import settle

FANOUT = 3
#: Levels of the tree in one array of FANOUT ** LEVELS slots.
LEVELS = 6
SLOTS = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Entries of a directory block are at most 1 << RADIX.
RADIX = 10
_NULL_WORD = -(1 << 58)  # before the words of all 64-bit ids


def leaf(columns: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values, each as its number of UTF-8 bytes, a colon and itself; nulls are ``-``."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def bitmaps(rows: DataFrame) -> DataFrame:
    """Compressed bitmaps of the ids by tree: tree, word, bits, n (rows), extra (bit -> rows beyond its first one).

    ``rows`` has tree, word (id / 64) and bit (id mod 64). Words merge by OR, in each task before the exchange. Repeated ids
    show as words with more rows than bits; only their rows are counted by id.
    """
    words = rows.groupBy("tree", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")
    )
    words = settle(words)
    again = words.where(F.col("n") > F.bit_count("bits")).select("tree", "word")
    counted = spread_join(rows.groupBy("tree", "word", "bit").agg(F.count("*").alias("c")), again, ["tree", "word"], "left_semi")
    extra = counted.where("c > 1").groupBy("tree", "word").agg(
        F.map_from_entries(F.collect_list(F.struct("bit", (F.col("c") - 1).alias("more")))).alias("extra")
    )  # at most 64 entries
    return spread_join(words, extra, ["tree", "word"], "left")


def directory(words: DataFrame) -> DataFrame:
    """Rows before each word in its tree: tree, word, before; and of the whole tree: size.

    Counts go up in steps of 2 ** RADIX words until a tree has one block; offsets come down again. No window
    spans more than 2 ** RADIX entries, also for ids that are spread over all 64 bits.
    """
    low, high = words.agg(F.min("word"), F.max("word")).first()
    levels = [words.select("tree", F.col("word").alias("key"), "n")]
    shift = 0
    while low is not None and (high >> shift) - (low >> shift) >= 1 << RADIX:
        shift += RADIX
        up = levels[-1].groupBy("tree", F.shiftright("key", RADIX).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(settle(up))
    top = Window.partitionBy("tree")
    earlier = top.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    found = levels.pop().select(
        "tree", "key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(top).alias("size")
    )
    while levels:
        entries = levels.pop().withColumn("_block", F.shiftright("key", RADIX))
        inside = Window.partitionBy("tree", "_block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        entries = entries.select("tree", "key", "_block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_inside"))
        blocks = found.select("tree", F.col("key").alias("_block"), "before", "size")
        found = spread_join(entries, blocks, ["tree", "_block"], "inner").select(
            "tree", "key", (F.col("before") + F.col("_inside")).alias("before"), "size"
        )
    return found.withColumnRenamed("key", "word")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, id, digest, more columns) with the place of each in its tree (idx, from 0) and the tree's size.

    Rows of a tree ascend by id, null ids first; rows of equal id ascend by digest.
    """
    bits = rows.withColumns(
        {
            "word": F.coalesce(F.shiftright("id", 6), F.lit(_NULL_WORD).cast("long")),
            "bit": F.coalesce(F.col("id").bitwiseAND(63).cast("int"), F.lit(0)),
        }
    )
    words = settle(bitmaps(bits.select("tree", "word", "bit")))
    directed = spread_join(words.drop("n"), directory(words), ["tree", "word"], "inner")
    found = spread_join(bits, directed, ["tree", "word"], "inner")
    below = F.expr("~shiftleft(-1L, bit)")
    more = F.aggregate(
        F.map_entries(F.coalesce("extra", F.create_map().cast("map<int,bigint>"))),
        F.lit(0).cast("long"),
        lambda a, e: a + F.when(e["key"] < F.col("bit"), e["value"]).otherwise(0),
    )
    rank = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below)) + more
    repeated = F.coalesce(F.map_contains_key("extra", F.col("bit")), F.lit(False))
    ranked = settle(found.select(*rows.columns, rank.alias("idx"), "size", repeated.alias("_again")))
    single = ranked.where("not _again").drop("_again")
    several = numbered(ranked.where("_again").drop("_again"), ["tree", "idx"], ["digest"], "_nth")
    return single.unionByName(several.withColumn("idx", F.col("idx") + F.col("_nth")).drop("_nth"))


def _levels(digests: list[str], size: int) -> list[list[str]]:
    """Nodes of an array's levels, the slots first: all LEVELS in a larger tree, else until one node is left."""
    levels = [digests]
    while len(levels) <= LEVELS and (size > SLOTS or len(levels[-1]) > 1):
        nodes = levels[-1]
        levels.append(
            [hashlib.sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]
        )
    return levels


def _steps(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """Siblings of each slot, level by level: those before it and those after it, in one text each."""
    per_level = []
    for nodes in levels[:-1]:
        runs = [nodes[k - k % FANOUT : k - k % FANOUT + FANOUT] for k in range(len(nodes))]
        per_level.append([("".join(r[: k % FANOUT]), "".join(r[k % FANOUT + 1 :])) for k, r in enumerate(runs)])
    found = []
    for k in range(len(levels[0])):
        path = [level[k // FANOUT**depth] for depth, level in enumerate(per_level)]
        found.append(([p[0] for p in path], [p[1] for p in path]))
    return found


@F.arrow_udf(StringType())
def _digest(slots: pa.Array, size: pa.Array) -> pa.Array:
    pairs = zip(slots.to_pylist(), size.to_pylist(), strict=True)
    return pa.array([_levels(s, n)[-1][0] for s, n in pairs], pa.string())


def slot_arrays(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Arrays of SLOTS nodes at most, keyed by tree and array number: tree, idx, size, slots, carried, digest.

    ``nodes``: tree, idx, size, digest and the columns of ``payload``, which travel along in ``carried``.
    """
    slot = F.struct((F.col("idx") % SLOTS).alias("slot"), "digest", F.struct(*payload, F.lit(0).alias("_")).alias("carried"))
    arrays = nodes.groupBy("tree", F.expr(f"idx div {SLOTS}").alias("idx")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(slot), True).alias("slots")
    )
    arrays = arrays.select("tree", "idx", "size", F.col("slots.digest").alias("slots"), F.col("slots.carried").alias("carried"))
    return settle(arrays.withColumn("digest", _digest("slots", "size")))


def _slot_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of each slot, its array's own path at the end; a batch of rows for each array, so that one array's paths are held."""
    texts = pa.list_(pa.string())
    for batch in batches:
        carried = batch.column("carried")
        rows = zip(*(batch.column(c).to_pylist() for c in _ARRAY), strict=True)
        for k, (tree, array, size, slots, before, after, top) in enumerate(rows):
            steps, n = _steps(_levels(slots, size)), len(slots)
            columns = [
                pa.array([tree] * n, pa.string()),
                pa.array(range(array * SLOTS, array * SLOTS + n), pa.int64()),
                carried[k].values,
                pa.array([s[0] + before for s in steps], texts),
                pa.array([s[1] + after for s in steps], texts),
                pa.array([top] * n, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "carried", "before", "after", "top"])


_ARRAY = ("tree", "idx", "size", "slots", "before", "after", "top")


def rising(nodes: DataFrame, payload: Sequence[str]) -> list[DataFrame]:
    """Slot arrays of all passes, leaves first; the last one has one array for each tree, with its root as digest.

    One pass for each LEVELS levels of the largest tree; smaller trees are done earlier and go along as one node.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 1
    passes = [slot_arrays(nodes, payload)]
    while largest > SLOTS:
        largest = -(-largest // SLOTS)
        size = F.when(F.col("size") > SLOTS, F.expr(f"(size + {SLOTS - 1}) div {SLOTS}")).otherwise(1).cast("long")
        passes.append(slot_arrays(passes[-1].select("tree", "idx", size.alias("size"), "digest")))
    return passes


def falling(passes: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Path of each leaf: tree, idx, carried, before, after, top. ``above`` has tree, idx, before, after, top of each root.

    Paths are handed down to arrays before these are taken apart, so that an exchange moves arrays, not a path for each leaf.
    """
    for arrays in reversed(passes):
        carried = arrays.schema["carried"].dataType.elementType.simpleString()
        schema = f"tree string, idx long, carried {carried}, before array<string>, after array<string>, top string"
        handed = spread_join(arrays, above.select("tree", "idx", "before", "after", "top"), ["tree", "idx"], "inner")
        above = handed.select(*_ARRAY, "carried").mapInArrow(_slot_paths, schema)
    return above


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, idx, before, after, subroot, root, and seen.

    ``before`` and ``after`` are the row's proof: for each level from the leaf to the root the digests of the siblings to
    the left and to the right, concatenated. ``seen`` is the digest of the row with the text ``tampered`` in place of its own
    (null: as it is). Rows of a source ascend by doc_id, null ids first, equal ids by digest; equal rows have equal digests
    and places of their own. Null and empty sources are different; sources ascend by their bytes, null first.
    An empty table gives no rows. Columns that are not in ``columns`` are not looked at.
    """
    own = [F.col(c) for c in columns]
    other = F.lit(None).cast("string")
    if tampered is not None:
        changed = [tampered if c == "text" else F.col(c) for c in columns]
        other = F.when(~tampered.eqNullSafe(F.col("text")), leaf(changed))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = settle(
        docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(own).alias("digest"), other.alias("seen"))
    )
    passes = rising(placed(rows), ["id", "seen", "digest"])
    subroots = passes[-1].select("tree", "digest")
    count = subroots.groupBy().agg(F.count("*").alias("size"))
    tops = numbered(subroots, [], ["tree"], "idx").crossJoin(F.broadcast(count))
    top_passes = rising(tops.select(F.lit("").alias("tree"), "idx", "size", "digest", F.col("tree").alias("of")), ["of", "digest"])
    roots = top_passes[-1].select("digest")  # one row, none for an empty table
    none = F.array().cast("array<string>")
    over = roots.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("idx"), none.alias("before"), none.alias("after"), F.col("digest").alias("top"))
    sources = falling(top_passes, over).select(
        F.col("carried.of").alias("tree"),
        F.lit(0).cast("long").alias("idx"),
        "before",
        "after",
        F.concat("carried.digest", "top").alias("top"),
    )
    return falling(passes, sources).select(
        F.col("carried.id").alias("doc_id"),
        F.when(F.col("tree") != "", F.substring("tree", 2, (1 << 31) - 1)).alias("source"),
        F.col("carried.digest").alias("leaf"),
        "idx",
        "before",
        "after",
        F.substring("top", 1, 64).alias("subroot"),
        F.substring("top", 65, 64).alias("root"),
        F.coalesce("carried.seen", "carried.digest").alias("seen"),
    )


def proof(before: str = "before", after: str = "after") -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    pairs = F.zip_with(before, after, lambda b, a: F.concat(b, a))
    return F.sha2(F.array_join(pairs, "").cast("binary"), 256)


def folded(digest: str, before: str = "before", after: str = "after") -> Column:
    """The root that a digest and a proof lead to."""
    steps = F.arrays_zip(F.col(before).alias("b"), F.col(after).alias("a"))
    return F.aggregate(steps, F.col(digest), lambda d, s: F.sha2(F.concat(s["b"], d, s["a"]).cast("binary"), 256))
