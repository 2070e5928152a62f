"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over eight tokens that ignores some of them, so it still matches where ignored tokens were
substituted. Seeds of benchmark items and of documents that hash alike are hits; around each hit the two token sequences
are laid over each other and compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import ROW_KEY, row_key, whole_text, without
from wherescore.llm.exact import surviving
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

#: 1: compared, 0: ignored. Whatever tokens are substituted, as long as AGREE of 8 to 16 tokens agree, one of these masks
#: fits somewhere in them and ignores all substitutions under it; longer overlaps hold such a window.
MASKS = ("11001011", "10111001", "00011111", "01110110")
SPAN = 8
#: Tokens that are compared around a hit, and the share of them that must agree. Shorter items are compared whole.
WINDOW = 16
AGREE = 0.8
#: Bytes of benchmark seeds, three numbers each, up to which Spark is asked to broadcast them; beyond, it chooses the join.
BROADCAST_BYTES = 1 << 24
_SEED_BYTES = 24


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no empty tokens."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _seeds(words: str, at: Column) -> list[Column]:
    """Hashes of the masked tokens from position ``at`` (from 0), one for each mask; the mask's number is hashed too."""
    return [
        F.xxhash64(F.lit(k), *[F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"])
        for k, mask in enumerate(MASKS)
    ]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items that have seeds, once each: item_key, item_id, item (tokens). Those of fewer than eight tokens are left out."""
    items = benchmark.select("item_id", tokens(whole_text()).alias("item")).where(F.size("item") >= SPAN)
    own = F.xxhash64(F.col("item_id").isNull(), "item_id", "item").alias("item_key")
    return items.select(own, "item_id", "item").dropDuplicates(["item_key"])


def item_seeds(items: DataFrame) -> DataFrame:
    """Seeds of all items, numbers only: seed, item_key, at."""
    places = items.select("item_key", "item", F.explode(F.sequence(F.lit(0), F.size("item") - SPAN)).alias("at"))
    return places.select(F.explode(F.array(*_seeds("item", F.col("at")))).alias("seed"), "item_key", "at").distinct()


def _alignments(words: DataFrame, items: DataFrame) -> DataFrame:
    """Where hits lay an item over a document: row keys, item_key, start, and the item's tokens at which seeds lie (ats)."""
    seeds = settle(item_seeds(items))
    if seeds.count() * _SEED_BYTES <= BROADCAST_BYTES:
        seeds = F.broadcast(seeds)  # nothing leaves generated code, so a document's tokens are not copied for each place
    places = words.select("*", F.posexplode_outer("words").alias("pos", "_first")).where(F.col("pos") <= F.size("words") - SPAN)
    # The outer form: else Spark infers a filter on the array's size, for which it splits each text once more.
    seed = F.explode(F.array(*_seeds("words", F.col("pos")))).alias("seed")
    hits = places.select(*ROW_KEY, "pos", seed).join(seeds, "seed")
    start = (F.col("pos") - F.col("at")).alias("start")
    by_alignment = hits.groupBy(*ROW_KEY, "item_key", start)
    return by_alignment.agg(F.collect_set("at").alias("ats"))  # at most as many as the item has tokens


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """Verified overlaps: row keys, doc_id, item_id, start (token of the document where the item's first would lie).

    Document and item are aligned at the hit. Some ``window`` aligned tokens that hold the hit (the whole item if it is
    shorter) must lie in both and agree in ``agree`` of their positions. Each alignment is returned once.
    Null and empty texts, and texts or items of fewer than eight tokens, have none; null item ids are kept as such.
    Rows of equal id and text count as one, other repeated ids are told apart by their keys; no other column of ``docs`` is
    read, so their names cannot clash. Empty tables give no rows.

    Hits are numbers. The tokens of a document and of an item come in only once they are known to be aligned.
    """
    items = settle(benchmark_items(benchmark))
    given = docs.select(*row_key(), "doc_id", whole_text().alias("text"))
    words = given.select(*ROW_KEY, tokens(F.col("text")).alias("words"))
    aligned = settle(_alignments(words, items))
    with_hits = surviving(given, aligned.select(*ROW_KEY).distinct())
    split = with_hits.select(*ROW_KEY, "doc_id", tokens(F.col("text")).alias("words"))
    of_items = spread_join(aligned, items, ["item_key"], "inner")
    both = spread_join(of_items, split, ROW_KEY, "inner")
    # ``words`` and ``item`` stay plain columns here: an expression in their place would be worked out for each token.
    same = F.transform("item", lambda t, i: F.when(t == F.get("words", F.col("start") + i), 1).otherwise(0))
    width = F.least(F.lit(window), F.size("item"))
    # The comparison is bound to a name within the expression, so that it is made once for each alignment.
    verified = F.exists(
        F.array(same),
        lambda matched: F.exists(
            "ats",
            lambda at: F.exists(
                F.sequence(F.greatest(F.lit(0), at + SPAN - width), F.least(at, F.size("item") - width)),
                lambda s: F.aggregate(F.slice(matched, s + 1, width), F.lit(0), lambda a, x: a + x) >= F.ceil(width * agree),
            ),
        ),
    )
    agreeing = F.aggregate(same, F.lit(0), lambda a, x: a + x)
    return both.where(verified).groupBy(*ROW_KEY, "doc_id", "item_id", "start").agg(F.max(agreeing).alias("agreeing"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold a passage of the benchmark: row keys, doc_id, items (ids, sorted), n_overlaps."""
    found = overlaps(docs, benchmark).groupBy(*ROW_KEY, "doc_id", "item_id").agg(F.count("*").alias("n"))
    return found.groupBy(*ROW_KEY, "doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.sum("n").alias("n_overlaps")
    )  # a row holds at most as many items as tokens


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; extra columns, whatever their names, are kept as they are."""
    return without(docs, contaminated(docs, benchmark))
