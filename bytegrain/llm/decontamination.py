"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrain.functions.rows import explode_computed
from bytegrain.session import Stage

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BLOCK = 256  # words of a block, to which the words that a window may reach are added
PASS_WINDOWS = 200_000  # windows that are broadcast at once, some 200 bytes each
PASS_ITEMS = 1_000_000  # (window, item) pairs that are broadcast
BROADCAST_ROWS = 500_000  # result rows of documents with hits


def words_of(text: Column) -> Column:
    """Words in order: letters a-z and digits with A-Z lower-cased, and all signs beyond ASCII."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def token(words: Column, at: Column) -> Column:
    """The hash of the shingle that begins at a place, shorter at the end of the words."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE)])


def windows_of(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(words, size, items): distinct windows of the items with the ids of their items."""
    words = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("all"))
    count = F.greatest(F.size("all") - window + 1, F.lit(1))
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(1), count))
    cut = explode_computed(words, ["item", "all"], starts, "start")
    cut = cut.select("item", F.slice("all", F.col("start"), F.lit(window)).alias("words"))
    found = cut.groupBy("words").agg(F.collect_set(F.struct("item")).alias("items"))
    return found.withColumn("size", F.size("words"))


def shingles_of(windows: DataFrame) -> DataFrame:
    """(words, size, offset, token): the shingles of each window; one shorter than a shingle
    is a shingle itself."""
    last = F.greatest(F.col("size") - SHINGLE, F.lit(0))
    placed = windows.select("words", "size", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
    return placed.withColumn("token", token(F.col("words"), F.col("offset")))


def blocks_of(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(one, two, first, block): words of each text by blocks. A window that begins in the first
    BLOCK words of a block lies wholly inside it, so long texts make many rows of bounded size."""
    words = docs.select("_one", "_two", words_of(F.col(text)).alias("_words"))

    def cut(all_words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(all_words) - 1, F.lit(BLOCK))
        blocks = F.transform(
            starts,
            lambda at: F.struct(
                at.alias("first"), F.slice(all_words, at + 1, F.lit(BLOCK + window - 1)).alias("words")
            ),
        )
        return F.when(F.size(all_words) > 0, blocks)

    cut_up = explode_computed(words, ["_one", "_two"], cut(F.col("_words")), "_block")
    return cut_up.select("_one", "_two", F.col("_block.first").alias("first"), F.col("_block.words").alias("block"))


def places_of(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of every block with the token of its shingle. Shingles of fewer words than
    SHINGLE are made only if a window is that short."""
    placed = explode_computed(
        blocks, ["_one", "_two", "first", "block"], F.sequence(F.lit(0), F.size("block") - 1), "at"
    )
    if all(size >= SHINGLE for size in sizes):
        return placed.withColumn("token", token(F.col("block"), F.col("at")))
    shorter = [
        F.xxhash64(*[F.get("block", F.col("at") + i) for i in range(size)])
        for size in sizes
        if size < SHINGLE
    ]
    tokens = F.array_distinct(F.array(token(F.col("block"), F.col("at")), *shorter))
    return placed.withColumn("token", F.explode_outer(tokens))


def rarest(shingles: DataFrame, places: DataFrame) -> DataFrame:
    """(words, size, offset, token): of each window the shingle that the documents hold least,
    the prefix that a containment of all its shingles needs. Windows with a shingle that no
    document holds are left out."""
    wanted = shingles.select("token").distinct()
    held = (
        places.where(F.col("at") < BLOCK)
        .join(F.broadcast(wanted), "token")
        .groupBy("token")
        .agg(F.count("*").alias("often"))
    )
    counted = shingles.join(held, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    first = counted.groupBy("words", "size").agg(F.min(F.struct("often", "token", "offset")).alias("low"))
    return first.where("low.often > 0").select(
        "words", "size", F.col("low.offset").alias("offset"), F.col("low.token").alias("token")
    )


def occurrences(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(one, two, start, size, words): where windows occur. Documents meet windows by their
    prefix shingle; bounds on place and length go before the comparison of all words."""
    begin = F.col("at") - F.col("offset")
    inside = (begin >= 0) & (begin < BLOCK) & (begin + F.col("size") <= F.size("block"))
    met = places.join(F.broadcast(prefixes), "token").where(inside)
    same = met.where(F.slice("block", begin + 1, F.col("size")) == F.col("words"))
    return same.select("_one", "_two", (F.col("first") + begin).alias("start"), "size", "words")


def covered(found: DataFrame) -> DataFrame:
    """(one, two, n_hit): words of each text in any occurrence; a window of one text's own places."""
    end = F.col("start") + F.col("size")
    before = Window.partitionBy("_one", "_two").orderBy("start", end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0))
    return (
        found.select("_one", "_two", "start", "size").withColumn("_fresh", fresh)
        .groupBy("_one", "_two")
        .agg(F.sum("_fresh").alias("_hit"))
    )


def items_in(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(one, two, items): ids of the items that have a window in the text, sorted as strings."""
    held = windows.select(F.col("words"), "items")
    if held.agg(F.sum(F.size("items"))).first()[0] <= PASS_ITEMS:
        held = F.broadcast(held)
    met = found.select("_one", "_two", "words").distinct().join(held, "words")
    each = met.select("_one", "_two", F.explode("items.item").alias("item")).distinct()
    return each.groupBy("_one", "_two").agg(F.array_sort(F.collect_list(F.struct("item"))).alias("_items"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(key, n_words, n_hit, items), one row for each row of `docs`.

    Windows are runs of `window` words of an item, or the whole item if it has fewer words but
    not none. `n_hit` counts the words of a text inside occurrences of windows, `items` lists the
    ids (as strings, sorted, each once) of items with such windows. Null texts have no words;
    items that repeat an id count as one, null ids as one item with the empty id. Rows of `docs`
    are kept apart, also with null or repeated keys. Other columns are not read. An empty
    table of documents gives no rows, one of items no hits.

    1. Distinct windows are broken into shingles of three words; one narrow pass over the
       documents counts those shingles, which orders them by rarity.
    2. A window is contained only where its rarest shingle is: that one shingle is the prefix.
       A second narrow pass joins places of documents with the broadcast prefixes, filters by
       place and length, and compares all words.
    3. Hits are few beside the documents; they are summed per text and joined to the rows.

    Windows are broadcast in passes of at most PASS_WINDOWS, so there is no bound on items.
    """
    held = F.col(key), F.col(text), F.isnull(key), F.isnull(text)
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(text).alias("_text"),
        F.xxhash64(*held).alias("_one"),
        F.xxhash64(F.lit(7), *held[::-1]).alias("_two"),
    )
    windows = Stage(windows_of(items, item_key, item_text, window), "windows").df
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `window`
    passes = -(-windows.count() // PASS_WINDOWS)
    found = []
    for turn in range(passes):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == turn)
        blocks = blocks_of(rows, "_text", window)
        places = places_of(blocks, sizes)
        prefixes = Stage(rarest(shingles_of(part), places), "prefixes").df
        found.append(Stage(occurrences(places, prefixes), "occurrences").df)
    sized = rows.select("_key", "_one", "_two", F.size(words_of(F.col("_text"))).cast("bigint").alias("_size"))
    if not found:
        return sized.select(
            F.col("_key").alias(key),
            F.col("_size").alias("n_words"),
            F.lit(0).cast("bigint").alias("n_hit"),
            F.array().cast("array<string>").alias("items"),
        )
    found = reduce(DataFrame.union, found)
    hit = Stage(covered(found).join(items_in(found, windows), ["_one", "_two"]), "hits").df
    met = sized.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, ["_one", "_two"], "left")
    names = F.transform("_items.item", lambda i: F.coalesce(i, F.lit("")))
    return met.select(
        F.col("_key").alias(key),
        F.col("_size").alias("n_words"),
        F.coalesce(F.col("_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(names, F.array().cast("array<string>")).alias("items"),
    )
