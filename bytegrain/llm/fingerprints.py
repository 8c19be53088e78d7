"""Document fingerprints by I-Match over randomised lexicon subsets, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.operators.ordering import with_rank
from bytegrain.session import Stage

#: A term is kept if at least the one and less than the other share of all documents hold it.
LEAST_SHARE, MOST_SHARE = 0.001, 0.05
LEXICON_BUCKETS = 1 << 14
LEVELS = 10  # each keeps a quarter of the terms of the one before; the last suits millions of terms
SUBSETS = 32  # of a level
LEVEL_TERMS = 256  # a level that keeps more terms than that is empty; the next keeps fewer
LEAST_TERMS = 8  # of the lexicon; texts with fewer are known by all of their words
LEAST_FILLED = 8  # subsets that a level needs in order to be compared


def word_set(text: Column) -> Column:
    """Distinct lower-cased words."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(F.array_distinct(found), "")


def _place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(LEXICON_BUCKETS)).cast("int")


def lexicon(docs: DataFrame, text: str) -> DataFrame:
    """One row: the terms of the frequency band, as an array of hash buckets.

    A term of the band is held by LEAST_SHARE of all documents or more, so the lexicon has at
    most (mean distinct words of a document) / LEAST_SHARE terms, however many documents
    there are.
    """
    total = docs.count()
    terms = docs.select(F.explode_outer(word_set(F.col(text))).alias("term"))
    counted = terms.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    kept = counted.where((F.col("n") >= LEAST_SHARE * total) & (F.col("n") < MOST_SHARE * total))
    filled = kept.groupBy(_place(F.col("term")).alias("place")).agg(
        F.collect_list("term").alias("terms")
    )
    places = docs.sparkSession.range(LEXICON_BUCKETS).select(F.col("id").cast("int").alias("place"))
    dense = places.join(filled, "place", "left")
    listed = F.sort_array(F.collect_list(F.struct("place", "terms")))
    return dense.agg(F.transform(listed, lambda e: e["terms"]).alias("lexicon"))


def with_fingerprint(df: DataFrame, text: str, known: Column, name: str) -> DataFrame:
    """Add the fingerprint of a text column.

    The distinct terms of the lexicon, in order, are hashed; each randomised subset of the
    lexicon (a residue of term hashes, thinned by level) gives two hexadecimal digits for the
    terms that it keeps, or '00' if it keeps none. Terms are dealt to 8 groups and then to 4
    subsets of each, which touches a term 12 times instead of 32.

    A level that keeps more than LEVEL_TERMS terms of a text is empty for it: hardly a subset of so
    many terms would survive an edit. The ladder is the same for all texts, and so deep that
    each has levels of some 8 to 256 terms, up to tens of millions of terms (the last has no limit).
    """
    inside = F.filter(
        "_words", lambda w: F.coalesce(F.array_contains(F.get("_known", _place(w)), w), F.lit(False))
    )
    terms = F.when(F.size("_terms") >= LEAST_TERMS, F.col("_terms")).otherwise(F.col("_words"))
    kept = df.columns
    found = (
        df.withColumn("_words", word_set(F.col(text)))
        .withColumn("_known", known)
        .withColumn("_terms", inside)
        .drop("_known")
        .withColumn("_hashes", F.transform(F.sort_array(terms), lambda t: F.xxhash64(t)))
        .drop("_words", "_terms")
    )
    for level in range(LEVELS):
        above = f"_level_{level - 1}" if level else "_hashes"
        thinned = f"filter({above}, x -> (shiftright(x, 8) & {(1 << 2 * level) - 1}) = 0)"
        thinned = thinned if level else above
        found = found.withColumn(f"_level_{level}", F.expr(thinned))
    group = "filter(a, x -> (x & 7) = g)"
    subset = "filter(q, x -> (shiftright(x, 3) & 3) = k)"
    digit = "if(size(f) = 0, '00', lpad(hex(1 + pmod(xxhash64(f), 255)), 2, '0'))"
    inner = f"transform(sequence(0, 3), k -> transform(array({subset}), f -> {digit})[0])"
    each = f"transform(sequence(0, 7), g -> transform(array({group}), q -> array_join({inner}, ''))[0])"
    none = "00" * SUBSETS
    digits = []
    for level in range(LEVELS):
        left_out = "size(a) = 0" if level == LEVELS - 1 else f"size(a) = 0 or size(a) > {LEVEL_TERMS}"
        joined = f"if({left_out}, '{none}', array_join({each}, ''))"
        digits.append(F.expr(f"transform(array(_level_{level}), a -> {joined})[0]"))
    return found.withColumn(name, F.concat(*digits)).select(*kept, name)


def filled_bytes(words: str) -> str:
    """For an array of 64-bit words, how many bytes of each are not 0: bits of a byte are
    gathered in its lowest."""
    for shift in (4, 2):
        words = f"transform({words}, w -> w | shiftrightunsigned(w, {shift}))"
    lowest = 0x0101010101010101
    return f"transform({words}, w -> bit_count((w | shiftrightunsigned(w, 1)) & {lowest}L))"


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the greatest share of equal subsets on a level, of those that one of both fills.

    Fingerprints are compared 8 subsets at a time, as the bytes of 64-bit words.
    """
    count = LEVELS * SUBSETS // 8
    x, y = (
        f"transform(sequence(0, {count - 1}), "
        f"i -> CAST(conv(substring({c}, 16 * i + 1, 16), 16, -10) AS BIGINT))"
        for c in (a, b)
    )
    shares = []
    for level in range(LEVELS):
        part = f"{count // LEVELS * level + 1}, {count // LEVELS}"
        filled, other = (
            F.expr(f"aggregate(slice({c}, {part}), 0, (n, w) -> n + w)") for c in ("_filled", "_differ")
        )
        enough = filled >= (LEAST_FILLED if level else 1)
        shares.append(F.when(enough, (filled - other) / filled))
    best = F.coalesce(F.greatest(*shares), F.lit(0.0))
    return (
        df.withColumn("_x", F.expr(x))
        .withColumn("_y", F.expr(y))
        .withColumn("_filled", F.expr(filled_bytes("zip_with(_x, _y, (x, y) -> x | y)")))
        .withColumn("_differ", F.expr(filled_bytes("zip_with(_x, _y, (x, y) -> x ^ y)")))
        .withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(best))
        .drop("_x", "_y", "_filled", "_differ")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint), one row for each row; narrow but for the lexicon's word count.

    Null and empty texts have only empty subsets; equal texts have equal fingerprints. Rows
    with null or repeated keys are kept apart, other columns are not read.
    """
    known = Stage(lexicon(docs, text), "lexicon").df.scalar()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return with_fingerprint(rows, "_text", known, "fingerprint").select(
        F.col("_key").alias(key), "fingerprint"
    )


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edits, and how near these are.

    The edit replaces the last quarter of a text's code points by the first as many of the
    next text. Returns (key, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next), one row for each row. Next is the row with the next key, null keys first and
    the first after the last; rows that share a key follow each other by a hash of the text,
    rows that share key and text have the same next text. Texts that are null are empty.

    Texts are shuffled once, with their fingerprints, for both joins: with the row whose next
    text they are, and with their own edit.
    """
    known = Stage(lexicon(docs, text), "lexicon").df.scalar()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    narrow = rows.select(
        F.col("_key").isNotNull().alias("_named"), "_key", "_hash", F.length("_text").alias("_n")
    ).distinct()
    ranked = with_rank(narrow, "_named", "_key", "_hash").select("rank", "_key", "_hash", "_n")
    count = ranked.count()
    following = ranked.select(
        F.col("rank").alias("_follows"),
        F.col("_key").alias("_next_key"),
        F.col("_hash").alias("_next_hash"),
    )
    pairs = ranked.join(following, F.pmod(F.col("rank") + 1, F.lit(max(count, 1))) == F.col("_follows")).select(
        F.col("_key").alias("_own_key"),
        F.col("_hash").alias("_own_hash"),
        F.floor(F.col("_n") / 4).cast("int").alias("_quarter"),
        "_next_key",
        "_next_hash",
    )
    printed = with_fingerprint(rows, "_text", known, "fingerprint")
    is_next = F.col("_key").eqNullSafe(F.col("_next_key")) & (F.col("_hash") == F.col("_next_hash"))
    parts = (
        printed.join(pairs, is_next)
        .select(
            "_own_key",
            "_own_hash",
            "_quarter",
            F.col("_text").substr(F.lit(1), F.col("_quarter")).alias("_first"),
            F.col("fingerprint").alias("_next_print"),
        )
        .groupBy("_own_key", "_own_hash")
        .agg(*[F.first(c).alias(c) for c in ("_quarter", "_first", "_next_print")])
    )
    own = F.col("_key").eqNullSafe(F.col("_own_key")) & (F.col("_hash") == F.col("_own_hash"))
    left = F.col("_text").substr(F.lit(1), F.length("_text") - F.col("_quarter"))
    edited = printed.join(parts, own).select(
        "_key",
        F.length("_text").cast("bigint").alias("n_chars"),
        F.concat(left, "_first").alias("edited"),
        "fingerprint",
        "_next_print",
    )
    edited = with_fingerprint(edited, "edited", known, "edited_fingerprint")
    edited = with_likeness(edited, "fingerprint", "edited_fingerprint", "near_edited")
    edited = with_likeness(edited, "fingerprint", "_next_print", "near_next")
    return edited.select(
        F.col("_key").alias(key),
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
