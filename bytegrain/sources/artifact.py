"""The tokenizer artifact: one JSON object per file.

Keys: vocab_size, special_tokens (name to id), vocab (id to base64 bytes), merges
(ordered id pairs), and pattern, which files of other writers may lack. The layout is
recognised from the special tokens, or made from them and the stored vocabulary.
"""

from __future__ import annotations

from base64 import b64decode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.model import LAYOUTS, BpeModel, Layout, check_vocab_size

ARTIFACT_SCHEMA = (
    "vocab_size int, special_tokens map<string,int>, "
    "vocab map<string,string>, merges array<array<int>>, pattern string"
)


def artifact_table(spark: SparkSession, model: BpeModel) -> DataFrame:
    """The artifact as one row. Spark's base64 breaks lines, JSON readers expect none."""
    vocab = model.vocab_table(spark)
    encoded = F.regexp_replace(F.base64("bytes"), "\r\n", "")
    entries = F.sort_array(F.collect_list(F.struct("token_id", encoded.alias("data"))))
    names = F.sort_array(
        F.collect_list(F.when(F.col("kind") == "special", F.struct("token_id", "surface")))
    )
    summary = vocab.agg(
        F.count("*").cast("int").alias("vocab_size"),
        F.map_from_entries(
            F.transform(names, lambda s: F.struct(s["surface"], s["token_id"]))
        ).alias("special_tokens"),
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["token_id"].cast("string"), e["data"]))
        ).alias("vocab"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", "left", "right")))
    merges = model.merge_table(spark).agg(
        F.transform(ordered, lambda m: F.array(m["left"], m["right"])).alias("merges")
    )
    return summary.withColumn("merges", merges.scalar()).withColumn(
        "pattern", F.lit(model.pattern)
    )


def save_model(spark: SparkSession, model: BpeModel, path: str, mode: str = "errorifexists") -> None:
    artifact = artifact_table(spark, model)
    artifact.select(F.to_json(F.struct(*artifact.columns))).write.mode(mode).text(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).json(path)


def load_model(spark: SparkSession, path: str, pattern: str | None = None) -> BpeModel:
    """Merge ids follow from the layout and the order of `merges`; the stored size is not used.

    The pattern is the stored one; `pattern` stands in for files without one (cl100k if
    neither is known), and must agree with a stored one. Merges of tokens that don't exist
    yet, more ids than a model can have, and stored bytes that the merges don't make are errors.
    """
    row = load_artifact(spark, path).first()
    if row is None or row.merges is None:
        raise ValueError(f"{path} holds no merges")
    if pattern is not None and row.pattern not in (None, pattern):
        raise ValueError(f"the artifact was trained with pattern {row.pattern!r}, not {pattern!r}")
    layout = _layout_of(row.special_tokens or {}, row.vocab or {}, len(row.merges))
    merges = _checked_merges(layout, row.merges)
    model = BpeModel(layout, row.pattern or pattern or "cl100k", merges)
    _check_vocab(model, row.vocab or {})
    return model


def _checked_merges(layout: Layout, pairs: list[list[int]]) -> list[tuple[int, int, None]]:
    if pairs:
        check_vocab_size(layout, layout.merges_start + len(pairs))
    merges = []
    for new, pair in enumerate(pairs, layout.merges_start):
        known = [i for i in pair or () if i is not None and (0 <= i < 256 or layout.merges_start <= i < new)]
        if len(known) != 2 or len(pair) != 2:
            raise ValueError(f"token {new} can't be made of {pair}")
        merges.append((pair[0], pair[1], None))
    return merges


def _check_vocab(model: BpeModel, vocab: dict[str, str]) -> None:
    """Bytes and merges must be what is stored for them; names of other tokens may differ."""
    made = {token: content for token, content, kind, _ in model.vocab_rows if kind in ("byte", "merge")}
    for token, data in vocab.items():
        if not 0 <= int(token) < model.vocab_size:
            raise ValueError(f"token {token} of the stored vocabulary belongs to no merge")
        if int(token) in made and b64decode(data) != made[int(token)]:
            raise ValueError(f"token {token} is stored as {b64decode(data)!r}, but made as {made[int(token)]!r}")


def _layout_of(specials: dict[str, int], vocab: dict[str, str], n_merges: int) -> Layout:
    for layout in LAYOUTS.values():
        if specials == {name: layout.special_id(name) for name in layout.specials}:
            return layout
    return _stored_layout(specials, {int(i): b64decode(b) for i, b in vocab.items()}, n_merges)


def _stored_layout(specials: dict[str, int], vocab: dict[int, bytes], n_merges: int) -> Layout:
    """The layout of a file with special tokens of its own: bytes, perhaps bytes again as
    fallback, the special tokens without a gap, perhaps reserved ids, then merges."""
    names = sorted(specials, key=specials.get)
    start = specials[names[0]] if names else 256
    fallback = 256 if all(vocab.get(256 + i) == bytes([i]) for i in range(256)) else None
    merges_start = max(vocab, default=-1) + 1 - n_merges
    reserved = merges_start - start - len(names)
    dense = [specials[name] for name in names] == list(range(start, start + len(names)))
    if not dense or reserved < 0 or start != (256 if fallback is None else 512):
        raise ValueError(f"no layout fits the special tokens {specials} and the stored vocabulary")
    return Layout("stored", start, tuple(names), reserved, fallback)
