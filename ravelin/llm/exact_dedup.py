"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every normalised text is cut where its own characters say so; its recipe is the ordered list
of chunk identifiers. An identifier is a 64-bit hash that has been verified: the bytes of all
chunks under a hash are compared, for those documents whose recipe occurs more than once, and
documents with a hash that stands for two byte strings are told apart by their bytes. Documents are
equal when their verified lists are equal, so only chunks of likely copies move, once, merged
on the map side, and long unique documents never leave their scan task.

Defined cases: a null text counts as empty; all empty texts are one group; rows that repeat a
doc_id are compared like any others (with equal texts each of them counts in group_size and
has the same keep_id); a null doc_id loses to any other when the row to stay is chosen;
columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, small_or_plain, text_or_empty

#: Fewest and most characters of a chunk.
MIN_CHUNK, MAX_CHUNK = 256, 8192
#: Broadcast limit for recipe keys (16 bytes each).
BROADCAST_KEYS = 500_000


def _low_bits(value: int) -> str:
    """Character class of the printable ASCII characters whose low three bits are value."""
    return "[" + "".join(f"\\x{c:02x}" for c in range(32, 127) if c & 7 == value) + "]"


#: A chunk ends behind three characters whose low bits are 5, 2, 0: a 9-bit condition on
#: content alone, so the cuts of a text do not depend on what stands before them for long.
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{_low_bits(5)}{_low_bits(2)}{_low_bits(0)}|.{{1,{MAX_CHUNK}}}"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    base = docs.select("doc_id", normalised().alias("norm"))
    recipes = materialize(
        base.select(
            "doc_id",
            F.transform(chunks_of(F.col("norm")), lambda c: F.xxhash64(c)).alias("ids"),
            F.octet_length("norm").cast("long").alias("n_bytes"),
            F.sha2("norm", 256).alias("text_sha256"),
        ).withColumn("recipe", F.xxhash64("ids", "n_bytes")),
        "recipes",
    )
    likely = materialize(recipes.groupBy("recipe").count().where("count > 1").select("recipe"), "likely")
    likely = small_or_plain(likely, likely.count(), BROADCAST_KEYS)

    # Verify: within documents that share a recipe, does any hash stand for two byte strings?
    moved = (
        base.select(
            chunks_of(F.col("norm")).alias("chunks"),
            F.xxhash64(
                F.transform(chunks_of(F.col("norm")), lambda c: F.xxhash64(c)), F.octet_length("norm").cast("long")
            ).alias("recipe"),
        )
        .join(likely, "recipe", "left_semi")
        .select(F.explode("chunks").alias("chunk"))
        .select(F.xxhash64("chunk").alias("id"), "chunk")
        .groupBy("id", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ambiguous = materialize(moved.groupBy("id").count().where("count > 1").select("id"), "ambiguous-ids")
    if ambiguous.limit(1).count():
        # Two byte strings met in 64 bits. Documents with such a chunk are told apart by their bytes.
        unsure = recipes.join(likely, "recipe", "left_semi").select("recipe", F.explode("ids").alias("id")).join(ambiguous, "id", "left_semi")
        unsure = materialize(unsure.select("recipe", F.lit(True).alias("unsure")).distinct(), "unsure-recipes")
        ids = F.transform(chunks_of(F.col("norm")), lambda c: F.xxhash64(c))
        size = F.octet_length("norm").cast("long")
        again = base.select("doc_id", "norm", ids.alias("ids"), F.sha2("norm", 256).alias("text_sha256"), F.xxhash64(ids, size).alias("recipe"))
        recipes = again.join(unsure, "recipe", "left").withColumn("bytes", F.when(F.col("unsure"), F.col("norm"))).drop("unsure", "norm")
    else:
        recipes = recipes.withColumn("bytes", F.lit(None).cast("string"))

    groups = (
        recipes.join(likely, "recipe", "left_semi")
        .groupBy("recipe", "ids", "bytes")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    # Written first, so that both sides of the join are plain exchanges and a hot recipe can be split.
    groups = materialize(groups, "recipe-groups").alias("g")
    r = recipes.alias("r")
    same = (F.col("r.recipe") == F.col("g.recipe")) & (F.col("r.ids") == F.col("g.ids")) & F.col("r.bytes").eqNullSafe(F.col("g.bytes"))
    return r.join(groups, same, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
SELECT doc_id,
       coalesce(min(doc_id) OVER g, doc_id) AS keep_id,
       count(*) OVER g AS group_size,
       (coalesce(min(doc_id) OVER g, doc_id) IS NOT DISTINCT FROM doc_id) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
