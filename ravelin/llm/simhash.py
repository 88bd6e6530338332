"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64 bits, the majority of each bit over the hashes of all word shingles, counted
in codegen: 32 sums each carry the counts of two bits. Equal fingerprints are one node.

Search: a fingerprint is cut into three segments. Of two fingerprints with at most two
differing bits one segment has none (pigeonhole), and its right-hand neighbour (cyclically) at most two;
so the pair shares a key made of the error-free segment and a Golay key of the neighbour.
Keys of buckets up to BUCKET members are joined and verified. The members of larger buckets
take an exact way whose cost is linear: each also emits its 64 one-bit neighbours, and all
that meet in a word (65 at most) are within two bits of each other, while any two fingerprints
with at most two differing bits meet in some word. No bucket is cut or sampled.

Defined cases: null and empty texts have no shingles and fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows and repeated doc_ids
are rows of their own; a null doc_id never names a component unless all are null; columns other
than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from ..shipping import ship
from .common import SPACES, discard_since, materialize, release, text_or_empty, written_so_far
from .components import connected_components

#: Word count of a shingle unless told otherwise.
SHINGLE_WORDS = 5
#: Bits that linked fingerprints may differ in.
LINK_BITS = 2
#: Members of a bucket that are compared with each other; larger ones take the linear way.
BUCKET = 32
#: Width of the three segments, from the lowest bit.
SEGMENTS = (22, 21, 21)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SPACES, -1), "")


def shingle_hashes(docs: DataFrame, words: int) -> DataFrame:
    """__row, doc_id, h: a row for each shingle, and one with a null h for texts without words."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("__row"), "doc_id", words_of(text_or_empty()).alias("__words")
    )
    n = F.size("__words")
    placed = numbered.select("*", F.explode(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1)))).alias("__i"))
    parts = [F.element_at("__words", F.col("__i") + k) for k in range(words)]
    shingle = F.when(n >= words, F.concat_ws(" ", *parts)).when(n > 0, F.array_join("__words", " "))
    return placed.select("__row", "doc_id", shingle.alias("__shingle")).select(
        "__row", "doc_id", F.when(F.col("__shingle").isNotNull(), F.xxhash64("__shingle")).alias("h")
    )


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (long) for every row of docs."""
    lanes = [
        F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"__s{k}") for k in range(32)
    ]
    counted = shingle_hashes(docs, words).groupBy("__row", "doc_id").agg(F.count("h").alias("__n"), *lanes)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"__s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("__n")
        high = F.shiftrightunsigned(f"__s{k}", 32) * 2 > F.col("__n")
        fp = fp.bitwiseOR(F.when(low, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        top = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        fp = fp.bitwiseOR(F.when(high, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select("doc_id", fp.alias("fp"))


def _fuzzy_keys(batches):
    """fp -> key, fp: the error-free segment and a Golay key of its neighbour, for each segment."""
    at = np.cumsum((0, *SEGMENTS[:-1]))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        bits = fp.astype(np.int64).view(np.uint64)
        part = [((bits >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in zip(at, SEGMENTS)]
        for i in range(3):
            rows, index = golay.keys(part[(i + 1) % 3])
            key = (np.int64(i) << 34) | (part[i][rows] << 12) | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows])], names=["key", "fp"])


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> a, b: links enough to connect all fingerprints within LINK_BITS; each is verified."""
    ship(distinct.sparkSession)
    keyed = materialize(distinct.select("fp").mapInArrow(_fuzzy_keys, "key long, fp long"), "golay-keys")
    # Written first, so that both sides of the join are plain exchanges and a hot key can be split.
    buckets = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-buckets")
    member = materialize(keyed.join(buckets, "key"), "golay-members")

    small = member.where(F.col("n") <= BUCKET)
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS
    joined = a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()

    large = member.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    met = (
        large.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("meeting"))
        .agg(F.collect_set("fp").alias("fps"))  # 65 at most
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return joined.union(met)


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for every row of docs."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    release(docs.sparkSession)
    mark = written_so_far()
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    reach = connected_components(link_fingerprints(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(reach, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialize(rooted.join(named, "root").select("fp", "component_id"), "fp-components")
    discard_since(mark, names)
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, words: int = 3) -> DataFrame:
    return near_groups(docs, words).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
