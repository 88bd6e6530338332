"""Removal of repeated passages of lines by content-defined chunks (DataFrame functions only).

A text is split at line feeds. A rolling hash runs over the hashes of each two neighbouring lines. A
place is a boundary where its rolling hash is the least of some two neighbouring places (the first and the last
place of a text are boundaries too). So boundaries follow the lines alone, whatever stands further away, and no two
places in a row are passed over. The chunks of a boundary are its two lines, and these with the
line before and with the line behind.

A chunk that stood earlier, in (doc_id, text, line) order, is repeated. Hashes only choose what is
compared: chunks are repeated because their bytes equal. A passage of three or more lines that two texts share holds a
boundary in both, its chunks leave no line of it uncovered, and the three-line chunks
reach its first and last line; so it is found whole whatever its neighbours are. One of two lines is found where
its rolling hash is a boundary in both texts, in about half of all cases.

Repeated chunks that overlap or touch are one passage. A passage goes if it holds CONTENT letters and digits or more; blank
lines, rules, braces and the like stay. A chunk that overlaps the first one of its kind (a line
said three times) stays, and so does the first place of any line.

Cuts go back to their row by doc_id and a hash of its text.

Defined cases: a null text stays null and has no lines; an empty text is one empty line and
stays; rows that repeat a doc_id and its text are one document (what is first in one is first in all),
other texts of one id are documents of their own; a null doc_id comes before all others; other
columns, whatever their names, are carried; an empty table gives an empty result. A line whose neighbours both differ is never removed, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, small_or_plain

#: Modulus and multiplier of the rolling hash.
MODULUS, BASE = 2**31 - 1, 1_000_003
#: Letters and digits that a passage must hold to be removed.
CONTENT = 40
#: Broadcast limits for repeated chunk hashes (8 bytes each), and for texts with cuts and their cuts.
BROADCAST_KEYS, BROADCAST_TEXTS, BROADCAST_CUTS = 500_000, 50_000, 200_000


def _shifted(a: str, by: int) -> Column:
    """Array a moved one place on (1) or back (-1), null where it opens."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    gap = F.array(F.lit(None))
    return F.concat(gap, F.slice(a, F.lit(1), n)) if by > 0 else F.concat(F.slice(a, F.lit(2), n), gap)


def boundaries(docs: DataFrame) -> DataFrame:
    """doc_id, text_h (a hash of the text), start, a, b (the two lines of a boundary), before, after (the lines around them or null)."""
    text = docs.select("doc_id", F.xxhash64("text").alias("text_h"), F.split("text", "\n", -1).alias("lines"))
    # The generators keep what they give from being computed again for each use below.
    pinned = lambda df, *columns: df.select(F.explode(F.array(F.struct(*columns))).alias("r")).select("r.*")
    n = F.greatest(F.size("lines") - 1, F.lit(0))
    hashed = pinned(text, "doc_id", "text_h", "lines", F.transform("lines", lambda x: F.xxhash64(x) % MODULUS).alias("h"))
    roll = F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), lambda x, y: F.pmod(x * BASE + y, F.lit(MODULUS)))
    rolled = pinned(hashed, "doc_id", "text_h", "lines", roll.alias("roll"))
    each = F.arrays_zip(
        F.slice("lines", F.lit(1), n).alias("a"), F.slice("lines", F.lit(2), n).alias("b"),
        _shifted("lines", 1).alias("before"), F.slice("lines", F.lit(3), n).alias("after"),
        F.col("roll").alias("roll"), _shifted("roll", 1).alias("left"), _shifted("roll", -1).alias("right"),
    )
    # Places and not lines go through the last generator: no row carries its whole text.
    places = rolled.where(F.size("roll") > 0).select("doc_id", "text_h", F.posexplode(F.slice(each, F.lit(1), F.size("roll"))).alias("start", "p"))
    least = (F.col("p.roll") <= F.col("p.left")) | (F.col("p.roll") <= F.col("p.right"))
    return places.where(F.coalesce(least, F.lit(True))).select("doc_id", "text_h", "start", "p.a", "p.b", "p.before", "p.after")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_h, start, n (lines) of every chunk to remove."""
    found = boundaries(docs).withColumn("h", F.xxhash64("a", "b"))
    keys = materialize(found.groupBy("h").count().where("count > 1").select("h"), "line-keys")
    keys = small_or_plain(keys, keys.count(), BROADCAST_KEYS)
    likely = found.join(keys, "h", "left_semi")
    chunk = lambda start, *lines: F.struct(F.lit(len(lines)).alias("n"), F.lit(start).alias("from"), F.concat_ws("\n", *lines).alias("chunk"))
    variants = F.array(
        chunk(0, "a", "b"), F.when(F.col("before").isNotNull(), chunk(-1, "before", "a", "b")), F.when(F.col("after").isNotNull(), chunk(0, "a", "b", "after"))
    )
    # Chunks of one boundary are told apart by where they begin beside it.
    chunks = likely.select("doc_id", "text_h", "start", F.explode(F.array_compact(variants)).alias("c")).select(
        "doc_id", "text_h", (F.col("start") + F.col("c.from")).alias("start"), "c.n", "c.chunk", F.xxhash64("c.n", "c.chunk").alias("h")
    )
    # Written first, so that both sides of the join are plain exchanges and a hot chunk can be split.
    classes = materialize(
        chunks.groupBy("h", "n", "chunk")
        .agg(F.min(F.struct("doc_id", "text_h", "start")).alias("first"), F.count(F.lit(1)).alias("m"))
        .where("m > 1")
        .select("h", "n", "chunk", "first"),
        "line-classes",
    )
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_h") == F.col("first.text_h"))
    gone = (
        chunks.join(classes, ["h", "n", "chunk"])
        .where(~here | (F.col("start") - F.col("first.start") >= F.col("n")))
        .select("doc_id", "text_h", "start", "n")
    )
    gone = materialize(gone, "line-repeats")
    discard(classes)
    return gone


def line_dedup(docs: DataFrame, count: str | None = None) -> DataFrame:
    """docs with the repeated passages taken out of text; count names a column for the number of passages taken."""
    repeats = repeated_chunks(docs)
    lines = repeats.select("doc_id", "text_h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line"))
    covered = lines.groupBy("doc_id", "text_h").agg(F.sort_array(F.collect_set("line")).alias("s"))  # a text's own lines at most
    begins = F.filter("s", lambda x, k: (k == 0) | (x - F.get("s", k - 1) > 1))
    ends = F.transform(F.filter("s", lambda x, k: (k == F.size("s") - 1) | (F.get("s", k + 1) - x > 1)), lambda x: x + 1)
    gone = materialize(covered.select(F.col("doc_id").alias("id"), "text_h", F.arrays_zip(begins.alias("start"), ends.alias("end")).alias("gone")), "line-cuts")
    discard(repeats)
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("cuts")).first()
    if size["cuts"] <= BROADCAST_CUTS:
        gone = small_or_plain(gone, size["n"], BROADCAST_TEXTS)
    same = docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["text_h"])
    return _without(docs, gone, same, count)


def _without(docs: DataFrame, gone: DataFrame, same, count: str | None) -> DataFrame:
    """docs without the line ranges of gone(.., gone: array of (start, end)) that hold enough."""
    lines, number = free_name(docs, "lines"), free_name(docs, "gone")
    own = [docs[c] for c in docs.columns]
    # Lines and ranges go through generators so that they are computed once and not in the lambdas below.
    split = docs.join(gone, same, "left").select(
        *own, gone["gone"].alias(number), F.explode(F.array(F.when(gone["gone"].isNotNull(), F.split(docs["text"], "\n", -1)))).alias(lines)
    )
    passage = lambda r: F.array_join(F.slice(lines, r["start"] + 1, r["end"] - r["start"]), "\n")
    enough = F.filter(number, lambda r: F.length(F.regexp_replace(passage(r), r"[^\p{L}\p{N}]+", "")) >= CONTENT)
    cut = split.select(*docs.columns, lines, F.explode(F.array(F.when(F.size(enough) > 0, enough))).alias(number))
    stays = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col(f"{number}.end")).alias("start"),
        F.concat(F.col(f"{number}.start"), F.array(F.size(lines))).alias("end"),
    )
    kept = F.array_join(F.flatten(F.transform(stays, lambda r: F.slice(lines, r["start"] + 1, r["end"] - r["start"]))), "\n")
    text = F.when(F.col(number).isNull(), F.col("text")).otherwise(kept)
    removed = F.coalesce(F.when(F.col(number).isNotNull(), F.size(number)), F.lit(0)).cast("long")
    return cut.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *([removed.alias(count)] if count else []))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_removed, n_lines_kept, kept_sha256."""
    out = line_dedup(docs.select("doc_id", "text"), count="n_removed")
    return out.select(
        "doc_id",
        "n_removed",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
