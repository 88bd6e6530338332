"""Secret scan (DataFrame functions only).

Three fixed kinds come from patterns. Besides them, runs of token characters become candidates
whose Shannon entropy is taken in a sliding window, per character class (hexadecimal, base 64):
the counts of the window's characters and the sum of n*log2(n) over them are carried from one
position to the next (five bits a character in a few long words), so a step costs the two
characters that come and go. A candidate whose
best window passes the threshold of a class is a span of kind entropy, unless it overlaps a
span of a fixed kind or the allow-list explains it.

Positions come from the pieces between matches: lengths of pieces and matches add up to code
point offsets, so one split and one extraction give every span without leaving the JVM. What
is carried from match to match is gathered in blocks within blocks, so a text's cost stays
near its length however many matches it has.

Defined cases: a null text counts as empty; an empty text has no spans; every row is scanned
by itself, so repeated rows give equal results; a null doc_id is returned as it is; columns
other than doc_id and text are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_or, text_or_empty

# Patterns of the base kinds in their order; failing matches are dropped after
# matching where a shorter pattern could match elsewhere (assign), else the length is in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates of the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of the sliding window, and the bits a window of each class must reach.
WINDOW = 20
HEX_BITS, BASE64_BITS = 3.2, 3.75
HEX_CLASS = "0123456789abcdef"
BASE64_CLASS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="

#: Candidates that are no secrets: without digit or without letter, UUIDs, placeholders, paths.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0{8}|1234567",
    r"^[/_=+-]*[a-z]+([/_-][a-z]+)*[/_=-]*[0-9]{0,4}$",
)
#: The last of them without a repeated group, which would recurse for each word of a long path: a
#: path by its characters, and two separators in a row between its words.
PATH, BROKEN_PATH = r"^[/_=+-]*+[a-z][a-z/_-]*+[/_=-]*+[0-9]{0,4}+$", r"[a-z][/_-]{2,}[a-z]"
#: Matches are gathered in blocks within blocks, so deep.
LEVELS = 1
SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


def running(items: Column, at: Column, step, kind: str, levels: int = LEVELS) -> Column:
    """struct(at, out): step(at, item) -> (next at, emitted), with what is emitted in out, an array
    of type kind. One array that grows by each item would be copied for each; here blocks of
    items give arrays of their own, which are joined. items must be a plain column."""
    start = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
    if not levels:

        def put(acc, x):
            after, emitted = step(acc["at"], x)
            return F.struct(after.alias("at"), F.concat(acc["out"], F.array(emitted)).alias("out"))

        return F.aggregate(items, start, put)
    n = F.size(items)
    width = F.ceil(F.pow(n, F.lit(levels / (levels + 1)))).cast("int")

    def block(acc, first):
        # The part is bound by a lambda, so that it is sliced once.
        part = F.transform(F.array(F.slice(items, first, width)), lambda p: running(p, acc["at"], step, kind, levels - 1))
        joined = F.transform(part, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))
        return F.element_at(joined, 1)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n, width)).otherwise(F.array().cast("array<int>")), start, block)


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, m>>: the leftmost non-overlapping matches, and the lengths of the pieces before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    return F.when(text.rlike(pattern), pairs).otherwise(F.array().cast("array<struct<gap:int,m:string>>"))


def spans_of(pairs: Column, kind: int, ok=None) -> Column:
    """array<struct<start, kind, end, found>> of matches, from their pieces()."""

    def step(at, x):
        begin = at + x["gap"]
        end = begin + F.length(x["m"])
        return end, F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("found"))

    spans = running(pairs, F.lit(0), step, SPANS)["out"]
    return F.filter(spans, ok) if ok else spans


def window_entropy(candidate: Column, alphabet: str) -> Column:
    """Bits of the candidate's best window whose characters are all in alphabet; 0 if there is none."""
    per_word = 12  # counts up to WINDOW take five bits each
    words = -(-(len(alphabet) + 1) // per_word)

    def place(i):
        """The word and the shift of a character's count."""
        return F.floor(i / per_word).cast("int"), (F.pmod(i, F.lit(per_word)) * 5).cast("int")

    index = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    before = F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), index)

    def move(new, old):
        (w, s), (v, t) = place(new), place(old)
        return F.struct(new.alias("new"), w.alias("w"), s.alias("s"), old.alias("old"), v.alias("v"), t.alias("t"))

    moves = F.zip_with(index, F.slice(before, F.lit(1), F.size(index)), move)
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s)
    of = lambda n, w, s: F.call_function("shiftright", F.get(n, w), s).bitwiseAND(F.lit(31))
    zero = F.lit(0).cast("long")
    start = F.struct(F.array_repeat(zero, words).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"))

    def step(acc, m):
        same = m["new"].eqNullSafe(m["old"])
        counts = F.transform(
            acc["n"], lambda x, k: x + F.when(k == m["w"], bit(m["s"])).otherwise(zero) - F.when(k.eqNullSafe(m["v"]), bit(m["t"])).otherwise(zero)
        )
        came, went = of(acc["n"], m["w"], m["s"]), of(acc["n"], m["v"], m["t"])
        gone = F.when(m["old"].isNull(), F.lit(0.0)).otherwise(weight(went) - weight(went - 1))
        total = acc["sum"] - weight(came) + weight(came + 1) - gone
        return F.struct(
            F.when(same, acc["n"]).otherwise(counts).alias("n"),
            F.when(same, acc["sum"]).otherwise(total).alias("sum"),
            (acc["seen"] + 1).alias("seen"),
            acc["best"].alias("best"),
        )

    def scored(acc, m):
        def best(now):
            bits = F.log2(F.lit(float(WINDOW))) - now["sum"] / F.lit(float(WINDOW))
            inside = (now["seen"] >= WINDOW) & (of(now["n"], F.lit(0), F.lit(0)) == 0)
            return F.struct(now["n"].alias("n"), now["sum"].alias("sum"), now["seen"].alias("seen"), F.when(inside, F.greatest(now["best"], bits)).otherwise(now["best"]).alias("best"))

        # The step is bound by a lambda, so that it is taken once.
        return F.element_at(F.transform(F.array(step(acc, m)), best), 1)

    return F.aggregate(moves, start, scored, lambda acc: acc["best"])


def _held(df: DataFrame) -> DataFrame:
    """df behind a generator, which keeps its expressions from being copied into those that use them."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, found) in (start, kind) order."""
    text = text_or_empty()
    found = _held(
        docs.select(
            "doc_id", pieces(text, ASSIGN).alias("assign"), pieces(text, ACCESS).alias("access"), pieces(text, HEX).alias("hex"), pieces(text, CANDIDATE).alias("run")
        )
    )
    fixed = _held(
        found.select(
            "doc_id",
            F.array_sort(
                F.concat(
                    spans_of(F.col("assign"), 0, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 8),
                    spans_of(F.col("access"), 1),
                    spans_of(F.col("hex"), 2),
                )
            ).alias("base"),
            spans_of(F.col("run"), 3, lambda s: ~s["found"].rlike("|".join(ALLOWED[:2]))).alias("runs"),
        )
    )
    both = _held(fixed.select("doc_id", "base", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", "runs"))).otherwise(F.array().cast(SPANS)).alias("all")))
    # A run is free if no base span before it reaches into it and the next span is not a base one that begins in it.
    reach = running(F.col("all"), F.lit(0), lambda at, s: (F.when(s["kind"] < 3, F.greatest(at, s["end"])).otherwise(at), at), "array<int>")["out"]
    free = F.filter(
        F.zip_with("all", F.zip_with(reach, F.slice("all", F.lit(2), F.size("all")), lambda r, s: F.struct(r.alias("reach"), s.alias("next"))),
                   lambda s, x: F.when((s["kind"] == 3) & (x["reach"] <= s["start"])
                                       & ~F.coalesce((x["next"]["kind"] < 3) & (x["next"]["start"] < s["end"]), F.lit(False)), s)),
        lambda s: s.isNotNull(),
    )
    suspicious = F.filter(
        free,
        # One by one: joined, the (?i) of a pattern would reach into those behind it.
        lambda s: ~fold_or([s["found"].rlike(p) for p in ALLOWED[2:4]])
        & ~(s["found"].rlike(PATH) & ~s["found"].rlike(BROKEN_PATH))
        & (
            (window_entropy(s["found"], HEX_CLASS) >= HEX_BITS)
            | (window_entropy(s["found"], BASE64_CLASS) >= BASE64_BITS)
        ),
    )
    return both.select("doc_id", "base", F.array_sort(F.concat("base", suspicious)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return scan(docs).select(
        "doc_id",
        *counts,
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def _oracle() -> str:
    def spans(kind: int, pattern: str, extra: str) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {kind} AS kind, m[i] AS found, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))){extra}"""

    assign = ASSIGN.replace("'", "''")
    bits = f"log2({WINDOW}) - list_sum(list_transform(list_distinct(string_split(w, '')), lambda y: len(list_filter(string_split(w, ''), lambda x: x = y)) * log2(len(list_filter(string_split(w, ''), lambda x: x = y))))) / {WINDOW}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({spans(0, ASSIGN, "")}) WHERE length(regexp_extract(found, '{assign}', 1)) >= 8
UNION ALL {spans(1, ACCESS, "")} UNION ALL {spans(2, HEX, "")}),
candidates AS (SELECT * FROM ({spans(3, CANDIDATE, "")}) WHERE {" AND ".join(f"NOT regexp_matches(found, '{p}')" for p in ALLOWED)}),
free AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.start + length(c.found) AND c.start < b.start + length(b.found))),
windows AS (SELECT doc_id, start, found, substring(found, i, {WINDOW}) AS w FROM (SELECT *, unnest(generate_series(1, length(found) - {WINDOW - 1})) AS i FROM free)),
entropy AS (SELECT DISTINCT doc_id, 3 AS kind, found, start FROM windows WHERE ({bits}) >= CASE WHEN regexp_matches(w, '^[0-9a-f]+$') THEN {HEX_BITS} ELSE {BASE64_BITS} END),
spans AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || (start + length(found)) AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM entropy))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLE = _oracle()
