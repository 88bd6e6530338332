import hashlib
import re
import random

import xxhash
from pyspark.sql import functions as F

from ravelin.llm import exact_dedup, line_dedup

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_exact(pairs):
    norm = [(i, SPACE.sub(" ", t or "")) for i, t in pairs]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        ids = [j for j in same if j is not None]
        keep = min(ids) if ids else i
        out.append((i, keep, len(same), keep == i, hashlib.sha256(t.encode()).hexdigest()))
    return out


def as_tuples(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_exact_edges(edge, none):
    from tests.llm.conftest import EDGE

    assert as_tuples(exact_dedup.exact_groups(edge)) == sorted(brute_exact(EDGE), key=str)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_random(documents):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    pairs = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "\n", "  "]))) for i in range(120)]
    assert as_tuples(exact_dedup.exact_groups(documents(pairs))) == sorted(brute_exact(pairs), key=str)


def test_equal_hashes_are_told_apart_by_bytes(documents, monkeypatch):
    """With a hash of three values nearly all chunks collide; groups must not change."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 3)
    pairs = [(i, f"text {i % 5}") for i in range(40)]
    assert as_tuples(exact_dedup.exact_groups(documents(pairs))) == sorted(brute_exact(pairs), key=str)


def test_chunks_lose_nothing(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh jkmnzé") for _ in range(30_000))
    df = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks_of(F.col("t")).alias("c"))
    chunks = df.first().c
    assert "".join(chunks) == text
    assert max(map(len, chunks)) <= exact_dedup.MAX_CHUNK and len(chunks) > 10


def line_hash(x):
    """Spark's hash of a line, modulo as there (the sign stays)."""
    v = xxhash.xxh64_intdigest(x.encode(), 42)
    v = v - (1 << 64) if v >> 63 else v
    return abs(v) % line_dedup.MODULUS * (1 if v >= 0 else -1)


def boundaries(lines):
    """Places whose rolling hash is the least of some two neighbours."""
    h = [line_hash(x) for x in lines]
    roll = [(a * line_dedup.BASE + b) % line_dedup.MODULUS for a, b in zip(h, h[1:])]
    return [k for k, r in enumerate(roll) if k in (0, len(roll) - 1) or r <= roll[k - 1] or r <= roll[k + 1]]


def brute_lines(pairs):
    """(doc_id, text, passages) by the rule, chunk after chunk in order."""
    first, repeats = {}, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0])):
        lines = t.split("\n")
        for k in boundaries(lines):
            for a, e in ((k, k + 2), (k - 1, k + 2), (k, k + 3)):
                if a >= 0 and e <= len(lines):
                    chunk = tuple(lines[a:e])
                    first[chunk] = min(first.get(chunk, (i, a)), (i, a))
                    repeats.append((i, a, e, chunk))
    out = []
    for i, t in pairs:
        lines, gone = t.split("\n"), set()
        for d, a, e, chunk in repeats:
            if d == i and (first[chunk][0] != i or a - first[chunk][1] >= e - a):
                gone |= set(range(a, e))
        cut, runs = set(), 0
        for start in (k for k in gone if k - 1 not in gone):
            end = next(k for k in range(start, len(lines) + 1) if k not in gone)
            if sum(c.isalnum() for x in lines[start:end] for c in x) >= line_dedup.CONTENT:
                cut |= set(range(start, end))
                runs += 1
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in cut), runs))
    return sorted(out)


def lines_of(docs):
    return sorted((r.doc_id, r.text, r.n_passages) for r in line_dedup.line_dedup(docs, count="n_passages").collect())


def test_lines_edges(edge, none):
    out = line_dedup.line_dedup(edge)
    assert out.columns == edge.columns
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id in (1, 2, 3)} == {1: None, 2: "", 3: "a"}
    assert out.count() == edge.count()
    assert line_dedup.digest(none).count() == 0
    assert line_dedup.digest(edge).count() == edge.count()


def test_passages_between_different_neighbours(documents):
    """Shared passages of 3 to 9 lines go whole, whatever stands around them."""
    pairs, want = [], []
    for n in range(3, 10):
        for copy in range(3):
            i = n * 10 + copy
            own = [f"own {i} {k}" for k in range(6)]
            shared = [f"shared line {n} {k} of some length" for k in range(n)]
            pairs.append((i, "\n".join([*own[: copy + 1], *shared, *own[copy + 1 :]])))
            want.append(pairs[-1] + (0,) if copy == 0 else (i, "\n".join(own), 1))
    assert lines_of(documents(pairs)) == want
    digest = {r.doc_id: (r.n_removed, r.n_lines_kept) for r in line_dedup.digest(documents(pairs)).collect()}
    assert digest == {i: (n, t.count("\n") + 1) for i, t, n in want}


def test_recall_of_short_passages(documents):
    """Lines of passages of 2 to 10 lines removed from texts with other neighbours, by length."""
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4))
    pairs, shared = [], {}
    for n in range(2, 11):
        for k in range(60):
            passage = [line() for _ in range(n)]
            for copy in range(2):
                i = (n * 100 + k) * 2 + copy
                pairs.append((i, "\n".join([*(line() for _ in range(rng.randint(2, 5))), *passage, *(line() for _ in range(rng.randint(2, 5)))])))
            shared[i] = (n, set(passage))
    left = {i: set(t.split("\n")) for i, t, _ in lines_of(documents(pairs))}
    found = {n: sum(len(p - left[i]) for i, (m, p) in shared.items() if m == n) / (60 * n) for n in range(2, 11)}
    assert all(found[n] == 1.0 for n in range(3, 11)), found
    assert found[2] >= 0.35 and sum(found.values()) / len(found) >= 0.9, found


def test_little_content_stays(documents):
    """Blank lines, rules, braces and short closing lines are no passages."""
    pairs = [(1, "alpha one\n\n\nbeta one"), (2, "gamma two\n\n\ndelta two"), (3, "Title A\n---\n\nBody 6"), (4, "Title B\n---\n\nBody 7"),
             (5, "f(x) {\n  a: {\n    b: 1\n  },\n  },\n}"), (6, "g(y) {\n  c: {\n    d: 2\n  },\n  },\n}"), (7, "own\nthe end\nof it"), (8, "else\nthe end\nof it")]
    assert lines_of(documents(pairs)) == [(i, t, 0) for i, t in pairs]


def test_lines_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "CONTENT", 12)
    rng = random.Random(8)
    blocks = [[f"line {b} {k}" for k in range(rng.randint(1, 9))] for b in range(12)]
    pairs = [(1, "\n".join(["again"] * 50)), (2, "x\n" + "\n".join(["again"] * 30) + "\ny"), (3, "z\nz\nz"), (4, "a\nb\na\nb\na"), (5, "")]
    for i in range(10, 70):
        lines = [x for _ in range(rng.randint(0, 5)) for x in rng.choice(blocks)]
        lines.insert(rng.randint(0, len(lines)), f"own {i}")
        pairs.append((i, "\n".join(lines)))
    want = brute_lines(pairs)
    assert want[0][1].count("again") == 2 or want[0][1].count("again") == 3
    assert want[2:5] == [(3, "z\nz\nz", 0), (4, "a\nb\na\nb\na", 0), (5, "", 0)] and sum(w[2] for w in want) > 40
    assert lines_of(documents(pairs)) == want
    # Equal hashes are told apart by bytes.
    real = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: real(*c) % 3 if len(c) == 2 else real(*c))
    assert lines_of(documents(pairs)) == want
    # The same where neither keys nor cuts are broadcast.
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_CUTS", -1)
    assert lines_of(documents(pairs)) == want


def test_lines_of_rows_with_one_id(documents):
    """Cuts of one row stay out of another with its id."""
    unique = "\n".join(f"own line {i}" for i in range(40))
    block = "\n".join(f"shared {i}" for i in range(30))
    out = line_dedup.line_dedup(documents([(1, block), (2, block), (2, unique)])).collect()
    assert unique in [r.text for r in out] and len(out) == 3 and block not in [r.text for r in out if r.doc_id == 2]


def test_repeated_rows_and_null_ids(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "CONTENT", 3)
    same = "p\nq\nr"
    got = sorted(r.text for r in line_dedup.line_dedup(documents([(1, same), (1, same), (1, "own\n" + same)])).collect())
    assert got in (["own", same, same], ["", "", "own\n" + same])
    got = sorted(r.text for r in line_dedup.line_dedup(documents([(None, same), (None, "u\nv\nw"), (3, "s\n" + same)])).collect())
    assert got == sorted([same, "u\nv\nw", "s"])
