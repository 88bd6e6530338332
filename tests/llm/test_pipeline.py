import random

import corpus_pipeline as P
from tests.conftest import TESTDATA


def test_stages_are_the_pipeline(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, TESTDATA)
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= kept
        kept = n
    last = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in P.pack(spark, docs, TESTDATA).collect()}
    assert last == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in P.run(spark, TESTDATA).collect()}
    assert {x[0] for x in last} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages_against_brute_force(spark, documents):
    """Each stage on what its predecessor kept, against the rule it follows, written out."""
    from ravelin.llm import decontamination as D
    from ravelin.llm import toxicity
    from tests.llm.test_exact_and_lines import brute_lines
    from tests.llm.test_near import Sets, shingles
    from tests.llm.test_search_and_repeats import distance

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [r.text for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    passage = [line(9) for _ in range(4)]
    pairs = []
    for i in range(0, 60, 2):
        body = [line(12) for _ in range(rng.randint(2, 6))]
        if i % 6 == 0:
            body[1:1] = passage
        if i % 10 == 0:
            body.append(items[i // 10 % 4].upper() if i % 20 else items[i // 10 % 4] + " more words")
        pairs.append((i, "\n".join(body)))
        if i % 4 == 0:
            words = " ".join(body).split(" ")
            words[len(words) // 2] = "changed"
            pairs.append((i + 1, " ".join(words)))
    pairs += [(100, None), (101, ""), (102, "x"), (103, "you stupid idiot i will kill you")]
    docs, stages = documents(pairs), dict(P.STAGES)
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = stages["toxicity"](spark, docs, TESTDATA)
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert rows(kept) == {i: t for i, t in pairs if i not in bad}

    before, kept = rows(kept), stages["line_dedup"](spark, kept, TESTDATA)
    want = {i: t for i, t, _ in brute_lines([(i, t) for i, t in before.items() if t is not None])}
    assert rows(kept) == {i: want.get(i) for i in before} and want != {i: t for i, t in before.items() if t is not None}

    before, kept = rows(kept), stages["near_dedup"](spark, kept, TESTDATA)
    sets = {i: set(shingles(t, 5)) for i, t in before.items()}
    groups = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and (not sets[a] and not sets[b] or sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                groups.join(a, b)
    assert rows(kept) == {i: t for i, t in before.items() if groups.find(i) == i} and len(rows(kept)) < len(before) - 5

    before, kept = rows(kept), stages["decontamination"](spark, kept, TESTDATA)
    plain = [D.normalise(t).decode() for t in items]
    clean = {i: t for i, t in before.items() if all(distance(x, D.normalise(t or "").decode()) > int(len(x) * D.EDITS) for x in plain)}
    assert rows(kept) == clean and len(clean) < len(before)

    placed = stages["packing"](spark, kept, TESTDATA).collect()
    assert {r.doc_id for r in placed} == set(clean)
    for seq in {r.sequence_id for r in placed}:
        own = sorted((r.offset, r.length) for r in placed if r.sequence_id == seq)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_stages_take_edge_rows(spark, edge, none):
    for start in (edge, none):
        docs = start
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, TESTDATA)
            assert docs.columns == start.columns
        left = docs.select("doc_id", "text").collect()
        assert P.pack(spark, docs, TESTDATA).select("doc_id").distinct().count() == len({r.doc_id for r in left})
    # Of the empty and null texts one stays, of the two rows that are one document both or none.
    docs = P.dedup_near(spark, edge, TESTDATA)
    ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
    assert ids.count(1) + ids.count(2) + ids.count(7) == 1 and None in ids and ids.count(4) in (0, 2)
