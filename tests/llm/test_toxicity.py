import random
import time
import zlib

from ravelin.llm import toxicity as X


def corpus(rng, n=400):
    """Invented prose; toxic texts carry insults, or words of two made-up stems in a second language."""
    words = ["".join(rng.choice(["ta", "re", "mo", "li", "su", "no"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                bad = rng.choice(["idiot", "scum"]) if i % 2 else rng.choice(["gruzka", "vrodel"]) + rng.choice(["ta", "no", "li"])
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(documents, spark):
    rows, labels = corpus(random.Random(1))
    got = X.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 0.05 * len(held)


def test_labels_of_the_held_out_fold_do_not_matter(documents, spark):
    rows, labels = corpus(random.Random(2), 200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    run = lambda ls: sorted((r.doc_id, round(r.score, 9)) for r in X.toxicity(documents(rows), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert run(labels) == run(flipped)


def grammar():
    insults, threats = X.seeds()
    return X.Grammar(insults, {}, threats)


def marks(text):
    return [X.reading(m) for _, m, _ in grammar().read(text.lower())]


def test_readings():
    assert marks("some idiot walked by slowly over there") == ["plain"]
    assert marks("you are an idiot") == ["aimed"]
    assert marks("what a stupid thing of you") == ["aimed"]
    assert marks("nobody is an idiot here") == ["negated"]
    assert marks("the paper wrote that a clown came") == ["reported"]
    assert marks('the word "scum" is old') == ["reported"]
    assert marks("not so far away from here lives one moron") == ["plain"]
    assert marks("clean words only") == []


def test_insults_and_threats_are_told_apart():
    read = lambda t: [(k, X.reading(m), w) for k, m, w in grammar().read(t)]
    assert read("you idiot") == [("insult", "aimed", 1.5)]
    assert read("somebody may hurt the old clown") == [("threat", "plain", 1.5), ("insult", "plain", 1.5)]
    assert read("i will hurt you") == [("threat", "aimed", 2.25)]
    assert read("he said i will kill a moron") == [("threat", "reported", 2.25), ("insult", "reported", 1.5)]


def all_paths(machine, symbols):
    """(weight, output) of every path, without dynamic programming."""
    paths = [(0.0, [], machine.start)]
    for s in symbols:
        paths = [(w + v, [*out, o], to) for w, out, state in paths for o, v, to in machine.arcs(state, s)]
    return [(w + machine.final(state), out) for w, out, state in paths]


def test_best_path_is_the_best_of_all():
    """Of the composed machine, and of its parts run one after the other on all outputs."""
    g, rng = grammar(), random.Random(4)
    words = "you idiot hurt not said will clown \" the a them scum kill".split()
    for _ in range(300):
        symbols = [("word", X.PLAIN_MARK, rng.choice(words)) for _ in range(rng.randint(0, 9))]
        weight, out = g.machine.best_path(symbols)
        paths = all_paths(g.machine, symbols)
        assert abs(weight - max(w for w, _ in paths)) < 1e-12 and (weight, out) in paths
        chained = [(0.0, symbols)]
        for part in g.parts:
            chained = [(w + v, o) for w, s in chained for v, o in all_paths(part, s)]
        assert abs(weight - max(w for w, _ in chained)) < 1e-12


def test_long_text_without_clause_marks():
    g = grammar()
    begin = time.perf_counter()
    g.features("idiots of the town " * 20_000)  # "idiots" is no entry but begins like one
    g.features("the idiot went. " * 20_000)
    assert time.perf_counter() - begin < 30


def test_edges(edge, none, spark):
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0), (3, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = X.toxicity(edge, labels).collect()
    assert len(got) == edge.count()
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 7)) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert X.toxicity(none, labels.limit(0)).count() == 0
    out = X.reject_toxic(edge, labels.limit(0))
    assert out.columns == edge.columns and out.count() == edge.count()
