import random

import pytest

from ravelin.llm import decontamination as D
from ravelin.llm import suffix_dedup as S


def brute(pairs):
    return {i: x for i, x in S.brute_force([(i, t or "") for i, t in pairs]).items()}


def run(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(df).collect()}


def repetitive(rng):
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 120))) for _ in range(8)]
    pairs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5 and p:
                p[rng.randrange(len(p))] = "#"
            parts += ["".join(p), rng.choice(words)]
        pairs.append((i * 7 % 61, " ".join(parts)))
    return pairs + [(100, "ab" * 400), (101, "ab" * 90 + "c"), (102, "a" * 99), (103, "a" * 100), (104, "a" * 101), (105, "")]


@pytest.mark.parametrize("group, hot", [(50_000, 2_000), (2, 2_000), (50_000, 2)])
def test_removal_is_exact(documents, monkeypatch, group, hot):
    """As it is, with groups ranked by their windows, and with hot ranks known from the sample."""
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SEEN", min(hot, S.SEEN))
    monkeypatch.setattr(S, "TOGETHER", 10)
    pairs = repetitive(random.Random(group))
    assert run(documents(pairs)) == brute(pairs)


def test_long_document_in_blocks(documents, monkeypatch):
    """A document longer than a block, with a repeat that crosses the block's edge."""
    monkeypatch.setattr(S, "BLOCK", 5000)
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghij") for _ in range(12_000))
    pairs = [(1, body), (2, body[4800:5300]), (3, "x" + body[100:400] + "y" + body[11_000:])]
    assert run(documents(pairs)) == brute(pairs)


def test_ids_of_other_types_and_shared_ids(spark):
    """Names as ids, and one null id over thousands of different texts, in the order of their numbers."""
    pairs = repetitive(random.Random(5))
    named = spark.createDataFrame([(f"n{i:04d}", t) for i, t in pairs], "doc_id string, text string")
    assert {int(i[1:]): x for i, x in run(named).items()} == brute(pairs)
    rng = random.Random(6)
    same = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(None, f"{i} {'' if i % 100 else same}") for i in range(20_000)] + [(3, same)]
    got = [(r.doc_id, r.n_removed) for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and sum(n >= 300 for _, n in got) == 200 and (3, 300) in got


def test_repeat_edges(edge, none, documents):
    assert S.digest(none).count() == 0
    assert S.digest(edge).count() == edge.count()
    rng = random.Random(1)
    same = "".join(rng.choice("abcdef") for _ in range(300))
    # Rows with equal id and text are one document; different texts of one id are its parts.
    got = sorted((r.doc_id, r.n_removed) for r in S.digest(documents([(1, same), (1, same), (2, same)])).collect())
    assert got == [(1, 0), (1, 0), (2, 300)]
    got = sorted((r.doc_id, r.n_removed) for r in S.digest(documents([(1, same), (1, same + "!"), (None, same)])).collect() if r.doc_id)
    assert got == [(1, 300), (1, 300)]


def distance(item, text):
    """Least edits of item against any stretch of text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def edited(rng, s, k):
    z = list(s)
    for _ in range(k):
        p = rng.randrange(len(z))
        match rng.randrange(3):
            case 0:
                z[p] = "q"
            case 1:
                del z[p]
            case 2:
                z.insert(p, "z")
    return "".join(z)


def test_search_against_edit_distance(documents, spark):
    rng = random.Random(12)
    words = ["tion", "the", "er", "and", "ing", "re", "on", "st", "ha", "é"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 30, 60])))) for i in range(14)] + [(90, None), (91, ""), (92, "abc")]
    pairs = []
    for i in range(60):
        host = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        text = items[i % 14][1]
        k = rng.randint(0, 2 + int(0.05 * len(text)))
        pairs.append((i, f"{host}\n {edited(rng, text, k).upper()}  {host}" if i % 3 else host))
    got = {(r.doc_id, r.item_id): r.edits for r in D.contamination(documents(pairs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in pairs:
        for i, x in items:
            item = D.normalise(x or "")
            k = int(len(item) * D.EDITS)
            e = distance(item, D.normalise(t))
            if item and e <= k:
                want[d, i] = e
    assert got == want and len(want) > 10


def test_items_in_blocks(documents, spark, monkeypatch):
    items = spark.createDataFrame([(i, f"passage number {i} with enough words to be found") for i in range(6)], "item_id long, text string")
    docs = documents([(i, f"before passage number {i} with enough words to be found after") for i in range(6)])
    whole = sorted((r.doc_id, r.item_id) for r in D.contamination(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert sorted((r.doc_id, r.item_id) for r in D.contamination(docs, items).collect()) == whole
    assert {(i, i) for i in range(6)} <= set(whole)
    assert D.decontaminate(docs, items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == 6


def test_search_edges(edge, none, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word word word word word word")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contamination(edge, items).collect()} == {(None, 3)}
    out = D.decontaminate(edge, items)
    assert out.columns == edge.columns and out.count() == edge.count() - 1
    assert D.contamination(none, items).count() == 0


def test_capitals_of_all_scripts_cost_no_edits(documents, spark):
    items = [(1, "l'été dernier, élève à l'école dédiée, où été préféré"), (2, "съешь ещё этих мягких французских булок"),
             (3, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία της οδός"), (4, "die größte straße heißt schloßstraße")]
    docs = documents([(i, f"avant {t.upper()} après") for i, t in items])
    items = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.contamination(docs, items).collect()) == [(i, i, 0) for i in range(1, 5)]
    assert D.decontaminate(docs, items).count() == 0


def test_short_items_are_found():
    """Items of every length from one byte on, exact and, where the budget has an edit, edited."""
    rng = random.Random(6)
    for m in range(1, 40):
        item = "".join(rng.choice("abcdefghijklm") for _ in range(m)).encode()
        k = int(m * D.EDITS)
        search = D.Searcher([(1, item)])
        for edits in range(k + 1):
            text = f"0123 {edited(rng, item.decode(), edits)} 4567"
            assert [(x[0], x[1]) for x in search.find(text)] == [(1, distance(item, text.encode()))], (m, edits)
        assert search.find("0123 456789") == []
    assert D.Searcher([(1, b"")]).find("text") == []


@pytest.mark.parametrize("common", [0, 1, 3])
def test_shared_wording_against_edit_distance(monkeypatch, common):
    """Items that share an opening, or nearly all they have, with q-grams common from few items on, in texts that repeat themselves."""
    monkeypatch.setattr(D, "COMMON", common)
    rng = random.Random(common)
    opening = "which of the following statements about "
    tail = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, opening + tail(rng.choice([1, 2, 8, 20]))) for i in range(12)] + [(20, opening + "x1"), (21, opening + "x2"), (22, opening + "x2")]
    search = D.Searcher([(i, D.normalise(t)) for i, t in items])
    assert sum(len(x.items) for x in search.indexes) == len(items) and any(x.around for x in search.indexes)
    some = 0
    for n in range(25):
        parts = [rng.choice([opening, opening + opening, tail(3), edited(rng, rng.choice(items)[1], rng.randint(0, 4)), rng.choice(items)[1]]) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts) * rng.choice([1, 1, 3])
        want = {}
        for i, t in items:
            item = D.normalise(t).decode()
            e = distance(item, D.normalise(text).decode())
            if e <= int(len(item) * D.EDITS):
                want[i] = e
        assert {x[0]: x[1] for x in search.find(text)} == want, n
        assert search.holds(text) == bool(want)
        some += len(want)
    assert some > 30


def test_templates_in_time():
    """2,000 items with one opening against 1 MB of that opening, and a page of other questions that open so."""
    import time

    rng = random.Random(9)
    opening = "Which of the following statements about the subject is correct: "
    tail = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstu") for _ in range(rng.randint(3, 8))) for _ in range(n))
    for words in (2, 14):
        items = [(i, opening + tail(words)) for i in range(2000)]
        search = D.Searcher([(i, D.normalise(t)) for i, t in items])
        begin = time.perf_counter()
        got = {x[0]: x[1] for x in search.find(opening * (1_000_000 // len(opening)) + items[7][1])}
        assert time.perf_counter() - begin < 60, words
        end = D.normalise(opening + items[7][1]).decode()
        for i, t in items[:25] + [items[i] for i in got]:  # an occurrence of the opening alone is further off
            item = D.normalise(t).decode()
            e = distance(item, end)
            assert got.get(i) == (e if e <= int(len(item) * D.EDITS) else None), i
    begin = time.perf_counter()
    page = "\n".join(f"{k}. {opening}{tail(14)}" for k in range(100))
    assert search.find(page) == [] and search.find(page + items[3][1])[0][:2] == (3, 0)
    assert time.perf_counter() - begin < 60


def test_ids_of_items_of_other_types(documents, spark):
    from decimal import Decimal

    docs = documents([(1, "one passage with enough words to be found")])
    for kind, ident in (("string", "a"), ("smallint", 3), ("decimal(9,2)", Decimal("1.50")), ("binary", b"x"), ("date", None)):
        items = spark.createDataFrame([(None if ident is None else ident, "passage with enough words")], f"item_id {kind}, text string")
        assert [r.item_id for r in D.contamination(docs, items).collect()] == [ident]
