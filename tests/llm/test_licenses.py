import random
import re

import pytest

from ravelin.llm import licenses as L
from tests.conftest import TESTDATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    """(n_words, n_base, first, last, labels) by looking at every place."""
    words = WORD.findall((text or "").translate(UPPER))
    found = [
        (i, label)
        for phrase, label in L.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def rows(df):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.orderBy("doc_id").collect()]


def test_base_places_of_the_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    want = [brute_base(r.text) for r in docs.orderBy("doc_id").collect()]
    assert rows(L.digest(docs)) == want
    assert sum(w[1] for w in want) > 0


def test_statistics_are_the_longest_matches():
    """At every word: the longest run that ends there and stands in a template, and all places where it stands."""
    rng = random.Random(2)
    templates = [("x", " ".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))) for _ in range(6)]
    own = L.Scanner(templates)
    split = [t.split() for _, t in templates]
    words = [rng.choice("abcd") for _ in range(400)]
    for i, (v, n) in enumerate(own.statistics([w.encode() for w in words]), 1):
        longest = max(m for m in range(i + 1) if m == 0 or any(words[i - m : i] == s[j : j + m] for s in split for j in range(len(s))))
        assert n == longest
        if n:
            ends = {(k, j + n) for k, s in enumerate(split) for j in range(len(s) - n + 1) if s[j : j + n] == words[i - n : i]}
            assert own.automaton.ends[v] == ends


def brute_share(words, template):
    """Largest number of template words that ordered, gap-bounded runs of MATCH or more cover (exhaustive over matches)."""
    m, n = len(words), len(template)
    runs = []
    for i in range(m):
        for j in range(n):
            if i and j and words[i - 1] == template[j - 1]:
                continue
            k = 0
            while i + k < m and j + k < n and words[i + k] == template[j + k]:
                k += 1
            if k >= L.MATCH:
                runs.append((i, j, k))
    return runs


@pytest.mark.parametrize("seed", range(12))
def test_chains_cover_edited_templates(seed):
    """A template with words changed, left out and added far enough apart is covered but for what was touched."""
    rng = random.Random(seed)
    template = [f"w{i}" for i in range(60)]
    text, lost = [f"x{i}" for i in range(rng.randint(0, 30))], 0
    start = len(text)
    k = 0
    for i, w in enumerate(template):
        if k >= 6 and len(template) - i > 6 and rng.random() < 0.2:
            kind = rng.choice("adr")
            lost += kind != "a"
            text += [] if kind == "d" else ["new"] if kind == "r" else ["new", w]
            k = 0
        else:
            text.append(w)
            k += 1
    end = len(text)
    text += [f"y{i}" for i in range(rng.randint(0, 30))]
    own = L.Scanner([("t", " ".join(template))])
    n, _, spans, share = own.scan(" ".join(text).encode())
    assert n == len(text) and brute_share(text, template)
    assert share == (60 - lost) / 60
    assert [(s[0], s[1], s[2]) for s in spans] == [("t", start, end)]


def test_every_template_is_found_and_parts_are_not():
    own = L.scanner()
    for label, text in L.TEMPLATES:
        data = ("zzz " * 40 + text.upper() + " zzz" * 40).encode()
        found = own.scan(data)
        assert label in {s[0] for s in found[2]}, label
    n = len(L.words_of(L.TEMPLATES[0][1].encode()))
    third = " ".join(L.TEMPLATES[0][1].split()[: n // 3])
    _, _, spans, share = own.scan(third.encode())
    assert not spans and 0.25 < share < 0.4


def test_order_and_distance_break_chains():
    words = [f"w{i}" for i in range(40)]
    own = L.Scanner([("t", " ".join(words))])
    swapped = words[20:] + words[:20]
    assert own.scan(" ".join(swapped).encode())[3] == 0.5
    apart = words[:20] + ["x"] * (L.GAP + 1) + words[20:]
    near = words[:20] + ["x"] * L.GAP + words[20:]
    assert own.scan(" ".join(apart).encode())[3] == 0.5
    assert own.scan(" ".join(near).encode())[3] == 1.0


def test_pieces_give_what_whole_texts_give(monkeypatch):
    rng = random.Random(4)
    own = L.scanner()
    text = " ".join(rng.choice([t for _, t in L.TEMPLATES] + ["MIT License", "general public", "license", "ümlaut " * 9, "-"]) for _ in range(60)).encode()
    whole = own.scan(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(L, "PIECE", size)
        assert own.scan(text) == whole


def test_edges(edge, none, documents):
    out = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.digest(edge).collect()}
    assert out[1, 0] == out[2, 0] == out[7, 0] == (0, None, None, "", "", 0.0)
    assert (None, 60) in out and L.digest(edge).count() == edge.count()
    assert L.digest(none).count() == 0
    df = L.scanned(documents([(1, "Licensed under CC BY-NC 4.0. Released under the MIT License, the mit license"), (2, "mit-license GENERAL_public\nlicense")]))
    a, b = df.orderBy("doc_id").collect()
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (2, 9 + 1, 13, "mit", "cc-by-nc,mit", 1.0)
    assert [(s.label, s.start, s.end) for s in a.spans] == [("cc-by-nc", 0, 5)]
    assert (b.n_base, b.first_word, b.last_word, b.base_labels, b.score) == (2, 0, 2, "gpl,mit", 0.5)


def test_long_texts_of_matches_stay_cheap():
    """Repetitions of what many templates share keep few matches open."""
    import time

    own = L.scanner()
    text = ("permission is hereby granted free of charge to any person " * 30_000).encode()
    begin = time.perf_counter()
    n, _, _, share = own.scan(text)
    assert n == 300_000 and share < 0.5
    assert time.perf_counter() - begin < 30
