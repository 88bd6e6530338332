import random
import re
from itertools import combinations

import numpy as np
import xxhash

from ravelin.llm import golay, near_dedup, simhash
from ravelin.llm.components import connected_components

TABLE = str.maketrans(simhash.UPPER, simhash.LOWER)


def shingles(t, n):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(TABLE)) if x]
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def fingerprint(t, n):
    s = shingles(t, n)
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    for flips in (0, 1, 2):
        for _ in range(20):
            other = words.copy()
            for k in range(len(words)):
                for b in rng.choice(23, flips, replace=False):
                    other[k] ^= 1 << b
            one, two = (dict() for _ in range(2))
            for store, w in ((one, words), (two, other)):
                for r, i in zip(*golay.keys(w), strict=True):
                    store.setdefault(r, set()).add(i)
            assert all(one[r] & two[r] for r in one)
    rows, _ = golay.keys(words)
    assert set(np.bincount(rows)) <= {1, 6}


def make_texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    for _ in range(2 * n):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\n", " \t "]).join(w).title() if rng.random() < 0.2 else " ".join(w))
    return texts


def brute_components(pairs, n):
    prints = {i: fingerprint(t, n) for i, t in pairs}
    sets = Sets(prints)
    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= simhash.LINK_BITS:
            sets.join(a, b)
    return {i: (f"{prints[i]:016x}", sets.find(i)) for i in prints}


def test_components_against_brute_force(documents, monkeypatch):
    pairs = list(enumerate(make_texts(random.Random(7), 60)))
    want = brute_components(pairs, 3)
    for bucket in (simhash.BUCKET, 1):  # 1: every shared bucket takes the linear way
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(documents(pairs)).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(pairs) - 30


def test_links_are_found_at_every_distance(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(100)]
    prints = set(base)
    for f in base:
        for flips in (1, 2, 3):
            for b in rng.sample(range(64), flips):
                f ^= 1 << b
            prints.add(f)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = Sets(signed)
    for r in links.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
        got.join(r.a, r.b)
    want = Sets(signed)
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            want.join(a, b)
    assert {p: got.find(p) for p in signed} == {p: want.find(p) for p in signed}


def test_simhash_edges(edge, none):
    got = simhash.digest(edge).collect()
    assert len(got) == edge.count()
    zero = [r for r in got if r.doc_id in (1, 2, 7)]
    assert {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 1)}
    assert simhash.digest(none).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def brute_groups(pairs, n, similarity):
    sets_of = {i: frozenset(shingles(t, n)) for i, t in pairs}
    sets = Sets(sets_of)
    for a, b in combinations(sets_of, 2):
        x, y = sets_of[a], sets_of[b]
        if (len(x & y) / len(x | y) if x | y else 1.0) >= similarity:
            sets.join(a, b)
    return {i: sets.find(i) for i in sets_of}


def test_near_groups_against_brute_force(documents):
    pairs = list(enumerate(make_texts(random.Random(9), 80)))
    want = brute_groups(pairs, 5, 0.8)
    got = {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not [i for i in wrong if got[i] != i and want[i] == i]  # nothing dropped that is not similar
    assert len(wrong) <= 0.01 * len(pairs)
    kept = {r.doc_id for r in near_dedup.keep_one(documents(pairs)).select("doc_id").collect()}
    assert kept == {i for i, k in got.items() if i == k}


def test_short_texts_against_brute_force(documents):
    """Eight and nine words, similarity 0.8 and no more: every group is found, also behind a passage that many share."""
    rng = random.Random(13)
    texts = []
    for k in range(400):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 8, 8, 3, 5, 9, 10, 15]))]
        if k % 8 == 0:
            own = "a line that is in many of them".split() + own[:7]
        texts += [" ".join(own), " ".join(own + [f"x{k}"] if k % 2 else [f"x{k}", *own])]
    pairs = list(enumerate(texts))
    want = brute_groups(pairs, 5, 0.8)
    got = {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()}
    assert got == want and sum(i != k for i, k in want.items()) > 200


def test_large_families_go_by_pivots(documents, monkeypatch):
    """Buckets and families beyond a block: pivots, and cells for what they leave, change nothing."""
    pairs = list(enumerate(make_texts(random.Random(9), 20)))
    plain = {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()}
    for block, pivots in ((2, 1), (3, 0)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
        assert {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()} == plain
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    assert {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()} == plain


def test_trees_hold_no_pair_lists():
    """4,000 like nodes of 500 shingles: memory stays far below that of their eight million pairs."""
    import tracemalloc

    rng = np.random.default_rng(3)
    prints = np.tile(rng.integers(0, 1 << 62, (1, near_dedup.WORDS), np.int64).view(np.uint64), (4000, 1))
    prints ^= np.uint64(1) << rng.integers(0, 64, prints.shape).astype(np.uint64)
    sets = [np.sort(rng.choice(520, 500, replace=False)) for _ in range(4000)]
    tracemalloc.start()
    label = near_dedup.trees(prints, np.zeros(4000, np.int64), lambda i, j: near_dedup.shared(sets[i], sets[j]) >= 0.8 * 520)
    assert len(set(label.tolist())) == 1 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_rows_of_one_id_are_kept_apart(documents):
    long = " ".join(f"w{i}" for i in range(40))
    pairs = [(1, long), (7, long + " more"), (7, "a text that no other row is near to at all"), (8, long), (8, long), (9, None)]
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(documents(pairs, )).collect()), key=str)
    assert kept == sorted([(1, long), (7, pairs[2][1]), (9, None)], key=str)


def test_near_edges(edge, none):
    out = near_dedup.keep_one(edge)
    assert out.columns == edge.columns
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == sorted([1, 3, None, 8, 9], key=str)
    assert near_dedup.keep_one(none).count() == 0


def test_recall_at_the_threshold_by_length(spark):
    """Pairs of similarity 0.80 to 0.85, texts of 50 to 900 shingles: the share that is found."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows, found = [], {}
    for n, changes in ((50, 1), (100, 2), (200, 4), (900, 20)):
        for k in range(60):
            i = n * 1000 + 2 * k
            words = [word() for _ in range(n + 4)]
            other = list(words)
            step = n // changes
            for c in range(changes):
                other[c * step + step // 2] = word()
            rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
            a, b = (set(shingles(t, 5)) for _, t in rows[-2:])
            assert 0.8 <= len(a & b) / len(a | b) <= 0.85
    keep = {r.doc_id: r.keep_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in (50, 100, 200, 900):
        found[n] = sum(keep[n * 1000 + 2 * k + 1] == n * 1000 + 2 * k for k in range(60)) / 60
    assert min(found.values()) >= 0.95 and sum(found.values()) / 4 >= 0.98, found


def test_links_that_fingerprints_miss_are_found(documents, monkeypatch):
    """Without any bits of difference the fingerprints find next to nothing; every group is found all the same."""
    monkeypatch.setattr(near_dedup, "MOST_BITS", 0)
    pairs = list(enumerate(make_texts(random.Random(13), 60)))
    got = {r.doc_id: r.keep_id for r in near_dedup.near_groups(documents(pairs)).collect()}
    assert got == brute_groups(pairs, 5, 0.8)


def test_parities_never_exclude_a_similar_pair(monkeypatch):
    """Both forms of the comparison let the same pairs through, all similar ones of different roots among them."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (13, 60, 70, 127, 130, 500):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for change in (0.02, 0.1, 0.11, 0.3, 0.6):
            other = base.copy()
            other[: int(change * n)] = rng.integers(0, 1 << 63, int(change * n), np.uint64)
            sets.append(np.unique(other[: n - int(change * 10)]))
    n, strings = np.array([len(s) for s in sets]), [near_dedup.parity(s) for s in sets]
    root = np.arange(len(sets)) // 2
    whole = {tuple(sorted(p)) for a, b in near_dedup.possible(n, root, strings, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
    a, b = near_dedup.possible_in(np.zeros(len(sets), int), n, root, strings, 0.8)
    assert whole == {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if root[i] != root[j]]
    similar = {(i, j) for i, j in pairs if both(i, j) >= 0.8 * (n[i] + n[j] - both(i, j))}
    assert similar and similar <= whole and len(whole) < len(pairs) / 2
