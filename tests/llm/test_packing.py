import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ravelin.llm import packing, sequences, tokens


def check(patterns, counts, capacity):
    got = np.zeros(capacity + 1, np.int64)
    for pattern, n in patterns:
        assert n > 0 and sum(length * c for length, c in pattern) <= capacity
        for length, c in pattern:
            got[length] += n * c
    assert (got == counts).all()


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 300))
    counts = np.bincount(rng.integers(1, capacity + 1, rng.integers(0, 3000)), minlength=capacity + 1)
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    for plan in (packing.best_fit_decreasing(counts, capacity), packing.grouped_packing(counts, capacity, capacity // 8, 20)):
        check(plan, counts, capacity)
        bins = sum(n for _, n in plan)
        assert least <= bins <= 1.25 * least + 3


def test_best_fit_decreasing_is_that_of_single_pieces():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randint(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        left: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [x for x in left if x >= length]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - length)
            else:
                left.append(capacity - length)
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
        plan = packing.best_fit_decreasing(counts, capacity)
        got = sorted(capacity - sum(a * c for a, c in p) for p, n in plan for _ in range(n))
        assert got == sorted(left)


def test_capacity_tree_finds_the_smallest():
    tree, have = packing.CapacityTree(100), []
    rng = random.Random(1)
    for _ in range(500):
        x = rng.randint(0, 100)
        if have and rng.random() < 0.4:
            x = have.pop()
            tree.add(x, -1)
        else:
            have.append(x)
            tree.add(x, 1)
        q = rng.randint(0, 100)
        assert tree.at_least(q) == min((y for y in have if y >= q), default=None)


def test_configurations_meet_demand_at_the_lower_bound():
    sizes, demand = np.array([51, 27, 26, 23, 24, 40]), np.array([10.0, 20, 20, 20, 20, 5])
    solution = packing.configurations(sizes, demand, 100)
    assert np.allclose(sum(a * x for a, x in solution), demand)
    assert all(a @ sizes <= 100 for a, _ in solution)
    assert sum(x for _, x in solution) >= sizes @ demand / 100 - 1e-9
    assert sum(x for _, x in solution) <= 28  # the sum of sizes is 27.1 bins


TEXTS = [
    "Hello, World's it'll don't 12345 ß Éa", '"quoted" -- a_b-c', "İstanbul ΣΑΣ 漢字 é", "  ", "", "<|endoftext|> x", "a <|endoftext|> b", "é<|startoftext|>漢<|ENDOFTEXT|>", "a\x1cb\x85c ½²", "x" * 5000, "ÀÉ×÷ŁŐ ıİ",
]


def test_word_ids_are_the_librarys():
    library = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE))
    rng = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCDEÉéüßñ0123456789 .,;'\"!?-_()\n\t      "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(400)) for _ in range(200)]
    model = tokens.tokenizer(tokens.WORD_BPE)
    for t in texts:
        assert model.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_linear_grouping_round_trip(documents, edge, none):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["tion", "the", "er", "x,"]) for _ in range(rng.choice([0, 3, 50, 700, 5000])))) for i in range(60)]
    out = sequences.linear_grouping(documents(rows)).toPandas()
    model = tokens.tokenizer(tokens.WORD_BPE)
    for i, t in rows:
        ids = np.append(model.ids(t), 0).astype("<u4")
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048)) and mine.piece.tolist() == list(range(len(mine)))
        assert mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 2
    assert sequences.linear_grouping(edge).where("piece = 0").count() == edge.count()
    assert sequences.linear_grouping(none).count() == 0


def test_packed_sequences_round_trip(documents, edge, none, tmp_path, spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["tion", "the", "er", "x,"]) for _ in range(rng.choice([0, 3, 50, 700, 5000])))) for i in range(40)]
    sequences.write_packed(documents(rows), str(tmp_path / "packed"))
    back: dict[int, dict[int, np.ndarray]] = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, e, doc, piece in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, strict=False):
            back.setdefault(doc, {})[piece] = ids[a:e]
            assert places[a:e].tolist() == list(range(e - a))
        assert (ids[r.n_tokens :] == tokens.BYTE_BPE_END).all()
    model = tokens.tokenizer(tokens.BYTE_BPE)
    for i, t in rows:
        whole = np.concatenate([back[i][p] for p in sorted(back[i])])
        assert whole.tolist() == [*model.ids(t).tolist(), tokens.BYTE_BPE_END]
        assert model.engine.decode(whole[:-1].tolist()) == t
    assert sequences.packed_sequences(none).count() == 0
    assert sequences.packed_digest(edge).count() > 0
