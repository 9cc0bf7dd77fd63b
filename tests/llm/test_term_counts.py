"""Terms of all tails of a shard are counted by one sort; the index scores as BM25 tail by tail."""
import numpy as np
import pytest

from rebaja.llm import packing
from rebaja.llm.packing import B, K1, Shard, term_counts


@pytest.mark.parametrize("n", [1, 60, (1 << 16) + 3])
def test_counts_match_one_tail_at_a_time(n):
    rng = np.random.default_rng(n)
    tails = [rng.integers(0, 1 << 16 if i % 2 else 9, rng.integers(0, 6)).astype("<u2") for i in range(n)]
    found = [*zip(*(x.tolist() for x in term_counts(tails)))]
    assert found == [(k, t, c) for k, tail in enumerate(tails) for t, c in zip(*(x.tolist() for x in np.unique(tail, return_counts=True)))]


def test_no_tails_have_no_terms():
    assert [len(x) for x in term_counts([])] == [0, 0, 0]


def test_scores_are_bm25_and_one_sort_serves_all_tails(monkeypatch):
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u2") for _ in range(50)]
    idf, mean = np.where(np.arange(1 << 16) % 5, rng.random(1 << 16), 0), float(np.mean([len(t) for t in tails]))
    expected = [[sum(idf[t] * (c := int((other == t).sum())) * (K1 + 1) / (c + K1 * (1 - B + B * len(other) / mean)) for t in np.unique(tail) if (other == t).any()) for other in tails] for tail in tails]
    unique, calls = np.unique, []
    monkeypatch.setattr(packing.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    index = Shard(tails, idf, mean)
    assert len(calls) <= 1  # not one for each tail
    assert np.allclose([index.scores(k) for k in range(len(tails))], expected)
