"""What workers remember of words is bounded and changes no result."""

import pickle

import numpy as np

from colorjobs.llm import quality
from colorjobs.llm.common import WordHashes


def test_hashes_are_bounded_and_the_same():
    words = [f"w{i % 700}" for i in range(3000)]
    small, large = WordHashes(10), WordHashes()
    assert (small.of(words) == large.of(words)).all() and len(small) <= 10 and len(large) == 700
    again = pickle.loads(pickle.dumps(small))
    assert again.most == 10 and (again.of(words) == large.of(words)).all() and len(again) <= 10


def test_terms_do_not_depend_on_what_is_remembered(monkeypatch):
    text = " ".join(f"word{i * i % 97}" for i in range(400))
    before = quality.terms(text)
    monkeypatch.setattr(quality, "MEMORY", 3)
    monkeypatch.setattr(quality, "_word_slot", {})
    after = quality.terms(text)
    assert all(np.array_equal(a, b) for a, b in zip(before, after, strict=True)) and len(quality._word_slot) <= 3
