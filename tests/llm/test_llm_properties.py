"""Properties on generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civictally.llm.grams import hash_words, whole_windows, window_hashes
from civictally.llm.mixture import permuted
from civictally.llm.names import Name, block_keys, compare, jaro_winkler, normal_form, one_edit

LETTERS = st.text(alphabet="abckmnoprstu", min_size=5, max_size=10)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.integers(1, 4))
@settings(deadline=None)
def test_equal_windows_have_equal_hashes_and_others_do_not(texts, width):
    words = [w for t in texts for w in t]
    at, owner = whole_windows(np.array([len(t) for t in texts], np.int64), width)
    hashes = window_hashes(hash_words(words), width)
    want = [(i, tuple(t[j : j + width])) for i, t in enumerate(texts) for j in range(len(t) - width + 1)]
    assert list(owner) == [i for i, _ in want]
    seen = {}
    for h, (_, w) in zip(hashes[at].tolist(), want):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.integers(1, 3000), st.integers(0, 1 << 32))
@settings(deadline=None)
def test_permutations(size, key):
    assert len(set(permuted(np.arange(size), size, key).tolist())) == size


@given(LETTERS, LETTERS)
@settings(deadline=None)
def test_similarities_are_symmetric(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1 and one_edit(a, b) == one_edit(b, a)
    assert abs(jaro_winkler(a, b) - jaro_winkler(b, a)) < 0.12


@given(LETTERS, LETTERS, st.integers(1, 8), st.sampled_from("dwxz"), st.sampled_from(["insert", "delete", "replace", "swap"]))
@settings(max_examples=300, deadline=None)
def test_a_slip_keeps_a_common_block(first, last, at, char, kind):
    at = min(at, len(last) - 2)
    slip = {
        "insert": last[:at] + char + last[at:],
        "delete": last[:at] + last[at + 1 :],
        "replace": last[:at] + char + last[at + 1 :],
        "swap": last[:at] + last[at + 1] + last[at] + last[at + 2 :],
    }[kind]
    a, b = normal_form(f"{first} {last}"), normal_form(f"{slip}, {first}")
    if len(slip) >= 5 and Name(a).person and Name(b).person and len(Name(a).full) == len(Name(b).full) == 2:
        assert block_keys(Name(a)) & block_keys(Name(b))
        assert compare(a, b) >= 0.9
