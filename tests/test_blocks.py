import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.operators.blocks import Runs, matching_blocks


def library(a, b):
    """The library's blocks; it joins those that touch, which ours leave as they were found."""
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


def joined(blocks):
    out = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_blocks_equal_the_library_on_few_tokens(a, b):
    assert joined(matching_blocks(a, b)) == library(a, b)


def test_blocks_equal_the_library_on_texts():
    rng = random.Random(6)
    for _ in range(150):
        words = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
        a = rng.choices(words, k=rng.randint(0, 200))
        b = [w for w in a if rng.random() > 0.2] if rng.random() < 0.5 else rng.choices(words, k=rng.randint(0, 200))
        b = [rng.choice(words) if rng.random() < 0.1 else w for w in b]
        assert joined(matching_blocks(a, b)) == library(a, b)


def test_runs_know_their_first_place():
    assert Runs("abcbc").longest_in("xbcb") == (1, 1, 3)
    assert Runs("aaaa").longest_in("baab") == (1, 0, 2)
    assert Runs("abab").longest_in("ba ab") == (0, 1, 2)
    assert Runs("").longest_in("ab") == Runs("ab").longest_in("") == Runs("ab").longest_in("xyz") == (0, 0, 0)


def test_a_repeated_line_of_100_000_tokens_takes_no_time():
    line = "la la la hey you".split()
    began = time.process_time()
    (block,) = matching_blocks(line * 20_000, line * 19_000)
    assert block == (0, 0, 95_000) and time.process_time() - began < 10
