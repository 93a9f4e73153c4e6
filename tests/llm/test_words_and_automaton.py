import random
import re

import numpy as np

from popweave.llm.automaton import Automaton
from popweave.llm.text import ALNUM, SPACED, lower_ascii, slices, words_of


def test_words_are_those_of_the_patterns():
    r = random.Random(1)
    texts = ["".join(r.choice("aB3 é\n\t.,_-漢🙂\x0b\x00\x7f") for _ in range(r.randint(0, 80))) for _ in range(300)] + ["", None]
    for table, pattern in ((SPACED, "[^\x20\x09-\x0D]+"), (ALNUM, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words_of(texts, table)
        number = {}
        for i, t in enumerate(texts):
            a, b = w.first[i], w.first[i + 1]
            want = re.findall(pattern, lower_ascii(t))
            assert [w.text(k) for k in range(a, b)] == want
            for k, word in zip(range(a, b), want):
                assert number.setdefault(word, w.hash[k]) == w.hash[k]
        assert len(set(number.values())) == len(number)


def test_slices_cover_all_rows_and_leave_long_texts_alone():
    offsets = np.array([0, 5, 5, 100, 103, 103, 110])
    assert [r for a, b in slices(offsets, 10) for r in range(a, b)] == list(range(6))
    assert (2, 3) in list(slices(offsets, 10)) or (1, 3) in list(slices(offsets, 10))


def test_matching_statistics_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        sequences = [[r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 5))]
        runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        text = [r.randrange(5) for _ in range(40)]
        got = [length for _, length in Automaton(sequences).walk(text)]
        want = [max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n:i + 1]) in runs) for i in range(len(text))]
        assert got == want
