"""Words and hashes of byte columns against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from beamspark.llm.bytewords import ALNUM, SPACED, word_slices

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize(("table", "pattern"), [(ALNUM, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), (SPACED, "[^\\x20\\x09-\\x0D]+")])
@pytest.mark.parametrize("limit", [7, 200, 1 << 20])
def test_words(table, pattern, limit):
    rnd = random.Random(limit)
    texts = ["".join(rnd.choice("aBz09 _-\n\té中😀\x0b\x85 ") for _ in range(rnd.randrange(0, 60))) for _ in range(150)]
    texts += ["", None, "x" * 70000 + " Y", "a" * 70000, " " * 50, "end"]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    seen, hashes = [], {}
    for w in word_slices(column, table, limit):
        h = w.hashes()
        assert w.first == len(seen)
        for r in range(w.rows):
            at = range(w.offsets[r], w.offsets[r + 1])
            seen.append([w.word(i) for i in at])
            for i in at:
                assert hashes.setdefault(w.word(i), h[i]) == h[i]
    assert seen == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
    assert len(set(map(int, hashes.values()))) == len(hashes)


def test_grams_stay_inside_a_text():
    w = next(word_slices(pa.array(["a b c", "a b", "b c a b c"]), SPACED))
    g, whole = w.grams(w.hashes(), 2)
    assert whole.tolist() == [True, True, False, True, False, True, True, True, True, False]
    words = [w.word(i) for i in range(10)]
    by = {}
    for i in np.flatnonzero(whole):
        assert by.setdefault((words[i], words[i + 1]), g[i]) == g[i]
    assert len(set(by.values())) == len(by) == 3


def test_no_rows():
    assert list(word_slices(pa.array([], pa.string()), SPACED)) == []
