"""Filter audit: the contraction against running the filters one by one."""

import itertools
import re
from collections import Counter

import numpy as np

from beamspark.llm import filteraudit
from beamspark.llm.filteraudit import FILTERS


def fails(text, again):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": again}


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in docs:
        again = i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == (text or "") for o in docs)
        parts.setdefault(lang or "", []).append((i, fails(text or "", again)))
    out = []
    for part, rows in parts.items():
        shapley = Counter()
        mine = []
        for order in itertools.permutations(FILTERS):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(removed)
                all_fail = [r for r in rows if r[1][f]]
                mine.append((part, "".join(order), step, len(left), len(removed), len(all_fail) - len(removed), sum(sum(r[1].values()) == 1 for r in all_fail),
                             sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed), f))
        out += [(*m[:-1], shapley[m[-1]]) for m in mine]
    return sorted(out)


DOCS = [(1, "a b c", "en"), (2, "a b c", "en"), (2, "a b c", "en"), (1, "a b c", None), (3, None, ""), (None, "", None), (4, "", "de"), (None, "a b c", "en"), (None, "a b c", "en"),
        (5, " ".join(f"w{i}" for i in range(120)), "en"), (6, " ".join(["same"] * 120), "en"), (7, "SHOUT " * 110, "de"), (8, " ".join(f"w{i}" for i in range(119)) + "\x0b50% off", "de"),
        (9, "x y z ÄÖ", "fr"), (10, " ".join(f"{i}" for i in range(40_000)), "fr"), (11, " ".join(f"{i}" for i in range(40_000)), "fr"), (12, "A" * 10 + "b" * 90, "fr")]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (6, 1, None), (None, 1, 1), (7, 0, 0), (99, 1, 1), (11, 1, 0)]


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as digest", "4 as n"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as salt", "2 as good"))


def test_small_table(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    got = sorted(tuple(r) for r in filteraudit.audited(filteraudit.failures(docs, labels)).collect())
    assert got == brute(DOCS, LABELS)
    assert filteraudit.audited(filteraudit.failures(docs.limit(0), labels)).count() == 0
    bare = sorted(tuple(r) for r in filteraudit.audited(filteraudit.failures(docs, labels.limit(0))).collect())
    assert bare == brute(DOCS, [])


def test_hot_text_and_id(spark):
    """A third of all rows share one text, another third one doc_id."""
    docs = [(i, "hot text", "en") for i in range(200)] + [(500, f"text {i}", "de") for i in range(200)] + [(1000 + i, f"#{i}", None) for i in range(200)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(600)]
    a, b = frames(spark, docs, labels)
    assert sorted(tuple(r) for r in filteraudit.audited(filteraudit.failures(a, b)).collect()) == brute(docs, labels)


def test_contraction_is_the_sum_over_chosen_cells():
    rng = np.random.default_rng(5)
    tensor = rng.integers(0, 50, (3, 2, 2, 2))
    pick = {"pass": filteraudit.PASS, "fail": filteraudit.FAIL, "all": filteraudit.ALL}
    cut = {"pass": slice(0, 1), "fail": slice(1, 2), "all": slice(None)}
    for names in itertools.product(pick, repeat=3):
        want = tensor[(slice(None), *[cut[n] for n in names])].sum(axis=(1, 2, 3))
        assert (filteraudit.contracted(tensor, [pick[n] for n in names]) == want).all()
