"""Edit fingerprints against a walk in plain Python, and their likeness against real edits."""

import hashlib
import random

import numpy as np

from beamspark.llm import editwalk
from beamspark.llm.bytewords import mix
from beamspark.llm.op_queries import op6_edit_fingerprints


def one_fingerprint(text, samples=editwalk.SAMPLES):
    flat, kinds = editwalk.coins(), editwalk.class_table()
    p, seen = 0, []
    while p < len(text):
        c = int(kinds[ord(text[p])])
        seen.append(c)
        p += int(flat[(len(seen) - 1) % editwalk.COINS * editwalk.CLASSES + c])
    if not seen:
        return "00" * samples
    steps = np.arange(len(seen), dtype=np.uint64)
    out = bytearray()
    for i in range(samples):
        j = int(np.argmin(mix(steps ^ np.uint64((i + 1) << 40))))
        out.append(int(mix(np.array([(j << 8) | seen[j]], np.uint64))[0] >> np.uint64(56)))
    return bytes(out).hex()


def texts(seed, n=90):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("abcde fgé😀\n") for _ in range(rnd.choice([0, 1, 2, 7, 60, 400, 3000]))) for _ in range(n)]
    return [*made, "", None, made[5], "x" * 30000]


def test_walks_together_and_alone(monkeypatch):
    t = [x or "" for x in texts(1)]
    want = [one_fingerprint(x) for x in t]
    for together, chars in ((0, 1 << 23), (48, 1 << 23), (1000, 5000)):
        monkeypatch.setattr(editwalk, "TOGETHER", together)
        monkeypatch.setattr(editwalk, "SLICE_CHARS", chars)
        assert [r.tobytes().hex() for r in editwalk.fingerprints(t)] == want


def same(a, b):
    return sum(a[i:i + 2] == b[i:i + 2] for i in range(0, len(a), 2)) / (len(a) // 2)


def test_likeness_follows_edits():
    rnd = random.Random(3)
    means = []
    for edits in (0, 4, 40, 400):
        got = []
        for _ in range(12):
            a = [rnd.choice("abcdefghij klmno") for _ in range(2000)]
            b = list(a)
            for _ in range(edits):
                k = rnd.randrange(len(b))
                b[k:k + 1] = rnd.choice([[], ["z"], ["z", b[k]]])
            got.append(same(one_fingerprint("".join(a)), one_fingerprint("".join(b))))
        means.append(sum(got) / len(got))
    assert means[0] == 1 and means[1] > 0.9 and means[0] > means[1] > means[2] > means[3] and means[3] < 0.4


def expected(docs):
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, f = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + f[:half]
        a, b, c = map(one_fingerprint, (t, e, f))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return sorted(out, key=str)


def test_neighbours_over_parts(spark):
    docs = [(7 * i % 101, t) for i, t in enumerate(texts(2, 50))] + [(3, "tie"), (3, "tie"), (None, "no id"), (-4, "below")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as part", "2 as head").repartition(4)
    for chars in (700, 1 << 24):
        got = editwalk.neighbours(df, part_chars=chars)
        got = got.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", editwalk.likeness("fingerprint", "edited_fingerprint"),
                         editwalk.likeness("fingerprint", "next_fingerprint"))
        assert sorted(map(tuple, got.collect()), key=str) == expected(docs)
    assert editwalk.neighbours(df.limit(0)).count() == 0


def test_links_of_near_texts(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefghij") for _ in range(1500)) for _ in range(6)]
    docs = [(i, b) for i, b in enumerate(base)] + [(10 + i, b[:700] + "Q" + b[701:]) for i, b in enumerate(base)] + [(20, base[0]), (21, ""), (22, None)]
    prints = editwalk.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.doc_id, r.other_id) for r in editwalk.near_links(prints, 0.8).collect()}
    known = dict(prints.select("doc_id", "fingerprint").collect())
    # Rows with the very same fingerprint are one.
    assert got == {(10 + i, i) for i in range(6) if known[10 + i] != known[i]} and len(got) >= 2


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op6_edit_fingerprints(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)
