import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P

from framerank.llm import _common as C
from framerank.llm import similar
from framerank.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    counts = Counter(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return {(s, k) for s, n in counts.items() for k in range(n)}


def brute_groups(texts):
    """Least index reachable over pairs of similarity 0.8 or more."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def edited(n, seed):
    """Texts, and copies of some with words replaced: similarities on both sides of 0.8, in chains."""
    rng = np.random.default_rng(seed)
    out = [[f"w{v}" for v in rng.integers(0, 5000, rng.integers(3, 200))] for _ in range(n)]
    for k in range(4 * n):
        copy = list(out[rng.integers(0, len(out))])
        for at in rng.integers(0, len(copy), rng.integers(1, 5)):
            copy[at] = f"x{k}"
        out.append(copy)
    return [" ".join(t) for t in out]


def test_groups_match_brute_force(spark):
    texts = [*edited(60, 1), None, " ", "", "Same TEXT", "same text", "one two three four five six", "one two three four five six " * 9, "one two three four five six " * 10]
    rows = C.materialise(spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text"), "rows")
    got = {r.row: r.component_id for r in similar.groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_the_stage_drops_what_is_similar(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    groups = brute_groups([r.text for r in rows])
    want = {r.doc_id for k, r in enumerate(rows) if groups[k] == k}
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, small).collect()} == want
    assert 1 in want and 177 not in want  # 9 bits apart, similarity 0.83


def test_large_bands_match_brute_force(spark, monkeypatch):
    """Every open band walked as tries, in parts of few rows."""
    monkeypatch.setattr(similar, "FEW_ROWS", 1)
    rng = np.random.default_rng(4)
    base = [f"w{v}" for v in rng.integers(0, 5000, 120)]
    texts = edited(20, 3)
    for k in range(80):
        copy = list(base)
        for at in rng.choice(120, rng.integers(1, 4), replace=False):
            copy[at] = f"y{k}_{at}"
        texts.append(" ".join(copy))
    want = brute_groups(texts)
    rows = C.materialise(spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text"), "rows")
    for part, size in ((1024, 8 << 20), (16, 8 << 20), (1024, 4096)):
        monkeypatch.setattr(similar, "TASK_ROWS", part)
        monkeypatch.setattr(similar, "TASK_BYTES", size)
        got = {r.row: r.component_id for r in similar.groups(rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_the_self_join_alone_finds_its_links(spark):
    """With no bands to share, all pairs of similar texts within 4 bits are joined by the trie self-join."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(20):
        base = [f"w{v}" for v in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for c in range(12 if k < 3 else 2):
            copy = list(base)
            copy[rng.integers(0, 300)] = f"x{k}_{c}"
            texts.append(" ".join(copy))
    sets = [similar.shingles(t) for t in texts]
    fps = [similar.majority(s) for s in sets]
    near = [[(fps[i] ^ fps[j]).bit_count() <= 4 and similar.similarity(a, b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = list(range(len(texts)))
    for _ in texts:
        want = [min(want[j] for j in range(len(texts)) if near[i][j]) for i in range(len(texts))]
    assert len(set(want)) <= 30
    rows = C.materialise(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), "rows")
    bare = rows.select("row", similar._sketches("text").alias("k")).select("row", "k.n", "k.fp", F.array().cast("array<long>").alias("bands"))
    got = {r.node: r.root for r in components(similar.links(C.materialise(bare, "bare"), rows)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want
