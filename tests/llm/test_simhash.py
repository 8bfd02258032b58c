import numpy as np
import xxhash

from framerank.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Least index reachable over links of at most 4 bits."""
    x = np.array(fps, np.uint64)
    label = list(range(len(x)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1:
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(x))]


def planted(n, seed):
    rng = np.random.default_rng(seed)
    out = [int(v) for v in rng.integers(0, 1 << 63, n, np.uint64)]
    chain = out[0]
    for _ in range(40):  # a chain: ends far apart
        for b in rng.choice(64, 4, replace=False):
            chain ^= 1 << int(b)
        out.append(chain)
    for _ in range(600):  # a ball of near copies
        near = out[1]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            near ^= 1 << int(b)
        out.append(near)
    return sorted(set(out))


def test_trie_matches_all_pairs():
    for seed in range(4):
        x = np.array(planted(1500, seed), np.uint64)
        label = simhash.trie_links(x, np.array([0]), np.array([len(x)]))
        assert label.tolist() == brute_groups(x)


def test_forest_is_of_links():
    x = np.array(planted(1500, 1), np.uint64)
    i, j = simhash.trie_forest(x, np.array([0]), np.array([len(x)]))
    assert (i < j).all() and (np.bitwise_count(x[i] ^ x[j]) <= 4).all()
    want = brute_groups(x)
    assert simhash.settle(len(x), i, j).tolist() == want and len(i) == len(x) - len(set(want))


def test_ranges_are_apart():
    x = np.array([1, 2, 3, 1, 2], np.uint64)
    assert simhash.trie_links(x, np.array([0, 3]), np.array([3, 5])).tolist() == [0, 0, 0, 3, 3]


def test_split_tops_keep_every_link(spark, monkeypatch):
    fps = planted(3000, 9)
    monkeypatch.setattr(simhash, "TASK_ROWS", 64)
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.groups(rows).collect()}
    assert [got[i] for i in range(len(fps))] == brute_groups(fps)


def test_digest_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, brute_groups(fps))}
    assert {tuple(r) for r in simhash.digest(docs).collect()} == want


def test_edges(spark, docs_of):
    docs = docs_of([(5, None, 1), (3, "", 1), (9, " \n", 1), (7, "ÀB cd", 1), (7, "ÀB cd", 1), (None, "ÀB cd", 1), (1, "x " * 300_000, 1)], ", fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.digest(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (None, 7), (1, 1)}
    assert simhash.digest(docs).count() == 7
    assert simhash.digest(docs.limit(0)).count() == 0
    only = docs_of([(None, "a b c d"), (None, "a b c d")])
    assert [r.component_id for r in simhash.digest(only).collect()] == [None, None]
