import numpy as np

from framerank.llm import toxicity


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    wrong = [r.predicted for r in rows if not r.toxic]
    print("caught", np.mean(caught), "wrong", np.mean(wrong), len(caught), len(wrong))
    # Part of the rows labelled toxic have no toxic word at all.
    assert np.mean(caught) > 0.4 and np.mean(wrong) < 0.01
    marked = [r for r in toxicity.digest(docs, labels).join(docs, "doc_id").where("text rlike '(?i)\\\\b(idiot|moron|scum)\\\\b'").collect()]
    assert np.mean([r.predicted for r in marked]) > 0.95
    for r in rows:
        assert 0 <= r.severity <= toxicity.GRADES and 0 <= r.score <= 1


def test_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    y = (z[:, None] > np.array([0.0, 1.5, 3.0])).sum(axis=1)
    w, t = toxicity.fit_ordinal(x, y)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(t, [0, 1.5, 3], atol=0.25)
    p = toxicity.grade_probabilities(x @ w, t)
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(t) > 0).all()


def test_near_copies_make_no_term(spark):
    copy = "alpha beta gamma delta epsilon zeta"
    rng = np.random.default_rng(2)
    plain = [f"v{a}" for a in range(60)]
    rows = [(i, copy, 1) for i in range(40)]
    for i in range(40, 400):
        toxic = i % 4 == 0
        own = list(rng.choice(plain, 12))
        if toxic:
            own[1:9:3] = ["vile"] * 3
        rows.append((i, " ".join(own), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    assert b"vile" in model["place"] and b"alpha" not in model["place"]


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, 1), (None, "", 1), (2, "a b", 1), (2, "a b", 1)], ", severity int")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.digest(docs, labels).collect()
    assert len(rows) == 4 and {(r.predicted, r.grade) for r in rows} == {(0, 0)}
    assert toxicity.digest(docs.limit(0), labels).count() == 0


def test_the_query_matches_brute_force(spark, small):
    import re
    from collections import Counter
    from zlib import crc32

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = np.random.default_rng(3)
    vile = {i for i in texts if i % 3 == 0 and texts[i]}
    for i in vile:
        own = texts[i].split(" ")
        for at in rng.integers(0, len(own) + 1, rng.integers(1, 9)):
            own.insert(int(at), "Vileness!")
        texts[i] = " ".join(own)
    labels = {i: int(i in vile) for i in texts}

    def words(t):
        return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]

    learned = [i for i in texts if crc32(str(i).encode()) % 5]
    around, n, has = {}, Counter(labels[i] for i in learned), Counter()
    for i in learned:
        own = ["", *words(texts[i]), ""]
        has.update((labels[i], w) for w in set(own[1:-1]))
        for a, w, b in zip(own, own[1:], own[2:]) if labels[i] else ():
            around.setdefault(w, (set(), set()))
            around[w][0].add(a)
            around[w][1].add(b)
    odds = []
    for w in (w for w, sides in around.items() if min(map(len, sides)) >= toxicity.CONTEXTS):
        a, b = has[1, w], has[0, w]
        odd = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
        odds.append((-abs(odd / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), w.encode(), odd))
    best = sorted(odds)[: toxicity.TERMS]
    place = {w.decode(): k for k, (_, w, _) in enumerate(best)}
    marked = {w.decode() for z, w, odd in best if odd >= toxicity.MARK_ODDS and -z >= toxicity.MARK_Z}
    assert "vileness" in marked

    def features(t):
        x = np.zeros(len(place))
        for w, k in Counter(w for w in words(t) if w in place).items():
            x[place[w]] = np.log1p(k)
        return x

    x = np.array([features(texts[i]) for i in learned], np.float32)
    y = np.array([0 if not labels[i] else 1 + sum(sum(w in marked for w in words(texts[i])) >= s for s in toxicity.STEPS) for i in learned])
    w, t = toxicity.fit_ordinal(x, y)
    changed = spark.createDataFrame([(i, texts[i]) for i in texts], "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = toxicity.digest(changed, known).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        above = [1 / (1 + np.exp(np.clip(k - features(texts[r.doc_id]) @ w, -500, 500))) for k in t]
        assert abs(r.severity - sum(above)) < 2e-3 and abs(r.score - above[0]) < 2e-3
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_very_long_text(spark, docs_of):
    docs = docs_of([(1, "plain words here " * 100_000), (2, "x"), (3, "y" * 500_000)])
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic int")
    assert len(toxicity.digest(docs, labels).collect()) == 3
