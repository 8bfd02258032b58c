import numpy as np

from framerank.llm import quality


def auc(pairs):
    order = sorted(pairs)
    ranks = {}
    for i, (s, _) in enumerate(order):
        ranks.setdefault(s, []).append(i + 1)
    one = [np.mean(ranks[s]) for s, y in pairs if y]
    n1, n0 = len(one), len(pairs) - len(one)
    return (sum(one) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    print("auc", auc([(r.score, r.quality) for r in rows]), "accuracy", np.mean([r.predicted == r.quality for r in rows]), len(rows))
    assert auc([(r.score, r.quality) for r in rows]) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_moments_and_density(spark):
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = rng.normal(size=(400, d))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(int)
    rows = spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(y, x)], "label int, x array<double>")
    model = quality.fit(rows, 0.0, 0.0)
    want = []
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True) + quality.RIDGE * np.eye(d)
        off = x - own.mean(axis=0)
        want.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (off @ np.linalg.inv(cov) * off).sum(axis=1))
    assert np.allclose(quality.score_matrix(x, model), 1 / (1 + np.exp(want[0] - want[1])), atol=1e-6)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, 1.0), (None, "", 1.0), (2, "a\n\n!", 1.0), (2, "a\n\n!", 1.0), (3, "w " * 200_000, 1.0)], ", score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.digest(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.digest(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.digest(docs.limit(0), labels).count() == 0


def naive(text):
    """The statistics from their definitions, a character and a word at a time."""
    text = text or ""
    n, own = len(text), text.split()
    k = len(own)
    lines = [s for s in text.split("\n") if s.strip()]

    def logit(count, of):
        share = (count + 0.5) / (of + 1) if of else 0.5
        return np.log(share / (1 - share))

    def share(test):
        return logit(sum(map(test, text)), n)

    marks = ".,;:!?'\"-()"
    sizes = [len(w) for w in own]
    run = best = 0
    for i, w in enumerate(own):
        run = run + 1 if i and own[i - 1] == w else 1
        best = max(best, run)
    stops = sum(text.count(c) for c in ".!?")
    return [
        np.log1p(n), np.log1p(k), np.log(np.mean(sizes) + 1) if k else 0, np.log1p(np.std(sizes)) if k else 0,
        share(lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or c >= "À"), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in marks),
        share(lambda c: "!" <= c <= "~" and not c.isalnum() and c not in marks), logit(len(set(own)), k), logit(max((own.count(w) for w in set(own)), default=0), k),
        logit(sum(own[i] == own[i - 1] for i in range(1, k)), k), np.log1p(len(lines)), logit(len(set(lines)), len(lines)), logit(own.count("|"), k),
        logit(sum(s <= 3 for s in sizes), k), np.log1p(k / (stops + 1)), logit(sum(w[0].isupper() for w in own), k), logit(sum(s.rstrip()[-1] in ".!?" for s in lines), len(lines)), np.log1p(best),
    ]


def test_the_query_matches_brute_force(spark, small):
    from zlib import crc32

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 20_000}
    x = {i: np.array(naive(t), float) for i, t in rows.items()}
    for i, t in rows.items():
        assert np.allclose(x[i], quality.statistics(t), atol=1e-9), i
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in rows and r.quality in (0, 1)]
    known += [(known[0][0], 1 - known[0][1])]  # a document with two labels is learned once for each
    learned = [(x[i], y) for i, y in known if crc32(str(i).encode()) % 5]
    both = [np.array([v for v, y in learned if y == c]) for c in (0, 1)]
    n = [len(b) for b in both]
    covs = [np.cov(b.T, bias=True) for b in both]
    shared = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = (1 - quality.DIAGONAL) * shared + quality.DIAGONAL * np.diag(np.diag(shared))
    logs = {}
    for c in (0, 1):
        cov = (1 - quality.POOLED) * covs[c] + quality.POOLED * target + quality.RIDGE * np.eye(len(shared))
        for i, v in x.items():
            off = v - both[c].mean(axis=0)
            logs[i, c] = np.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * off @ np.linalg.solve(cov, off)
    two = spark.createDataFrame(known, "doc_id long, quality int")
    got = quality.digest(docs.where("coalesce(length(text), 0) < 20000"), two).collect()
    assert {r.doc_id for r in got} == set(x)
    for r in got:
        want = 1 / (1 + np.exp(np.clip(logs[r.doc_id, 0] - logs[r.doc_id, 1], -500, 500)))
        assert abs(r.score - want) < 1e-5 and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= quality.THRESHOLD)
