from collections import Counter

from framerank.llm import langid


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    found = Counter()
    for w in words:
        p = f" {w} "
        found.update(c for c in w)
        found.update(p[i : i + 2] for i in range(len(p) - 1))
        found.update(p[i : i + 3] for i in range(len(p) - 2))
    return found


def pack(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [ord(c) for c in x[0]]))][:top]


TEXTS = ["The cat, the hat.", "ÀÉ été", None, "123 --", "a", "日本 語", "x" * 5000 + " y"]


def test_rankings_match_brute_force():
    grams = langid.Grams(TEXTS)
    for k, t in enumerate(TEXTS):
        assert grams.ranked(k, 300).tolist() == [pack(g) for g in ranked(brute_grams(t), 300)], t


def test_profiles_and_predictions_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    profiles = langid.fit(docs)
    counts = {}
    for r in rows:
        counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    want = {lang: [pack(g) for g in sorted(c, key=lambda g: (-c[g], pack(g)))[:300]] for lang, c in counts.items()}
    assert profiles == want
    place = {lang: {g: i for i, g in enumerate(own)} for lang, own in want.items()}
    model = langid.Model(profiles)
    for r, got in zip(rows[:60], model.predict([r.text for r in rows[:60]])):
        own = [pack(g) for g in ranked(brute_grams(r.text), 300)]
        off = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for lang, p in place.items()}
        assert got["lang"] == min(sorted(off), key=off.get)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, 1.0), (None, "", 1.0), (3, "12 !", 1.0), (4, "the thing", 1.0), (4, "the thing", 1.0)], ", score double")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.digest(docs).collect()), key=str)
    assert got == [(1, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "und")]
    assert langid.digest(docs.limit(0)).count() == 0
    nothing = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.digest(nothing).collect()} == {"und"}


def test_long_texts_and_tied_distances(spark, docs_of):
    """Two languages with the same texts are equally near: the first by name wins."""
    docs = spark.createDataFrame([(0, "abc " * 50, "xx"), (1, "abc " * 50, "ww"), (4, "abc " * 300_000, None), (5, "z" * 400_000, None)], "doc_id long, text string, lang string")
    got = {r.lang_pred for r in langid.digest(docs).collect()}
    assert got == {"ww"}
