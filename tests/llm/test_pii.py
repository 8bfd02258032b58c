import hashlib
import random
import re

from framerank.llm import pii

RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    return [(k, *m.span()) for k, (_, rule, ok) in enumerate(RULES) for m in rule.finditer(text or "") if ok(m[0])]


def test_base_matches_the_rules():
    rng = random.Random(3)
    for _ in range(30000):
        text = "".join(rng.choices(["1", "0", "25", ".", ".", "@", "a", "b_", "-", " ", "+", "(", ")", "4111111111111111", "é", "x.com", "%"], k=rng.randint(1, 14)))
        assert pii.base(text) == brute(text), text


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(docs).collect():
        own = brute(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in own) for j in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def bootstrapped():
    rows = [(i, f"Please ring me under +1 (555) 010-1{i:03d} after lunch, thanks {i}.") for i in range(8)]
    rows += [(20, "So ring me under 030 1234567 after lunch again."), (21, "The part number 030 7654321 is out of stock."), (22, "ring me maybe"), (23, None), (24, "")]
    rows += [(30 + i, f"written down by the {w} 4556737586899{i:03d} here") for i, w in enumerate(["old", "new"])]
    return rows


def test_bootstrap_finds_unseen_and_leaves_the_rest(spark, docs_of):
    docs = docs_of(bootstrapped())
    found = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    text = dict(bootstrapped())
    a = text[20].index("030")
    assert found[20] == f"phone:{a}:{a + 11}"
    assert found[21] == "" and found[22] == "" and found[23] == "" and found[24] == ""
    redacted = {r.doc_id: r.t for r in pii.annotate(docs, "s").select("doc_id", pii.redact(pii.F.col("text"), pii.F.col("s")).alias("t")).collect()}
    assert redacted[20] == "So ring me under [PHONE] after lunch again." and redacted[23] is None and redacted[21] == text[21]


def test_common_words_are_not_trusted(spark, docs_of):
    """The same words mostly stand before other things."""
    rows = bootstrapped() + [(100 + i, f"They ring me under cover {i} after lunch") for i in range(40)]
    rows = [(i, t.replace("after lunch", f"later today{i} x{i}") if t else t) for i, t in rows]
    found = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    assert found[20] == ""


def test_blocks_change_nothing(spark, docs_of, monkeypatch):
    docs = docs_of(bootstrapped())
    whole = sorted(map(tuple, pii.digest(docs).collect()))
    monkeypatch.setattr(pii, "BLOCK", 1)
    assert sorted(map(tuple, pii.digest(docs).collect())) == whole
    blocks = {r.doc_id: r.t for r in pii.redacted(docs, "t").collect()}
    monkeypatch.setattr(pii, "BLOCK", 1000)
    assert {r.doc_id: r.t for r in pii.redacted(docs, "t").collect()} == blocks
    assert blocks[20] == "So ring me under [PHONE] after lunch again." and blocks[23] is None


def test_long_and_empty(spark, docs_of):
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "(" * 400_000, "+1 " * 200_000, "1 " * 200_000, "a@" * 200_000, "::" * 200_000 + "1"):
        assert pii.base(text) == [] or text.startswith(("1.",))
        pii.candidates(text, [])
    docs = docs_of([(None, "a@b.co", 1), (1, "a@b.co", 1), (1, "a@b.co", 1)], ", spans int")
    assert [r.spans for r in pii.digest(docs).collect()] == ["email:0:6"] * 3
    assert pii.digest(docs.limit(0)).count() == 0


def generations():
    """Numbers of a second shape stand where phones do, and again in words of their own; there stands what no seed's words lead to."""
    rows = [(i, f"Please ring me under +1 (555) 010-1{i:03d} after lunch, thanks {i}.") for i in range(12)]
    rows += [(20 + i, f"So ring me under 030 12345{i:02d} after lunch again.") for i in range(4)]
    rows += [(40 + i, f"Her desk lists number 030 12345{i:02d} inside the hall") for i in range(4)]
    return [*rows, (60, "His desk lists number QX-77123b inside the hall"), (61, "the model QX-77123c was sold")]


def test_a_second_generation_reaches_further(spark, docs_of, monkeypatch):
    rows = generations()
    text = dict(rows)
    found = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    a = text[60].index("QX")
    assert found[60] == f"phone:{a}:{a + len('QX-77123b')}" and found[61] == ""
    assert all(found[i] for i in (*range(12), *range(20, 24), *range(40, 44)))
    monkeypatch.setattr(pii, "GENERATIONS", 1)
    once = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    assert once[60] == "" and all(once[i] for i in range(20, 24)) and not any(once[i] for i in range(40, 44))


def test_planted_rate(spark, docs_of):
    """Of identifiers of unseen shapes planted in three phrases that also introduce seeds, all are found; numbers elsewhere are left alone."""
    rng = random.Random(5)
    phrases = ["write to us at", "the server answers under", "my direct line is"]
    seeds = [lambda i: f"bob{i}@mail.example.com", lambda i: f"10.0.{i % 250}.{i % 199}", lambda i: f"+1 (555) 01{i:02d}-{1000 + i}"]
    rows, planted, plain = [], [], []
    for i in range(240):
        p = i % 3
        filler = [" ".join("".join(rng.choices("abdefgilmnorst", k=rng.randint(2, 8))) for _ in range(6)) for _ in range(2)]
        if i % 12 < 9:
            rows.append((i, f"{filler[0]} {phrases[p]} {seeds[p](i)} {filler[1]}"))
        elif i % 24 < 18:
            rows.append((i, f"{filler[0]} {phrases[p]} ext{rng.randint(10000, 99999)}x {filler[1]}"))
            planted.append(i)
        else:
            rows.append((i, f"{filler[0]} about {rng.randint(1000, 9999)} {filler[1]} {rng.randint(10**6, 10**7)}"))
            plain.append(i)
    found = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    assert planted and plain
    assert sum(bool(found[i]) for i in planted) == len(planted)
    assert not any(found[i] for i in plain)


def occurrences(texts, words, side):
    n = 0
    for t in texts:
        own = t.lower().split()
        n += sum(own[i : i + 2] == words and (i + 2 < len(own) if side == 0 else i > 0) for i in range(len(own) - 1))
    return n


def test_counts_match_brute_force(spark, small, monkeypatch):
    """Totals of a few word pairs, also through a filter so small that it lets much through."""
    from xxhash import xxh3_64_intdigest

    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text]
    pairs = sorted({(w[i], w[i + 1]) for t in texts[:40] for w in [t.lower().split()] for i in range(0, len(w) - 1, 17)})[:60]
    signed = lambda w: (xxh3_64_intdigest(w) + (1 << 63)) % (1 << 64) - (1 << 63)
    asked = {(side, signed(a), signed(b)): [a, b] for a, b in pairs for side in (0, 1)}
    rows = spark.createDataFrame([*asked], "side int, h1 long, h2 long")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    for most in (1 << 27, 1 << 6):
        monkeypatch.setattr(pii, "FILTER_BITS", most)
        counted = docs.mapInArrow(pii._occurrences(pii._pair_filter(rows)), "side int, h1 long, h2 long, n long").groupBy("side", "h1", "h2").sum("n").collect()
        got = {tuple(r)[:3]: r[3] for r in counted}
        assert {k: got.get(k, 0) for k in asked} == {k: occurrences(texts, w, k[0]) for k, w in asked.items()}


def test_nothing_is_cut_short():
    local = "a" * 100
    text = f"write {local} at example dot com"
    assert pii.candidates(text, []) == [(6, len(text))]
    word = "w" * 500
    (a, b, found), = pii.contexts(f"{word} {word} 1234567 x y", [(1002, 1009)])
    from xxhash import xxh3_64_intdigest as h

    assert found == [(0, h(word), h(word)), (1, h("x"), h("y"))]
    for text in ("1" * 300_000, "a1," * 100_000, "a" * 300_000 + "1", "a@b.co," * 50_000, "x1-" * 100_000 + " y", "1234 " * 60_000):
        own = pii.base(text)
        spans = sorted({s[1:] for s in own} | set(pii.candidates(text, own)))
        assert len(list(pii.contexts(text, spans))) == len(spans)
