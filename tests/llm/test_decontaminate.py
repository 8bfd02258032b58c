import duckdb

from framerank.llm import decontaminate as D
from framerank.llm import queries


def brute(text, items):
    own = D.words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        w = D.words(item)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for k in range(len(own) - n + 1):
                if own[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    ids.add("null" if item_id is None else str(item_id))
    return len(own), len(hit), sorted(ids)


LONG = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, LONG), (2, "Short É item"), (10, None), (11, " ... "), (3, "short é ITEM"), (None, "zz")]
TEXTS = [None, "", "a b", f"Hey, W0 w1-w2 {LONG} end", "x short, Ã© É item", "Xx short   é\titem!", "w1 " * 50, "zz", f"{' pad' * 500} short É item", f"{LONG} {LONG}"]


def test_matches_brute_force(spark, docs_of):
    docs = docs_of([(i, t, "x", 1) for i, t in enumerate(TEXTS)], ", hits string, runs int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (D.BLOCK_CHARS, 40):
        got = {r.doc_id: (r.h.n_words, r.h.n_hit, r.h.item_ids) for r in D.scan(docs, items, "h", block_chars=block).collect() if r.h.n_hit or r.h.item_ids is not None}
        for i, t in enumerate(TEXTS):
            assert got[i] == brute(t, ITEMS), (block, t)


def test_spans_are_of_the_original(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    text = "Ünï; Short —É— item, Ende. zz?"
    docs = docs_of([(1, text)])
    row = D.scan(docs, items, "h").withColumn("cut", D.excise(D.F.col("text"), D.F.col("h.spans"))).first()
    assert [text[s.start : s.end] for s in row.h.spans] == [text[s.start : s.end] for s in row.h.spans]
    assert "zz" in {text[s.start : s.end] for s in row.h.spans}
    keep = "".join(c for i, c in enumerate(text) if not any(s.start <= i < s.end for s in row.h.spans))
    assert row.cut == keep


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of([(1, "a b"), (1, "a b"), (None, None)])
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in D.digest(docs, items).collect()) == [(0, 0, False), (2, 0, False), (2, 0, False)]
    assert D.digest(docs.limit(0), items).count() == 0


def test_sql(spark, small):
    got = sorted(map(tuple, queries.op1_decontamination(spark, small).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert got == sorted(con.execute(queries.ORACLE["op1_decontamination"]).fetchall())
