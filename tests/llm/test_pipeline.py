import hashlib
import re
import struct
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P
import test_decontaminate
import test_pii
import test_similar

from framerank.llm import _common as C
from framerank.llm import queries


def brute(docs, items):
    rows = sorted((r for r in docs if r.text and any(c.isalpha() for c in r.text)), key=lambda r: r.doc_id)
    groups = test_similar.brute_groups([r.text for r in rows])  # five words, similarity 0.8
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    public = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    public.no_padding()
    public.no_truncation()
    out = {}
    for r in rows:
        n, hit, _ = test_decontaminate.brute(r.text, items)
        if hit and 20 * hit >= n:
            continue
        text = r.text
        if hit:
            continue  # cut texts are tested below
        spans = sorted(test_pii.brute(text), key=lambda s: (s[1], -s[2]))
        done, parts = 0, []
        for k, a, b in spans:
            if b <= done:
                continue
            if a >= done:
                parts += [text[done:a], "[" + ("EMAIL", "IP", "CARD", "PHONE")[k] + "]"]
            done = b
        text = "".join(parts) + text[done:]
        ids = public.encode(text, add_special_tokens=False).ids
        out[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_run_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, small).collect()}
    want = brute(docs, items)
    assert {k: v for k, v in got.items() if k in want} == want
    partly = {r.doc_id for r in docs if 0 < 20 * test_decontaminate.brute(r.text, items)[1] < test_decontaminate.brute(r.text, items)[0]}
    assert set(got) - set(want) <= partly


def test_stages_on_edges(spark, small, docs_of):
    long_text = "So ring me under +1 (555) 010-1234 please " + "word " * 3000
    item = C.read(spark, small, "benchmark").first().text
    docs = docs_of([(1, None, 1), (2, "!!", 1), (3, long_text, 1), (3, long_text, 1), (9, long_text, 1), (None, "one two three four", 1), (6, item, 1), (7, f"{item} " + "other words here " * 700, 1)], ", h int")
    for _, stage in P.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, small), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "h"]
    rows = {r.doc_id: r for r in docs.collect()}
    assert sorted(rows, key=str) == [3, 7, None] and docs.count() == 3
    assert "[PHONE]" in rows[3].text and rows[3].n_chars == len(rows[3].text)
    assert re.fullmatch(r"\W*(other words here )+", rows[7].text)
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, small).count() == 0


def test_clashing_names_and_repeated_ids(spark, small, docs_of):
    names = ["__lang", "__hits", "__redacted", "__text", "__row", "row", "component_id"]
    words = [" ".join(f"{a}{k}" for k in range(60)) for a in ("red", "blue", "green")]
    near = words[0].replace("red7 ", "rouge ")
    texts = [(5, words[0]), (5, words[1]), (5, words[2]), (2, near), (None, words[1]), (None, words[2] + " tail"), (None, "alone and apart in every word of it")]
    docs = docs_of([(i, t, *range(len(names))) for i, t in texts], "".join(f", {n} int" for n in names))
    for _, stage in P.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, small), "stage")
        assert docs.columns[5:] == names
    rows = docs.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted([(2, near), (5, words[1]), (5, words[2]), (None, texts[-1][1])], key=str)
    assert all([r[n] for n in names] == list(range(len(names))) for r in rows)


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
    assert len(P.STAGES) == 5
