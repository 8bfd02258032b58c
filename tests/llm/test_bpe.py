import hashlib
import random
import struct
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framerank.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def public():
    made = Tokenizer.from_file(PATH)
    made.no_padding()
    made.no_truncation()
    return made


def same(own, public, texts):
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in own.encode_batch(texts)]
    for text, a, b in zip(texts, want, got):
        assert a == b, text[:200]
        assert public.decode(a, skip_special_tokens=False) == bpe.names(PATH).decode(np.array(b, np.uint32))


ODD = ["", " ", "It's we'll I'VE 'd", "a<|endoftext|>b <|startoftext|> <|endoftext|", "ΑΣ ΣΑΣ", "İstanbul ǅ ß ẞ", "é ́x", "1234 ½ Ⅷ ٣٤", "a\x1cb\x1d c\x85d\xa0e​f　g᠎h﻿",
       "日本語テキスト 한국어 العربية हिन्दी", "🎉🎉 👩‍👩‍👧 ok!!!??", "aaaaaaaaaaaaaaaaaaaaaaa" * 50, "ababababab!!!!....====----", "x" * 20000, "\x00\x01\x7f", "don't you're 'S 'T", "ŉ ﬁ ǆ ͅ"]


def test_odd_texts(own, public):
    same(own, public, ODD)


def test_random_words(own, public):
    rng = random.Random(1)
    names = [t.replace("</w>", "") for t in own.inner]
    texts = ["".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(20000)]
    texts = [t for t in texts if t.isascii()]
    same(own, public, texts)
    same(own, public, ["".join(rng.choices("abeinrst", k=rng.randint(1, 14))) for _ in range(20000)])
    # Code points that no Unicode version has assigned are letters or not as each library's tables say.
    spans = [(32, 126), (160, 0x2FF), (0x370, 0x6FF), (0x1E00, 0x30FF)]
    signs = [c for a, b in spans for c in map(chr, range(a, b + 1)) if unicodedata.category(c) != "Cn"]
    same(own, public, [" ".join("".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(12)) for _ in range(3000)])


def test_forgetting_changes_nothing(own, public, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    rng = random.Random(2)
    for _ in range(30):
        same(own, public, [" ".join("".join(rng.choices("abc", k=3)) for _ in range(15)) for _ in range(5)])


def test_unknown_ids_vanish(public):
    ids = [512, 60000, 49407, 513]
    assert bpe.names(PATH).decode(np.array(ids, np.uint32)) == public.decode(ids, skip_special_tokens=False)


def test_documents(spark, small, public):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(docs, PATH).collect()}
    for r in docs.collect():
        ids = public.encode(r.text or "", add_special_tokens=False).ids
        text = public.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, "x"), (None, "", "x"), (2, "hello", "x"), (2, "hello", "x")], ", ids string")
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted(map(tuple, bpe.digest(docs, PATH).collect()), key=str)
    assert [r for r in got if r[1] == 0] == [(1, 0, empty, empty), (None, 0, empty, empty)]
    assert len([r for r in got if r[0] == 2]) == 2
    assert bpe.digest(docs.limit(0), PATH).count() == 0
