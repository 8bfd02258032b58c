"""BPE encoding and decoding for a word-level vocabulary, by prefix-sharing trie traversal.

For every prefix of a word one token is the last token of the prefix's encoding: the suffix token
that can follow the encoding of what stands before it. So an encoding is the chain of last tokens,
and the states of a prefix hold for all words that share it. The distinct new words of a batch are
walked in sorted order, which is the depth-first order of their trie: going to the next word drops
the states below the common prefix and computes only the rest. An automaton of the tokens tells at each
prefix which tokens end there.

Two tokens can stand side by side if no merge across their border would have come first; that is
looked up in the merge trees of both tokens.

The text is treated as the vocabulary file says: added tokens are cut out, the rest is NFC, lower
case, split at white space and into letters, single digits and other runs, and written in byte
symbols. Each worker keeps the encodings of recent pieces and words in two generations of bounded size.

Cases: null and empty texts have no tokens and decode to an empty text. Rows are handled one by one;
repeated rows, null ids and extra columns don't matter. Words of any length are walked iteratively.
Code points that Unicode has not assigned may be letters to one library and not to another.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

END = "</w>"
#: Pieces whose encodings one generation of a worker's memory holds, and token pairs it remembers.
KEPT, PAIRS = 50_000, 150_000
#: Texts whose pieces a worker holds at once, and bytes of text in a batch: pieces, ids and tokens take about fifteen
#: times as much. New words of a slice are walked together, so a larger slice shares more prefixes.
SLICE, SLICE_BYTES = 300, 1 << 20
_NEVER = 1 << 40
#: White space as the vocabulary's own pattern knows it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of one vocabulary file, and the encodings that follow from them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[int, int] = {}
        split: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merges[a << 20 | b] = rank
            split[c] = (a, b, rank)
        self.split = split
        sound: dict[int, bool] = {}
        for t in sorted(ids.values(), key=lambda t: split[t][2] if t in split else -1):
            sound[t] = t not in split or (sound[split[t][0]] and sound[split[t][1]] and not self._crossed(split[t][0], split[t][1], split[t][2]))
        self.inner = {t: i for t, i in ids.items() if sound[i] and not t.endswith(END)}
        raw = {s: b for b, s in enumerate(byte_symbols())}
        as_bytes = {t: bytes(map(raw.__getitem__, t.removesuffix(END))) for t, i in ids.items() if sound[i] and raw.keys() >= set(t.removesuffix(END))}
        self.final = {w: ids[t] for t, w in as_bytes.items() if t.endswith(END)}
        self.final_ends = self._ends(self.final)
        self._grow({w: ids[t] for t, w in as_bytes.items() if not t.endswith(END)})
        self.fits: dict[int, bool] = {}
        self.packed = {i: struct.pack("<I", i) for i in [*ids.values(), *self.added.values()]}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cut_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
        self.cut_space = regex.compile(f"[^{_SPACE}]+")
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) border, and the rank of the merge that takes it in."""
        out = [(token, _NEVER)]
        while token in self.split:
            halves = self.split[token]
            token = halves[side]
            out.append((token, halves[2]))
        return out

    def _crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """A merge across the border of a and b comes before both are whole (or before a rank)."""
        left = self._border(b, 0)
        merges = self.merges
        for p, taken in self._border(a, 1):
            for q, gone in left:
                rank = merges.get(p << 20 | q)
                # Of equal ranks the left pair merges first.
                if rank is not None and rank < taken and rank <= gone and rank < before:
                    return True
        return False

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        found = self.fits[a << 20 | b] = not self._crossed(a, b)
        return found

    @staticmethod
    def _ends(tokens: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Lengths, longest first, of the tokens that end in the same three bytes, and 2 and 1."""
        found: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        return {end: (*sorted(sizes, reverse=True), 2, 1) for end, sizes in found.items()}

    def _grow(self, tokens: dict[bytes, int]) -> None:
        """The automaton of the tokens within a word: `step` (state and byte to state), `back` (a state's longest proper
        suffix that is a state) and `ends` (tokens that end in a state, longest first, with their lengths)."""
        self.step: dict[int, int] = {}
        self.back, self.ends = [0], [()]
        level: dict[bytes, int] = {b"": 0}
        for n in range(1, max(map(len, tokens), default=0) + 1):
            below: dict[bytes, int] = {}
            for token in tokens:
                if len(token) < n or (prefix := token[:n]) in below:
                    continue
                below[prefix] = state = len(self.back)
                parent = level[prefix[:-1]]
                self.step[parent << 8 | prefix[-1]] = state
                to = 0
                if parent:
                    to = self._next(self.back[parent], prefix[-1])
                self.back.append(to)
                own = tokens.get(prefix)
                self.ends.append(self.ends[to] if own is None else ((n, own), *self.ends[to]))
            level = below
            tokens = {t: i for t, i in tokens.items() if len(t) >= n}

    def _next(self, state: int, byte: int) -> int:
        found = self.step.get(state << 8 | byte)
        while found is None:
            if not state:
                return 0
            state = self.back[state]
            found = self.step.get(state << 8 | byte)
        return found

    def _final(self, word: bytes, last: list[int], size: list[int]) -> tuple[int, int]:
        """The last token of a whole word's encoding, and its length."""
        i = len(word)
        for n in self.final_ends.get(word[i - 3 :], (2, 1)) if i > 2 else range(i, 0, -1):
            t = self.final.get(word[i - n :]) if n <= i else None
            if t is not None:
                if n == i:
                    return t, n
                if size[i - n]:
                    fit = self.fits.get(last[i - n] << 20 | t)
                    if self._fit(last[i - n], t) if fit is None else fit:
                        return t, n
        return 0, 0

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Encodings of distinct words in UTF-8, as little-endian 32-bit ids. `last` and `size` hold for every prefix of
        the present word the last token of its encoding and that token's length (0: it has none), `at` the automaton's state."""
        out: dict[bytes, bytes] = {}
        last, size, at = [0], [1], [0]
        before = b""
        step, back, ends, fits, packed = self.step, self.back, self.ends, self.fits, self.packed
        for word in sorted(words):
            n = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], size[shared + 1 :], at[shared + 1 :]
            state = at[shared]
            for i in range(shared, n - 1):
                byte = word[i]
                to = step.get(state << 8 | byte)
                while to is None:
                    if not state:
                        to = 0
                        break
                    state = back[state]
                    to = step.get(state << 8 | byte)
                state = to
                at.append(state)
                for k, t in ends[state]:
                    j = i + 1 - k
                    if j:
                        if not size[j]:
                            continue
                        pair = last[j] << 20 | t
                        fit = fits.get(pair)
                        if not (self._fit(last[j], t) if fit is None else fit):
                            continue
                    last.append(t)
                    size.append(k)
                    break
                else:
                    last.append(0)
                    size.append(0)
            t, k = self._final(word, last, size)
            if not k:
                raise ValueError(f"the vocabulary has no tokens for {word[:40]!r}")
            j = n - k
            if j:
                chain = [packed[t]]
                while j:
                    chain.append(packed[last[j]])
                    j -= size[j]
                chain.reverse()
                out[word] = b"".join(chain)
            else:
                out[word] = packed[t]
            before = word
        return out

    def pieces(self, text: str) -> list[str]:
        """Runs without white space of a normalised text."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return self.cut_space.findall(text) if self.odd_space.search(text) else text.split()

    def _learn(self, missing: set[str], known: dict[str, bytes]) -> None:
        """Add the encodings of pieces to `known`, and those of the words that they consist of."""
        cut = {p: self.cut_words.findall(p) for p in missing if not p.isalpha()}
        words = {p for p in missing if p not in cut}
        words.update(w for own in cut.values() for w in own if w not in known)
        raw = {w.encode(): w for w in words}
        for w, ids in self.encode_words(raw).items():
            known[raw[w]] = ids
        for p, own in cut.items():
            known[p] = known[own[0]] if len(own) == 1 else b"".join(map(known.__getitem__, own))

    def forget(self) -> None:
        """Give up what is remembered of the texts, as a worker does that has no task."""
        self.young, self.old = {}, {}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[tuple[bytes, list[str]]]] = []
        missing: set[str] = set()
        for text in texts:
            own = []
            for segment in self.cut_added.split(text) if text and self.cut_added and "<" in text else [text or ""]:
                if segment in self.added:
                    own.append((self.packed[self.added[segment]], []))
                else:
                    pieces = self.pieces(segment)
                    own.append((b"", pieces))
                    missing.update(pieces)
            parts.append(own)
        known, old = self.young, self.old
        new = {p for p in missing if p not in known}
        for p in [p for p in new if p in old]:
            known[p] = old[p]
            new.discard(p)
        if new:
            self._learn(new, known)
        if len(known) > KEPT:
            self.old, self.young = known, {}
        return [b"".join(mark + b"".join(map(known.__getitem__, pieces)) for mark, pieces in own) for own in parts]


class Names:
    """Tokens by id, which is all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names: list[str | None] = [known.get(i) for i in range(max(known) + 1)]
        self.gaps = len(known) < len(self.names)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, as a vocabulary without a decoder does; unknown ids vanish."""
        if self.gaps or (len(ids) and ids.max() >= len(self.names)):
            ids = np.array([i for i in ids.tolist() if i < len(self.names) and self.names[i] is not None], np.uint32)
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def names(path: str) -> Names:
    return Names(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker process."""
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """Binary column: the ids of a text as little-endian unsigned 32-bit integers."""

    @F.arrow_udf(T.BinaryType())
    @C.tidy
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for texts in batches:
            out: list[bytes] = []
            for at in range(0, len(texts), SLICE):
                out += own.encode_batch(texts.slice(at, SLICE).to_pylist())
            yield pa.array(out, pa.binary())

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """String column from a column that encode() made."""

    @F.arrow_udf(T.StringType())
    @C.tidy
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = names(path)
        for rows in batches:
            yield pa.array([own.decode(np.frombuffer(b or b"", "<u4")) for b in rows.to_pylist()], pa.string())

    return decoded(ids)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids` (binary) and `decoded` (text); columns of these names are replaced. One UDF does both, so a
    task needs one Python worker."""
    C.arrow_limits(docs.sparkSession, SLICE, SLICE_BYTES)

    @F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
    @C.tidy
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, known = vocabulary(path), names(path)
        for texts in batches:
            ids: list[bytes] = []
            for at in range(0, len(texts), SLICE):
                ids += own.encode_batch(texts.slice(at, SLICE).to_pylist())
            decoded = pa.array((known.decode(np.frombuffer(b, "<u4")) for b in ids), pa.string())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], names=["ids", "decoded"])
        own.forget()

    own = C.free(docs, "both")
    found = docs.select(*(c for c in docs.columns if c not in ("ids", "decoded")), both(F.col(text_col)).alias(own))
    return found.withColumn("ids", F.col(own)["ids"]).withColumn("decoded", F.col(own)["decoded"]).drop(own)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of op7: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = round_trip(docs.select("doc_id", "text"), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
