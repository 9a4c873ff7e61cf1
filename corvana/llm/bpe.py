"""BPE encoding and decoding by depth-first traversal of a prefix-sharing trie.

A word's BPE encoding is fixed by the last token of the encoding of each of its prefixes: a token
may follow another if merging the two spans side by side keeps the border between them, and for
each prefix just one last token can follow what stands before it. So the state of a prefix is its
last token, and words with a common prefix share its states. The distinct words of a batch are
visited in sorted order, which is the depth-first order of their trie; the stack of states is cut
back to the common prefix of neighbours and grown from there. No word is encoded twice in
a batch or while it is in the bounded cache, which takes words that a batch repeats; a shared prefix
is computed once for all the words below it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.llm.batches import give_back, mapper

CACHE_WORDS = 120_000
CACHE_PAIRS = 200_000
#: Of text in a slice. Workers live on beside the executor's heap, so what a slice takes counts for each of its cores.
SLICE_BYTES = 1 << 20
END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[^{WHITE}]+").findall
WIDE_BLANKS = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache
def character_class(kind: str) -> str:
    """The characters of a general category (L: letters, N: numbers) as ranges for a pattern."""
    ranges: list[list[int]] = []
    for n in range(0x110000):
        if unicodedata.category(chr(n))[0] == kind:
            if ranges and ranges[-1][1] == n - 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Vocabulary:
    """Merges, and the tokens by their bytes. Tokens are numbered in merge order, single symbols first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in ids if t not in made and (len(t) == 1 or len(t.removesuffix(END)) == 1)]
        order = {t: n for n, t in enumerate(base)}
        self.n_base = len(base)
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            n = order.setdefault(a + b, len(order))
            if n == len(self.left):
                self.left.append(order[a])
                self.right.append(order[b])
            self.merged.setdefault((order[a], order[b]), n)
        self.text = list(order)
        self.ids = [ids[t] for t in self.text]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, n in order.items():
            body = t.removesuffix(END)
            (self.final if t.endswith(END) else self.inner)[bytes(to_byte[c] for c in body)] = n
        self.length = [len(t.removesuffix(END)) for t in self.text]
        self.longest = max(self.length)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.follows: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay two tokens.

        The last steps that made a and b are undone from the latest on; the border is lost if the
        two symbols that face each other there would have merged before the step just undone.
        """
        key = a << 20 | b
        if (known := self.follows.get(key)) is not None:
            return known
        bound, x, y = 1 << 40, a, b
        while True:
            m = self.merged.get((x, y))
            if m is not None and m < bound:
                known = False
                break
            if x > y:
                if x < self.n_base:
                    known = True
                    break
                bound, x = x, self.right[x]
            else:
                if y < self.n_base:
                    known = True
                    break
                bound, y = y + 1, self.left[y]
        if len(self.follows) >= CACHE_PAIRS:
            self.follows.clear()
        self.follows[key] = known
        return known


def encode_words(vocabulary: Vocabulary, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Each distinct word and its tokens, in the trie's depth-first order.

    states[n] is the last token of the first n bytes. At a node the spans that end there are tried
    from the one that lengthens the parent's last token down to the single byte, then the longer
    ones; just one of them may follow its state, so the order only matters for speed.
    """
    inner, final, length, longest = vocabulary.inner.get, vocabulary.final.get, vocabulary.length, vocabulary.longest
    may_follow, follows = vocabulary.may_follow, vocabulary.follows.get
    states, before = [-1], b""

    def longer(word: bytes, end: int, near: int, token_of) -> int:
        for start in range(near - 1, max(0, end - longest) - 1, -1):
            t = token_of(word[start:end])
            if t is not None and (not start or may_follow(states[start], t)):
                return t
        raise ValueError(f"no token ends at byte {end} of {word[:80]!r}")

    for word in sorted(words):
        size = len(word)
        shared, most = 0, max(0, min(size, len(before)) - 1)
        if word[:most] == before[:most]:
            shared = most
        else:
            while word[shared] == before[shared]:
                shared += 1
        del states[shared + 1 :]
        for end in range(shared + 1, size + 1):
            token_of = inner if end < size else final
            near = end - 1 - length[states[-1]] if end > 1 else 0
            for start in range(near, end):
                t = token_of(word[start:end])
                if t is not None:
                    if not start:
                        break
                    known = follows((states[start] << 20) | t)
                    if known or known is None and may_follow(states[start], t):
                        break
            else:
                t = longer(word, end, near, token_of)
            states.append(t)
        token, at = states.pop(), size
        found = [token]
        while at := at - length[token]:
            token = states[at]
            found.append(token)
        yield word, found[::-1]
        before = word


class Encoder:
    """Texts to token ids and back, as the vocabulary file's own library does it without special tokens added."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.vocabulary = Vocabulary(path)
        self.cache_words = cache_words
        special = self.vocabulary.special
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letters, numbers = character_class("L"), character_class("N")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+").findall
        self.spans: dict[str, int] = {}  # of a run: the place of its ids in the store, and their number
        self.store = array("i")
        self.kept = 0  # of the store; what follows is the batch's own
        by_id = self.vocabulary.by_id
        self.shown = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())

    def plain(self, text: str | None) -> str:
        """The text normalised, with blanks for white space beyond ASCII; no piece reaches over white space."""
        if not text:
            return ""
        if text.isascii():
            return text.lower()
        return WIDE_BLANKS.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def runs(self, text: str) -> list[str]:
        """The runs between white space of a text that may hold special tokens, which stand for themselves, marked by a leading blank."""
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [" " + part] if i % 2 else RUNS(self.plain(part))
        return out

    def learn(self, runs: list[str], counts: np.ndarray) -> np.ndarray:
        """For each distinct run the place of its ids in the store and their number. What a batch holds once is put at the store's end and isn't kept in spans."""
        new = [i for i, r in enumerate(runs) if r not in self.spans]
        repeated = [i for i in new if counts[i] > 1]
        if len(self.spans) + len(repeated) > self.cache_words:
            self.spans.clear()
            self.store, self.kept = array("i"), 0
            new = range(len(runs))
            repeated = [i for i in new if counts[i] > 1]
        v, pieces = self.vocabulary, {runs[i]: [p.encode("utf-8") for p in self.pieces(runs[i])] for i in new if runs[i][:1] != " "}
        ids, found = v.ids, {}
        for word, tokens in encode_words(v, set(chain.from_iterable(pieces.values()))):
            found[word] = [ids[t] for t in tokens]
        store, places = self.store, np.fromiter(map(self.spans.get, runs, repeat(0)), np.int64, len(runs))
        for i in chain(repeated, (i for i in new if counts[i] == 1)):
            at, r = len(store), runs[i]
            if r[:1] == " ":
                store.append(v.special[r[1:]])
            else:
                for p in pieces[r]:
                    store.extend(found[p])
            places[i] = span = at << 32 | len(store) - at
            if counts[i] > 1 and len(self.spans) < self.cache_words:
                self.spans[r], self.kept = span, len(store)
        return places

    def encode_batch(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        marked = [i for i, t in enumerate(texts) if t and "<|" in t and self.specials is not None and self.specials.search(t)]
        plain = [self.plain(t) for t in texts]
        runs = pc.ascii_split_whitespace(pa.array(plain, pa.string()))
        if marked:
            rows = runs.to_pylist()
            for i in marked:
                rows[i] = self.runs(texts[i])
            runs = pa.array(rows, pa.list_(pa.string()))
        coded = runs.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        spans = self.learn(distinct, np.bincount(codes, minlength=len(distinct)))
        first, length = (spans >> 32)[codes], (spans & 0xFFFFFFFF)[codes]
        ends = np.cumsum(length)
        where = np.repeat(first - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)
        values = np.frombuffer(self.store, np.int32)[where]
        del self.store[self.kept :]
        bounds = np.concatenate([[0], ends])[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))

    def decode_batch(self, ids: pa.ListArray) -> pa.StringArray:
        """The tokens of each row's ids joined by blanks, as a tokenizer without a decoder shows them."""
        tokens = self.shown.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), " ")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    made = Encoder(path)
    give_back()
    return made


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids and decoded text of every whole text: (id_col, *keep, ids, decoded).

    path: the vocabulary file, present on each machine. keep: columns of df passed through. Other
    columns, whatever their names, aren't read. A null or empty text, or one of white space alone,
    has no ids and decodes to the empty text; a null id and repeated rows are kept, a row for each
    row. Memory is bounded by slices of about SLICE_BYTES of text (one row at least) and by caches of
    CACHE_WORDS words and CACHE_PAIRS pairs of tokens. No shuffle.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        ids = own.encode_batch(batch.column("t").to_pylist())
        passed = [c for c in batch.schema.names if c != "t"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), ids, own.decode_batch(ids)], names=[*passed, "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.col(text_col).alias("t"))
    out = T.StructType([*rows.drop("t").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    found = rows.mapInArrow(mapper(kernel, "t", SLICE_BYTES), out)
    return found.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "ids", "decoded")


def digests(encoded: DataFrame, with_ids: bool = False) -> DataFrame:
    """encode()'s rows with n_tokens and the digests of the ids and of the decoded text instead of that text, and of the ids unless with_ids."""
    dropped = ("decoded",) if with_ids else ("ids", "decoded")
    return encoded.select(
        *(c for c in encoded.columns if c not in dropped),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
