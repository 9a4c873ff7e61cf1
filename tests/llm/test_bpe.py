"""The encoder against the tokenizers library, text by text."""

import weakref

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvana.llm import bpe
from corvana.llm.batches import mapper

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n\t ", "It's DON'T we'll", "a <|endoftext|> b<|startoftext|>", "Σίσυφος ΟΔΟΣ", "İstanbul ǅ ﬁ ½²Ⅷ 日本語 😀😀", "x" * 5000, "é" * 700,
    "'s't've", "\x85 a​b\x00c\x1cd", "é Å", "123 4.5e6", "<|not a token|>", "a b　c",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(library, texts):
    own = bpe.encoder(PATH)
    ids = own.encode_batch(texts)
    shown = own.decode_batch(ids).to_pylist()
    for text, got, decoded in zip(texts, ids.to_pylist(), shown, strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert got == expected, text[:80]
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_odd_texts(library):
    check(library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"])), max_size=5))
def test_any_text(library, texts):
    check(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="etaoinshrdlu' é"), max_size=20))
def test_shared_prefixes(library, texts):
    check(library, texts)


def test_cache_turns_over(library):
    own = bpe.Encoder(PATH, cache_words=20)
    texts = [f"word{n} other{n * 7} shared" for n in range(60)]
    for n in range(0, 60, 10):
        assert own.encode_batch(texts[n : n + 10]).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts[n : n + 10]]


def test_rows(spark, library):
    rows = [(1, "Hello World", "x"), (1, "Hello World", "x"), (2, None, "y"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode(df, PATH)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 0), (1, 2), (1, 2), (2, 0)]
    kept = bpe.encode(df, PATH, keep=("ids",)).columns
    assert kept == ["doc_id", "ids", "ids", "decoded"]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_words_met_once_are_not_kept(library):
    own = bpe.Encoder(PATH)
    texts = [" ".join(f"once{n}x{m} twice" for m in range(50)) for n in range(100)]
    for n in range(0, 100, 20):
        part = texts[n : n + 20]
        assert own.encode_batch(part).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in part]
        assert list(own.spans) == ["twice"] and len(own.store) == own.kept == 1


def test_one_batch_at_a_time():
    held = []

    def batches():
        for n in range(3):
            assert not [r for r in held if r() is not None]
            batch = pa.RecordBatch.from_pydict({"t": ["a" * 100] * (n + 1)})
            held.append(weakref.ref(batch))
            yield batch
            del batch

    rows = [out.num_rows for out in mapper(lambda part: pa.RecordBatch.from_pydict({"n": [1] * part.num_rows}), "t")(batches())]
    assert rows == [1, 2, 3]
