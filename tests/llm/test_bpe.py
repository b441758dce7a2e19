from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import bpe
from tidewater.llm.bpe import Coder, encode_decode, read_spec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Coder(read_spec(PATH))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "The", " ", "  ", "\n", "\t", "'s", "'ll", ".", ",", "!!", "12", "é", "漢", "😀", "\x85", "\xa0", "　", "\x1c", "<|endoftext|>", "<|", "ing"]), max_size=30).map("".join))
def test_as_the_library(coder, theirs, text):
    ids = next(coder.encode([text]))
    known = theirs.encode(text, add_special_tokens=False).ids
    assert ids == known
    assert coder.decode(ids) == theirs.decode(known, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", "a" * 20_000, "ab" * 5_000 + " ", " " * 3_000, "\n \n" * 500, "x" * 65 + " " + "x" * 65])
def test_long_and_uniform(coder, theirs, text):
    assert next(coder.encode([text])) == theirs.encode(text, add_special_tokens=False).ids


def test_rows(odd, theirs):
    out = encode_decode(odd, read_spec(PATH), ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    expected = []
    for r in odd.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), ids, r.text or "", hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expected))
    assert encode_decode(odd.limit(0), read_spec(PATH)).count() == 0


def test_words_are_learnt_once_while_they_fit(monkeypatch):
    """Many words stay known for the next texts; with little room for them the ids are the same."""
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"{k:06}".translate(letters) for k in range(at, at + 10_000)) for at in range(0, 60_000, 10_000)] + ["x" * 100 + " a<|endoftext|>b  c"]
    coder, asked = Coder(read_spec(PATH)), []
    monkeypatch.setattr(coder, "merge", lambda words, merge=coder.merge: (asked.extend(words), merge(words))[1])
    first = [ids for x in texts for ids in coder.encode([x])]
    assert len(asked) >= 60_000
    asked.clear()
    assert [ids for x in texts[:-1] for ids in coder.encode([x])] == first[:-1] and not asked
    held = sum(bpe.ENTRY + len(x) + len(y) for known in (coder.words, coder.chunks, coder.after) for x, y in known.items())
    assert coder.kept == held
    monkeypatch.setattr(bpe, "KEPT", 1000)
    assert [ids for x in texts for ids in coder.encode([x])] == first and coder.kept < held
