import random

import pytest
from tokenizers import Tokenizer

from termloom.llm.tokens import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    """The library as a caller finds it, not the encoder's own object."""
    return Tokenizer.from_file(vocabulary_path())


def test_ids_are_the_librarys_own(enc, library):
    rng = random.Random(1)
    atoms = ["a", "b", " ", "  ", "\n", "\t", "é", " ", "'s", "1", "!", "<|endoftext|>", "\x01", "\r", "　", "😀", "word", " thea", "\x1c", "\x85", ""]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    texts[5:9] = [None, "", None, " x"]
    ids, lengths = enc.encode_many(texts, slice_chars=700)
    at = 0
    for t, n in zip(texts, lengths.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += n
    assert at == len(ids)


def test_nothing_to_encode(enc):
    for texts in ([], [None], ["", ""]):
        ids, lengths = enc.encode_many(texts)
        assert len(ids) == 0 and lengths.tolist() == [0] * len(texts)


def test_an_added_token_is_one_id(enc, library):
    for t in ("<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext| >", "x " * 300_000 + "<|endoftext|>"):
        ids, _ = enc.encode_many([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    assert enc.encode_many(["<|endoftext|>"])[0].tolist() == [library.token_to_id("<|endoftext|>")]


def test_a_full_memory_starts_anew(library):
    enc = Encoder(vocabulary_path(), cache_entries=50)
    texts = [f"w{i} v{i}\nu{i}" for i in range(300)]
    ids, lengths = enc.encode_many(texts, slice_chars=100)
    assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]
