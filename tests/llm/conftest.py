import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, slot int, spans string, items int, n_words string, accepted int, keys long, n long, s1 string, class int, rank int, part int, root long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    syllables = ["the", "ing", "er", "an", "tion", "re", "ou", "st", "ly", "ea", "nd", "ble"]
    words = ["".join(random.Random(k).choices(syllables, k=1 + k % 3)) for k in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def rows(texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    junk = (7, "x", 3, "s", 1, "w", 0, 5, 6, "q", 2, 8, 9, 4)
    return [(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else "src0", None if t is None else len(t), *junk) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def nasty(spark):
    """Null and empty texts, one very long, copies, a repeated row, a null id,
    columns that clash with names the operators use."""
    base = [prose(k, 30 + k) for k in range(12)]
    near = base[0].split()
    near[-1] = "changed"
    texts = [*base, None, "", " \t\n ", "word", "two words", base[0], base[0], " ".join(near), prose(99, 30_000), "é😀 ñ", "x\x00y", base[1]]
    ids = [*range(len(texts))]
    ids[5] = None
    ids[-1] = 1  # the same row as doc 1 once more
    return spark.createDataFrame(rows(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
