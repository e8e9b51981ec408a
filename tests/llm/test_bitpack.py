import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm.bitpack import PackedFile, id_bits, pack_ids, unpack_ids, write_file


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.integers(0, 2**31))
def test_round_trip_at_every_width(bits, n, seed):
    ids = np.random.RandomState(seed).randint(0, 1 << bits, n, dtype=np.int64).astype(np.uint32)
    words = pack_ids(ids, bits)
    assert (unpack_ids(words, bits, n) == ids).all()
    assert words.nbytes == -(-n // 64) * bits * 8


def test_width_is_least():
    assert [id_bits(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access_reads_any_range():
    rng = np.random.RandomState(3)
    lengths = np.array([0, 5, 200, 1, 700])
    for bits in (11, 16, 17):
        ids = rng.randint(0, 1 << bits, 906).astype(np.uint32)
        f = PackedFile(write_file(ids, lengths, [None, 4, 9, -3, 2**60], bits, block_ids=128))
        assert f.doc_ids == [None, 4, 9, -3, 2**60]
        for a, b in ((0, 0), (0, 906), (127, 129), (300, 301), (900, 906)):
            assert (f.ids(a, b) == ids[a:b]).all()
        assert (f.document(2) == ids[5:205]).all()
