"""The dictionary's sample of long id arrays."""

import numpy as np

from probatum.llm import token_files


def test_pieces_of_long_arrays():
    short = np.arange(1000, dtype="<u2").tobytes()
    assert token_files.sampled(short) == short
    ids = np.repeat(np.arange(100), 5000).astype("<u2").tobytes()  # a value tells its place in the array
    got = token_files.sampled(ids)
    assert len(got) == token_files.SAMPLE_BYTES and got == token_files.sampled(ids)
    values = np.frombuffer(got, "<u2")
    assert values.max() < 100 and values.max() > 60 and len(set(values.tolist())) > 8
