"""Samples of the dictionary reach the ends of long documents."""

import numpy as np

from stridelake.llm import token_files


def test_samples_come_from_the_whole_document(spark):
    for n in (0, 1, 2048, 2049, 5001, 100_000):
        ids = np.arange(n, dtype="<u4")
        got = np.frombuffer(token_files.spread_ids(ids.tobytes()), "<u4")
        assert len(got) == min(n, token_files.SAMPLE_BYTES // 4) and set(got) <= set(ids)
        assert not n or got[0] == 0 and got[-1] == n - 1
    text = " ".join(f"w{i}" for i in range(9000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    (sample,) = token_files.sample_ids(df, token_files.tokenizer_path(), 0)
    assert len(sample) == token_files.SAMPLE_BYTES and sample[-4:] == bytes(4)
