import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracewright.llm.packing import Shard, packed, packed_shard

SCHEMA = "doc_id long, text string, start string"


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def held(rows, pieces, ids, window):
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, text in rows:
        mine, at, want = sorted(of.pop(i), key=lambda p: p.start), 0, ids(text)
        for p in mine:
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    assert not of
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(sequences)


def test_every_id_in_one_piece(spark, sf_dir, ids):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    padding, n = held(rows, packed(docs).collect(), ids, 2048)
    assert padding < 0.01 * 2048 * n


def test_edges(spark, ids):
    rows = [(1, None), (2, ""), (3, "a " * 9000), (4, "<|endoftext|>"), *((10 + i, "same text here") for i in range(50))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for shard_tokens in (20, 2_000_000):
        held(rows, packed(df, window=64, shard_tokens=shard_tokens).collect(), ids, 64)
    twice = packed(spark.createDataFrame([(7, "one two", None)] * 3, SCHEMA), window=64).collect()
    assert len(twice) == 3 and len({(p.sequence_id, p.offset) for p in twice}) == 3
    assert packed(df.limit(0)).collect() == []


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    pieces = [np.concatenate([rng.integers(1000 * t, 1000 * t + 40, 60), rng.integers(0, 30, 40)]).astype(np.uint16) for t in [1, 2, 3, 4] * 10]
    idf = np.ones(50_257, np.float32)
    idf[:30] = 0.01
    near = Shard(pieces, idf).neighbours(0, np.ones(40, bool), 9)
    assert set(near.tolist()) == set(range(4, 40, 4))
    rows = list(packed_shard(pieces, idf, 500))
    assert sum(len({k % 4 for k, _, _ in r}) for r in rows) <= 10 and all(sum(n for *_, n in r) == 500 for r in rows)
