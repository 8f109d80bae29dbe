import numpy as np
import pytest

from tracewright.llm.tokens import SEPARATOR, Tokenizer, opened, separator_scan, token_counts

SCHEMA = "doc_id long, text string, n_tokens string"
TEXTS = ["", " ", "a", "Hello's  world\n\n 12.5 don't 'tis we'll", "<|endoftext|> x", "é ñ ß 中文 😀", "x" * 12000, " \t " * 4000 + "y", "ab " * 5000]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer as Slow

    return Slow.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers(plain, spark, sf_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fast = Tokenizer()
    for t in texts:
        assert fast.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    fast = Tokenizer(ordinary=True)
    for t in TEXTS:
        ids = fast.ids(t).tolist()
        assert ids == plain.encode(t, add_special_tokens=False).ids and SEPARATOR not in ids
    plain.encode_special_tokens = False


@pytest.mark.parametrize("block", [3, 1000, 1 << 22])
def test_counts(spark, plain, block):
    rows = [(i, t, None) for i, t in enumerate(TEXTS[:4] * 5 + (TEXTS[4:] if block > 3 else []))] + [(77, None, "x"), (77, None, "x"), (None, "a", None)]
    got = token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), block_tokens=block).collect()
    plain.encode_special_tokens = True
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    plain.encode_special_tokens = False
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, want = [], []
    for k in range(5):
        ids = np.where(rng.random(997) < 0.03, SEPARATOR, 5).astype("<u2")
        if k == 1:
            ids[:] = 5  # no separator at all
        if k == 2:
            ids[-1] = SEPARATOR
        name = f"{tmp_path}/{k}.tokens"
        store, path = opened(name)
        with store.open_output_stream(path) as f:
            f.write(ids.tobytes())
        rows.append((name, len(ids)))
        at = 0
        docs = "".join("|" if x == SEPARATOR else "x" for x in ids).split("|")
        for i, d in enumerate(docs):
            if i < len(docs) - 1 or d:
                want.append((name, i, at, len(d)))
            at += len(d) + 1
    for block in (1, 64, 5000):
        got = separator_scan(spark.createDataFrame(rows + rows[:1], "file string, file_tokens long"), block_tokens=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
