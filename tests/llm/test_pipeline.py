from collections import Counter

import corpus_pipeline as p
from test_line_dedup import plain
from test_minhash import brute
from test_mixing import water
from test_packing import held, ids  # noqa: F401
from tracewright.llm.common import written


def test_stages_against_brute_force(spark, sf_dir, ids):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = {}
    for name, stage in p.STAGES[:4]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == p.COLUMNS
        out[name] = docs.collect()
    clean = {r.doc_id for r in out["toxicity"]}
    assert all(rows[r.doc_id] == r for r in out["toxicity"])
    assert len(rows) * 0.8 < len(clean) <= len(rows) and not {i for i, y in labels.items() if y == 0} - clean

    lines = plain([(r.doc_id, r.text, None) for r in out["toxicity"]], 10, 1)
    assert {i for i, *_ in lines} == {r.doc_id for r in out["line_dedup"]}
    kept = {r.doc_id: r for r in out["line_dedup"]}
    for i, n, dropped, _ in lines:
        assert len(kept[i].text.split("\n")) == max(1, n - dropped) and kept[i].n_chars == len(kept[i].text)

    groups = brute([(r.doc_id, r.text) for r in out["line_dedup"]], 5, 80)
    assert {r.doc_id for r in out["minhash_near_dedup"]} == {i for i, _, _, stays in groups if stays}
    assert all(kept[r.doc_id] == r for r in out["minhash_near_dedup"])

    size = {r.doc_id: len(r.text.encode().split()) for r in out["minhash_near_dedup"]}
    source, taken = Counter(), Counter()
    for r in out["minhash_near_dedup"]:
        source[r.source] += size[r.doc_id]
    for r in out["mixing"]:
        taken[r.source] += size[r.doc_id]
        assert kept[r.doc_id] == r
    for s, target in water(source).items():
        assert abs(taken[s] - target) <= max(size.values())
    assert max(Counter(r.doc_id for r in out["mixing"]).values()) <= 3

    pieces = p.packing_stage(spark, docs, sf_dir).collect()
    copies = Counter(r.doc_id for r in out["mixing"])
    tokens = Counter()
    for x in pieces:
        tokens[x.doc_id] += x.length
    assert tokens == Counter({i: n * len(ids(kept[i].text)) for i, n in copies.items()})


def test_whole_run(spark, sf_dir):
    assert p.run(spark, sf_dir).count() > 0


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 9), (3, "x y z " * 20000, "en", "b", 5), (3, "x y z " * 20000, "en", "b", 5), (4, "some words", None, None, 1)]
    spark.createDataFrame([(4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)))
        assert {r.doc_id for r in docs.collect()} == ({None, 3, 4} if rows else set())
