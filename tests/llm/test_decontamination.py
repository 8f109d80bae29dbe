import random

import pytest

from tracewright.llm.decontamination import Automaton, decontaminated, need_of, spans_of, without_spans, words_of

DOCS = "doc_id long, text string, items string, `a.b` string, Spans string"
ITEMS = "item_id long, text string, doc_id string"


def plain(doc, items, window, share):
    hit, met = set(), set()
    for k, item in items:
        need = need_of(len(item), window, share)
        for s in range(len(item) - need + 1 if item else 0):
            for p in range(len(doc) - need + 1):
                if doc[p : p + need] == item[s : s + need]:
                    hit |= set(range(p, p + need))
                    met.add(k)
    return hit, met


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_automaton_matches_plain_rules(share):
    rng = random.Random(7)
    for _ in range(600):
        window = rng.choice([2, 3, 4])
        some = lambda n, k=rng.choice([1, 2, 3, 6]): [b"%d" % rng.randrange(k) for _ in range(n)]
        items = [some(rng.randrange(9)) for _ in range(rng.randrange(6))]
        items += items[:1]
        doc = some(rng.randrange(25)) + [b"other"] + (rng.choice(items) if items else [])
        hits, met = Automaton.of(items, [need_of(len(i), window, share) for i in items]).match(doc)
        want = plain(doc, list(enumerate(items)), window, share)
        assert ({p for a, n, _ in spans_of(hits) for p in range(a, a + n)}, met) == want
        for _, end, longest in hits:
            inside = lambda n: any(doc[end - n : end] == i[s : s + n] for i in items for s in range(len(i) - n + 1))
            assert longest == max(n for n in range(1, end + 1) if inside(n))


@pytest.mark.parametrize(("shard_words", "held"), [(10**6, 1 << 25), (40, 100)])
def test_whole_tables(spark, shard_words, held):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aÀé1") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 9, 30])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "... !"), (None, "null item here"), (1, "again as one"), (44, items[0][1].upper()), (5, items[5][1]), (46, "one " * 30)]
    docs = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            cut = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(cut) + 1)
            t += cut[at:] + [word()]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(t), "x", "y", "z"))
    docs += [(200, None, None, None, None), (201, "", None, None, None), (None, docs[3][1], None, None, None), (3, docs[3][1], None, None, None), (202, "one " * 50_000, None, None, None), (203, "Null, item: HERE", None, None, None)]
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS).repartition(3)
    out = decontaminated(spark.createDataFrame(docs, DOCS).repartition(4), table, window=6, shard_words=shard_words, held_bytes=held).collect()
    cut = [(k, words_of((t or "").encode())) for k, t in items]
    want, got = [], []
    for i, t, *_ in docs:
        w = words_of((t or "").encode())
        if i == 202:
            want.append((i, 50_000, 50_000, ["46"]))
            continue
        hit, met = plain(w, cut, 6, 1.0)
        want.append((i, len(w), len(hit), sorted(str(k) for k in met if k is not None)))
    for r in out:
        got.append((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])))
        assert (r.kept_text is None) == (r.doc_id == 200) and sum(s.length for s in r.spans) == r.n_hit and r.coverage == (r.n_hit / r.n_words if r.n_words else 0)
        assert len(words_of((r.kept_text or "").encode())) >= r.n_words - r.n_hit
        assert all(s.longest >= 1 for s in r.spans)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r.n_hit == 3 and r.doc_id == 203 and r["items"] == [] for r in out)


def test_text_without_spans():
    t = "Ab, cd! ef—gh".encode()
    assert words_of(t) == [b"ab", b"cd", "ef—gh".encode()]
    assert without_spans(t, [(1, 1, 1)]) == "Ab, ! ef—gh".encode()
    assert without_spans(t, [(0, 3, 3)]) == b"" and without_spans(t, []) == t


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", None, None, None)], DOCS), spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.n_hit, r.kept_text) for r in decontaminated(docs, items).collect()] == [(2, 0, "a b")]
    assert decontaminated(docs.limit(0), items).collect() == []
