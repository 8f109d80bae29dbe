import random
import zlib

import numpy as np

from tracewright.llm.common import table
from tracewright.llm.toxicity import NEGATION, PRIOR, REPORTED, SYMBOLS, TARGET, THREAT, THREAT_WEIGHT, WORDS, Grammar, fit_toxicity, held_out, lexicon, machine, parts, toxicity

LEXICON = {"idiot ": 2.0, "scum": 2.0, "!kill": 3.0}


def test_machine_weighs_targets_negation_and_reports():
    weigh = Grammar(LEXICON).clause
    assert weigh("nothing here") == 0 and weigh("idiots") == 0 and weigh("scummy") == 2.0
    assert weigh("an idiot") < weigh("you idiot") == weigh("idiot you")
    assert weigh("not an idiot") < weigh("an idiot")
    assert weigh("not once was it an idiot") == weigh("an idiot")  # beyond negation's reach
    assert weigh("he said you idiot") < weigh("you idiot")
    assert 0 < weigh("kill it") < weigh("i kill you") == weigh("you i kill") and weigh("you") == weigh("not you said") == 0
    assert weigh("murder you") == THREAT_WEIGHT > weigh("kill you") == 3.0
    assert weigh("an idiot or scum") == weigh("an idiot") + weigh("a scum") < weigh("an idiot scum")
    assert machine().states == 3 * 4 * 2 * 4 * 2


def by_rules(text):
    """A clause's weight from the rules in words, without any machine."""
    words = WORDS.findall(text)
    person = any(w in TARGET for w in words)
    insults, threats = 0.0, 0.0
    for i, w in enumerate(words):
        weight = 2.0 if w == "idiot" or w.startswith("scum") else 0.0
        threat = 0.0 if weight else 3.0 if w == "kill" else 4.0 if w in THREAT else 0.0
        # Negation reaches three words; an insult is never a negation.
        factor = 0.6 if any(x in NEGATION for x in words[max(0, i - 3) : i]) else 1.0
        factor *= 0.7 if any(x in REPORTED for x in words[:i]) else 1.0
        before = i and (words[i - 1] == "idiot" or words[i - 1].startswith("scum"))
        insults += weight * factor * (1.2 if before else 1.0)
        threats += threat * factor
    return insults * (1.5 if person else 1.0) + threats * (1.0 if person else 0.3)


def test_grammar_against_rules_and_uncomposed_parts():
    rng, grammar = random.Random(4), Grammar(LEXICON)
    pool = ["idiot", "scum", "scumbag", "kill", "murder", "you", "she", "not", "never", "said", "the", "of", "house"]
    for _ in range(3000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert abs(grammar.clause(text) - by_rules(text)) < 1e-9, text
        each = []
        for part in parts():
            state, seen = 0, []
            for word in text.split():
                state, weight = part.step(state, grammar.read(word)[0])
                seen.append(weight)
            each.append((seen, part.end(state)))
        total = [0.0, 0.0]
        for i, word in enumerate(text.split()):
            symbol, weight = grammar.read(word)
            if symbol in "IT":
                k = "IT".index(symbol)
                total[k] += weight * np.prod([seen[i][k] for seen, _ in each])
        assert abs(sum(t * np.prod([end[k] for _, end in each]) for k, t in enumerate(total)) - grammar.clause(text)) < 1e-9
    assert set(SYMBOLS) == set("ITGNRO")


def test_threat_verbs_learn_from_labels(spark):
    rows = [("they kill time", 0)] * 60 + [("i murder you", 1)] * 30 + [("plain words", 0)] * 60
    found = lexicon(spark.createDataFrame(rows, "text string, toxic int"), {1: 30, 0: 120})
    assert found["!kill"] < THREAT_WEIGHT < found["!murder"]


def test_features_need_a_word_start():
    g = Grammar({"scum": 2.0})
    assert g.features("xscum") == [0.0] * 4 and g.features("a. scum!")[2] > 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity(docs, fit_toxicity(docs, labels)).withColumn("held", held_out()).join(labels, "doc_id").collect()
    test = [r for r in out if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    score, y = np.array([r.toxicity for r in test]), np.array([r.toxic for r in test])
    assert auc(score, y) > 0.93
    assert ((score >= 0.5) == (y == 1)).mean() > 0.93
    assert (score[y == 1] >= 0.5).mean() > 0.9 and (score[y == 0] >= 0.5).mean() < 0.02


def test_edges(spark):
    schema = "doc_id long, text string, toxicity string, toxic string, sketch string"
    df = spark.createDataFrame([(1, None, None, None, "s"), (2, "", "x", None, None), (None, "you scum " * 20000, None, "y", None), (2, "", "x", None, None)], schema)
    labels = spark.createDataFrame([(None, 1), (9, 1), (1, None)], "doc_id long, toxic int")
    model = fit_toxicity(df, labels)
    assert model == ({}, PRIOR.tolist())
    out = toxicity(df, ({"scum": 5.0}, model[1])).collect()
    low, high = min(r.toxicity for r in out), max(r.toxicity for r in out)
    assert len(out) == 4 and 0 <= low < 0.1 and 0.9 < high <= 1 and {r.toxic for r in out} == {None, "y"}
    assert toxicity(df.limit(0), model).collect() == [] and fit_toxicity(df.limit(0), labels)
    # Contradicting and repeated labels, repeated ids.
    odd = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity(df, fit_toxicity(df, odd)).collect()) == 4
