"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Five transducers read a clause's words as symbols. Each has states, arcs that weigh what is read, and final weights
by which the clause that ends there counts; weights are pairs, for insults and for threats:

* insult: runs of insults weigh more than single ones; a clause without any has no insult weight;
* threat: a verb and a person threatened, in either order, make a threat; a verb alone counts little;
* target: a clause in which an insult and a person addressed both occur weighs more;
* negation: lowers what follows within a few words;
* reported speech: lowers what follows in its clause.

They are composed once to one machine, whose arcs and final weights are products. A clause's weight is the sum along
its one path, times the final weights; a document's score is a logistic function of its clauses' weights. The insult
arcs are words and word beginnings learned from labelled rows, the threat arcs' weights are learned for a list of
verbs; the other classes are short lists. Learning uses a bounded sample of the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_map, numbered_columns, texts

# Closed word classes in English, German, French and Spanish.
TARGET = set("you your you're u ya he she they them him her people du dich dir ihr euch sie er tu te toi vous ils elle il usted ustedes tú ti ellos él ella".split())
NEGATION = set("not no never isn't aren't don't nobody nicht kein keine niemals nie ne pas jamais aucun nunca jamás ningún".split())
REPORTED = set("said says claimed claims wrote reported quoted called according sagte sagt behauptete schrieb dit disait selon écrit dijo dice según escribió".split())
THREAT = set("kill murder shoot stab strangle töten umbringen erschießen tuer égorger assassiner matar asesinar degollar".split())

WORDS = re.compile(r"\w+(?:'\w+)?")
CLAUSES = re.compile(r"[.!?;:,\n\"¡¿«»()]+")
#: Lengths of word beginnings.
STARTS = range(4, 10)
#: Symbols of the machine: insult, threat, target, negation, reported speech, other.
SYMBOLS = "ITGNRO"


Pair = tuple[float, float]
ONE: Pair = (1.0, 1.0)


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0], a[1] * b[1]


class Transducer:
    """States are numbers from 0. ``arcs`` lead from (state, symbol) to (state, weight); others stay put with weight 1.

    An arc's weight multiplies what the word read there weighs; a final weight multiplies the clause's sum. Both are
    pairs, for insults and threats.
    """

    def __init__(self, states: int, arcs: dict[tuple[int, str], tuple[int, Pair]], final: dict[int, Pair] | None = None) -> None:
        self.states, self.arcs, self.final = states, arcs, final or {}

    def step(self, state: int, symbol: str) -> tuple[int, Pair]:
        return self.arcs.get((state, symbol), (state, ONE))

    def end(self, state: int) -> Pair:
        return self.final.get(state, ONE)

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same symbols; weights multiply."""
        arcs, final = {}, {}
        for a, b in product(range(self.states), range(other.states)):
            final[a * other.states + b] = times(self.end(a), other.end(b))
            for s in SYMBOLS:
                (x, f), (y, g) = self.step(a, s), other.step(b, s)
                arcs[a * other.states + b, s] = (x * other.states + y, times(f, g))
        return Transducer(self.states * other.states, arcs, final)


def insult_transducer(run: float = 1.2) -> Transducer:
    """0: no insult yet, 1: one was read, 2: the word before was one."""
    arcs: dict = {(k, "I"): (2, ONE if k < 2 else (run, 1.0)) for k in range(3)}
    arcs |= {(2, s): (1, ONE) for s in SYMBOLS if s != "I"}
    return Transducer(3, arcs, {0: (0.0, 1.0)})


def threat_transducer(alone: float = 0.3) -> Transducer:
    """0: nothing, 1: a verb, 2: a person, 3: both."""
    arcs: dict = {(0, "T"): (1, ONE), (0, "G"): (2, ONE), (1, "G"): (3, ONE), (2, "T"): (3, ONE)}
    return Transducer(4, arcs, {0: (1.0, 0.0), 1: (1.0, alone), 2: (1.0, 0.0)})


def target_transducer(raised: float = 1.5) -> Transducer:
    return Transducer(2, {(0, "G"): (1, ONE)}, {1: (raised, 1.0)})


def negation_transducer(lowered_to: float = 0.6, reach: int = 3) -> Transducer:
    """The state is how many words negation still reaches."""
    arcs: dict = {(k, s): (max(0, k - 1), (lowered_to, lowered_to) if k and s in "IT" else ONE) for k in range(reach + 1) for s in SYMBOLS}
    return Transducer(reach + 1, arcs | {(k, "N"): (reach, ONE) for k in range(reach + 1)})


def speech_transducer(lowered_to: float = 0.7) -> Transducer:
    return Transducer(2, {(0, "R"): (1, ONE)} | {(1, s): (1, (lowered_to, lowered_to)) for s in "IT"})


def parts() -> list[Transducer]:
    return [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), speech_transducer()]


def machine() -> Transducer:
    first, *others = parts()
    for other in others:
        first = first.compose(other)
    return first


#: What a threat verb weighs before any labelled row, and the rows that this counts for.
THREAT_WEIGHT, THREAT_ROWS = 4.0, 5.0


class Grammar:
    """The composed machine with its lexicon: whole words (ending in a space), beginnings, and (after ``!``) threat verbs."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.machine, self.lexicon = machine(), lexicon
        self.words = {k[:-1]: w for k, w in lexicon.items() if k.endswith(" ")}
        self.threats = dict.fromkeys(THREAT, THREAT_WEIGHT) | {k[1:]: w for k, w in lexicon.items() if k.startswith("!")}
        self.starts = {k: w for k, w in lexicon.items() if not k.endswith(" ") and not k.startswith("!")}
        self.lengths = sorted({len(k) for k in self.starts})
        self.found = ahocorasick.Automaton()
        for k in {*self.words, *self.starts, *self.threats}:
            self.found.add_word(k, len(k))
        self.found.make_automaton()

    def read(self, word: str) -> tuple[str, float]:
        weight = max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in self.lengths)])
        if weight:
            return "I", weight
        if word in self.threats:
            return "T", self.threats[word]
        return ("G" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORTED else "O"), 0.0

    def clause(self, text: str) -> float:
        state, insult, threat = 0, 0.0, 0.0
        for word in WORDS.findall(text):
            symbol, weight = self.read(word)
            state, (f, g) = self.machine.step(state, symbol)
            if symbol == "I":
                insult += weight * f
            elif symbol == "T":
                threat += weight * g
        f, g = self.machine.end(state)
        return insult * f + threat * g

    def features(self, text: str) -> list[float]:
        """Of a lower-case text: log of the clauses' weights in all, the greatest, the number of clauses matched, and their density."""
        hit = False
        for end, n in self.found.iter(text):
            if (end < n or not text[end - n].isalnum()) and not hit:
                hit = True
                break
        if not hit:
            return [0.0] * 4
        weights = [w for c in CLAUSES.split(text) if (w := self.clause(c))]
        total = sum(weights)
        return [math.log1p(total), max(weights, default=0.0) / 4, math.log1p(len(weights)), min(5.0, 1000 * total / (len(text) + 200)) if total else 0.0]


def lowered(text: bytes) -> str:
    return text.decode("utf-8", "replace").lower()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic) with the number of documents.

    A term is a whole word (with a space), the first letters of a longer one, or (with a star) first letters that
    at least three different words of the document share: rarer by chance, so fewer documents speak for it.
    """
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    seen: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            words = set(WORDS.findall(lowered(text)))
            starts = Counter(w[:k] for w in words for k in STARTS if len(w) > k)
            terms = {f"{w} " for w in words} | {w for w in starts if len(w) <= 6} | {f"{w}*" for w, n in starts.items() if n >= 3}
            seen.update((t, toxic) for t in terms)
        if len(seen) > 300_000:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen]), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen]), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)


def _sketch(batch: pa.RecordBatch) -> dict:
    """The least hash of a text's word triples: near copies mostly share it, so that they teach the lexicon once."""
    out = []
    for t in texts(batch.column(0)):
        w = t.split()
        out.append(min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0))
    return {"text": batch.column(0), "toxic": batch.column(1), "sketch": out}


def lexicon(train: DataFrame, rows: dict[int, int], least_docs: int = 4, least_gain: float = 16.0, most: int = 5000) -> dict[str, float]:
    """Terms that mark toxic documents, weighted by log odds, and learned weights of the threat verbs (after ``!``).

    At most ``most`` terms, those of greatest gain, reach the driver.
    """
    p_all, n_all = max(rows.get(1, 0), 1), max(rows.get(0, 0), 1)
    t = train.select("text", "toxic").mapInArrow(_terms, "term string, toxic int, n long").groupBy("term")
    t = t.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("n"))
    share = p_all / (p_all + n_all)
    p, n = F.col("p"), F.col("n")
    gain = 2 * (p * F.log(p / ((p + n) * share)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0))
    odds = F.log((p + 0.5) / (p_all + 1)) - F.log((n + 0.5) / (n_all + 1))
    star = F.col("term").endswith("*").cast("int")
    verb = F.col("term").isin(*[f"{w} " for w in sorted(THREAT)])
    t = t.withColumn("gain", gain).withColumn("odds", odds).withColumn("verb", verb)
    t = t.where(verb | (p >= least_docs - star) & (F.col("gain") >= least_gain - 4 * star) & (F.col("odds") >= 2))
    found: dict[str, float] = {}
    out: dict[str, float] = {}
    for r in t.orderBy(F.desc("verb"), F.desc("gain"), "term").limit(most).collect():
        if r.verb:  # its weight moves from its start as the rows that have it are more or less often toxic than others
            rate = (r.p + THREAT_ROWS * share) / (r.p + r.n + THREAT_ROWS)
            out[f"!{r.term[:-1]}"] = max(0.0, THREAT_WEIGHT + math.log(rate / (1 - rate)) - math.log(share / (1 - share)))
        else:
            found[r.term.rstrip("*")] = max(r.odds, found.get(r.term.rstrip("*"), 0.0))
    for term in sorted(found, key=lambda x: (len(x), x)):  # the shortest beginning speaks for longer ones of no greater odds
        if not any(out.get(term[:k], 0.0) >= found[term] - 1.0 for k in range(4, len(term))):
            out[term] = found[term]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5, rounds: int = 100) -> np.ndarray:
    """Weights (bias last) drawn to ``prior``: Newton steps, halved until the loss falls, which has one minimum."""
    x = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + strength / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
        at = loss(w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > at:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


#: What the score does without any labelled row: no match scores low, a strong clause high.
PRIOR = np.array([1.0, 1.0, 0.5, 0.3, -3.0])


def held_out(ident: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[dict[str, float], list[float]]:
    """Lexicon and score weights from at most ``max_rows`` labelled rows that are not held out.

    The sample is the ``max_rows`` labels of least hash. Labels of null, or of no document, teach nothing; without
    any toxic label the prior stands. A label counts for each row of its id; labels of one id that contradict each
    other count as one row of either kind, and equal ones once. Null and empty texts teach as texts without words.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    y = y.select("doc_id", (F.col("toxic") >= 1).cast("int").alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    train = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic")
    train = arrow_map(train, _sketch, "text string, toxic int, sketch long").groupBy("sketch", "toxic").agg(F.min("text").alias("text"))
    from tracewright.llm.common import written

    train = written(train)
    rows = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    words = lexicon(train, rows) if rows.get(1) else {}

    def features(batch: pa.RecordBatch) -> dict:
        grammar = Grammar(words)
        return {"x": [grammar.features(lowered(t)) for t in texts(batch.column(0))], "toxic": batch.column(1)}

    got = arrow_map(train.select("text", "toxic"), features, "x array<double>, toxic int").collect() if words else []
    if not got:
        return words, PRIOR.tolist()
    x, z = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    return words, fit_logistic(x, z, PRIOR).tolist()


def toxicity(docs: DataFrame, model: tuple[dict[str, float], list[float]], text: str = "text") -> DataFrame:
    """``docs`` (all columns) with toxicity, a score from 0 to 1 of each whole text; a column of that name is replaced.

    Null and empty texts get the score of a text without matches. Only the text is read. Equal texts score alike.
    """
    words, weights = model
    w = np.array(weights)
    docs = docs.drop("toxicity")
    at, names, docs = docs.columns.index(text), docs.columns, numbered_columns(docs)
    cell: list[Grammar] = []

    def score(batch: pa.RecordBatch) -> dict:
        if not cell:
            cell.append(Grammar(words))
        x = np.array([cell[0].features(lowered(t)) for t in texts(batch.column(at))]).reshape(-1, 4)
        s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        return {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {"toxicity": s}

    return arrow_map(docs, score, ", ".join([f"{n} {t}" for n, t in docs.dtypes] + ["toxicity double"])).toDF(*names, "toxicity")
