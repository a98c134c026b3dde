"""Toxicity by a weighted finite-state grammar over clauses.

Words map to classes: insult (a lexicon of words and word beginnings, learned with weights and
classed by their steps), threat (a fixed list; words of the lexicon are insults), target (who is
addressed), negation and reported speech. Five weighted transducers, one a class, are composed into
one machine: that of reported speech rewrites the insults and threats in its scope, that of negation
those left plain, that of targets those left plain after an address; those of insults and of threats
keep the first of their kind's context and the strongest step, and turn a plain one into a targeted
one where an address follows. The weights are on the arcs alone, a learned one for each pair of class
and context: the composition reads a clause's words in order, and what its path adds up to is the
clause's weight. A text's score is the logistic of the sum of its clauses' weights by its length, so
one clause counts less the longer the text is; no word counts but through the path of its clause.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches
from trackloom.llm.language_id import in_training

#: Labelled rows of each label that are learned from, about; the documented bound of the sample.
SAMPLE_ROWS = 20_000
#: Lengths of word beginnings in the lexicon.
STEMS = (4, 5, 6, 7, 8)
#: Toxic rows that must show an entry, and its least log-odds.
LEAST_ROWS, LEAST_ODDS = 3, 2.0
#: Steps of an insult's log-odds, and characters that a text's length counts for at least, about.
STEPS, SHORT = (2, 3, 4, 5, 6, 7), 200
#: Strength of the ridge that keeps rare paths' weights small.
RIDGE = 0.03
#: Words that a task remembers at most.
REMEMBERED = 100_000

#: Word classes of the grammar, in the languages of the corpus.
TARGETS = frozenset("you your yours you're he she they them him her his their u ur du dich dir dein deine ihr euch er sie tu te toi vous votre ton ta il elle ils elles usted ustedes tú ti él ella ellos ellas".split())
NEGATIONS = frozenset("not no never n't isn't aren't wasn't don't doesn't without nicht kein keine nie niemals ne pas jamais aucun sans nunca jamás sin ni".split())
REPORTS = frozenset("said says say called calls wrote writes told tells claimed claims quoted quote reported allegedly sagte sagt nannte schrieb behauptet dit disait appelé écrit prétend dijo dice llamó escribió".split())
THREATS = frozenset("kill hurt destroy murder stab shoot beat burn töten umbringen verletzen tuer détruire frapper brûler matar destruir golpear quemar".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n|\s[-–—|]\s")
KINDS = ("insult", "threat")
CONTEXTS = ("plain", "targeted", "negated", "reported")
#: Word classes that a path's weight depends on: kind and step.
CLASSES = (*(("insult", step) for step in STEPS), ("threat", 0))
#: Lexicon's mark of a threat.
THREAT = -1.0


def label(kind: str, step: int, context: str) -> str:
    return f"{context}/{step}" if kind == "insult" else f"threat_{context}"


PATHS = tuple(label(*c, x) for c in CLASSES for x in CONTEXTS)


class Transducer:
    """A deterministic transducer: from a start, (state, symbol) leads to a state, writes a symbol
    (or nothing) and adds a weight. A symbol without an arc stays as it is."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: list) -> Transducer:
    """The transducer that reads as ``first`` and writes what ``second`` makes of its output, over
    the states that ``symbols`` reach; weights add up."""
    start = (first.start, second.start)
    arcs: dict = {}
    known, ahead = {start}, [start]
    while ahead:
        state = ahead.pop()
        for symbol in symbols:
            one, passed, w = first.step(state[0], symbol)
            two, written, v = second.step(state[1], passed) if passed is not None else (state[1], None, 0.0)
            new = (one, two)
            arcs[state, symbol] = new, written, w + v
            if new not in known:
                known.add(new)
                ahead.append(new)
    return Transducer(start, arcs)


def scope(trigger: str, context: str) -> Transducer:
    """From the word of class ``trigger`` on, plain insults and threats are in ``context``."""
    arcs: dict = {(state, trigger): ("inside", None, 0.0) for state in ("outside", "inside")}
    arcs |= {("inside", (c, "plain")): ("inside", (c, context), 0.0) for c in CLASSES}
    return Transducer("outside", arcs)


def addressed() -> Transducer:
    """After a target plain insults and threats are targeted; targets pass on, as they may follow."""
    arcs: dict = {(state, "target"): ("inside", "target", 0.0) for state in ("outside", "inside")}
    arcs |= {("inside", (c, "plain")): ("inside", (c, "targeted"), 0.0) for c in CLASSES}
    return Transducer("outside", arcs)


def first_of(kind: str, paths: dict[str, float]) -> Transducer:
    """Ends in the context of the clause's first insult, or threat, and the strongest step; the arcs
    add up to the weight of that path. A target after a plain one makes it targeted."""
    steps = [step for k, step in CLASSES if k == kind]
    weight = lambda step, context: paths.get(label(kind, step, context), 0.0)
    arcs: dict = {}
    for new in steps:
        for c in CONTEXTS:
            symbol = ((kind, new), c)
            arcs["none", symbol] = (c, new), symbol, weight(new, c)
            for at in CONTEXTS:
                for old in steps:
                    if new > old:
                        arcs[(at, old), symbol] = (at, new), symbol, weight(new, at) - weight(old, at)
        arcs[("plain", new), "target"] = ("targeted", new), "target", weight(new, "targeted") - weight(new, "plain")
    return Transducer("none", arcs)


class Grammar:
    """The composition under learned weights of paths."""

    def __init__(self, paths: dict[str, float]):
        symbols = ["target", "negation", "report", *((c, "plain") for c in CLASSES)]
        machine = scope("report", "reported")
        for part in (scope("negation", "negated"), addressed(), first_of("insult", paths), first_of("threat", paths)):
            machine = compose(machine, part, symbols)
        self.machine = machine

    def read(self, kinds: list) -> tuple[list[str], float]:
        """The paths of the clause's insult and threat, those that it has, and their weight. ``kinds``
        has a class, a word class's name or None for each word."""
        state, weight = self.machine.start, 0.0
        for kind in kinds:
            if kind is not None:
                state, _, w = self.machine.arcs[state, (kind, "plain") if isinstance(kind, tuple) else kind]
                weight += w
        (_, insult), threat = state
        return [label(k, at[1], at[0]) for k, at in zip(KINDS, (insult, threat)) if at != "none"], weight


def features(word: str):
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Lexicon(dict):
    """Weights of words; the strongest of the word and its beginnings, or else THREAT for words of
    THREATS, 0 for none."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        low = word.lower()
        out = self[word] = max((self.weights.get(f, 0.0) for f in features(low)), default=0.0)
        if not out and low in THREATS:
            out = self[word] = THREAT
        return out


def class_of(word: str, lexicon: Lexicon):
    low, weight = word.lower(), lexicon[word]
    if weight > 0:
        return ("insult", min(STEPS[-1], max(STEPS[0], round(weight))))
    return ("threat", 0) if weight else "report" if low in REPORTS else "negation" if low in NEGATIONS else "target" if low in TARGETS else None


def matched(text: str, lexicon: Lexicon, grammar: Grammar) -> list[tuple[int, int, list[str], float]]:
    """Clauses with an insult or a threat: start, end, their paths and weight."""
    hits = [m for m in _WORD.finditer(text) if lexicon[m[0]]]
    if not hits:
        return []
    out, at, i = [], 0, 0
    for m in [*_CLAUSE.finditer(text), None]:
        end, first = m.start() if m else len(text), i
        while i < len(hits) and hits[i].start() < end:
            i += 1
        if i > first:
            out.append((at, end, *grammar.read([class_of(w[0], lexicon) for w in _WORD.finditer(text, at, end)])))
        at = m.end() if m else end
    return out


def scale_of(text: str) -> float:
    """What a clause counts for in a text of this length: it is one in so many characters."""
    return 1000.0 / (len(text) + SHORT)


def logistic_weights(rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights of the columns and the bias that fit the labels best, by Newton's method."""
    a = np.hstack([rows, np.ones((len(rows), 1))])
    w, least = np.zeros(a.shape[1]), np.diag([ridge] * rows.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + least, a.T @ (weight * (toxic - p)) - least @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Lexicon weights, weights of paths, and the bias, from the texts of labelled rows outside the
    held-out part. Word rows are counted in a Spark aggregation; the lexicon, every entry over the
    limits, comes to the driver and is bounded by the sample. Paths are counted in tasks; a row of
    counts for each sampled text, about 2 x ``sample_rows`` at most, goes to the driver, which fits
    a logistic regression."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & in_training(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        p = 0.5 if not sizes else (0.02 if 0 in sizes else 0.98)
        bias = math.log(p / (1 - p))
        return {"weights": {}, "paths": {}, "bias": bias}
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("toxic") == 1, min(1.0, sample_rows / sizes[1])).otherwise(min(1.0, sample_rows / sizes[0]))
    chosen = known.filter(draw < share)  # about 2 x sample_rows rows of two numbers at most
    sample = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), key)

    def words():
        def work(b):
            f, y = [], []
            for t, toxic in zip(b["__text"], b["toxic"]):
                own = {x for w in {w.lower() for w in _WORD.findall(t)} for x in features(w)}
                f += own
                y += [int(toxic)] * len(own)
            return {"f": f, "y": y}

        return work

    seen = sizes_of(sample)
    n1, n0 = max(1, seen.get(1, 0)), max(1, seen.get(0, 0))
    counts = map_batches(sample.select("__text", "toxic"), words, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log(((F.col("a") + 0.1) / n1) / ((F.col("b") + 0.5) / n0))
    top = counts.filter(F.col("a") >= LEAST_ROWS).withColumn("w", odds).filter(F.col("w") >= LEAST_ODDS).select("f", "w").collect()
    weights = {r["f"]: float(r["w"]) for r in top}
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def paths():
        lexicon, grammar = Lexicon(shared.value), Grammar({})

        def work(b):
            out = {"counts": [], "scale": [], "y": []}
            for t, toxic in zip(b["__text"], b["toxic"]):
                counts = [0] * len(PATHS)
                for clause in matched(t, lexicon, grammar):
                    for path in clause[2]:
                        counts[PATHS.index(path)] += 1
                for column, v in zip(out.values(), (counts, scale_of(t), int(toxic))):
                    column.append(v)
            return out

        return work

    rows = map_batches(sample.select("__text", "toxic"), paths, "counts array<int>, scale double, y int").collect()
    if not rows:
        return {"weights": weights, "paths": {}, "bias": 0.0}
    y = np.array([r["y"] for r in rows], float)
    counts = np.array([r["counts"] for r in rows], float) * np.array([[r["scale"]] for r in rows])
    # the sample's shares of labels are brought back to the corpus's
    keep = np.where(y == 1, min(1.0, sample_rows / sizes[1]), min(1.0, sample_rows / sizes[0]))
    # in a fixed order: sums of the same sample come out the same, however its rows are dealt
    order = np.lexsort((*counts.T, y))
    fitted = logistic_weights(counts[order], y[order], (keep.mean() / keep)[order])
    return {"weights": weights, "paths": dict(zip(PATHS, fitted[:-1].tolist())), "bias": float(fitted[-1])}


def sizes_of(sample: DataFrame) -> dict[int, int]:
    return {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}


def score_of(text: str, model: dict, lexicon: Lexicon, grammar: Grammar) -> tuple[float, list[tuple[int, int, str, float]]]:
    """The score, and the clauses with start, end, paths (joined by a blank) and weight."""
    found = matched(text, lexicon, grammar)
    logit = model["bias"] + scale_of(text) * sum(c[3] for c in found)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), [(a, b, " ".join(paths), w) for a, b, paths, w in found]


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 if score >= ``threshold``) and clauses (array of
    start, end, context, weight in code points).

    Null and empty texts have no clause and the score of a text without a match. Columns of these
    names are replaced, all others stay. Rows are independent: equal texts have equal scores, and
    there is no shuffle.
    """
    rows = docs.drop("score", "predicted", "clauses")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        lexicon, grammar = Lexicon(m["weights"]), Grammar(m["paths"])

        def work(b):
            found = [score_of(t or "", m, lexicon, grammar) for t in b[text]]
            return b | {"score": [f[0] for f in found], "predicted": [int(f[0] >= threshold) for f in found], "clauses": [[dict(zip(("start", "end", "context", "weight"), c)) for c in f[1]] for f in found]}

        return work

    return map_batches(rows, make, f"{schema}, score double, predicted int, clauses array<struct<start:int,end:int,context:string,weight:double>>")
