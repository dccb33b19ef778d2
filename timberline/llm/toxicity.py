"""Toxicity by a grammar of weighted transducers, read clause by clause.

The words of a clause become symbols: insults of four strengths, threats, targets, negations, reported speech, light words,
others. Five transducers are composed to one: reported speech marks what follows it, negation marks an insult or threat
behind it (light words may stand between), target marks one that has a target shortly before or (guessed, and proved by the
rest of the path) shortly after it, insult and threat weigh what is marked. The best accepted path weighs the clause: an insult
at a target counts whole, one without a target takes a path of its own low weight, and a threat without a target weighs nothing.
A text's score is the calibrated weight of its heaviest clause and of all its clauses.

Symbols are learned from labels: insults are words and beginnings of words far more common in toxic texts; targets stand beside them more
often than elsewhere; negations and reports stand before them in texts that are not toxic; light words are in a tenth of all texts. Small
fixed lists add to these.

Null, empty and clean texts get the calibrated score of no match. Without labels of both kinds every score is 0. Repeated rows
are scored each. A document labelled both ways counts as toxic. Long texts take time and memory in proportion to their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import frames, keep_rows, labelled_sample, logistic, logistic_fit, remainder, texts
from timberline.llm.transducers import Paths, Transducer, compose

SCHEMA = "doc_id bigint, score double, n_matches bigint"
PER_CLASS = 2500
# Fixed word classes, beside those learned.
TARGET = frozenset("you your u ya he she they him her tu te vous toi du dich ihr sie ustedes usted ellos".split())
THREAT = frozenset("kill hurt destroy beat burn tuer töten matar schlagen".split())
NEGATION = frozenset("not never no isn't aren't nicht kein keine jamás nunca ne pas".split())
REPORTED = frozenset("said says called reported quoted wrote claims dit sagte dijo".split())
LIGHT = frozenset("a an the such so are is was be been all ein eine der die das un une le la les una el es est ist bist".split())
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SHORTEST, LONGEST = 4, 8

LEVELS = 4
# Log odds of an insult of each level start here; a level weighs the middle of its range.
LEVEL_STARTS = (2.0, 3.0, 4.0, 5.0)
THREAT_WEIGHT = 3.5
# Share of a weight that stays without a target, behind a negation, in reported speech.
PLAIN, NEGATED, REPORT = 0.5, 0.1, 0.5
# How many steps a target reaches forward (a light word is one, another word two), a target may follow, a negation reaches.
REACH, FOLLOW, SCOPE = 4, 2, 3
INSULTS = tuple(f"I{k}" for k in range(LEVELS))
OTHERS = ("T", "N", "R", "F", "o")


def marked(more: str) -> list[str]:
    """Insults and threats with any of the marks."""
    return [kind + marks for kind in (*INSULTS, "H") for marks in reduce(lambda got, m: got + [g + m for g in got], more, [""])]


def reported_speech() -> Transducer:
    """Whatever follows a verb of speech in its clause is a report (mark r)."""
    out = Transducer("own", {"own", "report"})
    for state in out.finals:
        for x in OTHERS:
            out.add(state, x, x, "report" if x == "R" else state)
        for x in marked(""):
            out.add(state, x, x + ("r" if state == "report" else ""), state)
    return out


def negation() -> Transducer:
    """A negation reaches over light words to an insult or threat (mark n); the state is how far it still reaches."""
    out = Transducer(0, set(range(SCOPE + 1)))
    for left in out.finals:
        for x in OTHERS:
            out.add(left, x, x, SCOPE if x == "N" else max(left - 1, 0) if x == "F" else 0)
        for x in marked("r"):
            out.add(left, x, x + ("n" if left else ""), 0)
    return out


def target() -> Transducer:
    """Marks (t) what has a target near. A target to come is guessed: the state of a guess is final only once the target is read."""
    near, guess = [("near", k) for k in range(REACH + 1)], [("guess", k) for k in range(1, FOLLOW + 1)]
    out = Transducer(near[0], set(near))
    for k, state in enumerate(near):
        for x in OTHERS:
            out.add(state, x, x, near[REACH if x == "T" else max(k - (1 if x == "F" else 2), 0)])
        for x in marked("rn"):
            out.add(state, x, x + ("t" if k else ""), near[max(k - 1, 0)])
            out.add(state, x, x + "t", guess[-1])
    for k, state in enumerate(guess):
        for x in OTHERS:
            if x == "T":
                out.add(state, x, x, near[REACH])
            elif k:
                out.add(state, x, x, guess[k - 1])
        for x in marked("rn"):
            if k:
                out.add(state, x, x + "t", guess[k - 1])
    return out


def share(marks: str) -> float:
    return (1.0 if "t" in marks else PLAIN) * (NEGATED if "n" in marks else 1.0) * (REPORT if "r" in marks else 1.0)


def insult() -> Transducer:
    """Weighs insults by level and marks; all else passes."""
    out = Transducer(0, {0})
    for x in (*OTHERS, *marked("rnt")):
        out.add(0, x, x, 0, (LEVEL_STARTS[int(x[1])] + 0.5) * share(x[2:]) if x[0] == "I" else 0.0)
    return out


def threat() -> Transducer:
    """Weighs threats at a target; all else passes."""
    out = Transducer(0, {0})
    for x in (*OTHERS, *marked("rnt")):
        out.add(0, x, x, 0, THREAT_WEIGHT * share(x[1:]) if x[0] == "H" and "t" in x else 0.0)
    return out


def grammar() -> Transducer:
    return reduce(compose, (reported_speech(), negation(), target(), insult(), threat()))


@lru_cache(100_000)
def pieces(word: str) -> tuple[str, ...]:
    """What of a word can be learned as an insult: itself, and its beginnings (marked with a star)."""
    return (word, *(word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1)))


def clauses(text: str) -> list[list[str]]:
    return [found for part in CLAUSE.split(text.lower()) if (found := WORD.findall(part))]


def strength(word: str, insults: dict[str, float]) -> float:
    return max(map(insults.get, filter(insults.__contains__, pieces(word))), default=0.0)


def learn_insults(sample: list[tuple[str, int]], spread: float = 8.0, least: int = 6) -> dict[str, float]:
    """Pieces far more common in toxic training texts, with their log odds. Counts are of texts, not places."""
    seen, sizes = (Counter(), Counter()), Counter(y for _, y in sample)
    for text, y in sample:
        seen[y].update({p for w in set(WORD.findall(text.lower())) for p in pieces(w)})
    odds = {}
    for piece, n in seen[1].items():
        ratio = (n + 0.5) / (sizes[1] + 1) / ((seen[0][piece] + 0.5) / (sizes[0] + 1))
        if n >= least and ratio >= spread:
            odds[piece] = math.log(ratio)
    return odds


def learn_classes(sample: list[tuple[str, int]], insults: dict[str, float], spread: float = 8.0, least: int = 6) -> dict[str, str]:
    """Class of each learned word that is no insult itself. Counts are of texts, not places."""
    texts_with, beside, behind, before = Counter(), Counter(), Counter(), Counter()
    beside_any, calm = 0, 0
    known: dict[str, bool] = {}
    for text, y in sample:
        near, close, far, every = set(), set(), set(), set()
        for found in clauses(text):
            every.update(found)
            for i, word in enumerate(found):
                if word not in known:
                    known[word] = bool(strength(word, insults))
                if known[word]:
                    near.update(found[max(i - 2, 0):i] + found[i + 1:i + 3])
                    close.update(found[max(i - SCOPE, 0):i])
                    far.update(found[max(i - 12, 0):max(i - SCOPE, 0)])
        texts_with.update(every)
        if y:
            beside.update(near)
            beside_any += bool(near)
        else:
            behind.update(close)
            before.update(far)
            calm += bool(close or far)

    def often(counts: Counter, base: int) -> set[str]:
        """Words whose share of the texts with an insult is far above their share of all texts."""
        return {w for w, n in counts.items()
                if n >= least and not known[w] and n / max(base, 1) >= spread * texts_with[w] / len(sample)}

    out = {w: "F" for w, n in texts_with.items() if 10 * n >= len(sample) and n >= least and not known[w]}
    for kind, found in (("R", often(before, calm)), ("N", often(behind, calm)), ("T", often(beside, beside_any))):
        out.update({w: kind for w in found if w not in out})
    return out


class Grammar:
    """Words to symbols, clauses to weights. ``model`` holds the learned insults and the learned classes."""

    def __init__(self, model: tuple[dict[str, float], dict[str, str]]):
        self.insults, self.classes = model
        self.paths = Paths(grammar())
        self.cache: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        found = self.cache.get(word)
        if found is None:
            weight = strength(word, self.insults)
            found = (f"I{max(sum(weight >= x for x in LEVEL_STARTS) - 1, 0)}" if weight
                     else next((kind for kind, listed in (("H", THREAT), ("T", TARGET), ("N", NEGATION), ("R", REPORTED), ("F", LIGHT))
                                if word in listed), None) or self.classes.get(word, "o"))
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def clause(self, words: list[str]) -> tuple[float, int]:
        """Weight of the best path and how many insults and threats it weighs."""
        symbols = [self.symbol(w) for w in words]
        # A stretch without an insult or threat at the clause's end weighs nothing once no guess can be open.
        last = max((i for i, x in enumerate(symbols) if x[0] in "IH"), default=-1)
        return self.paths.heaviest(symbols[:last + 1 + FOLLOW]) if last >= 0 else (0.0, 0)

    def features(self, text: str) -> tuple[float, float, int]:
        found = [self.clause(words) for words in clauses(text)]
        return max((w for w, _ in found), default=0.0), sum(w for w, _ in found), sum(n for _, n in found)


def learn(sample: list[tuple[str, int]], least: int = 6) -> tuple[dict[str, float], dict[str, str]]:
    insults = learn_insults(sample, least=least)
    return insults, learn_classes(sample, insults, least=least)


def inputs(found: tuple[float, float, int], size: int) -> tuple[float, ...]:
    return found[0] / 4, math.log1p(found[1]), math.log1p(1000 * found[1] / (size + 200))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    sample = sorted(labelled_sample(docs, labels, "toxic", per_class))
    if len({y for _, y in sample}) < 2:
        return None
    # Weights are calibrated on texts that the symbols were not learned from, then the symbols are learned from all.
    x, y = [], []
    for fold in (0, 1):
        grammar = Grammar(learn([s for i, s in enumerate(sample) if i % 2 != fold], least=4))
        for text, label in (s for i, s in enumerate(sample) if i % 2 == fold):
            x.append(inputs(grammar.features(text), len(text)))
            y.append(label)
    return learn(sample), logistic_fit(x, y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        if model.value is None:
            yield from frames(batches, lambda ids, found: {"doc_id": ids, "score": [0.0] * len(found), "n_matches": [0] * len(found)})
            return
        grammar = Grammar(model.value[0])

        def columns(ids, found):
            got = [grammar.features(x) for x in found]
            x = [inputs(g, len(t)) for g, t in zip(got, found)] or [(0.0, 0.0, 0.0)]
            return {"doc_id": ids, "score": logistic(x, model.value[1])[:len(found)], "n_matches": [g[2] for g in got]}

        yield from frames(batches, columns)

    return texts(docs).mapInArrow(run, SCHEMA).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def clear_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def judge():
        if model.value is None:
            return lambda text: True
        grammar, weights = Grammar(model.value[0]), model.value[1]
        return lambda text: logistic([inputs(grammar.features(text), len(text))], weights)[0] < threshold

    return keep_rows(docs, judge)
