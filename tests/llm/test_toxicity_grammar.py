"""The toxicity grammar: composition against transducers applied one by one, and what its paths weigh."""

import itertools
import random

from timberline.llm import toxicity
from timberline.llm.toxicity import insult, negation, reported_speech, target, threat
from timberline.llm.transducers import Paths, Transducer, compose

READS = ["I0", "I3", "H", "T", "N", "R", "F", "o"]


def outputs(machine, symbols):
    """All accepted (output, weight) of one transducer."""
    found = [(machine.start, (), 0.0)]
    for x in symbols:
        found = [(to, out + (y,), w + more) for state, out, w in found for y, to, more in machine.arcs.get(state, {}).get(x, ())]
    return [(out, w) for state, out, w in found if state in machine.finals]


def by_hand(symbols):
    """The five transducers one behind the other, every path of each."""
    found = [(tuple(symbols), 0.0)]
    for machine in (reported_speech(), negation(), target(), insult(), threat()):
        found = [(out, w + more) for made, w in found for out, more in outputs(machine, made)]
    return max(w for _, w in found)


def test_best_path_equals_all_paths():
    paths, dice = Paths(toxicity.grammar()), random.Random(4)
    short = [list(s) for n in range(4) for s in itertools.product(READS, repeat=n)]
    for symbols in short + [dice.choices(READS, k=dice.randint(4, 9)) for _ in range(400)]:
        assert abs(paths.heaviest(symbols)[0] - by_hand(symbols)) < 1e-9, symbols


def test_composition_without_common_symbols():
    a, b = Transducer(0, {0}), Transducer(0, {0})
    a.add(0, "x", "y", 0, 1.0)
    b.add(0, "z", "z", 0, 1.0)
    both = compose(a, b)
    assert both.arcs == {} and both.finals == {(0, 0)}
    assert Paths(both).heaviest(["x"]) == (0.0, 0) and Paths(both).heaviest([]) == (0.0, 0)


def weight(text):
    return toxicity.Grammar(({"idiot": 4.2, "mor*": 0.0, "moro*": 4.2}, {"stuff": "T"})).features(text)[0]


def test_what_clauses_weigh():
    assert weight("you idiot") == weight("Idiot, you!") == weight("you are such an idiot") == weight("stuff moronic") > 4
    assert 0 < weight("the idiot light on the dashboard") == weight("idiot") < weight("you idiot")
    assert 0 < weight("not an idiot") < weight("the idiot light")
    assert weight("you are not an idiot") < weight("idiot")
    assert weight("she said you are an idiot") < weight("you are an idiot")
    # A negation reaches over light words only, and not past the clause.
    assert weight("never kind you idiot") == weight("no. you idiot") == weight("you idiot")
    assert weight("I will kill you") > 0 == weight("kill the process") == weight("") == weight(".;!")
    # A target after more than two words is not met; targets stay within their clause.
    assert weight("idiot of all the you") == weight("you. idiot") == weight("idiot")
    kind = toxicity.Grammar(({"idiot": 4.2}, {}))
    assert kind.features("you idiot. idiot")[1:] == (weight("you idiot") + weight("idiot"), 2)
    assert kind.features("idiot you " * 20_000)[2] == 20_000


def test_symbols_are_learned():
    filler = [f"word{k} and more of it" for k in range(40)]
    toxic = [(f"{filler[k]}. grumpf blorgish zed {k}", 1) for k in range(40)]
    clean = [(f"{filler[k]}. nowise blorgish thing" if k % 4 == 0 else f"{filler[k]}. all well", 0) for k in range(200 // 5)]
    insults, classes = toxicity.learn([*toxic, *clean, *[(f"{f} again", 0) for f in filler * 8]])
    assert "blorgish" in insults and classes["nowise"] == "N" and classes["and"] == "F"
    g = toxicity.Grammar((insults, classes))
    assert g.symbol("nowise") == "N" and g.symbol("blorgish")[0] == "I" and g.symbol("well") in ("o", "F")
    assert g.clause(["nowise", "blorgish"])[0] < g.clause(["blorgish"])[0]


def test_awkward_rows(spark):
    """Null, empty, long and repeated texts, clashing columns, a document labelled both ways, learned labels only."""
    made = [(i, f"calm words here {i % 7} and more." + (" you are a blorgish fool." if i % 3 == 0 else " all is well."), i % 3 == 0) for i in range(200)]
    made += [(1000, None, False), (1001, "", False), (1002, "calm words. " * 20_000, False), (0, made[0][1], True), (None, made[0][1], True)]
    df = spark.createDataFrame([(i, t, int(y), "x", 1.0) for i, t, y in made], "doc_id bigint, text string, toxic int, lang string, score double")
    labels = df.select("doc_id", "toxic").unionAll(spark.createDataFrame([(3, 0), (None, None), (4, None)], "doc_id bigint, toxic int"))
    got = sorted((str(r.doc_id), r.predicted) for r in toxicity.score(df.drop("toxic"), labels).collect())
    assert got == sorted((str(i), int(y)) for i, _, y in made)
    kept = toxicity.clear_rows(df.drop("toxic"), labels)
    assert kept.columns == df.drop("toxic").columns and kept.count() == sum(not y for _, _, y in made)
