"""The corpus operators on awkward rows, against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from timberline.llm import (
    byte_bpe, decontamination, language_id, license_scan, ngram_jaccard, ngram_lm, quality_classifier, quality_rules, token_counts, toxicity,
)
from timberline.llm.common import Steps
from timberline.llm.components import components

BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", "  \n\t ", "One two", "one TWO", BASE, BASE + " tail", BASE, "x" + BASE[2:] + " p q r s t u v w x y z 1 2 3 4 5 6 7 8 9",
    "GNU General Public License version 2 or later. All rights reserved. CC BY 4.0 cc-by", "12 ### !!", "a" * 3000, "na " * 5000,
    "日本語 😀 text <|endoftext|> it's\r\n\r\n end  ", "line\nline\n\n line\nline", "\x00\x0b odd\x0c É",
]
# Ids tie and repeat; other columns clash with the operators' own names.
COLUMNS = "doc_id bigint, text string, lang string, source string, h bigint, class string, n int, word string, host string, score string"


def rows():
    out = [(i, t, "en" if i % 2 else "fr", None if i == 3 else "s", i, "c", 1, "w", "x", "y") for i, t in enumerate(TEXTS)]
    return out + [out[5], (None, "no id here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_byte_bpe(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.encode_decode(docs, path, P.PATTERN)
    assert found.count() == len(rows()) and byte_bpe.encode_decode(none, path, P.PATTERN).count() == 0
    got = by_id(found)
    for i, text in enumerate(TEXTS):
        ids = true.encode_ordinary(text or "")
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert by_id(byte_bpe.encode(docs, path, P.PATTERN))[3].ids == true.encode_ordinary("One two")


def test_token_counts(docs, none):
    path = P.path("byte_bpe_50k.json")
    true = Tokenizer.from_file(path)
    got = by_id(token_counts.count_tokens(docs, path, P.PATTERN))
    for i, text in enumerate(TEXTS):
        n = len(true.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert token_counts.count_tokens(none, path, P.PATTERN).count() == 0


def test_language_model(docs, none):
    found = ngram_lm.score(docs)
    assert found.count() == len(rows()) and ngram_lm.score(none).count() == 0
    words = lambda t: (t or "").encode().lower().split() + [b" end"]
    train = Counter(w for i, t, *_ in rows() if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in words(t))
    for i, r in by_id(found).items():
        if i is not None:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(TEXTS[i])), sum(train[w] > 0 for w in words(TEXTS[i])), sum(train.values()))
            assert r.score < 0


def test_model_is_a_distribution(spark, none):
    """The probabilities after a seen word sum to one over the vocabulary and the unknown word."""
    import numpy as np

    made = spark.createDataFrame([(1, "a b a c a b d a a"), (2, "b a c")], "doc_id bigint, text string")
    model, hashes = ngram_lm.fit(made), ngram_lm.Hashes()
    stores = [ngram_lm.Shards(model["root"], n, model["shards"], f) for n, f in (("pairs", ("n",)), ("words", ngram_lm.FIELDS))]
    right = np.array([hashes[w] for w in (b"a", b"b", b"c", b"d", ngram_lm.END, b"unseen")])
    for left in (b"a", b"b", ngram_lm.START):
        assert (10 ** ngram_lm.log_probabilities(model, *stores, np.full(6, hashes[left]), right)[2]).sum() == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_an_order(spark, order):
    """Scores against brute force, and probabilities after contexts of every length that sum to one."""
    import math

    import numpy as np

    made = [(1, "a b a c a b d a a b a c"), (2, "b a c"), (3, "a b a d"), (4, ""), (5, "c"), (6, "c"), (7, "a b a c d d c a b a")]
    asked = [(20, "a b a c"), (21, "a b x b a c d"), (22, ""), (23, "c"), (24, "x y z")]
    lists = lambda rows: [["<s>", *t.split(), "</s>"] for _, t in rows]
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in lists(made):
        for k in counts:
            counts[k].update(g for i in range(len(t) - k + 1) if (g := tuple(t[i:i + k])) and (k == order or g[0] == "<s>"))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    del counts[1][("<s>",)]
    types = {w for t in lists(made) for w in t[1:]}
    cut = {k: [0.0, *ngram_lm.discounts(*[sum(n == i for n in counts[k].values()) for i in (1, 2, 3, 4)])] for k in counts}

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (len(types) + 1)
        after = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        n = counts[k][gram]
        return (n - cut[k][min(n, 3)] + sum(cut[k][min(m, 3)] for m in after) * lower) / sum(after) if after else lower

    docs = spark.createDataFrame(made + asked, "doc_id bigint, text string")
    model, hashes = ngram_lm.fit(docs.where("doc_id < 20"), order), ngram_lm.Hashes()
    opened = ngram_lm.open_model(model)
    _, _, own = ngram_lm.score_tokens(model, opened, [ngram_lm.token_hashes(t, hashes) for _, t in asked])
    assert own == pytest.approx([math.log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for t in lists(asked) for i in range(1, len(t))])
    for before in ([], ["a"], ["a", "b"], ["a", "b", "a"], ["b", "x"]):
        start = [hashes[ngram_lm.START], *[hashes[w.encode()] for w in before]]
        ends = [hashes[w] for w in (b"a", b"b", b"c", b"d", ngram_lm.END, b"unseen")]
        own = ngram_lm.score_tokens(model, opened, [np.array([*start, e]) for e in ends])[2]
        assert (10 ** own[len(before)::len(before) + 1]).sum() == pytest.approx(1)
    if order == 3:
        assert ngram_lm.fit(docs)["order"] == 3 and ngram_lm.score(docs, 7, 2, 3).count() == 12


def test_jaccard_join(docs, none):
    got = by_id(ngram_jaccard.join(docs))
    sets = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), least[i]) for i in sets}
    assert least[6] == least[7] == 5 and ngram_jaccard.join(none).count() == 0
    assert ngram_jaccard.keep_one(docs).columns == docs.columns


def test_jaccard_links(spark, docs, none):
    """All links between different sets, also those inside a group that is linked already."""
    import random

    draw = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    made = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[draw.randrange(len(words))] = f"u{draw.randrange(1000)}"
        made.append((100 + i, " ".join(words[:110 + i % 11])))
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(made, "doc_id bigint, text string"))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset({tuple(w)} - {()}))
    near = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in set(sets) - {s}) if s else 0 for s in sets}
    found = ngram_jaccard.link_counts(both).collect()
    assert Counter((r.doc_id, r.n_links) for r in found) == Counter((i, near[s]) for (i, _), s in zip(texts, sets))
    assert sum(near[s] for s in set(sets)) == 2 * ngram_jaccard.links(both).count() > 2 * len(set(sets))
    of = {}
    for r in found:
        of.setdefault(r.class_id, set()).add(next(s for (i, _), s in zip(texts, sets) if i == r.doc_id))
    assert all(len(x) == 1 for c, x in of.items() if c is not None) and of[None] == {frozenset()}
    assert ngram_jaccard.link_counts(none).count() == 0 and ngram_jaccard.links(none).count() == 0


def test_classifiers_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for score in (toxicity.score, quality_classifier.score):
        assert score(docs, labels).count() == len(rows()) and score(none, labels).count() == 0
        nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
        assert score(docs, nulls).count() == len(rows())


def test_quality_dictionaries_see_the_whole_sample(spark):
    """Passages shared late in long texts, by texts from all over the alphabet, are in the dictionaries."""
    import random

    draw = random.Random(5)
    noise = lambda n: " ".join(f"{draw.randrange(1 << 40):x}" for _ in range(n))
    passages = [noise(8) for _ in range(52)]
    own = lambda i: passages[i % 52]
    made = [(i, f"{chr(97 + i // 2 % 26)} {noise(150)} {own(i)} {noise(20)}", i % 2) for i in range(1560)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, quality int")
    found = quality_classifier.fit(df.drop("quality"), df.select("doc_id", "quality"))
    for y, content in zip((1, 0), found):
        assert len(content) <= quality_classifier.DICTIONARY_BYTES
        assert sum(own(2 * k + y).encode() in content for k in range(26)) >= 24
    few = [("é" * 700 + f" end of {k}") for k in range(20)]
    assert all(x.encode() in quality_classifier.dictionary(few) for x in few)


def test_toxicity_learns_held_out(spark):
    made = [(i, f"calm words here {i % 7} and more." + (" you are a blorgish fool." if i % 3 == 0 else " all is well."), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    got = by_id(toxicity.score(df.drop("toxic"), df.select("doc_id", "toxic")))
    assert all(got[i].predicted == y for i, _, y in made)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, BASE), (2, None), (3, ""), (4, "w40 w41 w42 w43 w44 w45 w0 w1 w2 w3 w4 w5"), (5, "absent words of an item")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    # Item 4 has its passages in another order.
    assert found == {(i, k) for i in (5, 6, 7) for k in (1, 4)} | {(8, 1), (8, 4)}
    assert decontamination.find_leaks(none, items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items).count() == len(rows()) - 5


def test_language(docs, none):
    got = by_id(language_id.identify(docs))
    assert [got[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and got[5].lang_pred in ("en", "fr")
    assert language_id.identify(none).count() == 0


def test_license_scan(docs, none):
    r = by_id(license_scan.scan(docs))
    assert (r[9].n_base, r[9].first_word, r[9].last_word, r[9].base_labels) == (4, 1, 15, "cc-by,gpl,reserved")
    assert "gpl-2" in r[9].labels and "cc-by-4.0" in r[9].labels
    assert (r[0].n_words, r[0].labels, r[0].first_word) == (0, "", None) and license_scan.scan(none).count() == 0
    assert len(license_scan.rules()) > 200


def spelled(tree, most: bool) -> str:
    """A text that a pattern matches: with no optional part and first branches, or with all of them and last branches."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "MAX_REPEAT":
            out += spelled(value[2], most) * max(value[0], int(most))
        elif op == "SUBPATTERN":
            out += spelled(value[3], most)
        elif op == "BRANCH":
            out += spelled(value[1][-1 if most else 0], most)
        elif op == "IN":
            out += chr(value[0][1][0] if str(value[0][0]) == "RANGE" else value[0][1])
        else:
            raise ValueError(op)
    return out


def test_each_license_rule_fires(spark):
    rules = license_scan.rules()
    assert len(rules) == len(set(rules))
    made = [(2 * i + most, f"This is {spelled(re._parser.parse(x), bool(most))}, see.") for i, (_, _, x, _) in enumerate(rules) for most in (0, 1)]
    made += [(-1, "CC0 1.0"), (-2, "Creative Commons Zero"), (-3, "under LGPLv3"), (-4, "cc0x cc01 mitten"), (-5, "lgpl 2 only")]
    got = by_id(license_scan.scan(spark.createDataFrame(made, "doc_id bigint, text string")))
    missing = [(rules[i // 2], t) for i, t in made if i >= 0 and rules[i // 2][3] not in got[i].labels.split(",")]
    assert not missing
    assert [got[-k].labels for k in range(1, 6)] == ["cc0-1.0", "cc0", "lgpl-3", "", "lgpl-2-only"]
    assert [got[-k].n_places for k in range(1, 6)] == [1, 1, 1, 0, 1] and got[-1].score > 0.5 and got[-4].score == 0


def test_quality_rules(docs, none):
    found = quality_rules.apply(docs)
    assert found.count() == len(rows()) and quality_rules.apply(none).count() == 0
    for i, r in by_id(found).items():
        if i is None:
            continue
        text = TEXTS[i] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))


def test_jaccard_unlinked_template(spark):
    """Texts of one template, each with a fifth of its own words, are below the threshold and make hardly any candidates."""
    template = [f"t{i}" for i in range(200)]
    made = [(i, " ".join([f"own{i}x{k}" for k in range(44)] + template)) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    steps = Steps(spark)
    _, _, postings = ngram_jaccard.prepare(df, 80, steps)
    assert ngram_jaccard.candidates(postings, 80).count() < 300
    assert all(r.component_id == r.doc_id for r in ngram_jaccard.join(df).collect())


def test_jaccard_sets_are_shuffled_once_for_both_ends(spark, monkeypatch):
    """The sets of the checked classes are made and shuffled by one exchange that both joins read, and are not written."""
    written, plans, write = [], [], Steps.write

    def watched(self, df, label):
        written.append(label)
        if label == "class-links":
            found = df.select("*")
            found.collect()
            plans.append(found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return write(self, df, label)

    monkeypatch.setattr(Steps, "write", watched)
    made = [(i, " ".join([f"g{i % 4}w{k}" for k in range(60)] + [f"own{i}"])) for i in range(24)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_jaccard.join(spark.createDataFrame(made, "doc_id bigint, text string"))
        assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i % 4) for i in range(24)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "fragments" not in written
    assert plans[0].count("MapInArrow") == 1 and plans[0].count("ReusedExchange") >= 1


def test_shingles_of_long_texts_and_words():
    made = ["a b c d e f " * 60_000, "x" * 300 + " y " + "x" * 299 + "z q r s", None, "", " \t", "É é A a", "one " + "w" * 5000]
    for text, got in zip(made, ngram_jaccard.shingle_sets(made), strict=True):
        w = (text or "").encode().lower().split()
        assert len(got) == len({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
        assert list(got) == list(next(ngram_jaccard.shingle_sets([text])))


def test_rows_are_kept_by_their_own_text(spark):
    """One row of a group stays; rows of one id with other texts, and rows without an id, are judged by themselves."""
    near = BASE + " tail"
    made = [(1, BASE), (1, BASE), (2, near), (None, near), (2, "quite another text of these two"), (None, "alone without an id"), (3, ""), (3, None)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    kept = Counter((r.doc_id, r.text) for r in ngram_jaccard.keep_one(df).collect())
    assert kept == Counter([(1, BASE), (2, "quite another text of these two"), (None, "alone without an id"), (3, ""), (3, None)])
    items = spark.createDataFrame([(9, BASE)], "item_id bigint, text string")
    left = Counter((r.doc_id, r.text) for r in decontamination.clean(df, items).collect())
    assert left == Counter(made[4:])


def test_language_bits_are_weighted(spark):
    made = [(i, ("the cat and the dog are here" if i % 2 else "der hund und die katze sind da") + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(made + [(None, "123 !", None), (7, None, "en")], "doc_id bigint, text string, lang string")
    languages, code, _, trust = language_id.fit(df)
    assert languages == ["de", "en"] and trust.shape == code.shape and trust.sum(1) == pytest.approx([1, 1]) and (trust > 0).all()
    assert Counter(r.lang_pred for r in language_id.identify(df).collect()) == {"en": 30, "de": 30, "und": 2}
    assert language_id.clear_rows(df).count() == 60 and language_id.clear_rows(df).columns == df.columns
    # Equal evidence for two languages is flagged and leaves.
    twins = spark.createDataFrame([(i, "same words in both", lang) for i in range(20) for lang in ("en", "de")], "doc_id bigint, text string, lang string")
    assert all(r.ambiguous for r in language_id.identify(twins).collect()) and language_id.clear_rows(twins).count() == 0


def test_pipeline_is_registered():
    assert "pipeline" in contract.queries() and len(corpus_pipeline.STAGES) == 5
    assert sum(bool(re.match(r"op\d+_", k)) for k in contract.queries()) == 13


def test_components_of_stars_and_chains(spark):
    def found(pairs):
        return {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}

    assert found([]) == {} and found([(1, 1)]) == {}
    assert found([(5, 2), (7, 2), (9, 3), (3, 9)]) == {2: 2, 5: 2, 7: 2, 3: 3, 9: 3}
    chain = found([(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 91)])
    assert chain == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 91, 95, 100)}}
    assert components(spark.createDataFrame([(5, 2)] * 3, "a bigint, b bigint")).count() == 2


def test_jaccard_order_reaches_the_driver_in_blocks(spark):
    import numpy as np

    made = [" ".join(f"w{(i * k) % 101}" for k in range(60)) for i in range(40)] + ["one two", "", None]
    profiled = ngram_jaccard.profile(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").repartition(3))
    blocks = profiled.where("block IS NOT NULL").groupBy("block").count().collect()
    assert len(blocks) * ngram_jaccard.SLOTS <= 1 << ngram_jaccard.SKETCH_BITS and max(r["count"] for r in blocks) <= 3
    order, cuts = ngram_jaccard.global_order(profiled)
    at = np.concatenate([ngram_jaccard.slots(s, ngram_jaccard.SKETCH_BITS) for s in ngram_jaccard.shingle_sets(made)])
    assert (order == np.bincount(at, minlength=len(order))).all() and order.itemsize == 2 and list(cuts) == sorted(cuts)


def test_jaccard_near_copies_meet_their_common_text(spark, monkeypatch):
    """Copies of one text with words of their own are linked with it, not with each other, and are not paired out."""
    import random

    draw, base = random.Random(5), [f"b{i}" for i in range(150)]
    made = [(0, " ".join(base))]
    for i in range(1, 121):
        own = dict.fromkeys(draw.sample(range(10, 140, 10), 2))
        made.append((i, " ".join(f"own{i}x{k}" if k in own else w for k, w in enumerate(base))))
    pairs, write = {}, Steps.write

    def counted(self, df, label):
        out = write(self, df, label)
        pairs[label] = out.count()
        return out

    monkeypatch.setattr(Steps, "write", counted)
    found = ngram_jaccard.join(spark.createDataFrame(made, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 121
    assert pairs["star-pairs"] + pairs["rest-pairs"] < 4 * len(made)
