"""The language model's disk, its words, its packed rows, and counts that do not fit their usual place."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import ngram_lm
from timberline.llm.common import words

ODD = ["", "  \n\t ", "One two", " a", "b ", "\x00\x0b odd\x0c É", "x\x1cy z\x85w\xa0v", " q  r", "日本語 😀 İ", "the THE the", "\r\n"]


def on_disk(*folders):
    return sum(os.path.getsize(os.path.join(at, f)) for top in folders for at, _, files in os.walk(top) for f in files)


def test_disk_of_a_token(spark):
    """Shuffles, tables between steps and the model together, for texts whose 3-grams are nearly all distinct."""
    draw = random.Random(5)
    texts = [" ".join(f"w{int(20_000 * draw.random() ** 4)}" for _ in range(1000)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [spark.conf.get("spark.checkpoint.dir"), *[x.getPath() for x in blocks]]
    docs.count()
    before = on_disk(*folders)
    model = ngram_lm.fit(docs)
    assert model["tokens"] == 300 * 1001
    assert on_disk(*folders) - before < 40 * model["tokens"]


def test_tokens_of_a_batch():
    for texts in (ODD, ["", " "], ["a"]):
        keys, places, sizes = ngram_lm.tokens_of(pa.array(texts))
        hashes = ngram_lm.Hashes()
        expected = [[hashes[w] for w in (ngram_lm.START, *words(t), ngram_lm.END)] for t in texts]
        assert keys[places].tolist() == sum(expected, []) and sizes.tolist() == [len(t) for t in expected]
        assert len(set(keys.tolist())) == len(keys) and set(places.tolist()) == set(range(len(keys)))


def test_long_texts_are_split_apart():
    texts = ["", "a " * 30, "b", "c " * 200, "", "d d", "e " * 60, " "]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(len(x))), "text": pa.array(x, pa.string())}) for x in (texts, [], ["f"])]
    found = [batch.column("text").to_pylist() for batch in ngram_lm.parts(batches, 100)]
    assert sum(found, []) == [*texts, "f"] and all(sum(map(len, x[:-1])) < 100 for x in found) and len(found) == 4
    tokens = [ngram_lm.tokens_of(batch.column("text")) for batch in ngram_lm.parts(batches, 100)]
    assert sum((sizes.tolist() for *_, sizes in tokens), []) == [len(words(t)) + 2 for t in (*texts, "f")]


@pytest.mark.parametrize("size", [0, 1, 500])
def test_packed_rows_come_back(size):
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, 5, size), draw.integers(0, 3, size), draw.integers(0, 1 << 32, size)]
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], draw.integers(-(1 << 62), 1 << 62, size)
    *found, m = ngram_lm.unpacked(ngram_lm.packed([*ngram_lm.differences(columns), n])) if size else [*columns, n]
    assert all((a == b).all() for a, b in zip([*ngram_lm.restored(found), m], [*columns, n], strict=True))
    keys = np.sort(draw.integers(-(1 << 63), (1 << 63) - 1, size))
    assert (ngram_lm.restored(ngram_lm.differences([keys]))[0] == keys).all()


def test_keys_of_pairs_differ():
    left, right = (x.ravel() for x in np.meshgrid(np.r_[:300, ngram_lm.NONE - 300:ngram_lm.NONE + 1], np.r_[:300, 1 << 20]))
    keys = ngram_lm.gram_keys([left, right])
    assert len(np.unique(keys)) == len(keys)
    shard = ngram_lm.shard_of(np.sort(keys), 7)
    assert (np.diff(shard) >= 0).all() and set(shard.tolist()) == set(range(7))


def test_followers_of_wide_numbers(tmp_path):
    """Counts beyond the room above a word's bits, with words of 32 bits too."""
    for bits in (3, 12, 28, 29, 32):
        draw = random.Random(bits)
        most = (1 << bits) - 1
        grams = {}
        for context in range(40):
            for word in {draw.randrange(most) for _ in range(1 if context % 3 else 20)}:
                grams[context, context % 7, word] = draw.choice([1, 2, 3, 300, ngram_lm.room(bits) if bits <= 28 else 70_000, 1 << 31])
        root, asked = str(tmp_path / str(bits)), [*grams, (1, 1, most), (50, 0, 0), (2, 3, 1), (ngram_lm.NONE, 0, 0)]
        columns, n = [np.array(c, np.int64) for c in zip(*sorted(grams))], np.array([grams[g] for g in sorted(grams)], np.int64)
        (rows,) = ngram_lm.deal_grams(3, columns, n, 4)
        frame = type("Rows", (), {"mapInArrow": lambda self, run, schema: [list(run(iter([rows.slice(i, 1)]))) for i in range(rows.num_rows)]})
        ngram_lm.store_grams(frame(), 3, root, 4, bits)
        contexts = ngram_lm.Shards(root, "contexts3", 4, ngram_lm.CONTEXT)
        columns = [np.array(c, np.int64) for c in zip(*asked)]
        found, fields, _ = contexts.followers(ngram_lm.gram_keys(columns[:2]), columns[2], bits)
        assert found.tolist() == [grams.get(g, 0) for g in asked]
        of = [[n for g, n in grams.items() if g[:2] == a[:2]] for a in asked]
        assert fields.T.tolist() == [[sum(x), x.count(1), x.count(2), sum(m > 2 for m in x)] for x in of]


def test_large_counts_against_brute_force(spark):
    """Words, pairs and 3-grams that occur more often than a byte holds."""
    made = [(i, "a b " * 400 + " ".join(f"a b u{j}" for j in range(i, i + 300))) for i in range(3)] + [(3, ""), (4, None)]
    asked = ["a b a b u7 a b zz", "u5 a", "", "zz a b"]
    texts = lambda rows: [["<s>", *(t or "").split(), "</s>"] for t in rows]
    counts = {k: Counter() for k in (1, 2, 3)}
    for t in texts(t for _, t in made):
        for k in counts:
            counts[k].update(g for i in range(len(t) - k + 1) if (g := tuple(t[i:i + k])) and (k == 3 or g[0] == "<s>"))
    for k in (2, 1):
        counts[k].update(g[1:] for g in counts[k + 1])
    del counts[1][("<s>",)]
    cut = {k: [0.0, *ngram_lm.discounts(*[sum(n == i for n in counts[k].values()) for i in (1, 2, 3, 4)])] for k in counts}

    def p(gram):
        k, n = len(gram), counts[len(gram)][gram]
        lower = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        after = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        return (n - cut[k][min(n, 3)] + sum(cut[k][min(m, 3)] for m in after) * lower) / sum(after) if after else lower

    docs = spark.createDataFrame([*made, *enumerate(asked, 20)], "doc_id bigint, text string")
    model = ngram_lm.fit(ngram_lm.texts(docs).where("doc_id < 20"))
    opened, hashes = ngram_lm.open_model(model), ngram_lm.Hashes()
    assert max(counts[1].values()) > 255 and max(counts[2].values()) > 255 and max(counts[3].values()) > 1023
    count, _, own = ngram_lm.score_tokens(model, opened, [ngram_lm.token_hashes(t, hashes) for t in asked])
    assert own == pytest.approx([math.log10(p(tuple(t[max(0, i - 2):i + 1]))) for t in texts(asked) for i in range(1, len(t))])
    of_words = Counter(w for t in texts(t for _, t in made) for w in t[1:])
    assert count.tolist() == [of_words[w] for t in texts(asked) for w in t[1:]]
