"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed byte n-grams (naive Bayes on counts that
Spark sums over all training texts) gives a margin. A second pass over the training texts sums each bit's logistic loss on each
language; a codeword's loss is the mean of its bits' losses, weighted by how little each bit lost on that language in training. The
language whose codeword loses least is chosen (ties: the first by name). A text whose two best languages lose about
the same is flagged ambiguous.

Null, empty and letterless texts are ``und`` with score 0. Without any training language all texts are ``und``. Repeated rows
count each; texts are read whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import frames, keep_rows, remainder, texts

BUCKETS = 1 << 14
SCHEMA = "doc_id bigint, lang_pred string, score double, ambiguous boolean"
# Most languages the driver takes in: the model has BUCKETS numbers per language.
MAX_LANGUAGES = 500


def grams(text: str):
    """Counts of hashed byte 3-grams of the lower-cased text."""
    import numpy as np

    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(18), minlength=BUCKETS)


def codewords(n: int):
    """Rows of +1 and -1: every split of up to six languages, else a fixed random code of 10 log2 n bits."""
    import numpy as np

    if n <= 6:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array([b for b in bits if len(set(b)) > 1] or [(1,) * n]).T
    return np.where(np.random.default_rng(7).random((n, 10 * n.bit_length())) < 0.5, 1, -1)


def gram_counts(train: DataFrame) -> DataFrame:
    """lang, bucket, n summed over every training text; each task sends one row per language and bucket at most."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[str, object] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums[lang] = sums.get(lang, 0) + grams(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": total[at]})

    return train.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def margins(text: str, weights):
    """Each bit's evidence; it grows with the length, but neighbouring grams repeat each other."""
    import numpy as np

    n = grams(text)
    at = np.flatnonzero(n)
    return (n[at] @ weights[at]) / np.sqrt(max(n.sum(), 1))


def bit_trust(train: DataFrame, languages: list[str], code, weights):
    """Weights of the bits of each language's codeword, summing to 1: exp(-mean logistic loss on its training texts).

    Losses are summed as whole millionths, so that the order of tasks does not matter.
    """
    import numpy as np

    model = train.sparkSession.sparkContext.broadcast((languages, code, weights))

    def run(batches):
        import pyarrow as pa

        languages, code, weights = model.value
        number = {x: i for i, x in enumerate(languages)}
        loss, texts_of = np.zeros(code.shape, np.int64), np.zeros(len(code), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                i = number[lang]
                loss[i] += np.rint(1e6 * np.logaddexp(0, -code[i] * margins(text, weights))).astype(np.int64)
                texts_of[i] += 1
        for i in np.flatnonzero(texts_of):
            bits = np.arange(code.shape[1])
            yield pa.RecordBatch.from_pydict({"i": np.full(len(bits), i), "bit": bits, "loss": loss[i], "n": np.full(len(bits), texts_of[i])})

    sums = train.mapInArrow(run, "i bigint, bit bigint, loss bigint, n bigint").groupBy("i", "bit").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    found = sums.toPandas()  # a row for each language and bit
    trust = np.zeros(code.shape)
    trust[found["i"], found["bit"]] = np.exp(-found["loss"] / found["n"] / 1e6)
    return trust / trust.sum(1, keepdims=True)


def fit(docs: DataFrame):
    """(languages, codewords, weights, trust): learned from texts with a language outside the held-out quarter."""
    import numpy as np

    train = texts(docs, "lang", ).where(F.col("lang").isNotNull() & (remainder(4) != 2)).select("lang", "text")
    found = gram_counts(train).limit(BUCKETS * MAX_LANGUAGES + 1).toPandas()
    if len(found) > BUCKETS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found["lang"].unique())
    if not languages:
        return [], None, None, None
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, found["lang"]), found["bucket"]] = found["n"]
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        on, off = shares[code[:, bit] > 0], shares[code[:, bit] < 0]
        if len(on) and len(off):
            weights[:, bit] = np.log(on.mean(0)) - np.log(off.mean(0))
    weights = weights.astype(np.float32)
    return languages, code, weights, bit_trust(train, languages, code, weights)


def decider(model, gap: float):
    """A function from a text to (language, score, whether it is ambiguous)."""
    import numpy as np
    import regex

    languages, code, weights, trust = model
    letter = regex.compile(r"\p{L}")

    def decide(text):
        if not languages or not letter.search(text):
            return "und", 0.0, False
        loss = (trust * np.logaddexp(0, -code * margins(text, weights))).sum(1)
        like = np.exp(loss.min() - loss)
        order = np.sort(loss)
        return languages[int(loss.argmin())], float(1 / like.sum()), len(order) > 1 and bool(order[1] - order[0] < gap)

    return decide


def clear_rows(docs: DataFrame, gap: float = 0.02) -> DataFrame:
    """``docs`` without the rows of no language, or of none clearly."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def judge():
        decide = decider(model.value, gap)

        def keeps(text):
            lang, _, ambiguous = decide(text)
            return lang != "und" and not ambiguous

        return keeps

    return keep_rows(docs, judge)


def identify(docs: DataFrame, gap: float = 0.02) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        decide = decider(model.value, gap)

        def columns(ids, found):
            out = [decide(x) for x in found]
            return {"doc_id": ids, "lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "ambiguous": [o[2] for o in out]}

        yield from frames(batches, columns)

    return texts(docs).mapInArrow(run, SCHEMA).withColumn("held_out", remainder(4) == 2)
