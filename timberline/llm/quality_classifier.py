"""Quality by compression: zstandard dictionaries of good and bad labelled text.

A text is compressed with both dictionaries; the difference of the sizes over the text's size, with the plain ratio beside it,
goes through a logistic calibration. Dictionaries and calibration use disjoint halves of a bounded labelled sample. A
dictionary is the whole texts of its half if they fit; else it is trained over all of them, cut into pieces that leave nothing out.

Null and empty texts get the calibrated score of no evidence. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import frames, labelled_sample, logistic, logistic_fit, remainder, texts

SCHEMA = "doc_id bigint, score double"
# Labelled rows of each kind that are learned from at most.
PER_CLASS = 1500
DICTIONARY_BYTES = 112 << 10
# Samples of the trainer: so many bytes of a text each; passages of SEGMENT bytes are picked by what they share with others.
PIECE_BYTES = 4 << 10
SEGMENT = 256


def features(text: str, good, bad, plain) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0, 0.0
    g, b, p = (len(c.compress(raw)) for c in (good, bad, plain))
    return (b - g) / (len(raw) + 40), p / (len(raw) + 40), (b - g) / (b + g)


def compressors(good: bytes, bad: bytes):
    import zstandard as zstd

    make = lambda data: zstd.ZstdCompressor(
        level=3, write_content_size=False, dict_data=zstd.ZstdCompressionDict(data))
    return make(good), make(bad), zstd.ZstdCompressor(level=3, write_content_size=False)


def dictionary(found: list[str]) -> bytes:
    """At most DICTIONARY_BYTES for all of the texts: they themselves, or what zstandard's trainer picks from all their pieces."""
    import zstandard as zstd

    raw = [x.encode("utf-8", "surrogatepass") for x in found]
    whole = b"\n".join(raw)
    if len(whole) <= DICTIONARY_BYTES:
        return whole
    pieces = [r[i:i + PIECE_BYTES] for r in raw for i in range(0, len(r), PIECE_BYTES)]
    return zstd.train_dictionary(DICTIONARY_BYTES, pieces, k=SEGMENT, d=8).as_bytes()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    import xxhash

    # In the order of a hash, so that the halves do not depend on what the texts begin with.
    sample = sorted(labelled_sample(docs, labels, "quality", per_class), key=lambda r: (
        xxhash.xxh3_64_intdigest(r[0].encode("utf-8", "surrogatepass")), *r))
    halves = {y: [t for t, k in sample if k == y] for y in (0, 1)}
    if min(map(len, halves.values())) < 4:
        return None
    good, bad = dictionary(halves[1][::2]), dictionary(halves[0][::2])
    tools = compressors(good, bad)
    x, y = zip(*[(features(t, *tools), k) for k in (0, 1) for t in halves[k][1::2]])
    return good, bad, logistic_fit(x, y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        if model.value is None:
            yield from frames(batches, lambda ids, found: {"doc_id": ids, "score": [0.5] * len(found)})
            return
        good, bad, weights = model.value
        tools = compressors(good, bad)
        yield from frames(batches, lambda ids, found: {
            "doc_id": ids, "score": logistic([features(x, *tools) for x in found] or [(0.0, 0.0, 0.0)], weights)[:len(found)],
        })

    return texts(docs).mapInArrow(run, SCHEMA).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
