"""N-gram Jaccard join by vertical partitioning.

Equal sets are one class (its id is a hash of the set). Shingles have a global order, rare ones first (by a counting sketch
of all texts; errors of the sketch cost time, never results), and that order is cut into fragments. In each fragment classes
are joined on the shingles that the needed overlap demands of it: the overlap of two classes is at most what is left
of either from a shared shingle on, so a shingle at position i of n can only be the first one shared with
classes up to a size that falls with i. Postings are therefore joined by fragment, shingle and size range, which
splits frequent shingles. Partial overlaps are counted by fragment and summed per pair; pairs that can still
reach the threshold get their whole overlap, again counted by fragment and summed.

``links`` gives every linked pair of classes and ``link_counts`` their number per document. ``join`` needs the components only, and
there groups of near copies are not paired out: first each shingle's members are checked only against the class that has
fewest rarer shingles before it, as the common text of a group does; then pairs are made between components that still share a shingle. Any link
between different texts that is not checked joins texts that are linked already.

Null, empty and wordless texts have no shingles and are linked with nothing; a null id has a null component unless
it is linked. Repeated rows are one class. Long texts are shingled whole, in blocks of words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from timberline.llm.common import Steps, texts
from timberline.llm.components import components

SKETCH_BITS = 23
# Slots whose counts are one row.
SLOTS = 1 << 12
# Larger counts are this in the order, which every task holds: two bytes are enough.
MOST = (1 << 16) - 1
BLOOM_BITS = 25
FRAGMENTS = 4
LONGEST = 5
# Bytes of texts that are shingled at once, and the longest word that is hashed by its bytes' powers.
BLOCK = 1 << 20
LONG_WORD = 256
# Size ranges of the join grow by this factor.
SIZE_STEP = 1.05


@cache
def byte_tables():
    """(is a byte white space, a 64-bit value per byte, powers of an odd number)."""
    import numpy as np

    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    value = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
    power = np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    with np.errstate(over="ignore"):
        return gap, value, np.cumprod(power)


def mixed(h):
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes):
    """(starts, hashes) of the words of lower-cased bytes."""
    import numpy as np
    import xxhash

    gap, value, power = byte_tables()
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap[a], [True])).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    used = np.minimum(sizes, LONG_WORD)
    upto, out, lo = np.cumsum(used), np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK)))
        n = used[lo:hi]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        with np.errstate(over="ignore"):
            out[lo:hi] = np.add.reduceat(value[a[at + np.repeat(starts[lo:hi], n)]] * power[at], first)
        lo = hi
    out = mixed(out ^ sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + sizes[i]])
    return starts, out


def joined(w, width: int):
    """Hashes of all runs of ``width`` words."""
    import numpy as np

    h = np.full(len(w) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ w[i:len(w) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def shingle_sets(found: list[str]):
    """Of each text the ascending distinct hashes of the 5-word shingles, or of the whole sequence if shorter."""
    import numpy as np

    def of_block(block):
        starts, w = word_hashes(b" ".join(block))
        ends = np.cumsum([len(b) + 1 for b in block])
        last = np.searchsorted(starts, ends).tolist()
        all_runs = joined(w, LONGEST) if len(w) >= LONGEST else None
        lo = 0
        for hi in last:
            if hi - lo >= LONGEST:
                yield np.unique(all_runs[lo:hi - LONGEST + 1])
            else:
                yield joined(w[lo:hi], hi - lo) if hi > lo else np.empty(0, np.int64)
            lo = hi

    block, size = [], 0
    for text in found:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if block and size + len(data) > BLOCK:
            yield from of_block(block)
            block, size = [], 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield from of_block(block)


def class_of(found) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def slots(found, bits: int):
    import numpy as np

    return (found.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, class and number of shingles of each whole text, and behind them (block, counts): each task's number of shingles in
    each of 2^SKETCH_BITS slots, SLOTS of them a row. One pass over the texts."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(**columns):
            n = len(next(iter(columns.values())))
            kinds = {"doc_id": pa.int64(), "class": pa.int64(), "n": pa.int64(), "block": pa.int32(), "counts": pa.binary()}
            return pa.RecordBatch.from_pydict({c: pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()})

        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            sets = []
            for found in shingle_sets(batch.column("text").to_pylist()):
                np.add.at(total, slots(found, SKETCH_BITS), 1)
                sets.append((class_of(found), len(found)))
            yield rows(**{"doc_id": batch.column("doc_id").to_pylist(), "class": [c for c, _ in sets], "n": [n for _, n in sets]})
        blocks = total.reshape(-1, SLOTS)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        if used:
            yield rows(block=used, counts=[packed(blocks[k]) for k in used])

    return texts(docs).mapInArrow(run, "doc_id bigint, class bigint, n bigint, block int, counts binary")


def packed(counts) -> bytes:
    """A block's counts in as few bytes each as the largest needs, most of them zero."""
    import numpy as np

    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def unpacked(data: bytes):
    import numpy as np

    data = zlib.decompress(data)
    return np.frombuffer(data, f"u{len(data) // SLOTS}")


def summed(blocks):
    """The sums of a block's counts."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(SLOTS, np.int64)
    for counts in blocks.column("counts"):
        total += unpacked(counts.as_py()).astype(np.int64)
    return pa.table({"block": blocks.column("block")[:1], "counts": pa.array([packed(total)], pa.binary())})


def described(profiled: DataFrame) -> DataFrame:
    return profiled.where("block IS NULL").select("doc_id", "class", "n")


def global_order(profiled: DataFrame):
    """(number of shingles per slot, cuts between fragments): slots by their number make the order, each fragment holds
    about the same number of shingles. 2^SKETCH_BITS counts reach the driver whatever the input, in blocks."""
    import numpy as np

    order, frequency = np.zeros(((1 << SKETCH_BITS) // SLOTS, SLOTS), np.uint16), np.zeros(MOST + 1, np.int64)
    sums = profiled.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(summed, "block int, counts binary")
    for row in sums.collect():
        order[row["block"]] = unpacked(row["counts"]).clip(max=MOST)
        frequency += np.bincount(order[row["block"]], minlength=MOST + 1)
    mass = np.cumsum(frequency * np.arange(MOST + 1))
    return order.ravel(), np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)


def postings_of(docs: DataFrame, order, percent: int) -> DataFrame:
    """(fragment, h, class, n, i): the shingles of which two linked classes share one, with their positions in the order.

    Only shingles of two classes or more stay; texts may be repeated, as a class counts once. One shuffle.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, cuts = order.value
        for batch in batches:
            done, out = set(), ([], [], [], [], [])
            for found in shingle_sets(batch.column("text").to_pylist()):
                name = class_of(found)
                if not len(found) or name in done:
                    continue
                done.add(name)
                take = len(found) - -(-percent * len(found) // 100) + 1
                k = counts[slots(found, SKETCH_BITS)]
                first = np.lexsort((found, k))[:take]
                values = (np.searchsorted(cuts, k[first], "right").astype(np.int32), found[first], np.full(take, name),
                          np.full(take, len(found), np.int32), np.arange(take, dtype=np.int32))
                for column, value in zip(out, values):
                    column.append(value)
            if done:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in zip(("fragment", "h", "class", "n", "i"), out)})

    raw = texts(docs).mapInArrow(run, "fragment int, h bigint, class bigint, n int, i int")
    same = Window.partitionBy("h")
    several = raw.withColumn("lo", F.min("class").over(same)).withColumn("hi", F.max("class").over(same)).where("lo <> hi")
    return several.drop("lo", "hi").dropDuplicates(["h", "class"])


def can_link(percent: int, left: Column, right: Column) -> Column:
    """Whether sets of sizes na and nb can link if at most ``left`` and ``right`` of their shingles are shared."""
    return ((100 + percent) * F.least(left, right) >= percent * (F.col("na") + F.col("nb"))) & (F.col("a") != F.col("b"))


def size_range(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def candidates(postings: DataFrame, percent: int, same: str | None = None) -> DataFrame:
    """(a, b, na, nb): pairs of classes that can still reach the threshold, by their partial overlaps in the fragments.

    A class of size n meets larger ones (or of its size) up to ((100 + percent) * (n - i) - percent * n) / percent shingles from
    its position i on; postings are joined by the ranges of these sizes. Pairs with equal ``same`` are left out.
    """
    rest = [] if same is None else [same]
    largest = F.floor(((100 + percent) * (F.col("n") - F.col("i")) - percent * F.col("n")) / percent)
    small = postings.where(largest >= F.col("n")).select(
        "fragment", "h", F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), *(F.col(c).alias("sa") for c in rest),
        # One range more on both sides: logarithms are not exact.
        F.explode(F.sequence(size_range(F.col("n")) - 1, size_range(largest) + 1)).alias("range"))
    large = postings.select(
        "fragment", "h", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), *(F.col(c).alias("sb") for c in rest),
        size_range(F.col("n")).alias("range"))
    met = small.join(large, ["fragment", "h", "range"]).where(
        (F.struct("na", "a") < F.struct("nb", "b")) & can_link(percent, F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")))
    if same is not None:
        met = met.where("sa <> sb")
    # Partial overlaps by fragment, then summed: all shared shingles up to the last one counted are counted.
    partial = met.groupBy("a", "b", "na", "nb", "fragment").agg(F.count("*").alias("c"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    return summed.where(can_link(percent, F.col("c") + F.col("na") - 1 - F.col("ia"), F.col("c") + F.col("nb") - 1 - F.col("ib"))).select(
        "a", "b", "na", "nb")


def bit_table(pairs: DataFrame):
    """2^BLOOM_BITS bits, set at the upper bits of each class in pairs (a class is a hash itself); or-ed by Spark."""
    import numpy as np

    bit = F.shiftrightunsigned(F.col("class"), 64 - BLOOM_BITS)
    found = pairs.select(F.explode(F.array("a", "b")).alias("class")).select(
        F.shiftright(bit, 6).alias("word"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(class, {64 - BLOOM_BITS}) & 63 as int))").alias("bits"),
    ).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def fragments(docs: DataFrame, pairs: DataFrame, order) -> DataFrame:
    """(class, fragment, s): the shingles of each fragment of the order, of the classes in pairs (and a few others,
    as the bit table tells classes apart by their upper bits only)."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(pairs))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, cuts = order.value
        for batch in batches:
            of_class, of_fragment, of_set, done = [], [], [], set()
            for found in shingle_sets(batch.column("text").to_pylist()):
                name = class_of(found)
                bit = (name & ((1 << 64) - 1)) >> (64 - BLOOM_BITS)
                if name in done or not (int(shared.value[bit >> 6]) >> (bit & 63)) & 1:
                    continue
                done.add(name)
                of = np.searchsorted(cuts, counts[slots(found, SKETCH_BITS)], "right")
                for k in np.unique(of).tolist():
                    of_class.append(name)
                    of_fragment.append(k)
                    of_set.append(found[of == k])
            yield pa.RecordBatch.from_pydict({
                "class": pa.array(of_class, pa.int64()), "fragment": pa.array(of_fragment, pa.int32()), "s": pa.array(of_set, pa.list_(pa.int64()))})

    needed = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    found = texts(docs).mapInArrow(run, "class bigint, fragment int, s array<bigint>")
    return found.join(needed, F.col("class") == F.col("of"), "left_semi").groupBy("class", "fragment").agg(F.first("s").alias("s"))


def linked(docs: DataFrame, pairs: DataFrame, order, percent: int, steps: Steps) -> DataFrame:
    """The pairs (a, b) whose summed overlaps reach the threshold, written.

    Sets are shuffled by class and fragment once, for both ends, and once more beside the pairs of the first end.
    """
    parts = fragments(docs, pairs, order)
    mine = parts.select(F.col("class").alias("a"), "fragment", F.col("s").alias("sa"))
    other = parts.select(F.col("class").alias("b"), "fragment", F.col("s").alias("sb"))
    asked = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(k) for k in range(FRAGMENTS)))))
    partial = asked.join(mine, ["a", "fragment"]).join(other, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    return steps.write(partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")).where(
        100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "class-links")


def prepare(docs: DataFrame, percent: int, steps: Steps):
    """(described documents, the broadcast order, postings)."""
    profiled = steps.write(profile(docs), "profile")
    known = steps.write(described(profiled), "sets")
    order = docs.sparkSession.sparkContext.broadcast(global_order(profiled))
    steps.drop(profiled)
    return known, order, steps.write(postings_of(docs, order, percent), "postings")


def classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n) of the documents, and (class, first, component, least) of the classes with shingles: their smallest
    document, their component, and its smallest document."""
    steps = Steps(docs.sparkSession)
    known, order, postings = prepare(docs, percent, steps)
    # Each shingle's members against the class with fewest rarer shingles.
    hub = postings.groupBy("h").agg(F.min(F.struct("i", "class", "n")).alias("hub"))
    star = postings.join(hub, "h").select(
        F.col("hub.class").alias("a"), F.col("class").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"),
        F.col("hub.i").alias("ia"), F.col("i").alias("ib"))
    ends = [F.struct(F.col(c).alias("class"), F.col(n).alias("n")) for c, n in (("a", "na"), ("b", "nb"))]
    star = star.where(can_link(percent, F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))).select(F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    star = steps.write(star.select(
        F.col("low.class").alias("a"), F.col("high.class").alias("b"), F.col("low.n").alias("na"), F.col("high.n").alias("nb")).distinct(), "star-pairs")
    near = linked(docs, star, order, percent, steps)
    label = steps.write(components(near), "star-components")
    # What is left: shingles that several components hold still, paired between components.
    comp = F.coalesce("component", "class")
    opened = steps.write(postings.join(label, F.col("class") == F.col("node"), "left").select(
        "fragment", "h", "class", "n", "i", comp.alias("component")), "open")
    steps.drop(postings)
    checked = star.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = candidates(opened, percent, "component")
    pairs = steps.write(pairs.join(
        checked, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti"), "rest-pairs")
    steps.drop(opened, star)
    more = linked(docs, pairs, order, percent, steps)
    # The new links join components, so only these are put together.
    of_a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joins = more.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(joins).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    first = known.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    parts = first.join(label, F.col("class") == F.col("node"), "left").select("class", "first", comp.alias("part"))
    named = steps.write(parts.join(top, "part", "left").select("class", "first", F.coalesce("whole", "part").alias("component")), "classes")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    out = steps.write(named.join(least, "component").select("class", "first", "component", "least"), "named")
    steps.drop(pairs, near, more, label, named)
    return known, out


def join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the same for equal sets) of every document."""
    known, named = classes(docs, percent)
    of_class = named.select(F.col("class").alias("of"), "least")
    return known.join(of_class, (F.col("class") == F.col("of")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("class").alias("class_id"))


def links(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b), a < b: every pair of classes that reaches the threshold, each pair verified.

    Classes are different sets, so equal texts add no pairs; the result itself grows with the square of a group of near copies.
    """
    return _links(docs, percent)[1]


def _links(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    steps = Steps(docs.sparkSession)
    known, order, postings = prepare(docs, percent, steps)
    pairs = steps.write(candidates(postings, percent), "link-pairs")
    steps.drop(postings)
    found = linked(docs, pairs, order, percent, steps)
    steps.drop(pairs)
    return known, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_counts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, class_id and n_links of every document: to how many other classes its class is linked. No class without shingles."""
    known, both = _links(docs, percent)
    counts = both.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("n_links"))
    return known.select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class_id")).join(
        counts, F.col("class_id") == F.col("of"), "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@F.pandas_udf(StructType().add("class", "long").add("n", "long"))
def text_class(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(class, n) of a text, beside its row."""
    for column in columns:
        sets = [(class_of(s), len(s)) for s in shingle_sets(column.tolist())]
        yield pd.DataFrame(sets, columns=["class", "n"], dtype="int64")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: of the smallest id, and of the smallest text where rows of that id differ.

    Rows are judged by their own text, not by their id, so other texts of the same id are not touched; rows without an id
    are ordered behind all ids. Rows without words are no group and all stay.
    """
    _, named = classes(docs, percent)
    names = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(names.alias("row"), text_class(F.coalesce("text", F.lit(""))).alias("of"))
    of_class = named.select(F.col("class").alias("of_class"), "component", "least")
    found = rows.join(of_class, (F.col("of.class") == F.col("of_class")) & (F.col("of.n") > 0), "left")
    wordless = found.where("component IS NULL").select("row.*")
    # Groups hold few rows of their smallest id, so only those are shuffled.
    best = found.where("component IS NOT NULL").where(F.col("row.doc_id").eqNullSafe(F.col("least"))).groupBy("component").agg(
        F.min_by("row", F.col("row.text")).alias("row"))
    return wordless.unionAll(best.select("row.*"))
