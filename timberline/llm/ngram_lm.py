"""Interpolated modified Kneser-Ney model of a given order, counted in Spark and stored as sorted arrays.

Words: a first pass counts them; a word's number is made of its rank by count among the words of its shard, and the shard, so common
words have small numbers. Counting: each task sums the n-grams of the highest order of its texts and sends them to shards by
context, a row for each shard that holds the sorted numbers as packed differences. A shard's task sums them, writes its contexts in order with their
followers, and sends on each n-gram without its first word once. These are the next lower order: its counts are the numbers of
distinct words before an n-gram. N-grams at the start of a text have no word before and count as often as they occur. Pairs that
are contexts lie in the order of these, so no key is held twice. Nothing is pruned. Scoring tasks memory-map the shards
from the shared folder and look up a batch's n-grams at once, so scoring shuffles nothing and no task holds the model in its heap.

The shared folder must be a mounted one (``file:`` or no scheme); executors that are lost rewrite their shards under
the same names. A null or empty text is one end token. Repeated rows count each. With no training rows, all words
have the same probability.
"""

from __future__ import annotations

import json
import os
import pickle
from array import array
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import remainder, texts, words
from timberline.session import scratch_path

# Tokens that are summed in a task before rows are sent on.
CHUNK = 2_000_000
# Bytes of texts that are split into words at once, besides the last of them.
PART = 1 << 24
ORDER = 3
WORDS_KEPT = 400_000
CONTEXT = ("total", "n1", "n2", "n3")
FIELDS = ("number", "count", "before", *CONTEXT)
# The number of words that the model does not hold; all others are below it.
NONE = (1 << 32) - 1
# Tables that lie in two files, the second written with the next lower or higher order.
BESIDE = {"words": "contexts2", "pairs": "contexts3"}
# Levels of the rows besides the orders: fields of words, and numbers of n-grams (below zero: of the order).
OF_WORDS = 1
ROWS = "level int, shard int, data binary"
SCHEMA = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


class Hashes(dict):
    """Word to signed 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = found = word_hash(word)
        return found


def word_hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


START, END = b" start", b" end"  # no word holds a blank


def token_hashes(text: str, hashes: Hashes):
    import numpy as np

    found = words(text)
    out = np.empty(len(found) + 2, np.int64)
    out[0], out[-1] = hashes[START], hashes[END]
    out[1:-1] = list(map(hashes.__getitem__, found))
    return out


def parts(batches, size: int = PART):
    """The batches, cut where their texts are long."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        first = firsts((np.cumsum(lengths) - lengths) // size)
        for low, high in zip(first, np.r_[first[1:], len(lengths)]):
            yield batch.slice(low, high - low)


def tokens_of(column):
    """Of a batch's texts: the hashes of its distinct words with start and end, the place there of each token, and the tokens of each text.

    The words are those of ``words``, split by Arrow.
    """
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    listed = pc.ascii_split_whitespace(pc.ascii_lower(column))
    found = listed.flatten().dictionary_encode()
    lengths, data = pc.binary_length(found.dictionary).to_numpy(zero_copy_only=False), found.dictionary.buffers()[2]
    data, bounds = data.to_pybytes() if data is not None else b"", np.r_[0, np.cumsum(lengths, dtype=np.int64)].tolist()
    hashed = [xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(bounds, bounds[1:]) if i < j]
    keys = np.r_[np.array(hashed, np.uint64).view(np.int64), word_hash(START), word_hash(END)]
    # Blanks at an end of a text leave an empty word there.
    at = found.indices.to_numpy(zero_copy_only=False)
    word, places = lengths[at] > 0, (np.cumsum(lengths > 0) - 1)[at]
    sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[word], minlength=len(sizes)) + 2
    out = np.full(sizes.sum(), len(keys) - 1)
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(out), bool)
    inner[starts] = inner[starts + sizes - 1] = False
    out[starts], out[inner] = len(keys) - 2, places[word]
    return keys, out, sizes


def pair_keys(left, right):
    import numpy as np

    with np.errstate(over="ignore"):
        h = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def gram_keys(columns):
    """Keys of n-grams given by one array of word numbers per place. Those of pairs differ for sure: each step can be undone."""
    import numpy as np

    if len(columns) == 1:
        return columns[0]
    with np.errstate(over="ignore"):
        h = (columns[0] << 32 | columns[1]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found = (h ^ (h >> np.uint64(32))).view(np.int64)
    for column in columns[2:]:
        found = pair_keys(found, column)
    return found


def shard_of(keys, shards: int):
    """Shards are ranges of keys."""
    return ((keys >> 32) + (1 << 31)) * shards >> 32


def firsts(ordered):
    """Where each distinct value begins."""
    import numpy as np

    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)


def sums(values, first):
    import numpy as np

    return np.add.reduceat(values, first) if len(first) else values[:0]


def grouped(keys, *values):
    """Ascending distinct keys and the sums of each."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    first = firsts(ordered)
    return ordered[first], [sums(v[order], first) for v in values]


def distinct_grams(columns, n, bits: int):
    """Distinct n-grams in the order of their words, and the sums of ``n``; word numbers have so many bits."""
    import numpy as np

    found = columns[0]
    for i, column in enumerate(columns[1:], 2):
        found = found.astype(np.uint64) << np.uint64(bits) | column.astype(np.uint64)
        if i < len(columns):
            found = np.unique(found, return_inverse=True)[1]
    order = np.argsort(found)
    first = firsts(found[order])
    at = order[first]
    return [c[at] for c in columns], sums(n[order], first)


def differences(columns):
    """Rows in order: a place holds its difference to the row before while the places before it are equal, else its value."""
    import numpy as np

    same, out = np.ones(max(len(columns[0]) - 1, 0), bool), []
    for column in columns:
        d, step = column.copy(), np.diff(column)
        d[1:][same] = step[same]
        same = same & (step == 0)
        out.append(d)
    return out


def restored(columns):
    import numpy as np

    new, out = np.arange(len(columns[0])) == 0, []
    for d in columns:
        upto, first = np.cumsum(d), np.flatnonzero(new)
        out.append(upto - np.repeat(upto[first] - d[first], np.diff(np.r_[first, len(d)])))
        new = new | (d != 0)
    return out


def packed(columns) -> bytes:
    """Arrays of one length, each by bytes of equal weight: the upper ones are mostly zero."""
    import numpy as np
    import pyarrow as pa

    codec, out = pa.Codec("zstd", compression_level=1), []
    for column in columns:
        width = (int(column.view(np.uint64).max(initial=0)).bit_length() + 7) // 8
        weights = column.astype("<i8").view(np.uint8).reshape(-1, 8)
        out.append([codec.compress(np.ascontiguousarray(weights[:, i]), asbytes=True) for i in range(width)])
    return pickle.dumps((len(columns[0]), out))


def unpacked(data: bytes) -> list:
    import numpy as np
    import pyarrow as pa

    codec, (size, columns) = pa.Codec("zstd"), pickle.loads(data)
    out = []
    for column in columns:
        weights = np.zeros((size, 8), np.uint8)
        for i, part in enumerate(column):
            weights[:, i] = np.frombuffer(codec.decompress(part, size), np.uint8)
        out.append(weights.view("<i8")[:, 0].astype(np.int64))
    return out


def as_rows(levels: list, shards: list, data: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["level", "shard", "data"])


def dealt(level: int, shard, columns, others):
    """A row for each shard: the rows of ``columns``, which are in order, and the other arrays beside them."""
    import numpy as np

    order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
    bounds, data, found = np.r_[firsts(shard[order]), len(shard)], [], []
    for low, high in zip(bounds, bounds[1:]):
        at = order[low:high]
        found.append(int(shard[at[0]]))
        data.append(packed([*differences([c[at] for c in columns]), *[c[at] for c in others]]))
    yield as_rows([level] * len(found), found, data)


def gathered(blobs: list, ordered: int):
    """The arrays of the rows of a shard; the first ``ordered`` of them are held as differences."""
    import numpy as np

    parts = [unpacked(data) for data in blobs]
    return [np.concatenate(p) for p in zip(*[[*restored(p[:ordered]), *p[ordered:]] for p in parts])]


def deal_grams(level: int, columns, n, shards: int):
    """By context, so that all followers meet; pairs by themselves, so that those of a common word are spread."""
    yield from dealt(level, shard_of(gram_keys(columns[:max(2, level - 1)]), shards), columns, [n])


def folder(spark, label: str) -> str:
    """A folder of the shared storage as a plain path."""
    url = urlparse(scratch_path(spark, label))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir, not {url.scheme}:")
    return url.path


def small(column: str, values) -> dict:
    """Counts, of which most are small, in a byte each; those that do not fit beside it by place."""
    import numpy as np

    over = np.flatnonzero(values >= 255)
    return {column: np.minimum(values, 255), f"{column}_at": over, f"{column}_over": values[over]}


def taken(table: dict, column: str, at):
    """Values of a column of ``small`` at given places."""
    import numpy as np

    found = table[column][at].astype(np.int64)
    over = np.flatnonzero(found == 255)
    if len(over):
        found[over] = table[f"{column}_over"][np.searchsorted(table[f"{column}_at"], at[over])]
    return found


def save(root: str, name: str, shard: int, columns: dict) -> None:
    """One file: the length of its head, the head, then the arrays; those but keys and places of contexts in the smallest type that holds them."""
    import numpy as np

    os.makedirs(root, exist_ok=True)
    head, parts, size = {}, [], 0
    for column, values in columns.items():
        if column == "many":
            values = values.astype(np.int32 if values.max(initial=0) < 1 << 31 else np.int64)
        elif not column.endswith("key"):
            values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
        head[column] = values.dtype.str, size, len(values)
        parts.append(values.tobytes().ljust(-(-values.nbytes // 8) * 8, b"\0"))
        size += len(parts[-1])
    top = json.dumps(head).encode()
    top = top.ljust(-(-len(top) // 8) * 8)
    path = f"{root}/{name}-{shard}"
    with open(f"{path}.{os.getpid()}-{os.urandom(4).hex()}", "wb") as file:
        file.write(len(top).to_bytes(8, "little"))
        file.write(top)
        for part in parts:
            file.write(part)
    os.replace(file.name, path)


def mapped(root: str, name: str, shard: int) -> dict:
    """The arrays of a file, memory-mapped; none if there is no file."""
    import numpy as np

    path = f"{root}/{name}-{shard}"
    if not os.path.exists(path):
        return {}
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    start = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for column, (kind, at, n) in json.loads(raw[8:start].tobytes()).items():
        kind = np.dtype(kind)
        out[column] = raw[start + at:start + at + n * kind.itemsize].view(kind)
    return out


def found_at(stored, keys):
    """Places of the keys in the stored ones, and whether they are there."""
    import numpy as np

    if not len(stored):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(stored, keys), len(stored) - 1)
    return at, stored[at] == keys


def places_in(stored, places):
    """How many stored places lie before each, and whether it is one of them. Both are of one type, so none is copied to search."""
    import numpy as np

    before = np.searchsorted(stored, places.astype(stored.dtype))
    if not len(stored):
        return before, np.zeros(len(places), bool)
    return before, (stored[np.minimum(before, len(stored) - 1)] == places) & (before < len(stored))


def pair_counts(table: dict, keys, at, hit):
    """Most pairs are contexts too, found at ``at`` where ``hit``, and lie in the order of these; the others are kept by themselves."""
    import numpy as np

    out, rest = np.zeros(len(keys), np.int64), np.flatnonzero(~hit)
    if len(rest) < len(keys):
        out[hit] = taken(table, "n", at[hit])
    at, hit = found_at(table["own_key"], keys[rest])
    out[rest[hit]] = table["own_n"][at[hit]]
    return out


class Shards:
    def __init__(self, root: str, name: str, shards: int, fields: tuple[str, ...]):
        self.root, self.name, self.shards, self.fields, self.open = root, name, shards, fields, {}

    def shard(self, k: int) -> dict:
        if k not in self.open:
            self.open[k] = (mapped(self.root, BESIDE[self.name], k) if self.name in BESIDE else {}) | mapped(self.root, self.name, k)
        return self.open[k]

    def split(self, keys):
        """The shard, its table and the places of its keys, ascending, for each shard that is there."""
        import numpy as np

        order = np.argsort(keys)
        shard = shard_of(keys[order], self.shards)
        bounds = np.r_[firsts(shard), len(shard)]
        for low, high in zip(bounds, bounds[1:]):
            k = int(shard[low])
            if self.shard(k):
                yield k, self.shard(k), order[low:high]

    def look_up(self, keys):
        """The fields of keys, zero where a key is not stored."""
        import numpy as np

        out = np.zeros((len(self.fields), len(keys)), np.int64)
        find = self.word_fields if self.name == "words" else self.pair_fields
        for k, table, mine in self.split(keys):
            find(k, table, keys[mine], mine, out)
        return out

    def word_fields(self, k, table, keys, mine, out):
        """By the hash of a word. A number holds a word's rank by count in its shard, and the shard."""
        at, hit = found_at(table["key"], keys)
        rank = table["rank"][at[hit]].astype("int64")
        for i, field in enumerate(self.fields):
            out[i, mine[hit]] = rank * self.shards + k if field == "number" else taken(table, field, rank)

    def pair_fields(self, k, table, keys, mine, out):
        out[0, mine] = pair_counts(table, keys, *found_at(table.get("key", keys[:0]), keys))

    def followers(self, keys, words, bits: int):
        """Of contexts and words after them: the counts of the n-grams, the fields of the contexts, and, of pairs, their own counts."""
        import numpy as np

        n, fields, own = np.zeros(len(keys), np.int64), np.zeros((len(CONTEXT), len(keys)), np.int64), np.zeros(len(keys), np.int64)
        mask = (1 << bits) - 1
        for _, table, mine in self.split(keys):
            sought = keys[mine]
            at, hit = found_at(table.get("key", sought[:0]), sought)
            if self.name == "pairs":
                own[mine] = pair_counts(table, sought, at, hit)
            if not hit.any():
                continue
            at, mine = at[hit], mine[hit]
            before, several = places_in(table["many"], at)
            # Contexts with one follower hold one place each, the others so many more.
            low = at + table["more"][before]
            wanted = words[mine]
            entries = table["followers"][low]
            first = self.counts(table, low, entries, bits)
            for i, field in enumerate(CONTEXT):
                fields[i, mine] = first if not i else (first == i if i < 3 else first > 2)
                fields[i, mine[several]] = table[field][before[several]]
            n[mine] = first * ((entries & mask) == wanted)

            mine, before, low, wanted = mine[several], before[several], low[several], wanted[several]
            high = low + (table["more"][before + 1] - table["more"][before])
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                below = (table["followers"][middle] & mask).astype(np.int64) < wanted[open_]
                low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
            entries = table["followers"][low]
            n[mine] = self.counts(table, low, entries, bits) * ((entries & mask) == wanted)
        return n, fields, own

    @staticmethod
    def counts(table: dict, at, entries, bits: int):
        """A follower's count is held above the bits of its word, or beside the followers where it does not fit."""
        import numpy as np

        found = (entries.astype(np.uint64) >> np.uint64(bits)).astype(np.int64)
        over = np.flatnonzero(found == room(bits))
        if len(over):
            found[over] = table["over"][np.searchsorted(table["over_at"], at[over])]
        return found


def room(bits: int) -> int:
    """The count from which on a follower's count is held apart."""
    return (1 << (32 if bits <= 28 else 64) - bits) - 1


def ends_of(sizes, order: int):
    """The indexes of the tokens that end an n-gram within their text."""
    import numpy as np

    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.flatnonzero(at >= order - 1)


def of_shard(batches, level: int, finish):
    """``finish(shard, data)`` of the rows of a level in a partition, which are those of one shard. Other rows pass."""
    shard, held = None, []
    for batch in batches:
        for of, k, data in zip(*[column.to_pylist() for column in batch.columns]):
            if of == level:
                shard = k
                held.append(data)
            else:
                yield as_rows([of], [k], [data])
    if held:
        yield from finish(shard, held)


def shuffled(rows: DataFrame, shards: int) -> DataFrame:
    """A shard to a partition."""
    return rows.repartitionById(shards, "shard")


def count_words(train: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        import numpy as np

        def rows(keys, n):
            yield from dealt(OF_WORDS, shard_of(keys, shards), [keys], [n])

        def merged():
            keys, (n,) = grouped(*map(np.concatenate, zip(*held)))
            return keys, n

        held, size, most = [], 0, WORDS_KEPT
        for batch in parts(batches):
            keys, places, _ = tokens_of(batch.column("text"))
            n = np.bincount(places, minlength=len(keys))
            n[-2] = 0  # the start of a text is no word of it
            held.append((keys, n))
            size += len(keys)
            if size > most:
                held = [merged()]
                size = len(held[0][0])
                if size > WORDS_KEPT:
                    yield from rows(*held[0])
                    held, size = [], 0
                most = 2 * size + WORDS_KEPT
        if held:
            yield from rows(*merged())

    return train.mapInArrow(run, ROWS)


def store_words(rows: DataFrame, root: str, shards: int) -> DataFrame:
    """Writes the words of each shard by their hashes, and their counts by rank. Start counts zero."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def finish(shard, data):
            keys, (n,) = grouped(*gathered(data, 1))
            by_count = np.lexsort((keys, -n))
            rank = np.empty_like(by_count)
            rank[by_count] = np.arange(len(rank))
            save(root, "words", shard, {"key": keys, "rank": rank} | small("count", n[by_count]))
            yield pa.RecordBatch.from_pydict({"size": [len(keys)], "tokens": [int(n.sum())], "types": [int((n > 0).sum())]})

        yield from of_shard(batches, OF_WORDS, finish)

    return rows.mapInArrow(run, "size bigint, tokens bigint, types bigint")


def count_ngrams(train: DataFrame, order: int, root: str, shards: int, bits: int) -> DataFrame:
    """N-grams of the highest order, and those of lower orders at the start of texts."""
    def run(batches):
        import numpy as np

        vocabulary = Shards(root, "words", shards, ("number", "count"))

        def rows(flat, sizes):
            one = np.ones(len(flat), np.int64)
            ends = ends_of(sizes, order)
            columns = [flat[ends - order + i] for i in range(1, order + 1)]
            yield from deal_grams(order, *distinct_grams(columns, one[:len(ends)], bits), shards)
            starts = np.cumsum(sizes) - sizes
            for k in range(2, order):
                at = starts[sizes >= k]
                yield from deal_grams(k, *distinct_grams([flat[at + i] for i in range(k)], one[:len(at)], bits), shards)

        held, size = [], 0
        for batch in parts(batches):
            keys, places, sizes = tokens_of(batch.column("text"))
            numbers, count = vocabulary.look_up(keys)
            if not np.delete(count, -2).all():
                raise ValueError("the training rows changed between the two passes over them")
            held.append((numbers[places], sizes))
            size += len(places)
            if size > CHUNK:
                yield from rows(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield from rows(*map(np.concatenate, zip(*held)))

    return train.mapInArrow(run, ROWS)


def number_row(order: int, n):
    """How many n-grams of the order occur once, twice, three and four times."""
    import numpy as np

    return as_rows([-order], [0], [packed([np.array([(n == i).sum() for i in (1, 2, 3, 4)], np.int64)])])


def context_sums(n, first) -> dict:
    import numpy as np

    return dict(zip(CONTEXT, (sums(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2))))


def store_grams(rows: DataFrame, order: int, root: str, shards: int, bits: int) -> DataFrame:
    """Writes each shard's contexts in the order of their keys with their followers; sends on each n-gram without its first word once."""
    def run(batches):
        import numpy as np

        def finish(shard, data):
            *columns, n = gathered(data, order)
            columns, n = distinct_grams(columns, n, bits)
            yield number_row(order, n)
            yield from deal_grams(order - 1, *distinct_grams(columns[1:], np.ones(len(n), np.int64), bits), shards)
            key = gram_keys(columns[:-1])
            by_key = np.argsort(key, kind="stable")  # followers of a context stay in order
            key, n, word = key[by_key], n[by_key], columns[-1][by_key]
            first = firsts(key)
            size = np.diff(np.r_[first, len(key)])
            many = np.flatnonzero(size > 1)
            over = np.flatnonzero(n >= room(bits))
            # Sums end where the next context begins, so they are made for all and then picked.
            save(root, f"contexts{order}", shard, {
                "key": key[first], "many": many, "more": np.r_[0, np.cumsum(size[many] - 1)], **{f: x[many] for f, x in context_sums(n, first).items()},
                "followers": word.astype(np.uint64) | np.minimum(n, room(bits)).astype(np.uint64) << np.uint64(bits),
                "over_at": over, "over": n[over]})

        yield from of_shard(batches, order, finish)

    return rows.mapInArrow(run, ROWS)


def store_pairs(rows: DataFrame, root: str, shards: int, bits: int) -> DataFrame:
    """Writes each shard's pairs, beside the contexts of the next order where they are such; sends on what the words need."""
    def run(batches):
        import numpy as np

        def finish(shard, data):
            *columns, n = gathered(data, 2)
            (left, right), n = distinct_grams(columns, n, bits)
            yield number_row(2, n)
            first = firsts(left)
            of_left = context_sums(n, first)
            words_right, (before,) = grouped(right, np.ones(len(n), np.int64))
            word = np.union1d(left[first], words_right)
            fields = np.zeros((1 + len(CONTEXT), len(word)), np.int64)
            fields[0, np.searchsorted(word, words_right)] = before
            fields[1:, np.searchsorted(word, left[first])] = list(of_left.values())
            yield from dealt(OF_WORDS, word % shards, [word], list(fields))

            key = gram_keys([left, right])
            by_key = np.argsort(key)
            key, n = key[by_key], n[by_key]
            contexts = mapped(root, "contexts3", shard).get("key", key[:0])
            at, hit = found_at(contexts, key)
            of_contexts = np.zeros(len(contexts), np.int64)
            of_contexts[at[hit]] = n[hit]
            save(root, "pairs", shard, small("n", of_contexts) | {"own_key": key[~hit], "own_n": n[~hit]})

        yield from of_shard(batches, 2, finish)

    return rows.mapInArrow(run, ROWS)


def store_fields(rows: DataFrame, root: str, shards: int) -> DataFrame:
    """Writes what the words need by rank; sums for the discounts of all orders."""
    columns = ("n1", "n2", "n3", "n4", "more", "pairs")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def finish(shard, data):
            word, *values = gathered(data, 1)
            size = len(mapped(root, "words", shard)["key"])
            fields = np.zeros((len(values), size), np.int64)
            for field, value in zip(fields, values):
                np.add.at(field, word // shards, value)
            before = fields[0]
            found = {c: x for f, v in zip(("before", *CONTEXT), fields) for c, x in small(f, v).items()}
            save(root, "contexts2", shard, found)
            row = [*((before == i).sum() for i in (1, 2, 3, 4)), (before > 2).sum(), before.sum()]
            yield pa.RecordBatch.from_pydict({"level": pa.array([1], pa.int32())} | {c: [int(x)] for c, x in zip(columns, row)})

        for batch in of_shard(batches, OF_WORDS, finish):
            if "data" not in batch.schema.names:
                yield batch
                continue
            for level, data in zip(batch.column("level").to_pylist(), batch.column("data").to_pylist()):
                row = [*unpacked(data)[0].tolist(), 0, 0]
                yield pa.RecordBatch.from_pydict({"level": pa.array([-level], pa.int32())} | {c: [x] for c, x in zip(columns, row)})

    return rows.mapInArrow(run, ", ".join(["level int", *[f"{c} bigint" for c in columns]]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts one, two, and three or more, each between 0 and its count."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def fit(train: DataFrame, order: int = ORDER) -> dict:
    """Counts, stores and describes the model; only totals come to the driver."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = train.sparkSession
    shards = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    root = folder(spark, "ngram-lm")
    found = store_words(shuffled(count_words(train, shards), shards), root, shards).agg(
        F.max("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    bits = max(1, (int(found["size"] or 0) * shards).bit_length())
    if bits > 32 or int(found["size"] or 0) * shards > NONE:
        raise ValueError("the model numbers fewer than 2^32 words")
    rows = count_ngrams(train, order, root, shards, bits)
    for k in range(order, 2, -1):
        rows = store_grams(shuffled(rows, shards), k, root, shards, bits)
    rows = store_fields(shuffled(store_pairs(shuffled(rows, shards), root, shards, bits), shards), root, shards)
    by_order = {r["level"]: [int(x) for x in r[1:]] for r in rows.groupBy("level").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]]).collect()}
    c1, c2, c3, c4, c3up, pairs = by_order.get(1, [0] * 6)
    return {"root": root, "shards": shards, "order": order, "bits": bits, "tokens": int(found["tokens"] or 0), "types": int(found["types"] or 0),
            "pairs": pairs, "c1": c1, "c2": c2, "c3up": c3up, "d1": discounts(c1, c2, c3, c4),
            **{f"d{k}": discounts(*by_order.get(k, [0] * 4)[:4]) for k in range(2, order + 1)}}


def interpolated(discount: list[float], n, context, lower):
    """The discounted share of counts ``n`` in their contexts, and what is left by the lower order; that alone after an unseen context."""
    import numpy as np

    d = np.r_[0.0, discount]
    total, n1, n2, n3 = context
    seen = np.maximum(total, 1)
    return np.where(total > 0, (n - d[np.minimum(n, 3)]) / seen + (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen * lower, lower)


def open_model(model: dict) -> tuple:
    """Pairs, which are the contexts of order 3 too, words, and the contexts of each higher order."""
    shards = lambda name, fields: Shards(model["root"], name, model["shards"], fields)
    return shards("pairs", ("n",)), shards("words", FIELDS), [shards(f"contexts{k}", CONTEXT) for k in range(4, model["order"] + 1)]


def described(vocabulary: Shards, keys):
    """The fields of each word; those of an unknown word are zero, and its number is none that the model holds."""
    fields = vocabulary.look_up(keys)
    fields[0, fields[FIELDS.index("before")] + fields[FIELDS.index("total")] == 0] = NONE
    return fields


def score_tokens(model: dict, opened: tuple, tokens: list):
    """``scored`` of texts given by the hashes of their tokens."""
    import numpy as np

    keys, places = np.unique(np.concatenate(tokens), return_inverse=True)
    return scored(model, opened, keys, places, np.array([len(t) for t in tokens], np.int64))


def scored(model: dict, opened: tuple, keys, places, sizes):
    """(count of the word, log10 base probability, log10 model probability) of every token but the first of each text."""
    import numpy as np

    pairs, vocabulary, higher = opened
    fields = described(vocabulary, keys)
    number, ends = fields[0, places], ends_of(sizes, 2)
    keys = gram_keys([number[ends - 1], number[ends]])
    if model["order"] > 2:
        after, context, n = pairs.followers(keys, number[np.minimum(ends + 1, len(number) - 1)], model["bits"])
    else:
        (n,) = pairs.look_up(keys)
    count, base, own = lower_orders(model, n, fields[:, places[ends - 1]], fields[:, places[ends]])
    if model["order"] > 2:
        # Pairs that another one of their text follows.
        pair = np.flatnonzero(np.diff(ends) == 1)
        own[pair + 1] = interpolated(model["d3"], after[pair], context[:, pair], own[pair + 1])
    of = np.zeros(len(places))
    of[ends] = own
    for k, contexts in enumerate(higher, 4):
        at = ends_of(sizes, k)
        n, context, _ = contexts.followers(gram_keys([number[at - k + i] for i in range(1, k)]), number[at], model["bits"])
        of[at] = interpolated(model[f"d{k}"], n, context, of[at])
    return count, base, np.log10(of[ends])


def log_probabilities(model: dict, pairs: Shards, vocabulary: Shards, left, right):
    """(count of the right word, log10 base probability, log10 probability by the orders up to 2) of each bigram."""
    import numpy as np

    left, right = described(vocabulary, left), described(vocabulary, right)
    (n,) = pairs.look_up(gram_keys([left[0], right[0]]))
    count, base, own = lower_orders(model, n, left, right)
    return count, base, np.log10(own)


def lower_orders(model: dict, n, left, right):
    """The same of the counts of pairs and the fields of their words, the last not as a logarithm."""
    import numpy as np

    _, count, before = right[:3]
    d1 = np.r_[0.0, model["d1"]]
    uniform = 1.0 / (model["types"] + 1)
    if model["pairs"]:
        gamma = (d1[1] * model["c1"] + d1[2] * model["c2"] + d1[3] * model["c3up"]) / model["pairs"]
        p1 = (before - d1[np.minimum(before, 3)]) / model["pairs"] + gamma * uniform
    else:
        p1 = np.full(left.shape[1], uniform)
    p2 = interpolated(model["d2"], n, left[3:], p1)
    return count, np.log10((count + 1) / (model["tokens"] + model["types"] + 1)), p2


def score(docs: DataFrame, holdout: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    found = texts(docs)
    model = fit(found.where(remainder(holdout) != held), order)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        opened = open_model(model)
        for batch in parts(batches):
            keys, places, sizes = tokens_of(batch.column("text"))
            count, base, own = scored(model, opened, keys, places, sizes)
            starts = np.r_[0, np.cumsum(sizes - 1)[:-1]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": sizes - 1, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(own, starts)})

    return found.mapInArrow(run, SCHEMA).select(
        "doc_id", (remainder(holdout) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
