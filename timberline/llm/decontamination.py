"""Benchmark decontamination by greedy string tiling.

Texts that share a seed of ``least`` words with an item are tiled against it: the longest common run of words that are
unmarked on both sides is taken, marked, and the search repeated, with Karp-Rabin hashes finding the runs of each
length, until no run of ``least`` words is left. An item is leaked where the tiles cover enough of its words, in whatever order.

The items go to every task in blocks of a fixed number of words, one pass over the documents per block, so a benchmark
of any size is checked whole. Items with fewer than ``least`` words match as one seed of their length. Null and empty
texts and items match nothing; repeated rows are checked each.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import keep_rows, texts

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id bigint, item_id bigint, covered bigint, item_words bigint, coverage double"
BLOCK_WORDS = 2_000_000
BASE, MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rolling(codes: list[int], length: int) -> list[int]:
    """Karp-Rabin hash of each window."""
    if len(codes) < length:
        return []
    top, h = pow(BASE, length - 1, MOD), 0
    for c in codes[:length]:
        h = (h * BASE + c) % MOD
    out = [h]
    for gone, come in zip(codes, codes[length:]):
        h = ((h - gone * top) * BASE + come) % MOD
        out.append(h)
    return out


def tile(item: list[int], text: list[int], least: int) -> int:
    """Words of ``item`` covered by greedily marked longest common runs."""
    marked_item, marked_text = bytearray(len(item)), bytearray(len(text))
    covered, length = 0, min(len(item), len(text))

    def free(marks: bytearray, n: int) -> list[int]:
        """Starts of windows of n unmarked places."""
        out, run = [], 0
        for i, m in enumerate(marks):
            run = 0 if m else run + 1
            if run >= n:
                out.append(i - n + 1)
        return out

    def starts_of(n: int) -> dict[int, deque]:
        ours, starts = rolling(item, n), {}
        for i in free(marked_item, n):
            starts.setdefault(ours[i], deque()).append(i)
        return starts

    def shared(n: int) -> bool:
        """Whether an unmarked window of n words is common; windows of equal hash are told apart by their words."""
        starts, theirs = starts_of(n), rolling(text, n)
        return any(h in starts and any(item[i:i + n] == text[j:j + n] for i in starts[h]) for j in free(marked_text, n) if (h := theirs[j]) in starts)

    def mark(n: int) -> int:
        """Marks common windows of n words from left to right; a window of the item that is marked in part is never looked at again."""
        starts, theirs, done = starts_of(n), rolling(text, n), 0
        for j in free(marked_text, n):
            ahead = starts.get(theirs[j])
            if not ahead or marked_text.find(1, j, j + n) >= 0:
                continue
            while ahead and marked_item.find(1, ahead[0], ahead[0] + n) >= 0:
                ahead.popleft()
            i = next((i for i in ahead if marked_item.find(1, i, i + n) < 0 and item[i:i + n] == text[j:j + n]), None)
            if i is not None:
                marked_item[i:i + n] = marked_text[j:j + n] = b"\x01" * n
                done += n
        return done

    while length >= least:
        # The longest length that still has a common window: windows nest, so it can be halved for.
        low, high = least - 1, length
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        if low < least:
            break
        covered += mark(low)
        # No common window of this length is left.
        length = low - 1
    return covered


def blocks(items: DataFrame):
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item), streamed through the driver."""
    block, size = [], 0
    for row in items.select("item_id", "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        found = tokens(row.text)
        if found:
            if block and size + len(found) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row.item_id, found))
            size += len(found)
    yield block


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """A row for each document and item whose tiles cover at least ``threshold`` of the item's words."""
    spark, found = docs.sparkSession, None
    for block in blocks(items):
        part = texts(docs).mapInArrow(_matcher(spark.sparkContext.broadcast(block), least, threshold), SCHEMA)
        found = part if found is None else found.unionAll(part)
    return found


def _finder(block, least: int, threshold: float):
    """A function from a text to (item, covered words, words) of the items of a block that it leaks."""
    number: dict[str, int] = {}
    coded = [[number.setdefault(w, len(number) + 1) for w in found] for _, found in block]
    seeds: dict[tuple, list[int]] = {}
    for k, codes in enumerate(coded):
        n = min(least, len(codes))
        for i in range(len(codes) - n + 1):
            seeds.setdefault(tuple(codes[i:i + n]), []).append(k)
    sizes = sorted({len(s) for s in seeds})

    def leaks(text):
        codes = [number.get(w, 0) for w in tokens(text)]
        near: dict[int, list[int]] = {}
        for n in sizes:
            for i, window in enumerate(zip(*[codes[j:] for j in range(n)])):
                if window in seeds:
                    for k in seeds[window]:
                        near.setdefault(k, []).append(i)
        for k, places in near.items():
            item = coded[k]
            n = min(least, len(item))
            # Only the neighbourhood of seeds can hold tiles; a word 0, which no item has, parts the pieces.
            keep = bytearray(len(codes))
            for i in places:
                keep[i:i + n] = b"\x01" * min(n, len(codes) - i)
            kept = [c for i, c in enumerate(codes) for c in ((c,) if keep[i] else (0,) if i and keep[i - 1] else ())]
            # Places of the item whose words the kept text lacks can't be covered.
            has = set(kept)
            if sum(c in has for c in item) < threshold * len(item):
                continue
            covered = tile(item, kept, n)
            if covered >= threshold * len(item):
                yield block[k][0], covered, len(item)

    return leaks


def _matcher(shared, least: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        leaks = _finder(shared.value, least, threshold)
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for item, covered, size in leaks(text):
                    for c, v in zip(out, (doc, item, covered, size, covered / size)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64())]))

    return run


def clean(docs: DataFrame, items: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; each row by its own text."""
    for block in blocks(items):
        docs = keep_rows(docs, _judge(docs.sparkSession.sparkContext.broadcast(block), least, threshold))
    return docs


def _judge(shared, least: int, threshold: float):
    def judge():
        leaks = _finder(shared.value, least, threshold)
        return lambda text: next(leaks(text), None) is None

    return judge
