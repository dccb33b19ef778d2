"""Token counts with a whole-token shortcut.

The vocabulary strings that encode alone as one token are found once, on the driver, by running the tokenizer's own merges on
each of them; tasks get the proved set, which the vocabulary bounds. A pre-token among them counts 1; only the others are
merged, each distinct one once per batch, in the task's own thread.

A null or empty text has no tokens. Special strings inside a text are single tokens, as is the library's default.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import frames, texts

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _tokenizer(path: str):
    # A task has one core; the library's own threads would work beside it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return sorted((t["content"] for t in json.load(file)["added_tokens"]), key=len, reverse=True)


@lru_cache(2)
def proved(path: str) -> frozenset[str]:
    """Strings that the library gives exactly one token for; the alphabet of byte symbols is undone first."""
    tokenizer, specials = _tokenizer(path), set(_specials(path))
    vocabulary = {tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())}
    asked = [x for x in vocabulary if x and "\ufffd" not in x and x not in specials]
    return frozenset(x for x, e in zip(asked, tokenizer.encode_batch(asked, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    def __init__(self, path: str, pattern: str):
        import regex

        self.tokenizer, specials = _tokenizer(path), _specials(path)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cut = regex.compile(pattern)
        self.one: frozenset[str] = frozenset()
        self.known: dict[str, int] = {}

    def merged(self, pieces: set[str]) -> None:
        new = [x for x in pieces if x not in self.known]
        if len(self.known) + len(new) > 300_000:
            self.known.clear()
            new = list(pieces)
        for x, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.known[x] = len(e.ids)

    def count(self, text: str) -> int:
        total, rest = 0, []
        parts = self.special.split(text) if self.special else [text]
        total += len(parts) - 1
        for part in parts:
            found = self.cut.findall(part)
            left = [x for x in found if x not in self.one]
            total += len(found) - len(left)
            rest += left
        self.merged(set(rest))
        return total + sum(map(self.known.__getitem__, rest))


@lru_cache(2)
def load(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """Tokens of each whole text; one narrow stage."""
    one = docs.sparkSession.sparkContext.broadcast(proved(path))

    def run(batches):
        counter = load(path, pattern)
        counter.one = one.value
        yield from frames(batches, lambda ids, found: {
            "doc_id": ids, "n_bytes": [len(x.encode()) for x in found], "n_tokens": [counter.count(x) for x in found],
        })

    return texts(docs).mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
