"""Periodic runs of words, found by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``power`` periods and ``least`` words long, that no
neighbouring word extends keeping period q. For each power of two, the stretches of that many words are named: equal
stretches share a number, made from the numbers of their halves. A stretch whose next occurrence starts within its own
length (both lie within twice that length) proposes the distance as a period; the occurrences of one stretch there form
an arithmetic progression, and neighbouring starts with one distance extend to the whole run. This is exact: a stretch
at least as long as q cannot recur sooner than q inside a run of smallest period q, so all its starts have distance q,
and a longer line of such starts would extend the run. A run shows at several lengths and is kept once. Only stretches
that occur twice have longer ones worth naming, so few words are left after the first lengths of ordinary text; a text
of n words takes at most log n sorts of n numbers.

Documents are independent: no shuffle. Several texts are numbered together with a separator of its own after each, so
that no stretch crosses from one to the next; a very long text is worked on alone. A null or empty text has no words and
no runs. Repeated rows are answered each; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from timberline.llm.common import texts

LEAST, POWER = 6, 4
# Words numbered together; a text with more is a group of its own.
GROUP = 100_000
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(words, longest: int | None = None, least: int = LEAST, power: int = POWER):
    """Rows (start, length, period), by start and then period, of a sequence of numbers.

    ``longest``: no run is longer than this (default: the whole sequence).
    """
    import numpy as np

    words = np.asarray(words, np.int64)
    n, found = len(words), [np.zeros((0, 3), np.int64)]
    size, at, name = 1, np.arange(n), words
    # A period q shows at the first power of two that is not below it.
    while len(at) > 1 and size < 2 * ((longest or n) // power):
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        ahead = np.diff(at[order])
        distance = np.zeros(len(at), np.int64)
        distance[order[:-1]] = np.where(same & (ahead <= size), ahead, 0)
        # Lines of neighbouring starts with one distance.
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(distance) != 0)])
        period = distance[first]
        length = np.diff(np.r_[first, len(at)]) - 1 + period + size
        kept = (period > 0) & (length >= np.maximum(least, power * period))
        found.append(np.column_stack([at[first], length, period])[kept])
        # Names of the stretches twice as long, where both halves occur elsewhere.
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(np.r_[0, ~same])
        place = np.full(n + size, -1, np.int64)
        place[at[twice]] = number[twice]
        at = at[twice]
        right = place[at + size]
        at, name = at[right >= 0], (place[at] * n + right)[right >= 0]
        size *= 2
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[np.r_[True, (np.diff(rows, axis=0) != 0).any(1)]] if len(rows) else rows


def repeated_words(n: int, rows):
    """True for the words that some run contains after its first period."""
    import numpy as np

    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _of_group(lists: list[list[bytes]], least: int, power: int):
    """Runs and collapsed text of each list of words."""
    import numpy as np

    numbers: dict[bytes, int] = {}
    starts = np.cumsum([0, *(len(found) + 1 for found in lists)])
    flat = np.empty(starts[-1], np.int64)
    for i, found in enumerate(lists):
        flat[starts[i]:starts[i + 1] - 1] = [numbers.setdefault(word, len(numbers)) for word in found]
        flat[starts[i + 1] - 1] = -1 - i
    rows = periodic_runs(flat, max(map(len, lists)), least, power)
    bounds = np.searchsorted(rows[:, 0], starts)
    for i, found in enumerate(lists):
        mine = rows[bounds[i]:bounds[i + 1]] - [starts[i], 0, 0]
        if len(mine):
            gone = repeated_words(len(found), mine)
            found = [word for word, out in zip(found, gone.tolist()) if not out]
        yield mine, b" ".join(found)


def find_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: every run by start and then period, and the words left when each run
    keeps its first period only, joined by one space."""
    def answer(ids, lists):
        import pyarrow as pa

        runs, collapsed = [], []
        for mine, text in _of_group(lists, least, power):
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()])
            collapsed.append(text.decode())
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(list(map(len, lists)), pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def work(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            first, lists, held = 0, [], 0
            for i in range(len(column)):
                lists.append(column[i].as_py().encode().split())
                held += len(lists[-1])
                if held >= GROUP:
                    yield answer(ids[first:i + 1], lists)
                    first, lists, held = i + 1, [], 0
            if lists:
                yield answer(ids[first:], lists)

    return texts(docs).mapInArrow(work, SCHEMA)
