"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is what merging gives exactly if each adjacent pair is: the merges of the pair's bytes give that
pair back. So the encoder walks longest matches (found by an Aho-Corasick automaton over bytes mapped to Latin-1),
takes a token if it is compatible with the one before, and else tries shorter ones or steps back. Positions that
led nowhere are marked, so the walk is linear in the piece's length.

A null or empty text has no tokens and decodes to no bytes. Repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from timberline.llm.common import frames, texts

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
PIECES_KEPT = 500_000


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known_pieces: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Merging as it is defined: the adjacent pair of lowest rank first, leftmost on ties."""
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i:i + 1] for i in range(len(piece))]
        gains = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while gains and (best := min(gains)) < none:
            at = gains.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = ranks.get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        found = self.known_pairs.get((left, right))
        if found is None:
            if len(self.known_pairs) > 2_000_000:
                self.known_pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            found = self.known_pairs[left, right] = self.merged(a + b) == [a, b]
        return found

    def walk(self, piece: bytes) -> tuple[int, ...]:
        matches: list[list[int]] = [[] for _ in piece]  # by start, ever longer
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            matches[end + 1 - len(self.bytes_of[rank])].append(rank)
        dead = bytearray(len(piece) + 1)
        path: list[tuple[int, int]] = []  # token, its place in matches
        at, tries = 0, None
        while at < len(piece):
            tries = len(matches[at]) - 1 if tries is None else tries
            while tries >= 0:
                token = matches[at][tries]
                end = at + len(self.bytes_of[token])
                if not dead[end] and (not path or self.compatible(path[-1][0], token)):
                    path.append((token, tries))
                    at, tries = end, None
                    break
                tries -= 1
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token, place = path.pop()
                at, tries = at - len(self.bytes_of[token]), place - 1
        return tuple(token for token, _ in path)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        found = self.known_pieces.get(piece)
        if found is None:
            whole = self.ranks.get(piece)
            found = (whole,) if whole is not None else self.walk(piece)
            if len(piece) <= 64:
                if len(self.known_pieces) >= PIECES_KEPT:
                    self.known_pieces.clear()
                self.known_pieces[piece] = found
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest of the ids of each whole text and of the bytes they decode to; no shuffle."""
    def run(batches):
        import regex

        coder, cut = load(path), regex.compile(pattern)
        number = {rank: str(rank) for rank in coder.bytes_of}

        def digests(ids, found):
            n, of_ids, of_bytes = [], [], []
            for text in found:
                tokens: list[int] = []
                for m in cut.finditer(text):
                    tokens.extend(coder.piece(m[0].encode()))
                n.append(len(tokens))
                of_ids.append(hashlib.sha256(",".join(map(number.__getitem__, tokens)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(tokens)).hexdigest())
            return {"doc_id": ids, "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

        yield from frames(batches, digests)

    return texts(docs).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves."""
    def run(batches):
        import regex

        coder, cut = load(path), regex.compile(pattern)
        yield from frames(batches, lambda ids, found: {
            "doc_id": ids, "ids": [[t for m in cut.finditer(x) for t in coder.piece(m[0].encode())] for x in found],
        })

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<bigint>")
