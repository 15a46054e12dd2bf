"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte sequence there is exactly one token that can end its encoding: the longest-first search
over the tokens that end there stops at the one which may follow the last token of what is before it. Two tokens may
follow each other if merging their bytes by rank gives those two tokens again. Storing that last token for every
prefix gives the encoding of any prefix by walking back, lets bytes be appended exactly, and lets an edit recompute
only until the stored tokens agree with the old ones again.

Tokens are ranks of a public vocabulary file whose path is a parameter; each match of the vocabulary's pattern is
encoded on its own and special tokens are ordinary text, as the tiktoken library does.

Defined cases: null text counts as empty and has no tokens; text of any length is encoded whole, in time
proportional to its length; repeated rows are encoded each; lone surrogates cannot occur in Spark strings; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, pieces and token pairs a worker keeps at most, and the longest word or piece it keeps.
CACHED, CACHED_PAIRS, CACHED_CHARS = 1 << 19, 1 << 20, 48
#: Characters of texts whose new words are encoded together.
CHUNK = 1 << 20

_TWO_SPACES = re.compile(r"\s\s").search


class Vocabulary:
    """Ranks of byte strings, with the two questions the prefix tables ask."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # Tokens as an automaton over bytes: state << 8 | byte leads on; ``ends`` is a state's longest token, ``shorter`` a token's next one that ends it.
        self.moves: dict[int, int] = {}
        self.ends, self.falls = [-1], [0]
        for token, i in ranks.items():
            state = 0
            for byte in token:
                to = self.moves.get(state << 8 | byte)
                if to is None:
                    to = self.moves[state << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.falls.append(0)
                state = to
            self.ends[state] = i
        self.shorter: dict[int, int] = {}
        self.lengths = {i: len(t) for i, t in self.tokens.items()}
        self.known: dict[int, int] = {}  # moves through shorter states
        level: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.moves.items():
            level.setdefault(key >> 8, []).append((key & 255, to))
        queue = [0]
        for state in queue:
            for byte, to in level.get(state, ()):
                fall = self.falls[to] = self.after(self.falls[state], byte) if state else 0
                if (own := self.ends[to]) >= 0:
                    self.shorter[own] = self.ends[fall]
                else:
                    self.ends[to] = self.ends[fall]
                queue.append(to)
        self.pairs: dict[int, bool] = {}

    def after(self, state: int, byte: int) -> int:
        """The state after one more byte: that of the longest bytes before it with which a token begins."""
        key = state << 8 | byte
        to = self.moves.get(key)
        while to is None and state:
            state = self.falls[state]
            to = self.moves.get(state << 8 | byte)
        if len(self.known) >= CACHED_PAIRS:
            self.known.clear()
        self.known[key] = to = to or 0
        return to

    def by_rank(self, data: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank until none is left. Only run on the bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.by_rank(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class PrefixTable:
    """The last token of every prefix of a byte sequence."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.states = vocabulary, b"", [], []
        self.append(data)

    def _extend(self, more: bytes) -> None:
        """Adds the last token of every further prefix: of the tokens that end there, the longest that may follow what is before it."""
        v, last, states = self.vocabulary, self.last, self.states
        known, ends, shorter, lengths, pairs = v.known, v.ends, v.shorter, v.lengths, v.pairs
        state, end = states[-1] if states else 0, len(last)
        for byte in more:
            end += 1
            to = known.get(state << 8 | byte)
            state = v.after(state, byte) if to is None else to
            token = ends[state]
            while token >= 0:
                before = end - lengths[token]
                if not before:
                    break
                left = last[before - 1]
                fits = pairs.get(left << 20 | token)
                if fits or fits is None and v.may_follow(left, token):
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError(f"byte {byte} is not in the vocabulary")
            last.append(token)
            states.append(state)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(more)

    def turn_into(self, data: bytes) -> None:
        """Makes this the table of other bytes; what both begin with is not computed again."""
        same, old = 0, self.data
        for x, y in zip(old, data, strict=False):
            if x != y:
                break
            same += 1
        del self.last[same:], self.states[same:]
        self.data = data
        self._extend(data[same:])

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in the place of data[start:stop]; returns how many prefixes were computed anew."""
        old, old_states, tail, shift = self.last, self.states, self.data[stop:], len(new) - (stop - start)
        self.data = self.data[:start] + new + tail
        self.last, self.states = old[:start], old_states[:start]
        end, same = start, 0
        # What follows depends on the bytes and on as many stored tokens as the longest token has bytes.
        while end < len(self.data) and same < self.vocabulary.longest:
            self._extend(self.data[end : end + 1])
            end += 1
            same = same + 1 if end - shift > stop and old[end - shift - 1] == self.last[-1] else 0
        computed = end - start
        if end < len(self.data):
            self.last += old[end - shift :]
            self.states += old_states[end - shift :]
        return computed

    def encoding(self, end: int | None = None) -> list[int]:
        """Tokens of the prefix of ``end`` bytes, or of all."""
        out, at, last, lengths = [], len(self.data) if end is None else end, self.last, self.vocabulary.lengths
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        return out[::-1]


class Codec:
    """Encodes whole texts, keeping what was met lately: between two characters that are no white space, a single space always
    begins a new match of the pattern, so a text is cut there into words that are looked up, and only new words are matched."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self._split = vocabulary, regex.compile(pattern).findall
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._words: dict[str, list[int]] = {}
        self._ids = {t.decode("utf-8", "surrogateescape"): (i,) for t, i in vocabulary.ranks.items()}

    def _learn(self, words: set[str]) -> None:
        """Encodes words not known yet. Their pieces are taken in order of their bytes, so that each continues what it shares with the last."""
        if len(self._words) + len(words) > CACHED:
            self._words.clear()
        if len(self._pieces) > CACHED:
            self._pieces.clear()
        split = {w: self._split(w) for w in words}
        pieces = {p.encode("utf-8"): p for found in split.values() for p in found if p not in self._ids and p not in self._pieces}
        table = PrefixTable(self.vocabulary)
        for data in sorted(pieces):
            table.turn_into(data)
            self._pieces[pieces[data]] = tuple(table.encoding())
        for word, found in split.items():
            self._words[word] = [i for p in found for i in self._ids.get(p) or self._pieces[p]]

    @staticmethod
    def words(text: str) -> list[str]:
        found = text.split(" ")
        if _TWO_SPACES(text) is None and not text[:1].isspace() and not text[-1:].isspace():
            return found[:1] + [" " + w for w in found[1:]]
        out, now = [], found[0]
        for w in found[1:]:
            if now and not now[-1].isspace() and w and not w[0].isspace():
                out.append(now)
                now = " " + w
            else:
                now += " " + w
        return [*out, now]

    def encode_many(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of every text, looking ahead over CHUNK characters of texts for new words."""
        held, size = [], 0
        for text in texts:
            held.append(self.words(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[list[str]]) -> Iterator[list[int]]:
        if new := set().union(*texts).difference(self._words):
            if len(self._words) + len(new) > CACHED:
                new = set().union(*texts)
            self._learn(new)
        known = self._words
        for words in texts:
            yield list(chain.from_iterable(map(known.__getitem__, words)))
        for word in [w for w in new if len(w) > CACHED_CHARS]:
            del known[word]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a Python worker."""
    return Codec(Vocabulary(read_ranks(path)), pattern)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids of a text column; null counts as empty."""

    @F.pandas_udf("array<int>")
    def ids(rows: pd.Series) -> pd.Series:
        encode = codec(path, pattern).encode_many
        texts = (t if isinstance(t, str) else "" for t in rows)
        return pd.Series([np.array(ids, dtype=np.int32) for ids in encode(texts)], dtype=object)

    return ids(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """binary of an array<int> of token ids; null gives empty bytes."""

    @F.pandas_udf("binary")
    def data(rows: pd.Series) -> pd.Series:
        decode = codec(path, pattern).decode
        return rows.map(lambda r: decode(r.tolist()) if isinstance(r, np.ndarray) else b"")

    return data(ids)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: the number of tokens, and digests of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids in c.encode_many(t if isinstance(t, str) else "" for t in batch["text"]):
                rows.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
