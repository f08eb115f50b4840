"""Exact byte-pair encoding of whole corpora, without replaying merges.

For every prefix of a piece of text exactly one token can be its last one. An automaton over
the vocabulary gives all tokens that end at a position, longest first; the first that may
stand behind the last token of the prefix before it is the one. Two tokens may stand side by
side when undoing their merges, latest first, meets no pair across the seam that would
have been merged earlier. Following the last tokens back from the end gives the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Entries kept of words seen, each worker; past it the memory starts anew.
REMEMBER = 400_000
_SPACE = "\t-\r \x85\xa0  -     　"  # Unicode White_Space
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed by the vocabulary's split pattern


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encoder of one byte-level vocabulary; made once in each worker."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if all(c in letters for c in word)}
        self.merged: dict[tuple[int, int], int] = {}  # pair of tokens: rank of its merge
        parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        reach = {vocab[bytes([b])] for b in range(256)}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(letters[c] for c in left), bytes(letters[c] for c in right)
            self.merged[vocab[a], vocab[b]] = rank
            parts.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
            reach.add(vocab[a + b])
        self.parts = parts
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if i in reach:
                self.automaton.add_word(word.decode("latin-1"), (i, len(word)))
        self.automaton.make_automaton()
        self.may: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(rf"{_ENDS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        self.split_ascii = re.compile(rf"{_ENDS}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens, each whole, may follow one another in an encoding."""
        known = self.may.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, len(self.merged)
        while True:
            if self.merged.get((a, b), before) < before:
                good = False
                break
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                good = True
                break
            # undo the later merge; a seam pair of lower rank than it would have come first
            if ra > rb:
                before, a = ra, self.parts[a][2]
            else:
                before, b = rb + 1, self.parts[b][1]
        if len(self.may) > 4 * REMEMBER:
            self.may.clear()
        self.may[left, right] = good
        return good

    def piece(self, text: str) -> bytes:
        """Ids (int32, packed) of a piece that the split pattern gives."""
        raw = text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * len(raw)
        for end, found in self.automaton.iter(raw):
            if last[end] is None:
                start = end - found[1]
                if start < 0 or (last[start] is not None and self.beside(last[start][0], found[0])):
                    last[end] = found
        ids, at = [], len(raw) - 1
        while at >= 0:
            token, size = last[at]
            ids.append(token)
            at -= size
        return np.array(ids[::-1], np.int32).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of blanks and the word behind them."""
        if len(self.pieces) > REMEMBER:
            self.pieces.clear()
        out = []
        for p in self.split_ascii(text) if text.isascii() else self.split(text):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.pieces[p] = self.piece(p)
            out.append(ids)
        return b"".join(out)


class Words(dict):
    """Packed ids of words (blanks before them included: no piece reaches beyond), filled as they come."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.findall = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= 64:  # longer ones hardly come again
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBER:
            self.clear()
        return b"".join(map(self.__getitem__, self.findall(text)))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(Encoder(path))


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text, whole, without special tokens.

    Strings of special tokens inside a text are ordinary text. Null and empty texts have no ids: an
    empty list. A null id keeps its row, as do repeated rows; other columns are not read. Narrow: one
    pass over the texts, no shuffle.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = words(vocabulary)
        for batch in batches:
            packed = [book.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row and ``n_tokens`` of its text (0 for null and empty ones); no shuffle."""
    keep = [c for c in documents.columns if c != text_col] if keep is None else keep
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = words(vocabulary)
        for batch in batches:
            n = [len(book.encode(t)) // 4 if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return documents.select(*keep, text_col).mapInArrow(count, schema)
