"""Token counts by a whole-token shortcut.

For the vocabulary's word-final strings it is proved beforehand, by running the merges on each, which of them encode alone as one token.
A text is normalised and cut into pre-tokens; a pre-token that is one of the proved strings counts as one, and only the others are merged
(each distinct one once per worker, within a bounded memory). Special strings in a text are single tokens, as the library takes them by
default; no special tokens are added and nothing is cut off or padded.

Built for files of byte-level merges with a word-end suffix, the Lowercase, NFC and white-space normalisers and the split pattern named
below; other files are refused.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); repeated rows get equal results; an empty table gives an empty result;
merging takes n log n steps in the length of a pre-token, so very long words are no danger.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

CACHE = 300_000
# The split pattern that the file must name, and white space as that pattern's engine knows it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"{_SUFFIXES}|[a-z]+|[0-9]|[^a-z0-9\t-\r\x20]+")
_ANY = regex.compile(rf"{_SUFFIXES}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
LATIN_END = "ɐ"


def _latin_pattern() -> re.Pattern:
    """The pattern for texts below LATIN_END, with the letters and numbers of that range written out."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(ord(LATIN_END))}
    letters = "".join(chr(c) for c, k in kinds.items() if k == "L")
    numbers = "".join(chr(c) for c, k in kinds.items() if k == "N")
    return re.compile(f"{_SUFFIXES}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


_LATIN = _latin_pattern()


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or split != SPLIT or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a file of the kind this operator is for")
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.signs = byte_signs()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.alone = self._prove(model["vocab"])

    def _prove(self, vocab: dict[str, int]) -> set[str]:
        """Texts that are one token on their own."""
        back = {sign: byte for byte, sign in enumerate(self.signs)}
        found = set()
        for token in vocab:
            word = token.removesuffix(self.end)
            if word == token or not all(c in back for c in word) or not word:
                continue
            try:
                text = bytes(back[c] for c in word).decode()
            except UnicodeDecodeError:
                continue
            if self.merge(text) == [token]:
                found.add(text)
        return found

    def merge(self, word: str) -> list[str]:
        """Tokens of a pre-token: the pair of least rank, leftmost first, is merged until none is left."""
        parts = [self.signs[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        return self._short(parts) if len(parts) <= 40 else self._long(parts)

    def _short(self, parts: list[str]) -> list[str]:
        ranks, none = self.ranks, len(self.ranks)
        of = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while of:
            least = min(of)
            if least == none:
                break
            at = of.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at:
                of[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(of):
                of[at] = ranks.get((parts[at], parts[at + 1]), none)
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at) for at, pair in enumerate(zip(parts, parts[1:])) if (rank := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if not parts[at] or right >= n or self.ranks.get((parts[at], parts[right])) != rank:
                continue
            parts[at] += parts[right]
            parts[right] = ""
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (r := self.ranks.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p]


class _Costs(dict):
    """Tokens by pre-token; what is not known is merged, and kept while there is room."""

    def __init__(self, merges: Merges, room: int):
        super().__init__(dict.fromkeys(merges.alone, 1))
        self.merges, self.room = merges, room + len(self)

    def __missing__(self, word: str) -> int:
        cost = len(self.merges.merge(word))
        if len(self) < self.room:
            self[word] = cost
        return cost


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    # Each capital is lowered by itself, without regard to where in a word it stands.
    text = text.replace("Σ", "σ").lower()
    return (_LATIN if max(text, default="") < LATIN_END else _ANY).findall(text)


class Counter:
    def __init__(self, path: str, room: int = CACHE):
        self.merges = Merges(path)
        self.costs = _Costs(self.merges, room)

    def count(self, text: str) -> int:
        cost = self.costs.__getitem__
        if "<" not in text:
            return sum(map(cost, pre_tokens(text)))
        total, at = 0, 0
        for m in self.merges.special.finditer(text):
            total += 1 + sum(map(cost, pre_tokens(text[at:m.start()])))
            at = m.end()
        return total + sum(map(cost, pre_tokens(text[at:])))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every document."""
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches):
            found = list(map(count, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = rows.mapInArrow(step, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
