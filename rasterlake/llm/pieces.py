"""Encoding texts into SentencePiece ids and back.

An Aho-Corasick automaton over the pieces reads a text once. At every position its output links give all pieces that end there, and the
best encoding of the text so far is relaxed from the best encodings before them. Two rules for what is best are offered:

* ``unigram``: the sum of the pieces' scores, as in unigram models.
* ``bpe``: for files of merges, where summed scores give other pieces than the library does. Of all pieces ending at a position exactly
  one is the last of the merged prefix: the one whose neighbour, the last piece of the prefix before it, stays apart from it when both
  are merged together. So one pass with a check of two neighbours gives what merging gives.

No piece has a space sign after another sign, or another sign after a letter (checked when the file is read), so a text falls apart
there; the parts are encoded once per worker and kept within a bounded memory. Characters without a piece become their UTF-8 bytes.

Defined cases: a null text counts as empty and has no ids; decoding gives back the text unless it contains the space sign (U+2581)
itself, which reads as a space; repeated rows get equal results; an empty table gives an empty result; the encoder takes time in
proportion to the length of a text, also without any spaces.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

SPACE = "▁"
PARTS = 200_000
PAIRS = 400_000


class Codec:
    def __init__(self, path: str, rule: str = "bpe"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.rule = rule
        self.names = [model.id_to_piece(i) for i in range(n)]
        bytes_at = [i for i in range(n) if model.is_byte(i)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in bytes_at}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.is_text = np.ones(n, dtype=bool)
        self.is_text[[*bytes_at, *self.silent, self.unknown]] = False
        self.ids = {self.names[i]: i for i in range(n) if self.is_text[i] and not model.is_unused(i)}
        self.score = [model.get_score(i) for i in range(n)]
        self.rank = {name: place for place, name in enumerate(sorted(self.ids, key=lambda x: (-self.score[self.ids[x]], self.ids[x])))}
        self.characters = {c for name in self.ids for c in name}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()
        self.cut = self._cuts(path)
        self.known = re.compile(f"[{re.escape(''.join(sorted(self.characters)))}]+|.", re.S)
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _cuts(self, path: str) -> re.Pattern:
        """Cuts a text at places that no piece reaches over: before spaces, before signs after letters, around lines."""
        inside = {pair for name in self.ids for pair in zip(name, name[1:])}
        if any(b == SPACE != a for a, b in inside):
            raise ValueError(f"{path}: pieces reach over spaces")
        line = "" if "\n" in self.characters else "\n"
        alone = f"|{line}+" if line else ""
        letters = re.escape("".join(sorted(c for c in self.characters if c.isalpha())))
        if any(a.isalpha() and not b.isalpha() for a, b in inside):
            return re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+{alone}")
        return re.compile(f"{SPACE}*[^{SPACE}{letters}{line}]*[{letters}]+|{SPACE}*[^{SPACE}{letters}{line}]+|{SPACE}+{alone}")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first, until none is left."""
        rank, none = self.rank.get, len(self.names)
        parts = list(text)
        of = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while of:
            least = min(of)
            if least == none:
                break
            at = of.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at:
                of[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(of):
                of[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their texts are merged together; left -1 stands for the text's start."""
        key = (left + 1) << 20 | right
        known = self.pairs.get(key)
        if known is None:
            own = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            known = self.merged("".join(own)) == own
            if len(self.pairs) < PAIRS:
                self.pairs[key] = known
        return known

    def _best_bpe(self, text: str) -> list[int]:
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, apart = self.pairs.get, self.apart
        for end, (length, piece) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - length
            left = last[begin]
            if left < 0 < begin:
                continue
            fits = known((left + 1) << 20 | piece)
            if fits or fits is None and apart(left, piece):
                last[end], size[end] = piece, length
        return self._walk(last, size)

    def _best_unigram(self, text: str) -> list[int]:
        n = len(text)
        last, size, best = [-1] * (n + 1), [0] * (n + 1), [0.0] + [float("-inf")] * n
        for end, (length, piece) in self.automaton.iter(text):
            end += 1
            score = best[end - length] + self.score[piece]
            if score > best[end]:
                last[end], size[end], best[end] = piece, length, score
        return self._walk(last, size)

    @staticmethod
    def _walk(last: list[int], size: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _part(self, text: str) -> bytes:
        whole = self.ids.get(text)
        if whole is not None and self.rule == "bpe" and self.apart(-1, whole):
            return self._keep(text, [whole])
        out: list[int] = []
        best = self._best_bpe if self.rule == "bpe" else self._best_unigram
        for run in self.known.findall(text):
            if run[0] in self.characters:
                out += best(run)
            else:
                out += [self.byte_ids.get(b, self.unknown) for b in run.encode("utf-8", "surrogatepass")]
        return self._keep(text, out)

    def _keep(self, text: str, ids: list[int]) -> bytes:
        packed = struct.pack(f"={len(ids)}i", *ids)
        if len(self.parts) < PARTS and len(text) < 64:
            self.parts[text] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        get, part = self.parts.get, self._part
        found = [get(x) or part(x) for x in self.cut.findall(SPACE + text.replace(" ", SPACE))]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        names = self.names
        if self.is_text[ids].all():
            text = "".join([names[i] for i in ids.tolist()]).replace(SPACE, " ")
        else:
            out, held = [], b""
            for i in ids.tolist():
                if i in self.byte_of:
                    held += self.byte_of[i]
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = b""
                out.append(" ⁇ " if i == self.unknown else "" if i in self.silent else names[i].replace(SPACE, " "))
            text = "".join(out) + held.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str, rule: str = "bpe") -> Codec:
    return Codec(path, rule)


def encode(docs: DataFrame, path: str, text_col: str = "text", rule: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text by default) with ``ids``, ``n_tokens`` and ``round_trip``.

    ``round_trip`` says that decoding the ids gives the text again.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = [*keep, "ids", "n_tokens", "round_trip"]
    rows = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, rule)
        for batch in slices(batches):
            texts = batch.column("__text").to_pylist()
            ids = [tool.encode(x) for x in texts]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            same = [tool.decode(i) == x for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists, pa.array(sizes), pa.array(same)], names)

    return rows.mapInArrow(step, ", ".join([*own, "ids array<int>", "n_tokens bigint", "round_trip boolean"]))


def decode(encoded: DataFrame, path: str, out: str = "text") -> DataFrame:
    """The rows with ``ids`` replaced by their text; null ids give a null text."""
    kept = [c for c in encoded.columns if c != "ids"]
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = [None if i is None else tool.decode(np.array(i, dtype=np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out])

    return encoded.select(*kept, "ids").mapInArrow(step, ", ".join([*own, f"`{out}` string"]))
