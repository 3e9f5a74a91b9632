"""Encoding of whole texts with a public tokenizer, one encoding per distinct piece between spaces.

A byte-pair tokenizer never merges across the start of a run of white space, nor between a letter and
a comma or full stop before white space, so the ids of a text are the ids of its pieces in a row.
Pieces repeat far more often than texts: each worker remembers the ids of the pieces it met.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cinderleaf.llm.common import per_worker

# Pieces a worker remembers in either of two generations, and how many outlive a task; they bound its
# memory, not its work.
REMEMBERED, KEPT = 300_000, 60_000
# Bytes of text that are cut together, and pieces per call of the tokenizer.
SLICE, TOGETHER = 4 << 20, 4_000
MARK = "\x01"
# White space after white space, or other than spaces and line ends, is cut with care.
ODD = r"[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _printable() -> list[str]:
    """The character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    `spaced` says that the tokenizer keeps white space: a piece then carries the space before it.
    Otherwise the tokenizer drops white space and lowers the case, and pieces are plain words.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaced = spaced
        # when `known` is full it becomes `before`; what is met again moves back
        self.known: dict = {}
        self.before: dict = {}
        self.glue = MARK if spaced else f" {MARK} "
        mark = self._ids([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.printable = _printable()
        self.careful = re.compile(r" (?=\S)(?<=\S )")
        # a word of Latin letters is one piece for the tokenizer too and goes straight to its merges
        self.word = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+" if spaced else r"[a-zß-öø-ÿ]+")
        # a piece that could join with the mark before it is encoded alone
        self.joins = re.compile(r"\A[ \w]" if spaced else r"\A[^\x01]")

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _stems(self, unknown: Iterable) -> dict:
        """Pieces with a comma or full stop after their last letter, and the two parts."""
        if self.spaced:
            return {k: (k[:-1], k[-1]) for k in unknown if k[-1:] in (",", ".") and k[-2:-1].isalnum()}
        marked = (k for k in unknown if k[-1:] in (b",", b"."))
        return {k: (k[:-1], k[-1:]) for k in marked if k.decode()[-2:-1].isalnum()}

    def _learn(self, unknown: set) -> None:
        stems = self._stems(unknown)
        parts = unknown.difference(stems).union(*stems.values()) if stems else unknown
        together, alone = [], []
        for key in parts.difference(self.known):
            piece = key if self.spaced else key.decode()
            if self.spaced and piece[:1] == " " and piece.isascii() and piece[1:].isalpha():
                self.known[key] = array("I", [t.id for t in self.model.tokenize(self.printable[32] + piece[1:])]).tobytes()
            elif self.word.fullmatch(piece):
                shown = piece
                if self.spaced or not piece.isascii():
                    shown = "".join([self.printable[b] for b in piece.encode()])
                found = [t.id for t in self.model.tokenize(shown)]
                self.known[key] = array("I", found).tobytes()
            elif self.mark is not None and MARK not in piece and self.joins.match(piece):
                together.append((key, piece))
            else:
                alone.append((key, piece))
        for at in range(0, len(together), TOGETHER):
            some = together[at : at + TOGETHER]
            ids = self._ids([self.glue.join(p for _, p in some)])[0]
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some) - 1:  # a piece holds the mark's id
                alone += some
                continue
            raw = ids.tobytes()
            starts = [0, *(int(e) * 4 + 4 for e in ends)]
            stops = [*(int(e) * 4 for e in ends), len(raw)]
            self.known.update((k, raw[a:b]) for (k, _), a, b in zip(some, starts, stops, strict=True))
        for at in range(0, len(alone), TOGETHER):
            some = alone[at : at + TOGETHER]
            for (key, _), ids in zip(some, self._ids([p for _, p in some]), strict=True):
                self.known[key] = ids.tobytes()
        for key, (stem, mark) in stems.items():
            self.known[key] = self.known[stem] + self.known[mark]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces, pieces of every text, the text's place): texts that need care come last."""
        if not self.spaced:
            cut = pc.ascii_split_whitespace(pc.ascii_lower(texts)).cast(pa.list_(pa.binary()))
            return cut.flatten(), cut.value_lengths().to_numpy(zero_copy_only=False), np.arange(len(texts))
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        plain = texts.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        cut = pc.split_pattern(marked, "\0")
        care = [self.careful.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        care = [[first, *(" " + p for p in rest)] for first, *rest in care]
        pieces = pa.concat_arrays([cut.flatten(), pa.array(list(chain.from_iterable(care)), pa.string())])
        sizes = np.concatenate([cut.value_lengths().to_numpy(zero_copy_only=False), np.array([len(c) for c in care], np.int64)])
        return pieces, sizes, np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first of every text). Distinct pieces are looked up once; nulls must have been replaced."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        pieces, sizes, place = self._cut(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        unknown = {p for p, raw in zip(distinct, found, strict=True) if raw is None}
        if unknown:
            again = {p: self.before[p] for p in filter(self.before.__contains__, unknown)}
            self.known.update(again)
            self._learn(unknown.difference(again))
            found = [self.known[p] if raw is None else raw for p, raw in zip(distinct, found, strict=True)]
        ids = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        # the pieces in the order of their texts
        first = np.cumsum(sizes) - sizes
        own = np.argsort(place, kind="stable")
        order = np.repeat(first[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(len(pieces))
        index = coded.indices.to_numpy(zero_copy_only=False)[order]
        n = lengths[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.arange(total) + np.repeat(starts[index] - (ends - n), n)]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[own])])]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of every text as bytes; an empty text has none."""
        ids, first = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]

    def rest(self) -> None:
        """Forgets all but the pieces met first, at the end of a task: an idle worker holds little."""
        self.before = {}
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder of a file; it outlives a task, which should end with `rest`."""
    return per_worker(("encoder", path, spaced), lambda: PieceEncoder(path, spaced))


def public_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
