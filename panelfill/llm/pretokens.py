"""Words of whole blocks of texts found by array arithmetic, and their token ids looked up by word hash.

The public vocabularies split a text into words before any merge. Here a block of texts becomes one array of code
points, the splitting rule becomes comparisons of neighbouring character classes, and each distinct word is encoded
once. Characters whose class differs between Unicode versions, and texts that normalisation or special tokens would
change, are left to the tokenizers library itself, so results never differ from it.
"""

from __future__ import annotations

import gc
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from panelfill.llm.common import SpanHasher, text_slices

BLOCK = 1 << 18
LETTER, NUMBER, SPACE, OTHER, END, UNSURE = range(6)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point below U+10000."""
    old, kinds, lower = unicodedata.ucd_3_2_0, np.full(1 << 16, UNSURE, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for cp in range(1, 1 << 16):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind != old.category(c) or kind in ("Cn", "Cs", "Co") or c.isspace():
            continue
        kinds[cp] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        if c.lower() != c:
            if len(c.lower()) != 1 or cp == 0x3A3:
                kinds[cp] = UNSURE
            else:
                lower[cp] = ord(c.lower())
    kinds[[9, 10, 13, 32]] = SPACE
    return kinds, lower


class Splitter:
    """Word bounds under the rule of one of the public vocabularies."""

    def __init__(self, spaced: bool):
        """spaced: words take a blank in front with them and keep their case, else white space and case are dropped."""
        self.spaced, self.hasher = spaced, SpanHasher()
        (self.kinds, self.lower), self.values = _classes(), np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)

    def simple(self, text: str) -> bool:
        """Whether the block arithmetic covers this text; the class of each character is checked by the block."""
        if "<|" in text or "\0" in text:
            return False
        return text.isascii() or self.spaced or unicodedata.is_normalized("NFC", text)

    def codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def sure(self, codes: np.ndarray) -> bool:
        return bool(not len(codes) or (codes.max() < 1 << 16 and not (self.kinds[codes] == UNSURE).any()))

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a block; code point 0 ends each text of it."""
        if not self.spaced:
            codes = self.lower[codes]
        kind = self.kinds[codes]
        kind[codes == 0] = END
        before = np.concatenate([[np.uint8(END)], kind[:-1]])
        begins = kind != before
        if not self.spaced:
            begins |= kind == NUMBER
        first = begins.copy()
        if self.spaced:
            last = np.flatnonzero((kind == SPACE) & np.concatenate([(kind[1:] != SPACE) & (kind[1:] != END), [False]]))
            begins[last] = True
            blank = last[codes[last] == 32]
            begins[blank + 1] = False
        self._short_forms(codes, kind, first, begins)
        begins |= kind == END
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
        keep = kind[starts] != END
        if not self.spaced:
            keep &= kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
        self.hasher.load(codes, self.values)
        return starts, ends, self.hasher.of(starts, ends)

    def _short_forms(self, codes: np.ndarray, kind: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a word are words of their own."""
        at = np.flatnonzero((codes == 39) & first & begins)
        at = at[at + 1 < len(codes)]
        one = codes[at + 1]
        two = codes[np.minimum(at + 2, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((at[short], 2), (at[long & ~short], 3)):
            begins[hit + 1] = False
            after = hit + size
            after = after[after < len(codes)]
            begins[after[kind[after] == LETTER]] = True


class WordTable:
    """Token ids by word hash; grows with the words seen by this worker and starts anew beyond ``limit`` words."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def ids_of(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row; ``word(i)`` is the text of the i-th word."""
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > self.limit:
            self._clear()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            found = self.encode([word(i) for i in where[new].tolist()])
            size = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((x for f in found for x in f), np.int32, int(size.sum()))
            at = len(self.ids) + np.cumsum(size) - size
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.at, self.size = hashes[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, flat])
        known = np.searchsorted(self.hashes, distinct)
        size = self.size[known][back]
        return size, self.ids[ragged(self.at[known][back], size)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of ranges, range after range."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def byte_letters() -> tuple[list[str], dict[str, int]]:
    """The printable letter that the vocabularies write for each byte, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)], {c: b for b, c in letters.items()}


class BlockEncoder:
    """Encodes lists of texts as the library does, without special tokens added."""

    def __init__(self, path: str, spaced: bool, lexicon=None):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.splitter, self.lexicon = self.tokenizer.model, Splitter(spaced), lexicon
        self.letters = dict(enumerate(byte_letters()[0]))
        self.table = WordTable(self._encode_words)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        if not self.splitter.spaced:
            words = [w.lower() for w in words]
        out = self.lexicon.ids_of(words) if self.lexicon else [None] * len(words)
        tokenize, letters = self.model.tokenize, self.letters
        for i, (word, ids) in enumerate(zip(words, out)):
            if ids is None:
                out[i] = [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of consecutive texts: number of ids of each text, and all ids in a row. A null is an empty text."""
        for lo, hi in text_slices(texts, BLOCK):
            yield self._block([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple, split = [self.splitter.simple(t) for t in texts], self.splitter
        block = "\0".join([t if s else "" for t, s in zip(texts, simple)]) + "\0"
        codes = split.codes(block)
        if not split.sure(codes):  # some text of the block holds a doubtful character
            simple = [s and split.sure(split.codes(t)) for t, s in zip(texts, simple)]
            block = "\0".join([t if s else "" for t, s in zip(texts, simple)]) + "\0"
            codes = split.codes(block)
        starts, ends, hashes = split.words(codes)
        sizes, ids = self.table.ids_of(hashes, lambda i: block[starts[i]:ends[i]])
        first = np.searchsorted(starts, np.concatenate([[0], np.flatnonzero(codes == 0) + 1]))
        per_text = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
        if all(simple):
            return per_text, ids
        parts, bounds = [], np.concatenate([[0], np.cumsum(per_text)])
        for i, text in enumerate(texts):
            own = ids[bounds[i]:bounds[i + 1]]
            if not simple[i]:
                own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                per_text[i] = len(own)
            parts.append(own)
        return per_text, np.concatenate(parts)


def encoder(name: str, spaced: bool, key: str = "", lexicon: Callable | None = None) -> BlockEncoder:
    """This worker's encoder for a vocabulary file; it stays with the process until it is released."""
    kept = vars(sys).setdefault("_panelfill_encoders", {})
    if (name, spaced, key) not in kept:
        kept.clear()
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        kept[name, spaced, key] = BlockEncoder(path, spaced, lexicon() if lexicon else None)
    return kept[name, spaced, key]


def release() -> None:
    """Let this worker's encoder go, and what Arrow keeps of freed memory."""
    vars(sys).pop("_panelfill_encoders", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
