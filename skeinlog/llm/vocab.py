"""Byte-level BPE vocabulary files and the pre-token pattern.

``load`` reads a vocabulary once in a process.  The path is a parameter
everywhere: the files are installed on every machine and are never copied.
"""

from __future__ import annotations

import functools
import gc
import json
from dataclasses import dataclass

import numpy as np
import regex

#: Fixed value: the published pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Merges by rank, and the bytes of every id."""

    size: int
    byte_ids: np.ndarray  # id of each single byte
    pairs: dict  # (left id, right id) -> (rank, merged id)
    id_bytes: list  # bytes of each id
    special: dict  # added token -> id, matched in texts before the pre-token pattern
    splitter: object  # regex that cuts a text at special strings; None if there are none


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary in a ``tokenizers`` JSON file of the byte-level BPE kind."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab = data["model"]["vocab"]
    letters = byte_letters()
    to_byte = {ch: b for b, ch in enumerate(letters)}
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    size = 1 + max([*vocab.values(), *added.values()])
    id_bytes = [b""] * size
    for token, i in {**vocab, **added}.items():
        inside = [to_byte.get(ch) for ch in token]
        id_bytes[i] = bytes(inside) if None not in inside else token.encode()
    pairs = {}
    for rank, merge in enumerate(data["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
    return Vocabulary(size, np.array([vocab[ch] for ch in letters], np.int32), pairs, id_bytes, added, cut)


def key_of(piece: str) -> str:
    """The cache's key of a pre-token: without its leading space, or with a space in front if it has none; white space is marked."""
    if piece.isspace():
        return "\x00" + piece
    return piece[1:] if piece[0] == " " else " " + piece


def piece_of(key: str) -> str:
    if key[0] == "\x00" and key[1:].isspace():
        return key[1:]
    return key[1:] if key[0] == " " else " " + key


class WordCoder:
    """Codes whole texts from cached pre-tokens.

    A text is cut at single spaces.  A part that ends in a visible character
    is coded alike wherever it stands, because no pre-token crosses the border
    before a space that follows a visible character.  A text
    with another part (doubled spaces, white space before a space or at the end)
    or a special string is cut by the pattern instead.  ``encode`` maps a list
    of distinct pre-tokens to their codes; ``add`` and ``special`` say how
    codes go together.
    """

    #: Bytes of pre-tokens and codes that stay between calls, about; beyond that the cache starts afresh.
    CACHE_BYTES = 96 << 20
    #: Bytes that an entry takes besides its characters and code, about.
    ENTRY_BYTES = 180
    #: Marks of what was met before: where ``keep_all`` is off only what is met a second time stays.
    MARKS = 1 << 22

    def __init__(self, vocabulary: Vocabulary, encode, zero, keep_all: bool = False):
        self.vocabulary, self.encode, self.zero, self.keep_all = vocabulary, encode, zero, keep_all
        self.codes: dict = {}
        self.held = 0
        self.met, self.n_met = bytearray(self.MARKS), 0
        self.find = regex.compile(PATTERN).findall
        self.marks = list(vocabulary.special)

    def lists(self, texts: list[str]) -> list[list]:
        """For each text the codes of its parts, in order.

        Nothing here makes reference cycles, so the collector, which would
        walk the cache again and again, rests meanwhile.
        """
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._lists(texts)
        finally:
            if resting:
                gc.enable()

    def clear(self) -> None:
        """Forget all codes."""
        self.codes, self.held = {}, 0

    def _forget(self, fresh: set) -> None:
        """Keep of the codes that were just made those that are met for the second time, or all; begin anew beyond the bound."""
        met, mask, codes = self.met, self.MARKS - 1, self.codes
        once = [] if self.keep_all else [x for x in fresh if not met[hash(x) & mask]]
        for x in once:
            del codes[x]
            met[hash(x) & mask] = 1
        self.n_met += len(once)
        self.held += (len(fresh) - len(once)) * self.ENTRY_BYTES + 4 * (sum(map(len, fresh)) - sum(map(len, once)))
        if self.held > self.CACHE_BYTES:
            self.clear()
        if 4 * self.n_met > self.MARKS:
            self.met, self.n_met = bytearray(self.MARKS), 0

    def _lists(self, texts: list[str]) -> list[list]:
        find, codes, marks = self.find, self.codes, self.marks
        # a text's first word stands without a space before it, so its key in the cache is marked
        split, slow = [], []
        for k, text in enumerate(texts):
            if any(m in text for m in marks):
                split.append(None)
                slow.append(k)
                continue
            words = text.split(" ")
            words[0] = " " + words[0]
            split.append(words)
        fresh = set()
        for words in split:
            if words is not None:
                fresh.update(words)
        fresh = fresh.difference(codes)
        # str.isspace also holds for U+001C to U+001F, which the pattern takes as visible: the slow way is right for them too
        need, several, wild_parts = set(), {}, set()
        for w in fresh:
            if w.isalpha():
                # letters alone are one pre-token
                need.add(w)
            elif w and not w[-1].isspace():
                keys = list(map(key_of, find(w[1:] if w[0] == " " else " " + w)))
                if len(keys) > 1:
                    several[w] = keys
                need.update(keys)
            else:
                wild_parts.add(w)
        wild = {}
        if wild_parts:
            for k, words in enumerate(split):
                if words is not None and not wild_parts.isdisjoint(words):
                    split[k] = None
                    slow.append(k)
        for k in slow:
            wild[k] = [key_of(p) if type(p) is str else p for p in self._cut(texts[k])]
            need.update(p for p in wild[k] if type(p) is str)
        need = need.difference(codes)
        todo = list(need)
        for at in range(0, len(todo), 50_000):
            some = todo[at : at + 50_000]
            codes.update(zip(some, self.encode(list(map(piece_of, some))), strict=True))
        # parts of several pre-tokens are put together for this call, or stay like any other where all codes do
        made = {w: self.add([codes[x] for x in keys], self.zero) for w, keys in several.items()}
        codes.update(made)
        out = []
        for k, words in enumerate(split):
            if words is not None:
                out.append(list(map(codes.__getitem__, words)))
            else:
                out.append([codes[p] if type(p) is str else p[0] for p in wild[k]])
        if self.keep_all:
            need.update(made)
        else:
            for w in made:
                del codes[w]
        self._forget(need)
        return out

    def _cut(self, text: str) -> list:
        """Pre-tokens of a text; a special string becomes a one-element tuple with its code."""
        if not self.marks or not any(m in text for m in self.marks):
            return self.find(text)
        found = []
        for run in self.vocabulary.splitter.split(text):
            if run in self.vocabulary.special:
                found.append((self.special(self.vocabulary.special[run]),))
            elif run:
                found.extend(self.find(run))
        return found

    def add(self, codes: list, zero):
        raise NotImplementedError

    def special(self, token_id: int):
        raise NotImplementedError


class IdCoder(WordCoder):
    """Codes are little-endian int32 ids as bytes."""

    def __init__(self, vocabulary: Vocabulary, encode, keep_all: bool = False):
        super().__init__(vocabulary, encode, b"", keep_all)

    def add(self, codes, zero):
        return b"".join(codes)

    def special(self, token_id):
        return np.int32(token_id).tobytes()


class CountCoder(WordCoder):
    """Codes are numbers of tokens."""

    def __init__(self, vocabulary: Vocabulary, encode, keep_all: bool = False):
        super().__init__(vocabulary, encode, 0, keep_all)

    def add(self, codes, zero):
        return sum(codes)

    def special(self, token_id):
        return 1
