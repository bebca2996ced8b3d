"""Tokenising whole texts with a public tokenizer file, remembering the ids of words already seen.

With a byte-level pre-tokenizer of the usual form no piece reaches from a non-space character over a
following space: a space goes to the piece after it. A text may therefore be cut before every single
space that stands between two non-space characters; likewise before a full stop or comma after a letter,
and before a line feed after anything but white space. The ids of the cuttings, joined, are those of the
whole text. ``Encoder`` has the library give the ids of each distinct cutting once per worker, finds
known ones by a 64-bit hash in an array, and gathers their ids. Texts in which a space touches other
white space, or with unusual white space or a special token's opening, go to the library whole.

Of a new cutting made of ASCII and Latin-1 letters, digits, punctuation and line feeds only, the pieces
are cut here, since there the pre-tokenizer's classes are plain, and the library's model gives the ids of
each new piece; any other new cutting goes through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from sylvan.llm import text as T

TOKENIZER = "byte_bpe_50k.json"
#: The pre-tokenizer for which texts may be cut at spaces.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_LETTERS, _PUNCTUATION = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[ {_LETTERS}0-9{_PUNCTUATION}\n]+")
#: The byte-level pre-tokenizer's fixed pattern, over the plain characters.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_PUNCTUATION}]+|\s+(?!\S)|\s+")
#: Cuttings and pieces remembered, and the longest one in bytes, before a worker starts its memory anew.
MOST_WORDS, MOST_PIECES, LONGEST = 1_000_000, 120_000, 200


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        letter = _byte_letters()
        self.spelled = {c: "".join(letter[b] for b in chr(c).encode()) for c in (10, 32, *range(33, 127), *range(192, 256))}
        self.may_cut = json.loads(self.library.to_str())["pre_tokenizer"] == _PRE_TOKENIZER and self.library.normalizer is None
        self.openings = sorted({t.content[:2].encode() for t in self.library.get_added_tokens_decoder().values()})
        self._forget()

    def _forget(self) -> None:
        slots = 1 << (2 * MOST_WORDS - 1).bit_length()
        self.keys, self.code = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.n = self.used = 0
        self.pieces: dict[str, bytes] = {}
        self.flat, self.begin, self.length = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_piece(self, word: str) -> bytes:
        """The ids as 32-bit integers; bytes, since the collector needn't look into them."""
        out = []
        for piece in [word] if word[0] == " " and word[1:].isalpha() else _PIECE.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = array("i", [t.id for t in self.model.tokenize(piece.translate(self.spelled))]).tobytes()
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Each key's code, or -1. Keys aren't 0; open addressing with steps of one."""
        mask = np.uint64(len(self.keys) - 1)
        out, open_ = np.full(len(key), -1, np.int64), np.arange(len(key))
        slot = key & mask
        while len(open_):
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.code[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + np.uint64(1)) & mask
        return out

    def _put(self, key: np.ndarray, code: np.ndarray) -> None:
        mask, slot = np.uint64(len(self.keys) - 1), key & np.uint64(len(self.keys) - 1)
        while len(key):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.code[slot[free]] = key[free], code[free]
            lost = self.keys[slot] != key
            key, code, slot = key[lost], code[lost], (slot[lost] + np.uint64(1)) & mask

    def _learn(self, new: list[str]) -> np.ndarray:
        """Codes of new cuttings, with their ids from the library."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        tokenize, ids, others = self.model.tokenize, [], []
        for k, w in enumerate(new):
            if w[0] == " " and w.isascii() and w[1:].isalpha():  # one piece
                ids.append(array("i", [t.id for t in tokenize(self.spelled[32] + w[1:])]).tobytes())
            elif _PLAIN.fullmatch(w):
                ids.append(self._by_piece(w))
            else:
                ids.append(b"")
                others.append(k)
        for k, x in zip(others, self._whole([new[k] for k in others])):
            ids[k] = array("i", x).tobytes()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(n.sum())
        while len(self.begin) < self.n + len(new):
            self.begin, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.length))
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        code = np.arange(self.n, self.n + len(new))
        self.begin[code], self.length[code] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.int32)
        self.used, self.n = self.used + total, self.n + len(new)
        return code

    def _must_go_whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may not be cut at their spaces, or hold a cutting too long to remember."""
        bad = np.zeros(len(data) + 2, bool)
        d = np.concatenate([data, np.zeros(2, np.uint8)])
        space = data == 32
        feed = data == 10
        bad[: len(data)] = ((data >= 9) & (data <= 13) & ~feed) | ((data >= 28) & (data <= 31))
        if len(data):
            white = space | feed
            bad[: len(data) - 1] |= (space[:-1] & white[1:]) | (white[:-1] & space[1:])
        for opening in self.openings:
            at = np.flatnonzero(data == opening[0])
            bad[at] |= d[at + 1] == opening[-1] if len(opening) > 1 else True
        at = np.flatnonzero(data == 0xC2)
        bad[at] |= (d[at + 1] == 0x85) | (d[at + 1] == 0xA0)
        at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
        a, b, c = d[at], d[at + 1], d[at + 2]
        bad[at] |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        full = np.diff(offsets) > 0
        bad[offsets[:-1][full]] |= space[offsets[:-1][full]]
        bad[offsets[1:][full] - 1] |= space[offsets[1:][full] - 1]
        count = np.concatenate([[0], np.cumsum(bad[: len(data)])])
        return (count[offsets[1:]] > count[offsets[:-1]]) | (not self.may_cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text as int32."""
        if self.n > MOST_WORDS - T.STEP_BYTES // 16:
            self._forget()
        docs, whole = len(offsets) - 1, self._must_go_whole(data, offsets)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = data == 32
        after, before = data[1:], data[:-1]
        letter = _LETTER[before]
        letter[1:] |= (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        cut[1:-1] |= ((after == 46) | (after == 44)) & letter | (after == 10) & (before != 10)
        cut[offsets[:-1]] = True
        cut[-1] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        doc = np.searchsorted(offsets, begin, "right") - 1
        whole[doc[end - begin > LONGEST]] = True
        keep = ~whole[doc]
        begin, end, doc = begin[keep], end[keep], doc[keep]
        key = T.hash_spans(data, begin, end) | np.uint64(1 << 63)
        code = self._find(key)
        if len(unknown := np.flatnonzero(code < 0)):
            new, first, back = np.unique(key[unknown], return_index=True, return_inverse=True)
            at, raw = unknown[first], data.tobytes()
            if self.n + len(new) > MOST_WORDS:  # a text with more new words than the memory has room for
                self._forget()
                return self.encode(data, offsets) if len(new) < MOST_WORDS - T.STEP_BYTES // 16 else [np.array(x, np.int32) for x in self._whole([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])]
            fresh = self._learn([raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())])
            self._put(new, fresh.astype(np.int32))
            code[unknown] = fresh[back]
        n = self.length[code].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bound = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(docs + 1))].tolist()
        out = [ids[a:b] for a, b in zip(bound[:-1], bound[1:])]
        if len(others := np.flatnonzero(whole & (np.diff(offsets) > 0))):
            for i, x in zip(others, self._whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in others])):
                out[i] = np.array(x, np.int32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(column, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(place, ids) of each text of an Arrow column in order, some at a time; null is taken as empty."""
    data, offsets = T.utf8(column)
    own = encoder(path)
    for a, b in T.steps(offsets):
        yield from zip(range(a, b), own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
