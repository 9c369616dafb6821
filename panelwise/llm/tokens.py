"""Token ids of whole texts by the ``tokenizers`` library, with the ids of repeated words remembered.

The two kinds of vocabulary used here never merge across a space: one splits every word off with
the space before it, the other drops white space. So the ids of a text are the ids of its
space-separated pieces one after the other, and each task keeps the ids of the pieces it has met. Nor do
they merge from a letter to a mark, so that a word is the same piece whatever mark follows it.
Texts with plain white space are cut as one byte buffer: a piece of up to 16 bytes is known by them and has
two places in a table, the second for those whose first place was taken before; what the second place loses
is learnt again when it is met again. Longer pieces are looked up in a dictionary. Texts with unusual white
space are cut by a pattern, and what does not fit the rule at all (added tokens in the text) goes through the
library whole. The ids are always the library's own.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from itertools import chain

import numpy as np

REMEMBERED = 300_000  # pieces kept in dictionaries per task and vocabulary, some 80 MB
IDS_REMEMBERED = 1 << 22  # ids kept for the pieces in the table and for long ones, 16 MB
AT_ONCE = 4_096  # pieces given to the library in one call
ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SLOTS = 19  # bits of a place in each half of the table of pieces, 28 MB in all
WIDE = 16  # bytes by which a piece is known there
MASK = np.array([int.from_bytes(b"\xff" * n + bytes(WIDE - n), "little") >> shift & (1 << 64) - 1 for n in range(WIDE + 1) for shift in (0, 64)], dtype=np.uint64).reshape(-1, 2)
LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130)  # a lower-cased dotted I is two characters
MARKS = "!-/:-@\\[-`{-~"
WORD = re.compile(f" ?(?:[{LETTERS}]+|[!-&(-/:-@\\[-`{{-~]+)")  # one word of plain letters, or marks without an apostrophe
SPACED = re.compile(f" ?[{LETTERS}]++(?=[{MARKS}])| ?\\S+|\\s+(?!\\S)|\\s+")
UNSPACED = re.compile(f"[{LETTERS}]++(?=[{MARKS}])|\\S+")
IS_MARK = np.array([re.fullmatch(f"[{MARKS}]", chr(b)) is not None for b in range(256)])
ENDS_LETTER = np.zeros((256, 256), dtype=bool)  # of the last two bytes
for encoded in map(str.encode, LETTERS):
    ENDS_LETTER[encoded[0] if len(encoded) == 2 else slice(None), encoded[-1]] = True
SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space for Python, not for the tokenizers


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: visible ones as they are, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.added = [t["content"] for t in layout.get("added_tokens", [])]
        split, normal = layout.get("pre_tokenizer") or {}, layout.get("normalizer")
        steps = [s.get("type") for s in split.get("pretokenizers", [])]
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not normal:
            self.kind = "spaced"
        elif steps == ["Split", "ByteLevel"] and split["pretokenizers"][0].get("behavior") == "Removed" and normal:
            self.kind = "words"
        else:
            self.kind = "whole"
        self.known: dict[str, bytes] = {}
        self.forget()
        self.model = self.tokenizer.model
        letters = byte_letters() | {0x0A: "\n"}
        self.byte_letters = "".join(letters[b] for b in range(256))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """Pieces whose ids follow each other; None when the text must go through whole."""
        if any(a in text for a in self.added):
            return None
        if self.kind == "words":
            return None if SEPARATORS.search(text) else UNSPACED.findall(text)
        if self.kind != "spaced" or SEPARATORS.search(text):
            return None
        return SPACED.findall(text)

    def seen(self, words: list[str]) -> list[str]:
        """The forms in which the merge model sees pieces that match WORD."""
        joined = "\n".join(words)
        if self.kind == "words":
            joined = joined.lower()  # letters of this range are never decomposed
        return codecs.charmap_decode(joined.encode(), "strict", self.byte_letters)[0].split("\n")

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Plain words and marks go straight to the library's merge model, all other pieces through the whole tokenizer."""
        tokenize, match = self.model.tokenize, WORD.fullmatch
        found: list[list[int] | None] = [None] * len(pieces)
        straight = [i for i, w in enumerate(pieces) if match(w)]
        for i, w in zip(straight, self.seen([pieces[i] for i in straight]), strict=False):  # no words are seen as one empty form
            found[i] = [t.id for t in tokenize(w)]
        others = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(others), AT_ONCE):
            part = others[at:at + AT_ONCE]
            got = self.tokenizer.encode([pieces[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            ids = got.ids
            ends = np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1)).tolist()
            for k, i in enumerate(part):
                found[i] = ids[ends[k]:ends[k + 1]]
        return found

    def is_plain(self, text: str) -> bool:
        """Whether spaces and line breaks alone tell where the text is cut."""
        if self.kind == "whole" or "\x00" in text or ODD_SPACE.search(text) or any(a in text for a in self.added):
            return False
        return self.kind == "words" or not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"))

    def cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of plain texts begin and end in their bytes; text i begins at first[i]."""
        space, line = data == 0x20, data == 0x0A
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[first] = True
        mark = np.flatnonzero(IS_MARK[data])
        mark = mark[ENDS_LETTER[data[np.maximum(mark - 2, 0)], data[mark - 1]]]  # where a text begins any cut is right
        if self.kind == "spaced":  # a word carries the space before it, a line break stands alone
            begins = space | line | edge[:-1]
            begins[1:] |= line[:-1]
            begins[mark] = True
            begin = np.flatnonzero(begins)
            return begin, np.append(begin[1:], len(data))[:len(begin)]
        inside = ~(space | line)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        begins[mark], ends[mark - 1] = True, True
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def remember(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these pieces stand and how many they are; all but the long ones met before are learnt."""
        new = [w for w in dict.fromkeys(words) if w not in self.long]
        met = {}
        if new:
            found = self.ids_of(b"\x00".join(new).decode().split("\x00"))
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            upto = self.used + np.cumsum(counts)
            if upto[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 4, int(upto[-1]) - len(self.ids)), dtype="<u4")])
            self.ids[self.used:upto[-1]] = np.fromiter(chain.from_iterable(found), dtype="<u4", count=upto[-1] - self.used)
            met = dict(zip(new, zip((upto - counts).tolist(), counts.tolist(), strict=True), strict=True))
            self.long.update((w, met[w]) for w in new if len(w) > WIDE)
            self.used = int(upto[-1])
        at = np.fromiter(chain.from_iterable(met.get(w) or self.long[w] for w in words), dtype=np.int64, count=2 * len(words))
        return at[::2], at[1::2]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        first = np.cumsum([0] + [len(r) for r in raw])
        joined = b"".join(raw)
        data = np.frombuffer(joined + bytes(WIDE), dtype=np.uint8)
        begin, end = self.cut(data[:len(joined)], first)
        if not len(begin):
            return [b""] * len(texts)
        length = end - begin
        keys = np.lib.stride_tricks.sliding_window_view(data, WIDE)[begin].view("<u8") & MASK[np.minimum(length, WIDE)]
        a, b = keys[:, 0], keys[:, 1]
        mixed = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        slot = (mixed >> np.uint64(64 - SLOTS)).astype(np.int64)
        held = (self.keys[slot, 0] == a) & (self.keys[slot, 1] == b) & (length <= WIDE)
        taken = np.flatnonzero(~held & (self.keys[slot, 0] != 0))  # a piece has no zero byte
        slot[taken] = (mixed[taken] >> np.uint64(64 - 2 * SLOTS)).astype(np.int64) & ((1 << SLOTS) - 1) | 1 << SLOTS
        held[taken] = (self.keys[slot[taken], 0] == a[taken]) & (self.keys[slot[taken], 1] == b[taken]) & (length[taken] <= WIDE)
        at, count = self.at[slot], self.count[slot]
        miss = np.flatnonzero(~held)
        if len(miss):
            words = [joined[i:j] for i, j in zip(begin[miss].tolist(), end[miss].tolist(), strict=True)]
            at[miss], count[miss] = self.remember(words)
            short = miss[length[miss] <= WIDE]
            self.keys[slot[short]], self.at[slot[short]], self.count[slot[short]] = keys[short], at[short], count[short]
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(at - (upto - count), count) + np.arange(upto[-1])].tobytes()
        ends = np.concatenate([[0], upto])[np.searchsorted(begin, first)] * 4
        ends = ends.tolist()
        return [ids[ends[i]:ends[i + 1]] for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.long) + len(self.known) > REMEMBERED or self.used > IDS_REMEMBERED:
            self.forget()
        plain = [self.is_plain(t) for t in texts]
        fast = iter(self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p]))
        split = [None if p else self.pieces(t) for t, p in zip(texts, plain, strict=True)]
        met = set(chain.from_iterable(s for s in split if s))
        new = list(met - self.known.keys())
        self.known.update((w, np.array(ids, dtype="<u4").tobytes()) for w, ids in zip(new, self.ids_of(new), strict=True))
        get = self.known.__getitem__
        return [
            next(fast) if p else b"".join(map(get, s)) if s is not None else self.whole(t)
            for t, p, s in zip(texts, plain, split, strict=True)
        ]

    def forget(self) -> None:
        """Give the remembered pieces back when a task ends; the worker process may be used for other work."""
        self.known, self.long, self.used = {}, {}, 0
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.keys = np.zeros((2 << SLOTS, 2), dtype=np.uint64)
        self.at, self.count = np.zeros(2 << SLOTS, dtype=np.int64), np.zeros(2 << SLOTS, dtype=np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
