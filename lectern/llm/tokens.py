"""Exact token ids of a word-level BPE vocabulary, with the ids of seen words kept.

The vocabulary lower-cases, drops white space and never lets a token span it, nor the place
between a letter and a sign other than the apostrophe; so the ids of what stands between such
places do not depend on its neighbours. Texts of Latin letters (up to U+017F) are split there,
many at once; the parts are looked up by 64-bit hashes, and each new one is encoded once by the
tokenizer itself, parts of letters alone by its model (they need no normalizing and no cutting). All other texts, texts with very long parts, and texts that hold a string which the
vocabulary has as a token of its own (such as the mark of a text's end) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from lectern.llm.shingles import _SPACE, hashed_words

#: Stands between words that are encoded together; plain texts do not hold it.
_MARK = "\x01"
# Where Python's lower() agrees with the vocabulary's own normalizer, and white space is known.
_PLAIN = re.compile("[\x00\x02-\x1b\x20-\u012f\u0131-\u017f]*")
_LONG_WORD = 64
#: So many new words go to the tokenizer in one call, whose own memory grows with the text it gets.
_AT_ONCE = 2048
#: Slots for words found without a search; the first word of a slot has it.
_SLOTS = 19
#: What a vocabulary does before its model sees a word. Of a word of lower-case letters up to U+017F, these
#: change nothing but the name of each byte.
_BEFORE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_OWN_NAME = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The character that byte-level vocabularies have for each byte, but the line's end, which stands between words.
_BYTE = np.arange(256, dtype="<u4")
_BYTE[[b for b in range(256) if b not in _OWN_NAME]] = np.arange(256, 512 - len(_OWN_NAME))
_BYTE[10] = 10
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """True at bytes that follow a letter and are a sign, or the other way round."""
    letter, sign = _LETTER[data], _SIGN[data]
    # two-byte characters that are no letters: all that begin with C2, and the signs of C3
    after = np.concatenate([data[1:], [0]]).astype(np.uint8)
    other = (data == 0xC2) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    letter &= ~other
    letter[1:] &= ~other[:-1]
    cuts = np.zeros(len(data), dtype=bool)
    cuts[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    return cuts


class WordEncoder:
    """``encode(texts)``: one int32 array of ids for each text; empty for empty texts."""

    def __init__(self, path: str, keep: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")
        self.keep = keep
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no single token for the mark")
        told = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model if {k: told[k] for k in _BEFORE} == _BEFORE else None
        self._clear()

    def _clear(self) -> None:
        self.names = np.zeros(0, dtype=np.uint64)  # hashes of known words, sorted
        self.numbers = np.zeros(0, dtype=np.int32)  # of each of them: words are numbered from 1 as they come
        self.hashes = np.zeros(1, dtype=np.uint64)  # by number
        self.starts = np.zeros(1, dtype=np.int32)  # where each one's ids begin in flat
        self.counts = np.zeros(1, dtype=np.int16)  # words are short: see _LONG_WORD
        self.flat = np.zeros(0, dtype=np.int32)
        self.slots = np.zeros(1 << _SLOTS, dtype=np.int32)  # numbers by the upper bits of the hash; 0: free

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has), many words in one call with a mark behind each."""
        parts = []
        for at in range(0, len(words), _AT_ONCE):
            joined = f" {_MARK} ".join(words[at : at + _AT_ONCE]) + f" {_MARK}"
            parts.append(np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark[0])
        if len(ends) != len(words):
            raise ValueError("the mark occurs inside a word")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _letter_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, by the tokenizer's model."""
        named = _BYTE[np.frombuffer("\n".join(words).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le").split("\n")
        found = [[t.id for t in self.model.tokenize(w)] for w in named]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((i for f in found for i in f), dtype=np.int32, count=int(counts.sum())), counts

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        """Encode new words."""
        letters = np.fromiter((self.model is not None and w.isalpha() for w in words), dtype=bool, count=len(words))
        for of, encode in ((letters, self._letter_ids), (~letters, self._ids)):
            if not of.any():
                continue
            ids, counts = encode([w for w, o in zip(words, of.tolist(), strict=True) if o])
            some, number = names[of], np.arange(len(self.starts), len(self.starts) + len(counts), dtype=np.int32)
            at = np.searchsorted(self.names, some)
            self.names = np.insert(self.names, at, some)
            self.numbers = np.insert(self.numbers, at, number)
            self.hashes = np.concatenate([self.hashes, some])
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int16)])
            self.flat = np.concatenate([self.flat, ids])
            slot = (some >> np.uint64(64 - _SLOTS)).astype(np.int64)
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free]

    def _encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        hashes, starts, ends = hashed_words(data, _cuts(data))
        if len(self.names) > self.keep:
            self._clear()
        number = self.slots[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        rest = np.flatnonzero((self.hashes[number] != hashes) | (number == 0))
        names, first, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = self.names[at] != names if len(self.names) else np.ones(len(names), dtype=bool)
        if new.any():
            words = [bytes(data[starts[i] : ends[i]]).decode() for i in rest[first[new]].tolist()]
            self._learn(names[new], words)
            at = np.searchsorted(self.names, names)
        number[rest] = self.numbers[at][which]
        counts = self.counts[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.starts[number] - total[:-1], counts) + np.arange(total[-1])]
        sizes = np.cumsum([len(t) + 1 for t in texts])
        cuts = total[np.searchsorted(starts, sizes)]
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, places = [], []
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                low = text.lower()
                if not self.added.search(low):
                    plain.append(low.replace("\x85", " ").replace("\xa0", " ").encode())
                    places.append(i)
        short = ~_with_long_words(plain)
        plain, places = ([x for x, o in zip(v, short.tolist(), strict=True) if o] for v in (plain, places))
        if plain:
            for i, ids in zip(places, self._encode_plain(plain), strict=True):
                out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out[i] = np.array(ids, dtype=np.int32)
        return out  # type: ignore[return-value]


def _with_long_words(texts: list[bytes]) -> np.ndarray:
    """Which texts have a run of more than _LONG_WORD bytes without white space."""
    gaps = np.concatenate([[-1], np.flatnonzero(_SPACE[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)])])
    found = np.zeros(len(texts), dtype=bool)
    at = gaps[1:][np.diff(gaps) > _LONG_WORD + 1]  # the white space behind such a run
    found[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")] = True
    return found


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; the words it has seen stay known between tasks."""
    return WordEncoder(path)
