"""Token ids from the tokenizers library, with a memo of words.

A byte-level BPE never joins what stands before a single space or line end with the word behind
it, so a text is the sequence of its words, each with the space or line end before it, and equal
words have equal ids. Each process asks the tokenizer for a word once and then copies its ids.
Texts to which that doesn't apply (other or double white space, special tokens) go to the
tokenizer whole. The same holds before a mark that follows a letter or digit, which spares the
memo the words with their full stops. A BPE of word ends that drops white space and lower-cases never looks beyond a word at all:
its words are what stands between white space of any kind and number. A word found by its hash counts only if its bytes are the
stored ones; words of more than EXACT bytes, and those whose hash another word has, are looked up by
their bytes. So ids are the library's whatever collides.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from millrace.llm import words as W

#: Words that the memo holds; when it is full, those that came only once are forgotten. The memo
#: speeds up and never changes ids.
MEMO_WORDS = 1 << 19
#: Bytes of a word that the memo keeps beside its hash, as numbers of eight.
EXACT = 32
_SLOTS_A_WORD = 2
_SPACE, _LINE, _HEAD = 0, 1, 2  #: what stands before a word: a space, a line end, nothing
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?*#$%&|()-")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[10, 32]] = True
#: Bytes that are white space themselves, and bytes that may begin some in UTF-8.
_OTHER_WHITE = np.zeros(256, dtype=bool)
_OTHER_WHITE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_MAYBE_WHITE = np.zeros(256, dtype=bool)
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: White space that separates words where it is dropped.
_DROPPED = np.zeros(256, dtype=bool)
_DROPPED[[9, 10, 11, 12, 13, 32]] = True
#: The steps before the model by which white space is dropped: fixed values of the public vocabulary of word ends.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_kept: dict[str, WordTokenizer] = {}


def _drops_space(spec: dict) -> bool:
    """Whether a vocabulary file describes a BPE of word ends over words between dropped white space."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        spec["model"]["type"] == "BPE" and bool(spec["model"].get("end_of_word_suffix")) and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and spec.get("post_processor") is None
        and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": _SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", []))
    )


def tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer for a vocabulary file."""
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]


class _Memo:
    """A hash table from word hashes to numbers, with open addressing, for whole arrays at once."""

    def __init__(self, words: int):
        self.bits = max(4, int(words * _SLOTS_A_WORD - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, 0 for those that aren't here."""
        out = np.zeros(len(keys), np.int32)
        left, at, mask = np.arange(len(keys)), self._places(keys), (1 << self.bits) - 1
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert keys that aren't here and differ from each other."""
        left, at, mask = np.arange(len(keys)), self._places(keys), (1 << self.bits) - 1
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several for one place the last stays
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & mask


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_word = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and len(line) == 1
        )
        self.line = line[0] if line else -1
        self.spaceless = _drops_space(spec)
        self.cuts = _DROPPED if self.spaceless else _CUT
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.memo, self.n, self.used, self.long = _Memo(MEMO_WORDS), 1, 0, {}
        self.emptied = getattr(self, "emptied", 0) + 1
        size = MEMO_WORDS + 1
        self.hashes, self.starts, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.tags, self.chars, self.again = np.zeros(size, np.int32), np.zeros((size, EXACT // 8), np.uint64), np.zeros(size, bool)
        self.ids = np.zeros(1 << 16, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """What the library gives for each text."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words from texts with a word on each line: all ids, each word's place (its line end first) and end."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.spaceless:
            own = self.whole(words)
            end = np.cumsum([len(x) for x in own])
            return np.concatenate(own), np.append(0, end[:-1]), end
        sep = "\n" + before
        ids = np.concatenate(self.whole([sep + sep.join(words[i : i + 200]) for i in range(0, len(words), 200)]))
        at = np.flatnonzero(ids == self.line)
        if len(at) != len(words):
            raise ValueError("the tokenizer joins words over line ends")
        return ids, at, np.append(at[1:], len(ids))

    def _learn(self, kinds: np.ndarray, words: list[str]) -> np.ndarray:
        """Ask the library for words; the numbers under which their ids are kept."""
        if self.n + len(words) > MEMO_WORDS:
            self._make_room()
            if self.n + len(words) > MEMO_WORDS:
                self._forget()
                return np.zeros(0, np.int32)
        number = np.arange(self.n, self.n + len(words), dtype=np.int32)
        for group, before in ((np.flatnonzero(kinds == _SPACE), " "), (np.flatnonzero(kinds != _SPACE), "")):
            ids, at, end = self._together([words[i] for i in group], before)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            skip = np.int64(0) if self.spaceless else (kinds[group] != _LINE).astype(np.int64)  # a word after a line end has the line end's id first
            self.starts[number[group]], self.lengths[number[group]] = self.used + at + skip, end - at - skip
            self.used += len(ids)
        self.tags[number], self.again[number] = 0, False
        self.n += len(words)
        return number

    def _enter(self, number: np.ndarray, hashes: np.ndarray, tags: np.ndarray, chars: np.ndarray) -> None:
        """Let words be found by their hashes, which aren't here and differ from each other."""
        self.hashes[number], self.tags[number], self.chars[number] = hashes, tags, chars
        self.memo.add(hashes, number)

    def _make_room(self) -> None:
        """Keep the words that have come again."""
        keep = np.flatnonzero(self.again[: self.n] & (self.tags[: self.n] > 0))[: MEMO_WORDS // 2]
        ids, lengths = self._gather(keep), self.lengths[keep].copy()
        hashes, tags, chars = self.hashes[keep].copy(), self.tags[keep].copy(), self.chars[keep].copy()
        self._forget()
        number = np.arange(1, len(keep) + 1, dtype=np.int32)
        self.ids = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.used, self.n = len(ids), len(keep) + 1
        self.lengths[number], self.starts[number] = lengths, np.cumsum(lengths) - lengths
        self._enter(number, hashes, tags, chars)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray | None:
        """The number of each word; None if the memo was emptied for too many new words."""
        at_once, size = W.eights(data), end - start
        h = W.hashes(at_once, start, end, kind)
        h[h == 0] = 1
        tag = np.where(size <= EXACT, size * 4 + kind + 1, 0).astype(np.int32)  # 0: only by its bytes
        text: bytes | None = None

        def words(which: np.ndarray) -> list[bytes]:
            nonlocal text
            text = data.tobytes() if text is None else text
            return [text[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]

        def chars(which: np.ndarray) -> np.ndarray:
            out = np.zeros((len(which), EXACT // 8), np.uint64)
            for k in range(EXACT // 8):
                on = np.flatnonzero(size[which] > 8 * k)
                w = which[on]
                out[on, k] = at_once[start[w] + 8 * k] & W._LOW_BYTES[np.minimum(size[w] - 8 * k, 8)]
            return out

        number = self.memo.find(h)
        self.again[number] = True
        new = np.flatnonzero((number == 0) & (tag > 0))
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            first = new[first]
            learnt = self._learn(kind[first], [x.decode() for x in words(first)])
            if not len(learnt):
                return None
            self._enter(learnt, fresh, tag[first], chars(first))
            number = self.memo.find(h)
        number[tag == 0] = 0
        same = (self.tags[number] == tag) & (number > 0)
        for k in range(EXACT // 8):
            on = np.flatnonzero(same & (size > 8 * k))
            same[on] = self.chars[number[on], k] == at_once[start[on] + 8 * k] & W._LOW_BYTES[np.minimum(size[on] - 8 * k, 8)]
        other = np.flatnonzero(~same)
        if len(other):
            emptied = self.emptied
            keys = [bytes([k]) + x for k, x in zip(kind[other].tolist(), words(other), strict=True)]
            unknown = list(dict.fromkeys(x for x in keys if x not in self.long))
            if unknown:
                learnt = self._learn(np.array([x[0] for x in unknown]), [x[1:].decode() for x in unknown])
                if self.emptied != emptied:
                    return None
                self.long.update(zip(unknown, learnt.tolist(), strict=True))
            number[other] = [self.long[x] for x in keys]
        return number

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        n = self.lengths[numbers].astype(np.int64)
        stop = np.cumsum(n)
        return self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.starts[numbers] - stop + n, n)]

    def _odd(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Which documents must go to the library whole."""
        if self.spaceless:
            return self._special(data, offsets, np.zeros(len(offsets) - 1, bool))
        bad = _OTHER_WHITE[data]
        bad[1:] |= cut[1:] & cut[:-1]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        bad[bounds] |= cut[bounds]
        bad[offsets[1:][np.diff(offsets) > 0] - 1] |= cut[offsets[1:][np.diff(offsets) > 0] - 1]
        maybe = np.flatnonzero(_MAYBE_WHITE[data])
        if len(maybe):
            a, b, c = data[maybe], data[np.minimum(maybe + 1, len(data) - 1)], data[np.minimum(maybe + 2, len(data) - 1)]
            white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            white |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            bad[maybe] |= white
        count = np.concatenate([[0], np.cumsum(bad)])
        return self._special(data, offsets, count[offsets[1:]] > count[offsets[:-1]])

    def _special(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``out``, and the documents that hold a special token."""
        for special in self.special:
            first = np.concatenate([[0], np.cumsum(data == special[0])])
            for i in np.flatnonzero(first[offsets[1:]] > first[offsets[:-1]]):
                out[i] |= special in data[offsets[i] : offsets[i + 1]].tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), as the library gives them for each whole text, and the bounds of each text's."""
        data, offsets = W.raw(texts)
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        row, n = 0, len(offsets) - 1
        while row < n:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + W.BLOCK_BYTES, "right")) - 1)
            ids, count = self._block(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
            parts.append(ids)
            counts.append(count)
            row = to
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        count = np.zeros(rows, np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), count
        cut = self.cuts[data]
        odd = self._odd(data, offsets, cut) if self.by_word or self.spaceless else np.diff(offsets) > 0
        inside = ~cut
        if odd.any():
            inside &= ~np.repeat(odd, np.diff(offsets))
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        mark = np.flatnonzero(_MARK[data])
        mark = mark[mark > 0]
        before, two = data[mark - 1], data[np.maximum(mark - 2, 0)]
        # Of other letters only those of Latin-1 count: their second byte follows 0xC3.
        mark = mark[(_LETTER[before] | (before >= 0x80) & (two == 0xC3) & (before != 0x97) & (before != 0xB7)) & inside[mark] & ~opens[mark]]
        opens[mark] = True
        closes[mark - 1] = True
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        bounds = np.searchsorted(start, offsets)
        doc_start = np.repeat(offsets[:-1], np.diff(bounds))
        last = data[start - 1]
        kind = np.where(last == 10, _LINE, np.where(last == 32, _SPACE, _HEAD))
        kind[start == doc_start] = _HEAD
        if self.spaceless:
            kind[:] = _HEAD
        number = self._numbers(data, start, end, kind)
        if number is None:
            return self._pieces(data, offsets, count)
        ids = self._gather(number)
        total = np.concatenate([[0], np.cumsum(self.lengths[number], dtype=np.int64)])
        count += total[bounds[1:]] - total[bounds[:-1]]
        if odd.any():
            which = np.flatnonzero(odd)
            own = dict(zip(which.tolist(), self.whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in which]), strict=True))
            bounds = np.concatenate([[0], np.cumsum(count)])
            ids = np.concatenate([own[i] if i in own else ids[bounds[i] : bounds[i + 1]] for i in range(rows)])
            for i, x in own.items():
                count[i] = len(x)
        return ids, count

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block without the memo."""
        own = self.whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        count[:] = [len(x) for x in own]
        return np.concatenate(own), count
