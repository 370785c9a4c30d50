"""Whole texts to token ids by the tokenizers library, with a cache of the ids of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The id after each document.
END = 1
#: Rare white space, which libraries tell apart, and letters whose lower case is odd: such texts are encoded whole.
_ODD = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeffΣİ]"
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 2 << 20
#: Words of a generation of the cache: some 60 MB for two.
CACHED_WORDS = 1 << 19
#: ASCII marks, which the tokenizer always parts from letters before them.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Of each byte of a lower-case text: white space, a letter or digit, a mark that stands alone, anything else.
_SPACE, _WORD, _ALONE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = _WORD
_CLASS[[*b".,"]] = _ALONE
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of a word from which it is hashed on its own.
_LONG = 256
_loaded: dict[str, "Encoder"] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts start and end, that lie one after the other in ``raw`` and start at ``at`` (the last end, too).

    Words are parted by white space; a full stop or comma between neighbours that are no marks is a word of its own.
    """
    kind = _CLASS[raw]
    alone, plain = np.flatnonzero(kind == _ALONE), kind <= _WORD
    edge = np.zeros(len(raw) + 1, bool)
    edge[at], edge[-1] = True, True
    before, after = plain[np.maximum(alone - 1, 0)] | edge[alone], plain[np.minimum(alone + 1, len(raw) - 1)] | edge[alone + 1]
    alone = alone[before & after]
    space = kind == _SPACE
    edge[:-1] |= space
    edge[1:] |= space
    edge[alone] = edge[alone + 1] = True
    cuts = np.flatnonzero(edge)
    keep = ~space[cuts[:-1]]
    return cuts[:-1][keep], cuts[1:][keep]


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of 64 bits and not 0, first eight bytes) of words."""
    size = end - start
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", wide, strides=(1,))
    head = eight[start] & _MASK[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        h = _mixed(head + size.astype(np.uint64) * _GOLD)
        rest, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(rest):
            h[rest] = _mixed(h[rest] * _GOLD + (eight[start[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]))
            k += 8
            rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return np.maximum(h, np.uint64(1)), head


class Words:
    """The ids of at most ``most`` words: an open hash table in arrays of some 40 bytes a slot, two slots a word."""

    def __init__(self, most: int):
        self.most, self.count, self.used = most, 0, 0
        slots = 1 << max(10, int(2 * most - 1).bit_length())
        self.mask = np.int64(slots - 1)
        self.key, self.head = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.first, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)

    def find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for those that are not here."""
        slot = h.view(np.int64) & self.mask
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(left):
            at = slot[left]
            key = self.key[at]
            same = key == h[left]
            same[same] = self.head[at[same]] == head[left[same]]
            out[left[same]] = at[same]
            left = left[(key != 0) & ~same]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def holds(self, words: int, ids: int) -> bool:
        return self.count + words <= self.most and self.used + ids <= 8 * self.most

    def put(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct words that are not here."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size) - size
        slot, left = h.view(np.int64) & self.mask, np.arange(len(h))
        while len(left):
            at = slot[left]
            free = left[self.key[at] == 0]
            self.key[slot[free]] = h[free]
            self.head[slot[free]], self.first[slot[free]], self.size[slot[free]] = head[free], first[free], size[free]
            mine = np.zeros(len(h), bool)
            mine[free] = (self.key[slot[free]] == h[free]) & (self.first[slot[free]] == first[free])
            left = left[~mine[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.count, self.used = self.count + len(h), self.used + len(ids)


class Encoder:
    """Ids of texts as unsigned 32-bit integers.

    The vocabulary's tokenizer drops white space and case and merges within runs of letters only, so the ids of a text are
    those of its words, one after the other, and those of "Word." are those of "word" and of ".". The ids of words are kept
    in two generations of at most ``most`` words and eight times as many ids each: a full one becomes the old one before
    words are added, and words in use move back. Words are told apart by 64 bits of hash and their first eight bytes.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.now, self.old = Words(most), Words(0)
        self.marks: dict[str, np.ndarray] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many each, ids) of words of letters, encoded as one string; each ends with the only id of a word's end that it has."""
        sizes, out = [], []
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                each = [self.whole(w) for w in part]
                ends, ids = np.cumsum([len(x) for x in each]), np.concatenate(each)
            sizes.append(np.diff(ends, prepend=0))
            out.append(ids)
        return (np.concatenate(sizes), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many each, ids) of any words."""
        bases, tails = list(words), [None] * len(words)
        for i, w in enumerate(words):
            if not w.isalpha():
                bases[i] = w.rstrip(_MARKS)
                tails[i] = w[len(bases[i]) :] if bases[i].isalpha() else w
        plain = np.array([t is None or len(t) < len(w) for t, w in zip(tails, words, strict=True)], bool)
        some, flat = self.letters([b for b, p in zip(bases, plain.tolist(), strict=True) if p])
        if len(some) == len(words) and not any(tails):
            return some, flat
        at, parts, k = np.concatenate([[0], np.cumsum(some)]).tolist(), [], 0
        for tail, p in zip(tails, plain.tolist(), strict=True):
            x = flat[at[k] : at[k + 1]] if p else flat[:0]
            k += p
            if tail:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                more = self.marks.get(tail)
                if more is None:
                    more = self.whole(tail)
                    if p:  # marks alone are few
                        self.marks[tail] = more
                x = np.concatenate([x, more])
            parts.append(x)
        return np.array([len(x) for x in parts]), np.concatenate(parts)

    def known(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slots of words in ``now``, where all of them are put."""
        h, head = hashed(raw, start, end)
        slot = self.now.find(h, head)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, i = np.unique(h[miss], return_index=True)
            new = miss[i]
            was = self.old.find(h[new], head[new])
            back, new = new[was >= 0], new[was < 0]
            was = was[was >= 0]
            size, ids = self.encoded([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            n = self.old.size[was]
            moved = self.old.ids[np.repeat(self.old.first[was] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            if not self.now.holds(len(new) + len(back), len(ids) + len(moved)):
                every = np.unique(h, return_index=True)[1]  # the whole batch into a new generation
                seen = every[slot[every] >= 0]
                k = self.now.size[slot[seen]]
                kept = self.now.ids[np.repeat(self.now.first[slot[seen]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                self.old, self.now = self.now, Words(max(self.most, 2 * len(every), (len(kept) + len(moved) + len(ids)) // 4))
                self.now.put(h[seen], head[seen], k, kept)
            self.now.put(h[back], head[back], n, moved)
            self.now.put(h[new], head[new], size, ids)
            slot = self.now.find(h, head)
            if (slot < 0).any():  # another word of the batch has the same 64 bits
                return self.known(raw, start, end)
        return slot

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each start (and the last end). Nulls are empty.

        All that is done for each word is done in Arrow and numpy; Python sees each word that is not known once.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        low = pc.utf8_lower(pc.if_else(odd, "", texts))
        n = len(low)
        at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1] if n else np.zeros(1, np.int64)
        if at[-1] > at[0]:
            raw = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]]
            start, end = cut(raw, at - at[0])
            slot = self.known(raw, start, end)
            each, first = self.now.size[slot], self.now.first[slot]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each, dtype=np.int64)])
            flat = self.now.ids[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])]
            at = ends[np.searchsorted(start, at - at[0])]
        else:
            flat, at = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if pc.any(odd).as_py():
            have = [self.whole(t.as_py()) if o else flat[a:b] for t, o, a, b in zip(texts, odd.to_pylist(), at[:-1], at[1:], strict=True)]
            flat, at = np.concatenate(have), np.cumsum([0, *map(len, have)])
        return flat, at

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with END after each text."""
        flat, at = self.ids(texts)
        return np.insert(flat, at[1:], np.uint32(END)), at + np.arange(len(at))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        flat, at = self.ids(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``most`` bytes of text each, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most)))
        yield batch.slice(a, b - a)
        a = b


def encoder(path: str, most: int = CACHED_WORDS) -> Encoder:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, most)
    _loaded[path].most = most
    return _loaded[path]


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
