"""Token ids of whole texts, with each different word encoded once.

Byte-level BPE never forms a token across the place where white space follows other
text: its pre-tokens start with at most one space and are otherwise all white space or
none. So a text may be cut there, and the ids of the words joined. Words recur; a table of
their ids, bounded in entries, lives as long as the Python worker. Words of up to 16 bytes
are looked up by their bytes in arrays, a whole batch at a time; texts with other white
space, or several in a row, or special tokens, go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quarry.llm.common import eights, first_bytes, joined_bytes, mixed

VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker keeps; a full table goes on with the half used most.
KEPT = 1 << 19
SLOTS = 1 << 21
#: New words that go to the tokenizer as one string.
TOGETHER = 512

#: First bytes of white space other than space and line feed, and of what counts as such in some libraries.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_SPACE = re.compile(rb"[\t\v\f\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary_path(path: str | None = None) -> str:
    """The tokenizer's file; the installed public one if none is given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """The ids that ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives, special tokens in the text included."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        # of the tokens of a word, with the space or line feed before it, the first and no other starts with that byte
        self.first = np.zeros(self.size, bool)
        self.first[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t[0] in "ĠĊ"]] = True
        self.kept = kept
        #: Entries: 16 bytes of the word, its length and what stands before it, its ids' place in the pool, and how often it was met.
        self.head, self.tail = np.zeros(kept, np.uint64), np.zeros(kept, np.uint64)
        self.kind, self.start, self.length, self.uses = (np.zeros(kept, np.int32) for _ in range(4))
        self.pool, self.count = np.zeros(0, np.uint32), 0
        self.slot = np.full(SLOTS, -1, np.int32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, head: np.ndarray, tail: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(mixed(head + kind.astype(np.uint64)) + tail)
        return h, (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)

    def _entries(self, head: np.ndarray, tail: np.ndarray, kind: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Each word's entry, or -1."""
        found = self.slot[places[0]]
        same = (found >= 0) & (self.head[found] == head) & (self.tail[found] == tail) & (self.kind[found] == kind)
        found = np.where(same, found, -1)
        rest = np.flatnonzero(found < 0)
        second = self.slot[places[1][rest]]
        same = (second >= 0) & (self.head[second] == head[rest]) & (self.tail[second] == tail[rest]) & (self.kind[second] == kind[rest])
        found[rest] = np.where(same, second, -1)
        return found

    def _add(self, head: np.ndarray, tail: np.ndarray, kind: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keeps new words; where two fall on one place, one may get none and is encoded again when met."""
        if self.count + len(head) > self.kept:
            best = np.argsort(-self.uses[: self.count], kind="stable")[: self.kept // 2]
            take = _stretches(self.start[best].astype(np.int64), self.length[best])
            self.pool = self.pool[take]
            for name in ("head", "tail", "kind", "length", "uses"):
                column = getattr(self, name)
                column[: len(best)] = column[best]
            self.uses[: len(best)] >>= 1
            self.start[: len(best)] = np.cumsum(self.length[: len(best)]) - self.length[: len(best)]
            self.count = len(best)
            self.slot[:] = -1
            self._place(0)
        n = min(len(head), self.kept - self.count)
        a, b = self.count, self.count + n
        self.head[a:b], self.tail[a:b], self.kind[a:b], self.uses[a:b] = head[:n], tail[:n], kind[:n], 1
        self.length[a:b] = np.diff(np.r_[0, ends[:n]])
        self.start[a:b] = len(self.pool) + ends[:n] - self.length[a:b]
        self.pool = np.concatenate([self.pool, ids[: ends[n - 1] if n else 0]])
        self.count = b
        self._place(a)

    def _place(self, first: int) -> None:
        mine = np.arange(first, self.count, dtype=np.int32)
        _, *places = self._places(self.head[first : self.count], self.tail[first : self.count], self.kind[first : self.count])
        for place in places:
            at = place[mine - first]
            free = self.slot[at] < 0
            self.slot[at[free]] = mine[free]
            mine = mine[self.slot[at] != mine]

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and their ends. ``after`` is 0 for words at a text's start, else they go with the byte before."""
        begin = starts - (after > 0)
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), ends.tolist())]
        joined = np.flatnonzero(after > 0)
        out: list[list[np.ndarray]] = [[] for _ in range(-(-len(joined) // TOGETHER))]
        length = np.zeros(len(pieces), np.int64)
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for k, (g, ids) in enumerate(zip(groups, self.plain([b"".join([pieces[i] for i in g.tolist()]).decode() for g in groups]))):
            at = np.flatnonzero(self.first[ids])
            if len(at) == len(g) and at[0] == 0:
                out[k], length[g] = [ids], np.diff(np.r_[at, len(ids)])
            else:
                out[k] = self.plain([pieces[i].decode() for i in g.tolist()])
                length[g] = [len(x) for x in out[k]]
        alone = np.flatnonzero(after == 0)
        single = self.plain([pieces[i].decode() for i in alone.tolist()])
        length[alone] = [len(x) for x in single]
        # words after white space are first in the pool, then those at a text's start
        order = np.concatenate([joined, alone])
        flat = np.concatenate([*(x for each in out for x in each), *single, np.zeros(0, np.uint32)])
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return flat[_stretches(start, length)], np.cumsum(length)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), and their n+1 offsets. A null text has none."""
        data, at = joined_bytes(texts)
        raw = data.tobytes()
        full = np.flatnonzero(at[1:] > at[:-1])
        odd = np.zeros(len(texts), bool)  # texts that go to the tokenizer as they are
        space = (data == 32) | (data == 10)
        spaces = np.flatnonzero(space)

        def mark(places: np.ndarray) -> None:
            odd[np.searchsorted(at, places, side="right") - 1] = True

        again = spaces[1:][spaces[1:] == spaces[:-1] + 1]
        mark(again), mark(again - 1)
        odd[full[space[at[full + 1] - 1]]] = True
        if _ODD[data].any():
            mark(np.array([m.start() for m in _ODD_SPACE.finditer(raw)], np.int64))
        if self.special and (found := [m.start() for m in self.special.finditer(raw)]):
            mark(np.array(found))

        spaces = spaces[~odd[np.searchsorted(at, spaces, side="right") - 1]]
        starts = np.concatenate([at[full], spaces + 1])
        after = np.concatenate([np.zeros(len(full), np.int32), np.where(data[spaces] == 10, 2, 1).astype(np.int32)])
        order = np.argsort(starts, kind="stable")
        starts, after = starts[order], after[order]
        text = np.cumsum(after == 0) - 1  # among the full ones
        ends = at[full + 1][text] if len(full) else starts
        inner = np.flatnonzero(after[1:] > 0)
        ends[inner] = starts[inner + 1] - 1
        size = ends - starts
        whole = odd[full][text] if len(full) else np.zeros(0, bool)
        short = np.flatnonzero((size <= 16) & ~whole)

        at_each = eights(data)
        head, tail = first_bytes(at_each, starts[short], size[short]), first_bytes(at_each, starts[short] + 8, size[short] - 8)
        kind = (size[short] * 4 + after[short]).astype(np.int32)
        h, *places = self._places(head, tail, kind)
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = self._entries(head, tail, kind, places)
        known = entry[short] >= 0
        self.uses[: self.count] += np.bincount(entry[short][known], minlength=self.count).astype(np.int32)

        new = np.flatnonzero(~known)
        _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
        one = new[one]
        alike = (head[one[which]] == head[new]) & (tail[one[which]] == tail[new]) & (kind[one[which]] == kind[new])
        rest = np.concatenate([short[new[~alike]], np.flatnonzero((size > 16) & ~whole)])
        learn = np.concatenate([short[one], rest])
        ids, learned = self._learn(raw, starts[learn], ends[learn], after[learn])
        wholes = np.flatnonzero(whole)
        others = self.plain([raw[a:b].decode() for a, b in zip(starts[wholes].tolist(), ends[wholes].tolist())])

        # what is not in the table stands behind it for now
        base = self.count
        entry[short[new[alike]]] = base + which[alike]
        entry[rest] = base + len(one) + np.arange(len(rest))
        entry[wholes] = base + len(learn) + np.arange(len(wholes))
        pool = np.concatenate([self.pool, ids, *others])
        length = np.concatenate([self.length[:base], np.diff(np.r_[0, learned]), np.array([len(x) for x in others], np.int64)])
        start = np.cumsum(length) - length
        count = length[entry]
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:][full] = np.bincount(text, weights=count, minlength=len(full)).astype(np.int64)
        np.cumsum(offsets, out=offsets)
        out = pool[_stretches(start[entry], count)]
        self._add(head[one], tail[one], kind[one], ids, learned[: len(one)])
        return out, offsets


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the stretches of these starts and lengths, one after the other."""
    ends = np.cumsum(length, dtype=np.int64)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
