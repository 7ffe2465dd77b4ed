"""Byte-pair merges of many plain words at once, in numpy.

A plain word is made of a to z, letters of U+00C0 to U+00FF, ASCII digits and
ASCII punctuation but ``'`` and ``<``.  It falls into pieces: runs of letters,
runs of punctuation, single digits.  All pieces of a block are merged in step: in
each round every piece that still has a known pair merges its pair of lowest rank
(the leftmost of equals), as the library does one word at a time.  Ranks are
looked up again only beside a merge.

What the tokenizer file lets a caller rely on is proven by enumeration against
the library (``prove``), never assumed.
"""

from __future__ import annotations

import json

import numpy as np

from lexmill.llm.token_counts import byte_chars

_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int32).max
_SHIFT = 32
#: pieces merged in step
BLOCK_WORDS = 16_384
#: longer words go to the library, whose time does not grow with their square
MOST_BYTES = 96
_LETTER, _DIGIT, _PUNCT, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[97:123], _KIND[48:58] = _LETTER, _DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = _PUNCT


class Merger:
    """Merges of one tokenizer file whose words end in ``end_of_word_suffix``."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("not a byte-pair vocabulary with word ends")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = np.array([(vocab[a] << _SHIFT) + vocab[b] for a, b in pairs], dtype=np.int64)
        self.bits = max(10, int(np.ceil(np.log2(8 * max(1, len(key))))))
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.key[slot[placed]], self.rank[slot[placed]] = key[placed], placed
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
        shown = {b: c for c, b in byte_chars().items()}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where the file has no such merge."""
        key = (a << _SHIFT) + b
        slot = self._slot(key)
        got = self.key[slot]
        out = np.where(got == key, self.rank[slot], _NONE)
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            got = self.key[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def merge(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each) of pieces in a buffer of bytes."""
        length, counts = end - start, np.zeros(len(start), dtype=np.int64)
        order, parts = np.argsort(length, kind="stable"), []
        for a in range(0, len(order), BLOCK_WORDS):
            at = order[a : a + BLOCK_WORDS]
            flat, counts[at] = self._block(low, start[at], length[at])
            parts.append((at, flat))
        first = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), dtype=np.uint32)
        for at, flat in parts:
            n = counts[at]
            ids[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
        return ids, counts

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are plain, ids of those in order, number of ids of each of those)."""
        data, start, end = buffer(words)
        low, kind = pieces_of(data)
        odd = np.concatenate(([0], np.cumsum(kind == _OTHER)))
        plain = (odd[end] == odd[start]) & (end - start <= MOST_BYTES)
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[start[start < len(data)]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(data))
        word = np.searchsorted(start, first, side="right") - 1
        own = plain[word]
        ids, n = self.merge(low, first[own], last[own])
        return plain, ids, np.bincount(word[own], weights=n, minlength=len(words)).astype(np.int64)[plain]

    def _block(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, width = len(start), int(length.max())
        col = np.arange(width + 1)
        inside = col[None, :] < length[:, None]
        symbol = np.where(inside, self.inner[data[np.minimum(start[:, None] + col, len(data) - 1)]], -1)
        row = np.arange(words)
        symbol[row, length - 1] = self.last[data[start + length - 1]]
        # neighbours by column; column ``width`` stands for none
        after = np.where(col[None, :] + 1 < length[:, None], col[None, :] + 1, width)
        before = np.repeat(np.where(col > 0, col - 1, width)[None, :], words, axis=0)
        symbol[:, width] = -1
        rank = np.full((words, width + 1), _NONE, dtype=np.int32)
        r, c = np.nonzero(after < width)
        rank[r, c] = self.ranks(symbol[r, c], symbol[r, c + 1])
        live = row
        while len(live):
            k = rank[live].argmin(axis=1)
            best = rank[live, k]
            live, k, best = live[best < _NONE], k[best < _NONE], best[best < _NONE]
            if not len(live):
                break
            made, gone = self.made[best], after[live, k]
            then, prior = after[live, gone], before[live, k]
            symbol[live, k], symbol[live, gone] = made, -1
            after[live, k] = then
            before[live, then] = k
            rank[live, gone] = _NONE
            right, left = symbol[live, then], symbol[live, prior]
            rank[live, k] = np.where(then < width, self.ranks(made, right), _NONE)
            rank[live, prior] = np.where(prior < width, self.ranks(left, made), _NONE)
        kept = symbol[:, :width] >= 0
        return symbol[:, :width][kept], kept.sum(axis=1)


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the kind of each."""
    kind, low = _KIND[data], data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    # U+00D7 and U+00F7 are signs, not letters
    second = second[(data[second] >= 0x80) & (data[second] < 0xC0) & (data[second] != 0x97) & (data[second] != 0xB7)]
    kind[second] = kind[second - 1] = _LETTER
    low[second[data[second] < 0x9F]] += 32
    return low, kind


def buffer(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length)
    return np.frombuffer(b"".join(words), dtype=np.uint8), end - length, end


def prove(spec: str, tok) -> dict:
    """What holds for this file: ``space`` (white space parts words and leaves nothing), ``lower`` (ASCII case makes no difference), ``plain`` (``Merger`` equals the library)."""
    conf = json.loads(spec)
    added = [t["content"] for t in conf["added_tokens"]]

    def ids(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and not chr(c).encode().isspace()]
    runs, whole, upper = [f"a{c}" for c in chars], ids([f"a{c} \n{c}B\t{c}" for c in chars]), ids([f"A{c}Z" for c in chars])
    one, two, three = ids(runs), ids([f"{c}b" for c in chars]), ids(chars)
    capital = ids([f"{c}B" for c in chars])
    space = not any(any(x.isspace() for x in a) for a in added) and all(w == [*p, *q, *r] for w, p, q, r in zip(whole, one, capital, three, strict=True))
    edges = all(x == y for x, y in zip(ids([f" \r{c}\x0b\x0c " for c in "ab.,19é"]), ids(list("ab.,19é")), strict=True))
    lower = two == capital and upper == ids([f"a{c}z" for c in chars])
    try:
        merger = Merger(spec)
    except (KeyError, ValueError):
        return {"space": space and edges, "lower": lower, "plain": False, "added": added}
    suffix, back, known = conf["model"]["end_of_word_suffix"], byte_chars(), []
    for entry in sorted(conf["model"]["vocab"]):
        try:
            known.append(bytes(back[c] for c in entry.removesuffix(suffix)).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    known = [w for w, ok in zip(known, merger.words([w.encode() for w in known])[0], strict=True) if w and ok]
    between = [chr(c) for c in range(33, 256) if chr(c).encode() and merger.words([chr(c).encode()])[0][0]]
    probes = known + [a + b for a, b in zip(known, reversed(known), strict=True)] + [a + b + c for a, b, c in zip(known[::2], known[1::2], known[5::2], strict=False)]
    probes += [f"{a}{c}{b}{c}{c}" for c in between for a, b in (("a", "b"), ("re", "s"), ("1", "9"), (".", "-"), ("é", "ß"))]
    ok, got, n = merger.words([w.encode() for w in probes])
    want = ids([w for w, o in zip(probes, ok, strict=True) if o])
    same = len(want) > 1000 and n.tolist() == list(map(len, want)) and got.tolist() == [i for x in want for i in x]
    return {"space": space and edges, "lower": lower, "plain": same, "added": added}
