"""Corpus-level merge replay for byte-pair encodings.

A block of a partition's texts is a corpus: its distinct words are laid out as one
array of symbols, an inverted index holds for every mergeable pair the positions at
which it stands, and the merges are replayed once over the whole block in rank order.
A merge touches only the positions in its index entry and their two neighbours, whose
new pairs go into the index. Words are merged independently of each other, so where a
corpus is cut into blocks doesn't change any result.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max


def grouped(own: np.ndarray, other: np.ndarray, ranks: np.ndarray, size: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Pairs by one of their symbols: where each symbol's pairs begin, then the other symbols, ascending, and the ranks."""
    order = np.lexsort((other, own))
    return np.searchsorted(own[order], np.arange(size)).tolist(), other[order], ranks[order]


def beside(groups: tuple[list[int], np.ndarray, np.ndarray], symbol: int, others: np.ndarray) -> np.ndarray | None:
    """Ranks of a symbol's pairs with each of ``others``, NONE where they don't merge; no array at all for a symbol without pairs."""
    starts, known, ranks = groups
    s, e = starts[symbol], starts[symbol + 1]
    if s == e:
        return None
    at = np.minimum(known[s:e].searchsorted(others), e - s - 1)
    return np.where(known[s:e][at] == others, ranks[s:e][at], NONE)


class MergeTable:
    """Pairs of symbols with the rank of their merge; ``made[rank]`` is the merged symbol."""

    def __init__(self, pairs: dict[tuple[int, int], int], made: dict[int, int]):
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(ranks[order], NONE)
        self.made = np.full(max(made, default=0) + 1, -1, np.int32)
        for rank, symbol in made.items():
            self.made[rank] = symbol
        self.pairs = pairs
        a, b = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
        size = int(max(a.max(initial=0), b.max(initial=0), self.made.max(initial=0))) + 2
        self.after, self.before = grouped(a, b, ranks, size), grouped(b, a, ranks, size)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> MergeTable:
        """Rank files: two tokens merge when their joined bytes are a token, whose id is the rank."""
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        return cls(pairs, {rank: rank for rank in ranks.values()})

    @classmethod
    def from_merges(cls, vocab: dict[str, int], merges: list[tuple[str, str]]) -> MergeTable:
        """Merge lists: the place in the list is the rank."""
        pairs, made = {}, {}
        for rank, (a, b) in enumerate(merges):
            pairs[vocab[a], vocab[b]] = rank
            made[rank] = vocab[a + b]
        return cls(pairs, made)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge (a symbol below 0 never does)."""
        want = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.searchsorted(self.keys, want)
        at[at >= len(self.keys)] = len(self.keys) - 1
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], NONE).astype(np.int32)

    def one_word(self, symbols: list[int]) -> list[int]:
        """The lowest rank first, leftmost first, for a single word."""
        symbols = list(symbols)
        while True:
            found = [(self.pairs[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.pairs]
            if not found:
                return symbols
            rank, i = min(found)
            symbols[i : i + 2] = [int(self.made[rank])]

    def replay(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words at once.

        symbols: int32, the words' symbols one after another; lengths: symbols of each
        word (0 allowed). Returns the merged symbols and their number for each word.
        """
        n, words = len(symbols), len(lengths)
        if not n:
            return symbols.astype(np.int32), np.zeros(words, np.int64)
        word = np.repeat(np.arange(words, dtype=np.int32), lengths)
        # one more slot at the end, which index -1 also reaches, stands for "no neighbour"
        sym = np.append(symbols.astype(np.int32), np.int32(-1))
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        last = np.append(word[1:] != word[:-1], True)
        nxt[:n][last] = n
        prv[1:n][word[1:] != word[:-1]] = -1
        cur = np.full(n + 1, NONE, np.int32)  # rank of the pair that starts at a position
        cur[:n] = self.rank(sym[:n], sym[nxt[:n]])
        dead = np.zeros(n + 1, bool)
        mark = np.zeros(n + 1, bool)
        again = np.zeros(words, bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for s, e, rank in zip(starts, [*starts[1:], len(at)], ranks[starts].tolist()):
                if (held := index.get(rank)) is None:
                    index[rank] = [at[s:e]]
                    heapq.heappush(heap, rank)
                else:
                    held.append(at[s:e])

        first = np.flatnonzero(cur < NONE).astype(np.int32)
        if len(first):
            put(first, cur[first])
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[cur[p] == rank]
            if not len(p):
                continue
            q = nxt[p]
            if len(p) > 1:
                mark[p] = True
                if mark[q].any():  # runs such as "aaaa": leftmost first, a used symbol is gone
                    mark[p] = False
                    keep, used = [], -1
                    for i in np.sort(p).tolist():
                        if i != used:
                            keep.append(i)
                            used = int(nxt[i])
                    p = np.array(keep, np.int32)
                    q = nxt[p]
                else:
                    mark[p] = False
            made = self.made[rank]
            sym[p] = made
            dead[q] = True
            cur[q] = NONE
            r = nxt[q]
            nxt[p] = r
            prv[r] = p
            left = prv[p]
            cur[p] = cur[left] = NONE
            found = []
            if (ranks := beside(self.after, int(made), sym[r])) is not None:
                cur[p] = ranks
                found.append(p[ranks < NONE])
            if (ranks := beside(self.before, int(made), sym[left])) is not None:
                cur[left] = ranks
                found.append(left[ranks < NONE])
            cur[n] = NONE
            at = np.concatenate(found) if found else p[:0]
            if len(at):
                ranks = cur[at]
                if (low := ranks < rank).any():  # a new pair comes before this merge: the word's own order decides
                    again[word[at[low]]] = True
                ok = ranks < NONE
                put(at[ok], ranks[ok])
        alive = ~dead[:n]
        out, counts = sym[:n][alive], np.bincount(word[alive], minlength=words)
        if again.any():
            ends, starts = np.cumsum(lengths), np.cumsum(counts) - counts
            parts = np.split(out, starts[1:])
            for w in np.flatnonzero(again).tolist():
                parts[w] = np.array(self.one_word(symbols[ends[w] - lengths[w] : ends[w]].tolist()), np.int32)
                counts[w] = len(parts[w])
            out = np.concatenate(parts)
        return out, counts


def replay_bytes(table: MergeTable, words: list[bytes], first: np.ndarray, final: np.ndarray | None = None) -> list[bytes]:
    """The words' ids as little-endian unsigned 32-bit integers.

    first: symbol of each byte; final: symbol of a word's last byte, where it differs.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = first[raw]
    if final is not None and len(raw):
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = final[raw[ends]]
    ids, counts = table.replay(symbols, lengths)
    packed, at, out = ids.astype("<u4").tobytes(), 0, []
    for n in (counts * 4).tolist():
        out.append(packed[at : at + n])
        at += n
    return out
