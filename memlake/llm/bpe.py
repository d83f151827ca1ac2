"""Byte-pair encoding on NumPy arrays, from a public ``tokenizer.json`` file.

A word is a row of *base symbols* (one for each byte; where the vocabulary marks
word ends, the last byte has a symbol of its own).  Every other token is made by
exactly one merge.  Three facts carry the whole module:

* two tokens may stand side by side exactly if, undoing their latest merges one
  after the other, no merge across the seam would have come earlier
  (:meth:`BpeTables.compatible`);
* a row of tokens is the encoding of a word exactly if all its neighbours are
  compatible, so a guess can be verified without running the merges;
* each prefix of a word has one last token, the one that is compatible with the
  last token of what stands before it (:meth:`BpeTables.prefix_counts`).
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from itertools import chain, count

import numpy as np
import regex

#: Words of more symbols than this are encoded one at a time, in O(n log n).
LONG_WORD = 96
_NONE = np.int32(2**31 - 1)
#: Text whose letters and white space every Unicode version classifies alike.
_LATIN = regex.compile("[\x00-\x1b\x20-\u024f]*")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s+n]`` for every start and length."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class IntMap:
    """A frozen map of non-negative int64 keys to int32 values, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._hash(keys)
        while todo.size:
            free = np.flatnonzero(self._keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self._keys[taken], self._values[taken] = keys[todo[won]], values[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self._mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self._hash(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while todo.size:
            slot_t = (slot[todo] + 1) & self._mask
            slot[todo] = slot_t
            found, want = self._keys[slot_t], keys[todo]
            hit = found == want
            out[todo[hit]] = self._values[slot_t[hit]]
            todo = todo[~hit & (found != -1)]
        return out


class _Trie:
    """Symbol rows to tokens; ``reverse`` reads the rows from their end."""

    def __init__(self, rows: list[tuple[int, ...]], ids: list[int], reverse: bool):
        edges: dict[int, int] = {}
        token = [-1]
        for row, token_id in zip(rows, ids, strict=True):
            node = 0
            for s in reversed(row) if reverse else row:
                key = node << 17 | s
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = token_id
        self.edges = IntMap(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.token = np.array(token, np.int32)
        self._dict = edges

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.edges.get(nodes.astype(np.int64) << 17 | symbols)

    def child(self, node: int, symbol: int) -> int:
        return self._dict.get(node << 17 | symbol, -1)


class BpeTables:
    """Merges, token spellings and seam checks of one byte-level BPE vocabulary."""

    def __init__(self, tokenizer_json: str):
        with open(tokenizer_json, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.size = max(vocab.values()) + 1

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        #: Rank of the merge that makes a token; -1 for base symbols.
        self.rank = np.full(self.size, -1, np.int32)
        self.rank[made] = np.arange(len(pairs), dtype=np.int32)
        self.left, self.right = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        self.left[made], self.right[made] = left, right
        self.made = made
        self.pair = IntMap(left.astype(np.int64) << 20 | right, np.arange(len(pairs), dtype=np.int32))
        self._pair = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}

        spelled: dict[int, tuple[int, ...]] = {int(i): (int(i),) for i in np.concatenate([self.inner, self.final])}
        for a, b, c in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            spelled[c] = spelled[a] + spelled[b]
        ids = sorted(spelled)
        rows = [spelled[i] for i in ids]
        sure = self._own_encoding(ids, rows)
        ids, rows = [i for i in ids if i in sure], [spelled[i] for i in ids if i in sure]
        self.forward, self.backward = _Trie(rows, ids, False), _Trie(rows, ids, True)

    def _own_encoding(self, ids: list[int], rows: list[tuple[int, ...]]) -> set[int]:
        """Tokens that the merges give for their own spelling; no other can occur."""
        lengths = np.array([len(r) for r in rows])
        flat = np.array([s for r in rows for s in r], np.int32)
        out, counts = self.merge(flat, lengths)
        alone = counts == 1
        first = out[np.cumsum(counts) - counts]
        return {i for i, one, f in zip(ids, alone, first, strict=True) if one and f == i}

    # -- words ---------------------------------------------------------------------

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Base symbols of words (ordinary text) and the words' numbers of symbols."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        chars = np.fromiter(map(len, words), np.int64, len(words))
        heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = heads[np.cumsum(chars)] if len(words) else chars
        lengths = np.diff(np.concatenate([[0], ends]))
        flat = self.inner[raw]
        last = ends[lengths > 0] - 1
        flat[last] = self.final[raw[last]]
        return flat, lengths

    # -- seams ---------------------------------------------------------------------

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the encoding of a word can hold these two tokens side by side."""
        ok = np.ones(len(first), bool)
        at, a, b = np.arange(len(first)), first.astype(np.int32), second.astype(np.int32)
        limit = np.full(len(first), _NONE, np.int32)
        while at.size:
            rank = self.pair.get(a.astype(np.int64) << 20 | b)
            bad = (rank >= 0) & (rank < limit)
            ok[at[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, rank_a, rank_b = at[go], a[go], b[go], rank_a[go], rank_b[go]
            undo_a = rank_a > rank_b
            limit = np.where(undo_a, rank_a, rank_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _fits(self, a: int, b: int) -> bool:
        limit, rank = int(_NONE), self.rank
        while True:
            across = self._pair.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = int(rank[a]), int(self.right[a])
            else:
                limit, b = int(rank[b]) + 1, int(self.left[b])

    # -- exact merging -------------------------------------------------------------

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoding by the merges themselves: lowest rank first, leftmost of equals."""
        starts = np.cumsum(lengths) - lengths
        counts = lengths.astype(np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            if n > LONG_WORD:
                for w in which:
                    out = self._merge_long(flat[starts[w] : starts[w] + n].tolist())
                    rows.append((np.array([w]), np.array([out], np.int32)))
                continue
            table = flat[starts[which][:, None] + np.arange(n)]
            while n > 1 and which.size:
                ranks = self.pair.get((table[:, :-1].astype(np.int64) << 20 | table[:, 1:]).ravel()).reshape(len(table), -1)
                ranks = np.where(ranks < 0, _NONE, ranks)
                j = ranks.argmin(axis=1)
                best = ranks[np.arange(len(j)), j]
                done = best == _NONE
                if done.any():
                    rows.append((which[done], table[done]))
                    which, table, j, best = which[~done], table[~done], j[~done], best[~done]
                table[np.arange(len(j)), j] = self.made[best]
                keep = np.arange(n - 1)
                table = np.take_along_axis(table, keep + (keep > j[:, None]), axis=1)
                n -= 1
            if which.size and n:
                rows.append((which, table))
        for which, table in rows:
            counts[which] = table.shape[1]
        out = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        for which, table in rows:
            out[starts[which][:, None] + np.arange(table.shape[1])] = table
        return out, counts

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pair, made = len(ids), self._pair, self.made
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(made[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := pair.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [t for t, x in zip(ids, alive, strict=True) if x]

    # -- speculate and verify ------------------------------------------------------

    def greedy(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token first, from the left: the words' tokens and their numbers."""
        ends = np.cumsum(lengths)
        at, end, word = (ends - lengths).copy(), ends, np.arange(len(lengths))
        live = lengths > 0
        at, end, word = at[live], end[live], word[live]
        counts = np.zeros(len(lengths), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while word.size:
            token, size = np.full(len(at), -1, np.int32), np.zeros(len(at), np.int64)
            walk, node, depth = np.arange(len(at)), np.zeros(len(at), np.int32), 0
            while walk.size:
                node = self.forward.step(node, flat[at[walk] + depth])
                alive = node >= 0
                walk, node, depth = walk[alive], node[alive], depth + 1
                here = self.forward.token[node]
                hit = here >= 0
                token[walk[hit]], size[walk[hit]] = here[hit], depth
                more = at[walk] + depth < end[walk]
                walk, node = walk[more], node[more]
            found.append((word, token))
            counts[word] += 1
            at = at + size
            go = at < end
            at, end, word = at[go], end[go], word[go]
        out = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        for k, (word, token) in enumerate(found):
            out[starts[word] + k] = token
        return out, counts

    def encode(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Speculate and verify; also the number of words that needed exact merging.

        The greedy guess of a word stands if all its neighbouring tokens are
        compatible; the other words go through :meth:`merge`.
        """
        guess, counts = self.greedy(flat, lengths)
        word = np.repeat(np.arange(len(counts)), counts)
        seam = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.empty(0, np.int64)
        wrong = np.zeros(len(counts), bool)
        wrong[word[seam[~self.compatible(guess[seam], guess[seam + 1])]]] = True
        if not wrong.any():
            return guess, counts, 0
        starts = np.cumsum(lengths) - lengths
        redo = np.flatnonzero(wrong)
        fixed, fixed_counts = self.merge(ragged_take(flat, starts[redo], lengths[redo]), lengths[redo])
        pool = np.concatenate([guess, fixed])
        begin = np.cumsum(counts) - counts
        begin[redo] = len(guess) + np.cumsum(fixed_counts) - fixed_counts
        counts = counts.copy()
        counts[redo] = fixed_counts
        return ragged_take(pool, begin, counts), counts, len(redo)

    # -- prefixes ------------------------------------------------------------------

    def prefix_counts(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact number of tokens of every prefix of every word, in the order of ``flat``.

        Only for vocabularies without word-end symbols (there a prefix is spelled
        as the word is).  Dynamic programming over the ends of prefixes: the last
        token of a prefix is the one token ending there that is compatible with the
        last token of the prefix before it.
        """
        last, count = np.full(len(flat), -1, np.int32), np.zeros(len(flat), np.int32)
        starts = np.cumsum(lengths) - lengths
        for w in np.flatnonzero(lengths > LONG_WORD):
            self._prefix_long(flat, int(starts[w]), int(lengths[w]), last, count)
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] <= LONG_WORD) & (lengths[order] > 0)]
        starts, lengths = starts[order], lengths[order]
        for i in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -i, side="left"))
            begin = starts[:live]
            end = begin + i
            walk, node = np.arange(live), np.zeros(live, np.int32)
            levels = []
            for depth in range(i + 1):
                node = self.backward.step(node, flat[end[walk] - depth])
                alive = node >= 0
                walk, node = walk[alive], node[alive]
                if not walk.size:
                    break
                here = self.backward.token[node]
                hit = here >= 0
                levels.append((depth, walk[hit], here[hit]))
            open_ = np.ones(live, bool)
            for depth, who, token in reversed(levels):
                todo = open_[who]
                who, token = who[todo], token[todo]
                if depth == i:
                    good = np.ones(len(who), bool)
                else:
                    good = self.compatible(last[end[who] - depth - 1], token)
                who, token = who[good], token[good]
                last[end[who]] = token
                count[end[who]] = 1 if depth == i else count[end[who] - depth - 1] + 1
                open_[who] = False
        return count

    def _prefix_long(self, flat: np.ndarray, start: int, length: int, last: np.ndarray, count: np.ndarray) -> None:
        row, back = flat[start : start + length].tolist(), self.backward
        lasts, counts = [0] * length, [0] * length
        for i in range(length):
            node, options = 0, []
            for k in range(i, -1, -1):
                node = back.child(node, row[k])
                if node < 0:
                    break
                if back.token[node] >= 0:
                    options.append((k, int(back.token[node])))
            for k, token in reversed(options):
                if k == 0 or self._fits(lasts[k - 1], token):
                    lasts[i], counts[i] = token, 1 + (counts[k - 1] if k else 0)
                    break
        last[start : start + length], count[start : start + length] = lasts, counts


class Words:
    """Distinct words of distinct pieces of text, cut as a vocabulary file says."""

    def __init__(self, pattern: str, library_tokenizer, lower: bool, specials: tuple[str, ...]):
        self._pattern, self._tok, self._lower, self._specials = regex.compile(pattern), library_tokenizer, lower, frozenset(specials)
        self._byte = {c: b for b, c in enumerate(byte_alphabet())}

    def cut(self, piece: str) -> list[str]:
        """Words of one piece; beyond Latin letters the library normalises and cuts."""
        if _LATIN.fullmatch(piece):
            return self._pattern.findall(piece.lower() if self._lower else piece)
        if self._tok.normalizer is not None:
            piece = self._tok.normalizer.normalize_str(piece)
        return [bytes(map(self._byte.__getitem__, w)).decode() for w, _ in self._tok.pre_tokenizer.pre_tokenize_str(piece)]

    def of(self, distinct: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words, the code of each word of each piece, the pieces' numbers of words."""
        whole = "".join(distinct)
        if _LATIN.fullmatch(whole):
            found = list(map(self._pattern.findall, map(str.lower, distinct) if self._lower else distinct))
        else:
            found = list(map(self.cut, distinct))
        if "<|" in whole:
            found = [[] if x in self._specials else f for x, f in zip(distinct, found, strict=True)]
        known: defaultdict[str, int] = defaultdict(count().__next__)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        return list(known), codes, counts


_TABLES: dict[str, BpeTables] = {}


def tables(tokenizer_json: str) -> BpeTables:
    """The tables of a vocabulary file, built once in each Python worker."""
    if tokenizer_json not in _TABLES:
        _TABLES[tokenizer_json] = BpeTables(tokenizer_json)
    return _TABLES[tokenizer_json]
