"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

Pre-tokens are the runs between white space, with a mark in front. The new ones of a slice form a trie, built level by
level from the pairs of parent and codepoint; the forward score of a node (best log-probability of a segmentation of
its path) and its number of pieces come from its ancestors, once for all pre-tokens that share the prefix. Terminal
counts are kept for later slices. Pieces are a vocabulary file's; a piece's log-probability follows from its rank by
Zipf's law, -log(rank + 10); a codepoint that is no piece counts as its UTF-8 bytes, each ``UNKNOWN``.

The trie goes to any depth: where few pre-tokens reach a level, the rest of each is a chain without branches below its
node, whose scores go on by the same recurrence from those of the node and its ancestors.

Edge cases: null and empty texts have no tokens; pre-tokens of any length follow the one method; of equally good
segmentations that with the longer last piece counts; repeated rows count alike; other columns pass through, and columns
named like the outputs are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Places
from .common import powers, append, arrow_map, mix, plus, slices, word_spans

MARK, UNKNOWN = 0x2581, -25.0
#: Levels of the trie that fewer pre-tokens reach are followed chain by chain.
NARROW = 12
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


class Unigram:
    CACHE = 150_000

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and p:
                self.pieces.setdefault(p, -float(np.log(i + 10)))
        self.longest = max(map(len, self.pieces), default=0)
        self.places = Places(len(self.pieces))
        self.places.add(np.array([_hash(p) for p in self.pieces], np.uint64))
        self.score = np.append(list(self.pieces.values()), -np.inf)
        self.clear()

    def clear(self) -> None:
        self.known, self.count = Places(2 * self.CACHE), np.empty(0, np.int64)

    def trie(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first, out, most = np.cumsum(size) - size, np.zeros(len(words), np.int64), self.longest
        node, live = np.zeros(len(words), np.int64), np.flatnonzero(size > 0)
        # For the last levels, the nearest first: parent of each node, hash of its path, best score and pieces.
        levels = deque([(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))], maxlen=most + 1)
        power = [np.uint64(pow(int(_B), k, 1 << 64)) for k in range(most + 1)]
        d = 0
        while len(live) > NARROW or (d == 0 and len(live)):
            d += 1
            parents, hashes, bests, counts = levels[0]
            step = node[live] << 21 | flat[first[live] + d - 1].astype(np.int64)
            nodes, node[live] = np.unique(step, return_inverse=True)
            parent, cp = nodes >> 21, (nodes & 0x1FFFFF)
            path = hashes[parent] * _B + (cp + 1).astype(np.uint64)
            bytes_ = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
            best, count = bests[parent] + UNKNOWN * bytes_, counts[parent] + bytes_
            up, tries = parent, []
            for back in range(1, min(d, most) + 1):
                if back > 1:
                    up = levels[back - 2][0][up]
                key = mix(path - levels[back - 1][1][up] * power[back] + np.uint64(back))
                tries.append((back, up, self.score[self.places.find(key)]))
            for back, up, s in reversed(tries):
                value = levels[back - 1][2][up] + s
                better = value > best
                best[better], count[better] = value[better], levels[back - 1][3][up][better] + 1
            levels.appendleft((parent, path, best, count))
            ended = live[size[live] == d]
            out[ended] = count[node[ended]]
            live = live[size[live] > d]
        for w in live.tolist():
            out[w] = self._chain(words[w], d, levels, int(node[w]))
        return out

    def _chain(self, word: str, d: int, levels: deque, at: int) -> int:
        """The pieces of a pre-token below its node ``at`` of level ``d``, from the scores of the node's ancestors."""
        best: deque[tuple[float, int]] = deque(maxlen=self.longest + 1)
        for k in range(min(d + 1, len(levels))):
            best.append((float(levels[k][2][at]), int(levels[k][3][at])))
            at = int(levels[k][0][at])
        for j in range(d + 1, len(word) + 1):
            size = len(word[j - 1].encode())
            here = (best[0][0] + UNKNOWN * size, best[0][1] + size)
            for back in range(min(j, self.longest), 0, -1):
                s = self.pieces.get(word[j - back : j])
                if s is not None and best[back - 1][0] + s > here[0]:
                    here = (best[back - 1][0] + s, best[back - 1][1] + 1)
            best.appendleft(here)
        return best[0][1]

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each row."""
        if self.known.n > self.CACHE:
            self.clear()
        starts, ends, rows = word_spans(data, offs)
        if not len(starts):
            return np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
        up, down = powers(len(data) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        keys = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        found = self.known.find(keys)
        if (miss := np.flatnonzero(found < 0)).size:
            new, one = np.unique(keys[miss], return_index=True)
            raw = data.tobytes()
            words = [chr(MARK) + raw[a:b].decode() for a, b in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist())]
            n = self.trie(words)
            self.known.add(new)
            self.count = np.concatenate([self.count, n])
            found[miss] = self.known.find(keys[miss])
        tokens = np.concatenate([[0], np.cumsum(self.count[found])])
        return np.diff(rows), tokens[rows[1:]] - tokens[rows[:-1]]


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_B) + ord(c) + 1) % (1 << 64)
    return int(mix(np.array([(h + len(piece)) % (1 << 64)], np.uint64))[0])


_MODELS: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    return _MODELS[path]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``n_pretokens`` and ``n_tokens`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words, tokens = m.counts(data, offs)
                yield append(part, {"n_pretokens": pa.array(words), "n_tokens": pa.array(tokens)})

    return arrow_map(df, run, plus(df.schema, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())))
