"""Byte-level BPE encoding and decoding.

Pre-tokenisation without a regex: every codepoint gets a class from a table, a little local context (what follows a
blank, whether an apostrophe opens a contraction) refines it, and each class is a function from automaton state to
automaton state. Functions compose associatively, so the state before every codepoint comes from a blocked prefix scan
over small ids of functions, and boundaries are a table look-up. Distinct slices are merged once per worker and cached.

Edge cases: null and empty texts give no ids and decode to no bytes; texts of any length are handled in slices of rows;
duplicate rows are encoded alike; other columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, append, arrow_map, binary_array, list_array, mix, plus, powers, slices

# Classes of codepoints, refined by what follows.
LETTER, NUMBER, OTHER, CONTRACT1, CONTRACT2, BLANK_MID, SPACE_LAST, BLANK_LAST, END = range(9)
# States: inside a run of letters, numbers, others or blanks; after a joining space; one or two letters of a contraction to come; fresh.
IN_L, IN_N, IN_O, IN_B, JOIN, LEFT1, LEFT2, FRESH = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a boundary lies before this codepoint", by state and class."""
    step, cut = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for state in range(8):
        for kind, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            step[state, kind], cut[state, kind] = run, state not in (run, JOIN)
        for kind, left in ((CONTRACT1, LEFT1), (CONTRACT2, LEFT2)):
            joined = state in (IN_O, JOIN)
            step[state, kind], cut[state, kind] = IN_O if joined else left, not joined
        step[state, BLANK_MID], cut[state, BLANK_MID] = IN_B, state != IN_B
        step[state, SPACE_LAST], step[state, BLANK_LAST], step[state, END] = JOIN, FRESH, FRESH
    for state, then in ((LEFT1, FRESH), (LEFT2, LEFT1)):
        step[state, LETTER], cut[state, LETTER] = then, False
    return step, cut


def _monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: the id of each class, the product table, and the functions."""
    ids, todo = {tuple(range(8)): 0}, [tuple(range(8))]
    gens = [tuple(int(x) for x in step[:, c]) for c in range(9)]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    funcs = np.array(list(ids), np.uint8)
    product = np.array([[ids[tuple(int(b[x]) for x in a)] for b in funcs] for a in funcs])
    small = np.uint8 if len(ids) <= 256 else np.uint16
    return np.array([ids[g] for g in gens], small), product.astype(small), funcs


STEP, CUT = _automaton()
GENERATOR, PRODUCT, FUNCTIONS = _monoid(STEP)
#: No merge.
NONE = np.int32(2**31 - 1)


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """LETTER, NUMBER, OTHER or BLANK_MID of all codepoints, as starts of runs and their classes, with the Unicode version
    of the tokenizer library: each class alone is asked which codepoints it holds. Found once, on the driver."""
    if not _RUNS:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one_byte = {bytes([i]): i for i in range(256)}
        kinds = np.full(0x110000, OTHER, np.uint8)
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK_MID)):
            held = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=one_byte, special_tokens={}).encode_ordinary(every)).decode()
            kinds[np.frombuffer(held.encode("utf-32-le"), np.uint32)] = kind
        starts = np.flatnonzero(np.diff(kinds, prepend=255))
        _RUNS.append((starts, kinds[starts]))
    return _RUNS[0]


_RUNS: list[tuple[np.ndarray, np.ndarray]] = []


def refine(classes: np.ndarray, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the codepoints of several texts joined by one filler each; ``ends`` are the fillers' places."""
    kinds = classes[points]
    kinds[ends] = END
    after = np.append(kinds[1:], END)
    last = (kinds == BLANK_MID) & (after != BLANK_MID) & (after != END)
    out = kinds.copy()
    out[last] = np.where(points[last] == 32, SPACE_LAST, BLANK_LAST)
    at = np.flatnonzero(points == 39)
    p1, p2 = (points[np.minimum(at + d, len(points) - 1)] for d in (1, 2))
    out[at[np.isin(p1, [ord(x) for x in "stmd"])]] = CONTRACT1
    for a, b in ("re", "ve", "ll"):
        out[at[(p1 == ord(a)) & (p2 == ord(b))]] = CONTRACT2
    return out


def scan_states(kinds: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each codepoint: scans inside blocks side by side, then over the blocks' totals, then both joined."""
    n = len(kinds)
    rows = -(-n // block)
    f = np.zeros(rows * block, GENERATOR.dtype)
    f[:n] = GENERATOR[kinds]
    f = np.ascontiguousarray(f.reshape(rows, block).T)
    width = len(FUNCTIONS)
    flat = PRODUCT.ravel()
    acc = np.zeros(rows, np.intp)
    before = np.empty_like(f)
    for j in range(block):
        before[j] = acc
        acc = flat[acc * width + f[j]].astype(np.intp)
    state, heads = FRESH, np.empty(rows, np.intp)
    if rows > 4 * block:
        heads[:] = FUNCTIONS[_prefix(acc), FRESH]
    else:
        for r, g in enumerate(acc.tolist()):
            heads[r] = state
            state = int(FUNCTIONS[g, state])
    return FUNCTIONS[before, heads[None, :]].T.ravel()[:n]


def _prefix(ids: np.ndarray) -> np.ndarray:
    """Exclusive prefix products of function ids by doubling."""
    out, d = np.concatenate([[0], ids[:-1]]), 1
    while d < len(out):
        out[d:] = PRODUCT[out[:-d], out[d:]]
        d *= 2
    return out


def boundaries(classes: np.ndarray, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """For a list of texts: all joined by NUL fillers, their codepoints, the places at which slices start, and the
    fillers' places."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kinds = refine(classes, points, ends)
    cut = CUT[scan_states(kinds), kinds]
    cut[ends] = True
    return joined, points, np.flatnonzero(cut), ends


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left; by a heap, so long pieces take n log n."""
    if piece in ranks or not piece:
        return [ranks[piece]] if piece else []
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Places:
    """An open-addressing table from 64-bit keys to the order in which they were added; looked up side by side."""

    def __init__(self, room: int) -> None:
        self.bits = max(10, (3 * room).bit_length())
        self.keys, self.at, self.n = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that the table doesn't hold."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = np.empty(self.n, np.uint64)
            old[self.at[self.at >= 0]] = self.keys[self.at >= 0]
            self.__init__(2 * (self.n + len(keys)))
            self.add(old)
        value = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.at[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.at[slot[won]] = keys[won], value[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, value, slot = keys[rest], value[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, -1 for those that it doesn't hold."""
        slot = self._slot(keys)
        out = self.at[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            out[todo] = self.at[slot[todo]]
            todo = todo[(self.keys[slot[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out


class Codec:
    """Ranks, the table of pairs that merge, the cache of merged slices, and the bytes of every id."""

    #: Slices kept; beyond it the cache starts anew (results stay the same).
    CACHE = 150_000
    #: Slices up to so many bytes are merged side by side in a matrix, longer ones one by one.
    WIDE = 48

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        starts, kinds = runs or class_runs()
        self.classes = np.repeat(kinds, np.diff(starts, append=0x110000))
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        words = [b""] * (max(self.ranks.values()) + 1)
        for w, r in self.ranks.items():
            words[r] = w
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._pairs()
        self.clear()

    def _pairs(self) -> None:
        """The id of both together, for each pair of ids that merges."""
        pairs = [(u << 32 | v, r) for w, r in self.ranks.items() for i in range(1, len(w)) if (u := self.ranks.get(w[:i])) is not None and (v := self.ranks.get(w[i:])) is not None]
        keys, ranks = np.array(pairs, np.int64).T
        self.pairs = Places(len(keys))
        self.pairs.add(keys.astype(np.uint64))
        self.both = np.append(ranks, NONE).astype(np.int32)

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE; ids below 0 merge with nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        return self.both[self.pairs.find(keys.astype(np.uint64))]

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many slices in a row, and how many each has. Each round merges, in every row, the leftmost pair
        of the lowest rank."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        done = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(pieces))
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.together(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        place = np.arange(width)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            end = best == NONE
            if end.any():
                done[rows[end]] = ids[end]
                go = ~end
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            if not len(rows):
                break
            n = np.arange(len(rows))
            take = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[n, at] = best
            rank[n, at] = self.together(best, ids[n, np.minimum(at + 1, width - 1)])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.together(ids[left, at[left] - 1], best[left])
        return done[done >= 0], (done >= 0).sum(1)

    def clear(self) -> None:
        self.known = Places(2 * self.CACHE)
        self.rows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Merge new slices and keep their ids, found again by their keys."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, counts, order = [self.rows[2]], [self.rows[1]], []
        for lo, hi in ((-1, 0), (0, 8), (8, 16), (16, self.WIDE)):
            group = np.flatnonzero((sizes > lo) & (sizes <= hi))
            for k in range(0, len(group), 8_000):
                order.append(group[k : k + 8_000])
                ids, n = self._matrix([pieces[r] for r in order[-1]], max(hi, 1))
                flat.append(ids)
                counts.append(n)
        order.append(np.flatnonzero(sizes > self.WIDE))
        for r in order[-1]:
            flat.append(np.array(merge(pieces[r], self.ranks), np.int32))
            counts.append(np.array([len(flat[-1])]))
        self.known.add(keys[np.concatenate(order)])
        lengths = np.concatenate(counts)
        self.rows = np.cumsum(lengths) - lengths, lengths, np.concatenate(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's."""
        if self.known.n > self.CACHE:
            self.clear()
        joined, points, starts, ends = boundaries(self.classes, texts)
        stops = np.append(starts[1:], len(joined))
        fillers = np.searchsorted(starts, ends)
        stops[fillers] = starts[fillers]
        up, down = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * up[: len(points)], out=total[1:])
        keys = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        found = self.known.find(keys)
        if (miss := np.flatnonzero(found < 0)).size:
            new, first = np.unique(keys[miss], return_index=True)
            self._learn(new, [joined[a:b].encode() for a, b in zip(starts[miss[first]].tolist(), stops[miss[first]].tolist())])
            found[miss] = self.known.find(keys[miss])
        first, lengths, flat = self.rows
        n = lengths[found]
        offs = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[found] - offs[:-1], n) + np.arange(offs[-1])]
        return ids, np.concatenate([[0], offs[fillers + 1]])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids in a row, and where each id's bytes start (one more)."""
        n = self.size[ids]
        offs = np.concatenate([[0], np.cumsum(n)])
        return self.blob[np.repeat(self.start[ids] - offs[:-1], n) + np.arange(offs[-1])], offs


_CODECS: dict[str, Codec] = {}


def codec(path: str, runs: tuple[np.ndarray, np.ndarray] | None = None) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path, runs)
    return _CODECS[path]


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
OFFSETS = T.StructField("byte_offsets", T.ArrayType(T.IntegerType(), False))
DECODED = T.StructField("decoded", T.BinaryType())


def _encoding(ranks_path: str, text: str, offsets: bool) -> Callable[[Batches], Batches]:
    runs = class_runs()

    def run(batches: Batches) -> Batches:
        c = codec(ranks_path, runs)
        for batch in batches:
            for part, data, offs in slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                ids, at = c.encode(texts)
                new = {"ids": list_array(ids, at)}
                if offsets:
                    n = c.size[ids]
                    where = np.concatenate([[0], np.cumsum(n)])[:-1] - np.repeat(offs[:-1], np.diff(at))
                    new["byte_offsets"] = list_array(where.astype(np.int32), at)
                yield append(part, new)

    return run


def _decoding(ranks_path: str, ids: str) -> Callable[[Batches], Batches]:
    runs = class_runs()

    def run(batches: Batches) -> Batches:
        c = codec(ranks_path, runs)
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                col = part.column(ids)
                n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, offs = c.decode(col.flatten().to_numpy(zero_copy_only=False))
                at = offs[np.concatenate([[0], np.cumsum(n)])]
                yield append(part, {"decoded": binary_array(data, at)})

    return run


def encode(df: DataFrame, ranks_path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ``ids`` (array<int>) and, for decoding parts, ``byte_offsets`` (array<int>: where each id's bytes start in
    the text's UTF-8). Null and empty texts give empty arrays."""
    return arrow_map(df, _encoding(ranks_path, text, offsets), plus(df.schema, IDS, *[OFFSETS] * offsets))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of each row's ids; null ids count as none."""
    return arrow_map(df, _decoding(ranks_path, ids), plus(df.schema, DECODED))


def round_trip(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one pass: one Python worker a task instead of two. The text itself isn't returned, only
    the other columns, ``ids`` and ``decoded``."""
    coded, back = _encoding(ranks_path, text, False), _decoding(ranks_path, "ids")

    def run(batches: Batches) -> Batches:
        return (b.drop_columns([text]) for b in back(coded(batches)))

    return arrow_map(df, run, plus(T.StructType([f for f in df.schema if f.name != text]), IDS, DECODED))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens and the two digests of rows that carry ``ids`` and ``decoded``."""
    return df.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    })
