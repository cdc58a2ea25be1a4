"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

All segmentations of a text form a lattice. Perturbed A* search pops the set of segmentations with the largest
perturbed maximum, emits that maximum, and splits what is left of the set by the first place at which a
segmentation deviates; each part's maximum is a Gumbel variable truncated at the one emitted. So the k segmentations
of largest perturbed log-probability come out in order, without replacement, and the next value in the queue gives
their inclusion scores. Noise is hashed from the row's key.

No piece holds a blank after another character, so the lattice falls into units between which choices are
independent. A unit's lattice is summed once and remembered by its worker, with its two best segmentations. Many
texts are searched at once: in each round every text pops one part, and the units of all of them are drawn by array
steps, those that are neither the best nor the second by walks through their lattices.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusloom.llm.common import text_or_empty, trimmed
from corpusloom.llm.suffix_tree import Places

#: The vocabulary; it is read by the driver alone.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, SHARPNESS = 3, 1.5
#: A longer unit's lattice is summed in logarithms, as products of its probabilities would leave the range of numbers.
LONGEST_UNIT = 24
#: Units that a worker remembers (of more, those seen once are forgotten), and adds at once; ids, and steps of lattices, held for each on average.
REMEMBERED, TOGETHER, HELD, STEPS = 150_000, 8_000, 20, 30
#: Rows, and characters unless a single row has more, that are searched at once.
BATCH_ROWS, BATCH_CHARS = 512, 600_000
#: A text with no more segmentations than these is searched by listing them, should its parts run out of mass.
LISTED = 4096

BLANK = "▁"
#: Stands for a text's own BLANK, which only byte pieces may spell; no text holds a lone surrogate.
OWN_BLANK = "\udc01"
#: A factor for each character of a piece, which cancels out and keeps products in range.
SCALE = 1e8
# No piece of a usual vocabulary holds a blank after another character, or another character after a letter.
_letter, _other = r"[^\W\d_¹²³]", rf"(?:(?![{BLANK}\n])[\W\d_¹²³])"
_units = re.compile(rf"{BLANK}*{_other}*{_letter}+|{BLANK}*{_other}+|{BLANK}+|\n").findall
#: Runs that begin with blanks or a line's end and hold none after another character: units never reach beyond them.
_chunks = re.compile(rf"{BLANK}+[^{BLANK}\n]*|\n[^{BLANK}\n]*").findall
_GOLDEN, _STREAM = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03
_MASK = (1 << 64) - 1


@dataclass
class Pieces:
    """name: of the vocabulary and its weights; ids: id and weight of each spelling; spelled: the bytes of each id; byte_id: the first byte
    piece; byte_weight: of a character spelled in bytes. The merge ranks of a
    BPE vocabulary serve as ranks of Zipf's law, of which weights are the SHARPNESS-th power."""

    name: str
    ids: dict[str, tuple[int, float]]
    spelled: list[bytes]
    byte_id: int
    byte_weight: float

    @staticmethod
    def load(path: str = MODEL, sharpness: float = SHARPNESS) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_id = next(i for i in range(n) if model.is_byte(i))
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {i: -model.get_score(i) for i in plain}
        total = sum(1 / (r + 2.7) for r in rank.values())
        weight = lambda r: (1 / (r + 2.7) / total) ** sharpness
        spelled = [b""] * n
        for i in range(256):
            spelled[byte_id + i] = bytes([i])
        for i in plain:
            spelled[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        if any(len(_units(model.id_to_piece(i))) > 1 for i in plain):
            raise ValueError("a piece of this vocabulary crosses the places at which texts are cut into units")
        scaled = {p: (i, weight(rank[i]) * SCALE ** len(p)) for i in plain for p in [model.id_to_piece(i)]}
        return Pieces(f"{path}/{sharpness}", scaled, spelled, byte_id, weight(2.0 * n) * SCALE)


def _log_weight(w: float, size: int) -> float:
    """The logarithm of a piece's weight without its SCALE."""
    return math.log(w) - size * math.log(SCALE)


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def ragged(offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [off, off + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(offs - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _rolled(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of a text with one more character."""
    h = (h ^ (c + np.uint64(1))) * _GOLDEN
    return h ^ (h >> np.uint64(32))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of texts that are sorted by falling size, a row each; the sizes; how many have at least j characters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    longest = int(sizes[0])
    codes = np.zeros((len(texts), longest), np.uint64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.repeat(np.arange(len(texts)), sizes), ragged(np.zeros(len(texts), np.int64), sizes)] = flat
    return codes, sizes, np.searchsorted(-sizes, -np.arange(longest + 1), side="right")


class Lattices:
    """The units seen by a worker: their two best segmentations, these ones' probabilities, and the steps of their lattices."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces, self.remembered = pieces, remembered
        names = sorted(pieces.ids, key=len, reverse=True)
        codes, sizes, so_long = _codes(names)
        self.longest_piece = int(sizes[0])
        hashes = np.zeros(len(names), np.uint64)
        for j in range(1, self.longest_piece + 1):
            hashes[: so_long[j]] = _rolled(hashes[: so_long[j]], codes[: so_long[j], j - 1])
        self.hashed = Places(hashes, room=16)
        #: Whether a piece has these lower bits: most spans are no pieces, and a small table says so soonest.
        self.some = np.zeros(1 << 18, bool)
        self.some[hashes & np.uint64(len(self.some) - 1)] = True
        self.piece_ids = np.array([pieces.ids[p][0] for p in names], np.int32)
        self.weights = np.array([pieces.ids[p][1] for p in names])
        self.drawn: dict[str, list] = {}
        self.drawn_size = 0
        self.from_there: dict[str, list[float]] = {}
        self.place: dict[str, int] = {}
        self.unit: list[str] = []
        self.p, self.log_p = np.zeros((1024, 2)), np.zeros((1024, 2))
        self.off, self.size = np.zeros((1024, 2), np.int32), np.zeros((1024, 2), np.int32)
        self.seen, self.log_mass = np.zeros(1024, np.int32), np.zeros(1024)
        #: Where a unit's states begin, one for each place in it; -1 if it is drawn without steps.
        self.states = np.zeros(1024, np.int64)
        self.buffer, self.used = np.zeros(1 << 16, np.int32), 0
        self.low = np.zeros((1024, 2))
        self.chunk: dict[str, int] = {}
        self.chunk_units, self.chunk_ends = array("q"), array("q", [0])
        self.n_states, self.first_step = 0, np.zeros(1024, np.int32)
        self.step_from, self.step_piece, self.step_sum = np.zeros(1024, np.int8), np.zeros(1024, np.int32), np.zeros(1024)

    def push(self, ids: tuple[int, ...] | np.ndarray) -> int:
        """Where the ids stand in the buffer now."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.buffer):
            self.buffer = np.concatenate([self.buffer, np.zeros(max(len(self.buffer) // 2, len(ids)), np.int32)])
        self.buffer[at : self.used] = ids
        return at

    def forget_if_full(self) -> None:
        """Keeps the units that were seen again, unless these are more than half of what may be remembered."""
        n = len(self.unit)
        if n <= self.remembered and self.used <= HELD * self.remembered and self.first_step[self.n_states] <= STEPS * self.remembered and len(self.chunk) <= 2 * self.remembered:
            return
        keep = np.flatnonzero(self.seen[:n] > 1)
        if len(keep) > self.remembered // 2 or self.size[keep].sum() > HELD * self.remembered // 2:
            keep = keep[:0]
        m, place = len(keep), np.full(n, -1)
        place[keep] = np.arange(m)
        # Chunks stay whose units all stay.
        ends, units = np.array(self.chunk_ends), place[np.array(self.chunk_units, np.int64)]
        lost = np.concatenate([[0], np.cumsum(units < 0)])
        stay = lost[ends[1:]] == lost[ends[:-1]]
        if stay.sum() > self.remembered:
            stay[:] = False
        self.chunk = dict(zip(itertools.compress(self.chunk, stay.tolist()), range(int(stay.sum())), strict=True))
        sizes = np.diff(ends)[stay]
        self.chunk_units, self.chunk_ends = array("q", units[ragged(ends[:-1][stay], sizes)]), array("q", np.concatenate([[0], np.cumsum(sizes)]))

        sizes, offs = self.size[keep].ravel(), self.off[keep].ravel()
        ids = self.buffer[ragged(offs, sizes)]
        self.unit = [self.unit[k] for k in keep.tolist()]
        self.place = dict(zip(self.unit, range(m), strict=True))
        for name in ("p", "log_p", "size", "seen", "off", "log_mass", "states", "low"):
            old = getattr(self, name)
            old[:m] = old[keep]
        self.seen[:m] = 0
        self.off[:m] = (np.cumsum(sizes) - sizes).reshape(-1, 2)
        self.buffer[: len(ids)], self.used = ids, len(ids)

        stepped = np.flatnonzero(self.states[:m] >= 0)
        sizes = np.array([len(self.unit[k]) + 1 for k in stepped.tolist()], np.int64)
        states = ragged(self.states[stepped], sizes)
        counts = self.first_step[states + 1] - self.first_step[states]
        at = ragged(self.first_step[states], counts)
        for name in ("step_from", "step_piece", "step_sum"):
            old = getattr(self, name)
            old[: len(at)] = old[at]
        self.states[stepped] = np.cumsum(sizes) - sizes
        self.n_states = len(states)
        self.first_step[: len(states) + 1] = np.concatenate([[0], np.cumsum(counts)])

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """From each character on, (end, ids, weight) of the pieces; a character without a piece is spelled in bytes.
        A long unit's weights are parts of what is left from the character on, so that all ways from there weigh 1."""
        if unit in self.drawn:
            return self.drawn[unit]
        out = self._edges(unit)
        if len(unit) > LONGEST_UNIT:
            left = [0.0] * (len(unit) + 1)
            for i in range(len(unit) - 1, -1, -1):
                logs = [_log_weight(w, j - i) + left[j] for j, _, w in out[i]]
                left[i] = _log_sum(logs)
                out[i] = [(j, ids, math.exp(x - left[i])) for (j, ids, _), x in zip(out[i], logs, strict=True)]
        if self.drawn_size >= REMEMBERED // 10 * LONGEST_UNIT:
            self.drawn.clear()
            self.from_there.clear()
            self.drawn_size = 0
        self.drawn[unit] = out
        self.drawn_size += len(unit)
        return out

    def _edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        out, known = [], self.pieces.ids
        for i in range(len(unit)):
            here = []
            for j in range(i + 1, min(len(unit), i + self.longest_piece) + 1):
                if found := known.get(unit[i:j]):
                    here.append((j, (found[0],), found[1]))
            if not here or here[0][0] != i + 1:
                here.insert(0, (i + 1, self._bytes(unit[i]), self.pieces.byte_weight))
            out.append(here)
        return out

    def sums(self, unit: str) -> list[float]:
        """The weight of all ways from each character on."""
        if unit in self.from_there:
            return self.from_there[unit]
        edges = self.edges(unit)
        beta = [0.0] * len(edges) + [1.0]
        for i in range(len(edges) - 1, -1, -1):
            b = 0.0
            for j, _, w in edges[i]:
                b += w * beta[j]
            beta[i] = b
        self.from_there[unit] = beta
        return beta

    def add(self, unit: str) -> int:
        """Sums the unit's lattice and finds its two best segmentations, in logarithms, in one pass from the left."""
        n = len(unit)
        came: list[list[float]] = [[0.0]] + [[] for _ in range(n)]
        best: list[list[tuple]] = [[(0.0, 0, (), 0)]] + [[] for _ in range(n)]
        mass = [0.0] * (n + 1)
        for i, edges in enumerate(self._edges(unit)):
            mass[i], came[i] = _log_sum(came[i]), []
            for j, ids, w in edges:
                w = _log_weight(w, j - i)
                came[j].append(mass[i] + w)
                best[j] = sorted(best[j] + [(x[0] + w, i, ids, rank) for rank, x in enumerate(best[i])], key=lambda x: -x[0])[:2]
        mass[n] = _log_sum(came[n])
        both = []
        for rank in (0, 1):
            at, out = n, []
            while at and rank < len(best[at]):
                _, at, ids, rank = best[at][rank]
                out.extend(reversed(ids))
            both.append(tuple(reversed(out)))
        log_p = np.array([x[0] - mass[n] for x in best[n]] + [-math.inf] * (2 - len(best[n])))
        k = len(self.unit)
        self._grow(k + 1)
        self.p[k], self.log_p[k] = np.exp(log_p), log_p
        self.off[k] = self.push(both[0]), self.push(both[1])
        self.size[k] = len(both[0]), len(both[1])
        self.seen[k], self.states[k] = 0, -1
        self.place[unit] = k
        self.unit.append(unit)
        return k

    def add_many(self, units: list[str]) -> None:
        """add() for many units at once: a step for each start and length of a piece, over all units that are so long."""
        units = [u for u in units if u not in self.place]
        spelled = set("".join(units)) - self.pieces.ids.keys()
        for u in [u for u in units if len(u) > LONGEST_UNIT or spelled and not spelled.isdisjoint(u)]:
            self.add(u)  # long, or with characters in bytes
        units = sorted((u for u in units if u not in self.place), key=len, reverse=True)
        for k in range(0, len(units), TOGETHER):
            self._add_plain(units[k : k + TOGETHER])

    def _spans(self, codes: np.ndarray, so_long: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all spans that are pieces, by rising start."""
        longest, mask = codes.shape[1], np.uint64(len(self.some) - 1)
        for i in range(longest):
            h = np.zeros(so_long[i + 1], np.uint64)
            for j in range(i + 1, min(longest, i + self.longest_piece) + 1):
                h = _rolled(h[: so_long[j]], codes[: so_long[j], j - 1])
                rows = np.flatnonzero(self.some[h & mask])
                found = self.hashed.find(h[rows])
                if (found < 0).any():
                    rows, found = rows[found >= 0], found[found >= 0]
                if len(rows):
                    yield i, j, rows, found

    def _add_plain(self, units: list[str]) -> None:
        codes, sizes, so_long = _codes(units)
        n, longest = codes.shape
        mass, score = np.zeros((longest + 1, n)), np.zeros((2, longest + 1, n))
        mass[0], score[0, 0] = 1.0, 1.0
        #: The piece, the rank of the way before it, and where it begins, of the two best ways to each place.
        way = np.zeros((2, longest + 1, n), np.int64)

        def offer(j: int, rows: np.ndarray, x: np.ndarray, i: int, k: np.ndarray, r: int) -> None:
            """A way to j of weight x, that came from i by piece k and i's way of rank r."""
            (best, second), (to_best, to_second) = score[:, j], way[:, j]
            if not r:
                up = x > best[rows]
                a = rows[up]
                second[a], to_second[a] = best[a], to_best[a]
                best[a], to_best[a] = x[up], k[up] << 16 | i
                up = ~up
                rows, x, k = rows[up], x[up], k[up]
            up = x > second[rows]
            a = rows[up]
            second[a], to_second[a] = x[up], k[up] << 16 | r << 8 | i

        found: list[tuple[np.ndarray, ...]] = []
        for i, j, rows, k in self._spans(codes, so_long):
            w = self.weights[k]
            x = mass[i, rows] * w
            mass[j, rows] += x
            found.append((rows, np.full(len(rows), j, np.int8), np.full(len(rows), i, np.int8), k.astype(np.int32), x))
            offer(j, rows, score[0, i, rows] * w, i, k, 0)
            there = score[1, i, rows] > 0
            offer(j, rows[there], score[1, i, rows[there]] * w[there], i, k[there], 1)
        ends = mass[sizes, np.arange(n)]
        p = score[:, sizes, np.arange(n)] / ends
        ids = np.zeros((2, n, longest), np.int32)
        lengths = np.zeros((2, n), np.int64)
        for which in (0, 1):
            rows = np.flatnonzero(p[which] > 0)
            at, r = sizes[rows], np.full(len(rows), which)
            while len(rows):
                last = way[r, at, rows]
                ids[which, rows, lengths[which, rows]] = self.piece_ids[last >> 16]
                lengths[which, rows] += 1
                at, r = last & 255, last >> 8 & 255
                rows, at, r = rows[at > 0], at[at > 0], r[at > 0]
        first = len(self.unit)
        self._grow(first + n)
        new = slice(first, first + n)
        self.p[new], self.size[new], self.seen[new], self.states[new] = p.T, lengths.T, 0, -1
        with np.errstate(divide="ignore"):
            self.log_p[new] = np.log(p.T)
        self.log_mass[new] = np.log(ends)
        counts = lengths.T.ravel()  # a unit's first, then its second
        offs = np.cumsum(counts) - counts
        # They were found from their ends.
        back = np.repeat(counts - 1, counts) - ragged(np.zeros(2 * n, np.int64), counts)
        owner = np.repeat(np.arange(2 * n), counts)
        self.off[new] = self.push(ids[owner % 2, owner // 2, back]) + offs.reshape(-1, 2)
        self.place.update(zip(units, range(first, first + n), strict=True))
        self.unit.extend(units)
        self._keep_steps(np.arange(first, first + n), sizes, mass, found)

    def _grow(self, n: int) -> None:
        while n > len(self.p):
            for name in ("p", "log_p", "off", "size", "seen", "log_mass", "states", "low"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old[: max(1024, len(old) // 2)])]))

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.pieces.byte_id + b for b in (BLANK if c == OWN_BLANK else c).encode())

    # A unit's steps lead from its end back to its start. A state's steps share [0, 1) by what each adds to the weight of
    # all ways there, so a number in [0, 1) walks to one segmentation, and each segmentation has an interval of its own.

    def _keep_steps(self, new: np.ndarray, sizes: np.ndarray, mass: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> None:
        """Writes out the lattices of new units."""
        base = np.cumsum(sizes + 1) - sizes - 1
        row, end, came, piece, x = (np.concatenate(c) for c in zip(*found, strict=True))
        state = base[row] + end
        order = np.argsort(state, kind="stable")
        share = (x / mass[end, row])[order]
        state, came, piece = state[order], came[order], piece[order]
        nth = np.arange(len(state))
        nth -= np.maximum.accumulate(np.where(np.append(True, state[1:] != state[:-1]), nth, 0))
        for r in range(1, int(nth.max()) + 1):
            at = np.flatnonzero(nth == r)
            share[at] += share[at - 1]
        share[np.append(state[1:] != state[:-1], True)] = 1.0
        counts = np.bincount(state, minlength=int(base[-1] + sizes[-1] + 1))
        self.states[new] = self.n_states + base
        before = self.first_step[self.n_states]
        self._extend("first_step", self.n_states + 1, before + np.cumsum(counts))
        for name, values in (("step_from", came), ("step_piece", piece), ("step_sum", share)):
            self._extend(name, int(before), values)
        self.n_states += len(counts)
        self.low[new] = np.nan

    def begins(self, places: np.ndarray) -> np.ndarray:
        """Where the intervals of the units' two best segmentations begin."""
        new = np.unique(places[np.isnan(self.low[places, 0])])
        for which in (0, 1):
            self.low[new, which] = self._trace(new, self.off[new, which], self.size[new, which])
        return self.low[places]

    def _extend(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            old = np.concatenate([old, np.zeros(max(len(old) // 2, len(values)), old.dtype)])
            setattr(self, name, old)
        old[at : at + len(values)] = values

    def _trace(self, places: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the intervals of segmentations of these units begin."""
        low, width = np.zeros(len(places)), np.ones(len(places))
        rows = np.flatnonzero(sizes > 0)
        at = np.array([len(self.unit[k]) for k in places.tolist()])[rows]
        for t in itertools.count():
            rows, at = rows[sizes[rows] > t], at[sizes[rows] > t]
            if not len(rows):
                return low
            want = self.buffer[offs[rows] + sizes[rows] - 1 - t]
            begin = self.first_step[self.states[places[rows]] + at]
            e = begin.copy()
            wrong = np.flatnonzero(self.piece_ids[self.step_piece[e]] != want)
            while len(wrong):
                e[wrong] += 1
                wrong = wrong[self.piece_ids[self.step_piece[e[wrong]]] != want[wrong]]
            base = np.where(e > begin, self.step_sum[e - 1], 0.0)
            low[rows] += width[rows] * base
            width[rows] *= self.step_sum[e] - base
            at = self.step_from[e].astype(np.int64)

    def walk(self, places: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the buffer, size, log-probability, begin of the interval) of the segmentations of units whose
        intervals hold v."""
        n = len(places)
        at = np.array([len(self.unit[k]) for k in places.tolist()])
        low, width, log_p, sizes = np.zeros(n), np.ones(n), -self.log_mass[places], np.zeros(n, np.int64)
        rows, u, ids = np.arange(n), v.copy(), []
        while len(rows):
            begin, end = self.first_step[self.states[places[rows]] + at], self.first_step[self.states[places[rows]] + at + 1]
            e = begin.copy()
            more = np.flatnonzero((u >= self.step_sum[e]) & (e + 1 < end))
            while len(more):
                e[more] += 1
                more = more[(u[more] >= self.step_sum[e[more]]) & (e[more] + 1 < end[more])]
            base = np.where(e > begin, self.step_sum[e - 1], 0.0)
            part = self.step_sum[e] - base
            low[rows] += width[rows] * base
            width[rows] *= part
            u = np.clip((u - base) / np.maximum(part, 1e-300), 0.0, 1 - 2.0**-53)
            piece = self.step_piece[e]
            log_p[rows] += np.log(self.weights[piece])
            step = np.zeros(n, np.int32)
            step[rows] = self.piece_ids[piece]
            ids.append(step)
            sizes[rows] += 1
            at = self.step_from[e].astype(np.int64)
            rows, u, at = rows[at > 0], u[at > 0], at[at > 0]
        if not n:
            return np.zeros(0, np.int64), sizes, log_p, low
        flat = np.array(ids)
        owner = np.repeat(np.arange(n), sizes)
        back = np.repeat(sizes - 1, sizes) - ragged(np.zeros(n, np.int64), sizes)
        first = self.push(flat[back, owner])
        return first + np.cumsum(sizes) - sizes, sizes, log_p, low

    def draw(self, unit: str, excluded: list[tuple[int, ...]], uniform) -> tuple[tuple[int, ...], float] | None:
        """A segmentation that is not excluded, by its probability, and that one's logarithm; None if all are."""
        edges, beta = self.edges(unit), self.sums(unit)
        ways = [w for w in (self._way(edges, ids) for ids in set(excluded)) if w is not None]
        at, out, log_p = 0, [], -math.log(beta[0])
        while at < len(edges):
            options = []
            for j, ids, w in edges[at]:
                gone = sum(way[1][at] for way in ways if way[0].get(at) == j)
                options.append(max(0.0, w * beta[j] - gone))
            total = sum(options)
            if not any(way[0].get(at) is not None for way in ways):
                total = beta[at]
            if total <= beta[at] * 1e-13:
                return None
            u, pick = uniform() * sum(options), 0
            while pick < len(options) - 1 and u >= options[pick]:
                u -= options[pick]
                pick += 1
            while options[pick] <= 0.0:
                pick -= 1
            j, ids, w = edges[at][pick]
            ways = [way for way in ways if way[0].get(at) == j]
            out.extend(ids)
            log_p += math.log(w)
            at = j
        return tuple(out), log_p

    @staticmethod
    def _way(edges: list, ids: tuple[int, ...]) -> tuple[dict[int, int], dict[int, float]] | None:
        """(next character, weight from there on) at each character that this segmentation stops at."""
        at, k, stops, weights = 0, 0, [], []
        while at < len(edges):
            for j, own, w in edges[at]:
                if ids[k : k + len(own)] == own:
                    stops.append((at, j))
                    weights.append(w)
                    at, k = j, k + len(own)
                    break
            else:
                return None
        rest, after = {}, 1.0
        for (i, _), w in zip(reversed(stops), reversed(weights), strict=True):
            after *= w
            rest[i] = after
        return dict(stops), rest

    def all_of(self, unit: str) -> list[tuple[tuple[int, ...], float]] | None:
        """All segmentations and their log-probabilities, unless they are more than LISTED."""
        edges, ways = self.edges(unit), [1] + [0] * len(unit)
        for i, here in enumerate(edges):
            for j, _, _ in here:
                ways[j] += ways[i]
        if ways[-1] > LISTED:
            return None
        listed: list[list[tuple[tuple[int, ...], float]]] = [[((), 0.0)]] + [[] for _ in unit]
        for i, here in enumerate(edges):
            for j, ids, w in here:
                listed[j] += [(x + ids, y + math.log(w)) for x, y in listed[i]]
        total = math.log(self.sums(unit)[0])
        return [(x, y - total) for x, y in listed[-1]]

    def places_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the texts' units, one text after the other, and how many each has; unknown units are added."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for r, text in enumerate(texts):
            own = chunks_of(text)
            counts[r] = len(own)
            chunks += own
        at = np.fromiter(map(self.chunk.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = list(map(chunks.__getitem__, missing.tolist()))
            new = list(dict.fromkeys(lost))
            cut = [_units(c if c[0] in _STARTS else BLANK + c) for c in new]
            units = list(itertools.chain.from_iterable(cut))
            self.add_many(list(dict.fromkeys(units)))
            self.chunk.update(zip(new, range(len(self.chunk), len(self.chunk) + len(new)), strict=True))
            self.chunk_ends.extend(itertools.accumulate(map(len, cut), initial=self.chunk_ends.pop()))
            self.chunk_units.extend(map(self.place.__getitem__, units))
            at[missing] = np.fromiter(map(self.chunk.__getitem__, lost), np.int64, len(lost))
        ends = np.array(self.chunk_ends)
        sizes = ends[at + 1] - ends[at]
        places = np.array(self.chunk_units, np.int64)[ragged(ends[at], sizes)]
        of = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return places, np.diff(of)


_STARTS = (BLANK, "\n")


def chunks_of(text: str) -> list[str]:
    """The text, after a blank that stands before each text, in chunks; one without a blank or line's end at its start
    stands for itself after a blank."""
    if not text:
        return []
    text = text.replace(BLANK, OWN_BLANK)
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        return _chunks(BLANK + text.replace(" ", BLANK))
    first, *lines = text.split("\n")
    out = first.split(" ")
    for line in lines:
        words = line.split(" ")
        words[0] = "\n" + words[0]
        out += words
    return out


def units_of(text: str) -> list[str]:
    return [u for c in chunks_of(text) for u in _units(c if c[0] in _STARTS else BLANK + c)]


def _mix(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def key_of(key: object, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(str(key), seed=seed)


class Noise:
    """Uniform numbers in (0, 1) that follow from the key."""

    def __init__(self, key: object, seed: int = 0):
        self.state = key_of(key, seed)

    def one(self) -> float:
        self.state = x = (self.state + 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
        return (((x ^ x >> 31) >> 11) + 0.5) / (1 << 53)


def _uniform(keys: np.ndarray, sizes: np.ndarray | int, stream: int, at: np.ndarray) -> np.ndarray:
    """The numbers in (0, 1) at places of the keys' streams, so many of each key."""
    x = np.repeat(_mix(keys + np.uint64((stream + 1) * _STREAM & _MASK)) + _GOLDEN, sizes) + at.view(np.uint64) * _GOLDEN
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _gumbel(mass: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log-masses, truncated at below."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-below, np.log(-np.log(u)) - mass)


class Search:
    """The segmentations of many texts, found round by round."""

    def __init__(self, texts: list[str], keys: list[int], ks: list[int], lattices: Lattices):
        self.lattices, self.ks = lattices, ks
        self.keys = np.array(keys, np.uint64)
        self.places, counts = lattices.places_of(texts)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        n = len(lattices.unit)
        lattices.seen[:n] += np.bincount(self.places, minlength=n).astype(np.int32)
        self.p = lattices.p[self.places]
        #: For each round, where the units' ids stand, how many, and their log-probabilities.
        self.samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: The ids of each round's samples, one text after the other, and where each text's begin, once found() has asked.
        self.spelled: list[tuple[np.ndarray, np.ndarray]] = []
        self.queues: list[list[tuple]] = [[] for _ in texts]
        #: (round, log-probability, perturbed) of each text's samples.
        self.out: list[list[tuple[int, float, float]]] = [[] for _ in texts]

    def run(self) -> None:
        values = -np.log(-np.log(_uniform(self.keys, 1, 0, np.zeros(len(self.keys), np.int64))))
        jobs = [(d, float(values[d]), -1, -1, []) for d in np.flatnonzero(self.ends > self.starts).tolist() if self.ks[d] > 0]
        while jobs:
            self._round(jobs)
            jobs = self._pop([d for d, *_ in jobs])

    def _ids(self, sample: int, at: int) -> tuple[tuple[int, ...], float]:
        offs, sizes, logs = self.samples[sample]
        return tuple(self.lattices.buffer[offs[at] : offs[at] + sizes[at]].tolist()), float(logs[at])

    def _pop(self, texts: list[int]) -> list[tuple]:
        """The next part of each text: (text, perturbed, sample it deviates from, unit, excluded there)."""
        jobs = []
        for d in texts:
            if len(self.out[d]) < self.ks[d] and self.queues[d]:
                value, _, sample, at, taken = heapq.heappop(self.queues[d])
                jobs.append((d, -value, sample, at, taken or [self._ids(sample, self.starts[d] + at)]))
        return jobs

    def _round(self, jobs: list[tuple]) -> None:
        """Draws a segmentation of each job's part and queues what is left of it."""
        lattices, stream = self.lattices, 3 * len(self.samples) + 1
        who = np.array([j[0] for j in jobs])
        start = np.array([j[3] for j in jobs])
        begin, end = self.starts[who], self.ends[who]
        # All units after the one that deviates.
        sizes = end - begin - start - 1
        at = ragged(begin + start + 1, sizes)
        u = _uniform(self.keys[who], sizes, stream, at - np.repeat(begin, sizes))
        p, places = (self.p, self.places) if len(at) == len(self.places) else (self.p[at], self.places[at])
        pick = (u >= p[:, 0]).astype(np.int8)
        later = np.flatnonzero(pick)
        pick[later] += u[later] >= p[later, 0] + p[later, 1]
        which = np.minimum(pick, 1)
        offs, lengths, logs = np.zeros(len(self.places), np.int64), np.zeros(len(self.places), np.int32), np.zeros(len(self.places))
        flat = 2 * places + which
        offs[at], lengths[at], logs[at] = lattices.off.ravel().take(flat), lattices.size.ravel().take(flat), lattices.log_p.ravel().take(flat)

        # Units that are drawn from their lattices, without some segmentations: (unit, text, excluded).
        other = at[pick == 2]
        owner = who[np.searchsorted(np.cumsum(sizes), np.flatnonzero(pick == 2), side="right")]
        deviate = np.flatnonzero(start >= 0)
        plain = lattices.states[self.places[other]] >= 0
        for i, d in zip(other[~plain].tolist(), owner[~plain].tolist(), strict=True):
            k = self.places[i]
            best = [tuple(lattices.buffer[o : o + s].tolist()) for o, s in zip(lattices.off[k], lattices.size[k], strict=True)]
            self._draw(i, d, stream, best, (offs, lengths, logs))
        other, owner = other[plain], owner[plain]
        k = self.places[other]
        low, wide = lattices.begins(k), lattices.p[k]
        swap = low[:, 0] > low[:, 1]
        low[swap], wide[swap] = low[swap][:, ::-1], wide[swap][:, ::-1]
        v = _uniform(self.keys[owner], 1, stream + 1, other - self.starts[owner]) * np.maximum(0.0, 1 - wide.sum(axis=1))
        for r in (0, 1):
            v += np.where(v >= low[:, r], wide[:, r], 0.0)
        units, lows, points, failed = [], [], [], set()
        parts = _uniform(self.keys[who[deviate]], 1, stream + 1, start[deviate]).tolist()
        for x, part in zip(deviate.tolist(), parts, strict=True):
            d, _, _, s, taken = jobs[x]
            i = int(begin[x] + s)
            place = self.places[i]
            if lattices.states[place] < 0:
                if not self._draw(i, d, stream, [ids for ids, _ in taken], (offs, lengths, logs)):
                    failed.add(x)
                continue
            gone = sorted((self._interval(int(place), ids), math.exp(lp)) for ids, lp in taken)
            left = 1 - sum(w for _, w in gone)
            if left <= 1e-13:
                failed.add(x)
                continue
            point = part * left
            for b, w in gone:
                point += w if point >= b else 0.0
            units.append(i)
            points.append(point)
            lows.append((gone[0][0], gone[-1][0]))
        if units:
            other, v, low = np.append(other, units), np.append(v, points), np.concatenate([low, lows])
        offs[other], lengths[other], logs[other], found = lattices.walk(self.places[other], np.minimum(v, 1 - 2.0**-53))
        # Rounding at an interval's border may have led back to what is excluded.
        for i in other[(found[:, None] == low).any(axis=1)].tolist():
            d = int(np.searchsorted(self.ends, i, side="right"))
            mine = [x for x in deviate.tolist() if begin[x] + start[x] == i]
            k = self.places[i]
            best = [tuple(lattices.buffer[o : o + s].tolist()) for o, s in zip(lattices.off[k], lattices.size[k], strict=True)]
            if not self._draw(i, d, stream, [ids for ids, _ in jobs[mine[0]][4]] if mine else best, (offs, lengths, logs)) and mine:
                failed.add(mine[0])
        for x in deviate.tolist():
            d, _, sample, s, _ = jobs[x]
            for new, old in zip((offs, lengths, logs), self.samples[sample], strict=True):
                new[begin[x] : begin[x] + s] = old[begin[x] : begin[x] + s]
        self.samples.append((offs, lengths, logs))
        self._queue(jobs, begin, end, start, logs, failed, stream + 2)

    def _queue(self, jobs: list[tuple], begin: np.ndarray, end: np.ndarray, start: np.ndarray, logs: np.ndarray, failed: set[int], stream: int) -> None:
        """The sets of segmentations that deviate first at each unit from a job's segmentation on, and their maxima."""
        sample, first = len(self.samples) - 1, np.maximum(start, 0)
        before = np.cumsum(logs) - logs
        sizes = end - begin - first
        at = ragged(begin + first, sizes)
        left = -np.expm1(logs[at])
        heads = np.cumsum(sizes) - sizes
        taken: dict[int, list] = {}
        for x in np.flatnonzero(start >= 0).tolist():
            if x not in failed:
                taken[x] = [*jobs[x][4], self._ids(sample, int(begin[x] + start[x]))]
                left[heads[x]] = max(0.0, 1 - sum(math.exp(lp) for _, lp in taken[x]))
        who = np.array([j[0] for j in jobs])
        u = _uniform(self.keys[who], sizes, stream, at - np.repeat(begin, sizes))
        with np.errstate(divide="ignore"):
            mass = before[at] - np.repeat(before[begin], sizes) + np.log(np.where(left > 1e-12, left, 0.0))
        values = _gumbel(mass, np.repeat([j[1] for j in jobs], sizes), u)
        for x, (d, value, *_) in enumerate(jobs):
            if x in failed:
                continue
            self.out[d].append((sample, float(logs[begin[x] : end[x]].sum()), value))
            own, wanted = values[heads[x] : heads[x] + sizes[x]], self.ks[d] - len(self.out[d]) + 1
            best = np.argpartition(-own, wanted)[:wanted] if len(own) > wanted else np.arange(len(own))
            for j in best.tolist():
                if own[j] > -math.inf:
                    i = int(first[x]) + j
                    heapq.heappush(self.queues[d], (-float(own[j]), (sample, i), sample, i, taken[x] if x in taken and i == start[x] else None))

    def _interval(self, place: int, ids: tuple[int, ...]) -> float:
        """Where the interval of a segmentation of a unit begins."""
        lattices, at = self.lattices, len(self.lattices.unit[place])
        low, width, state = 0.0, 1.0, int(lattices.states[place])
        for want in reversed(ids):
            begin = e = int(lattices.first_step[state + at])
            while lattices.piece_ids[lattices.step_piece[e]] != want:
                e += 1
            base = float(lattices.step_sum[e - 1]) if e > begin else 0.0
            low += width * base
            width *= float(lattices.step_sum[e]) - base
            at = int(lattices.step_from[e])
        return low

    def _draw(self, at: int, text: int, stream: int, excluded: list[tuple[int, ...]], to: tuple[np.ndarray, ...]) -> bool:
        """Draws a unit without array steps."""
        noise = Noise(f"{self.keys[text]}/{stream}/{at - self.starts[text]}")
        drawn = self.lattices.draw(self.lattices.unit[self.places[at]], excluded, noise.one)
        if drawn:
            to[0][at], to[1][at], to[2][at] = self.lattices.push(drawn[0]), len(drawn[0]), drawn[1]
        return drawn is not None

    def found(self, d: int) -> list[tuple[np.ndarray, float, float, float]]:
        """(ids, log-probability, perturbed log-probability, inclusion score) of the text's distinct segmentations."""
        a, b = self.starts[d], self.ends[d]
        if a == b:
            return [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)]
        if len(self.out[d]) < self.ks[d] and (listed := self._listed(d)):
            return listed
        limit = -self.queues[d][0][0] if self.queues[d] else -math.inf
        for offs, sizes, _ in self.samples[len(self.spelled) :]:
            before = np.concatenate([[0], np.cumsum(sizes)])
            self.spelled.append((self.lattices.buffer[ragged(offs, sizes)], before[np.append(self.starts, self.ends[-1])]))
        out = []
        for s, log_p, value in self.out[d]:
            ids, begin = self.spelled[s]
            out.append((ids[begin[d] : begin[d + 1]], log_p, value, _inclusion(log_p, limit)))
        return out

    def _listed(self, d: int) -> list[tuple] | None:
        """found() of a text whose parts have no mass left to tell apart, if its segmentations are few."""
        lists, total = [], 1
        for k in self.places[self.starts[d] : self.ends[d]].tolist():
            ways = self.lattices.all_of(self.lattices.unit[k])
            total *= len(ways) if ways else LISTED + 1
            if total > LISTED:
                return None
            lists.append(ways)
        whole = [(sum((x for x, _ in way), ()), sum(y for _, y in way)) for way in itertools.product(*lists)]
        logs = np.array([y for _, y in whole])
        values = logs - np.log(-np.log(_uniform(self.keys[d : d + 1], total, 0, np.arange(1, total + 1))))
        order = np.argsort(-values, kind="stable")
        limit = values[order[self.ks[d]]] if total > self.ks[d] else -math.inf
        return [(np.array(whole[i][0], np.int32), float(logs[i]), float(values[i]), _inclusion(float(logs[i]), limit)) for i in order[: self.ks[d]].tolist()]


def _inclusion(log_p: float, limit: float) -> float:
    """The probability that a segmentation's perturbed value passes the limit."""
    return -math.expm1(-math.exp(min(700.0, log_p - limit))) if limit > -math.inf else 1.0


def top_k_many(texts: list[str], keys: list[int], ks: list[int], lattices: Lattices) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, as Search.found() gives them."""
    used = lattices.used
    search = Search(texts, keys, ks, lattices)
    used = max(used, lattices.used)
    search.run()
    yield from map(search.found, range(len(texts)))
    lattices.used = used


def top_k(text: str, lattices: Lattices, key: object, k: int, seed: int = 0) -> list[tuple[np.ndarray, float, float, float]]:
    return list(top_k_many([text], [key_of(key, seed)], [k], lattices))[0]


def decode(ids: np.ndarray | list[int], spelled: list[bytes]) -> str:
    """The text of the ids: the exact text that was encoded."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    return b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def spelled_runs(ids: np.ndarray, ends: list[int], spelled: pa.Array) -> Iterator[bytes]:
    """The bytes that decode() decodes, for the runs of ids between each two ends."""
    joined = spelled.take(pa.array(ids))
    offsets, data = np.frombuffer(joined.buffers()[1], np.int32)[: len(ids) + 1].tolist(), joined.buffers()[2]
    data = data.to_pybytes() if data else b""
    for a, b in itertools.pairwise(ends):
        yield data[offsets[a] : offsets[b]]


#: Lattices that outlive a worker's tasks; of one vocabulary at a time.
_held: dict[str, Lattices] = {}


def _lattices(pieces: Pieces, held: bool) -> Lattices:
    if not held:
        _held.clear()
        return Lattices(pieces, REMEMBERED // 3)
    if pieces.name not in _held:
        _held.clear()
        _held[pieces.name] = Lattices(pieces)
    return _held[pieces.name]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that are searched at once."""
    sizes = pc.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
    begin, held = 0, 0
    for r, size in enumerate(sizes):
        if r > begin and (r - begin >= BATCH_ROWS or held + size > BATCH_CHARS):
            yield batch.slice(begin, r - begin)
            begin, held = r, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def encode(docs: DataFrame, pieces: Pieces, k: int = K, seed: int = 0, check: bool = False, repeat: str | None = None, together: bool = False, held: bool = True) -> DataFrame:
    """(doc_id, text, maybe more) -> a row for each of up to k segmentations: doc_id, sample from 0 on in falling order of
    perturbed log-probability, ids, log_prob, perturbed, inclusion; with check also exact, whether ids give the text.

    A text with fewer segmentations gives all of them, an empty or null one a row without ids. Noise follows from
    doc_id, so rows that repeat get the same samples, unless repeat names a column that numbers them from 0 on:
    then they take k each in turn of the samples drawn without replacement, beginning anew where a text has no more,
    and inclusion is that among k samples for each row so far. With together, a text's rows are one, with an array
    samples after doc_id and what other columns docs has but for text and repeat; otherwise other columns are
    ignored. held: workers keep lattices from task to task, up to about 150 MB, which is faster; without it they keep a
    third as many, and none after a task. Texts are never cut; a very long one is searched alone, at about 50 bytes a character. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    keep = [f for f in docs.schema.fields if together and f.name not in ("doc_id", "text", repeat)]
    kept = [f"kept_{n}" for n in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, spelled = _lattices(shared.value, held), pa.array(shared.value.spelled, pa.binary())
        for part in itertools.chain.from_iterable(map(_parts, batches)):
            turns, rows, sizes, flat = part.column("turn").to_pylist(), [], [0], []
            which, ends = [], [0]
            texts = part.column("text").to_pylist()
            keys = [key_of(x, seed) for x in part.column("doc_id").to_pylist()]
            lattices.forget_if_full()
            found_all = top_k_many(texts, keys, [k * (t + 1) for t in turns], lattices)
            for r, (text, turn, found) in enumerate(zip(texts, turns, found_all, strict=True)):
                start = k * turn if k * turn < len(found) else turn % len(found)
                for s in range(start, start + min(k, len(found))):
                    s %= len(found)
                    ids, lp, g, inc = found[s]
                    flat.append(ids)
                    sizes.append(sizes[-1] + len(ids))
                    rows.append((s, lp, g, inc, None))
                    which.append(r)
                ends.append(len(which))
            columns = list(zip(*rows, strict=True))
            if check:
                want = [f" {t}".encode() if t else b"" for t in texts]
                columns[4] = [said == want[r] for r, said in zip(which, spelled_runs(np.concatenate(flat), sizes, spelled), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(which)), pa.array(columns[0], pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat))),
                 pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.bool_())],
                ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "exact"],
            )
            if together:
                names = [n for n in out.schema.names[1:] if check or n != "exact"]
                samples = pa.StructArray.from_arrays([out.column(n) for n in names], names)
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[part.column(n) for n in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), samples)], ["doc_id", *kept, "samples"]
                )
            yield out

    kind = docs.schema["doc_id"].dataType
    turn = (F.col(repeat) if repeat else F.lit(0)).cast("int")
    texts = docs.select("doc_id", text_or_empty().alias("text"), turn.alias("turn"), *[F.col(f"`{f.name}`").alias(n) for f, n in zip(keep, kept, strict=True)])
    ids = StructType.fromDDL("sample int, ids array<int>, log_prob double, perturbed double, inclusion double" + (", exact boolean" if check or not together else ""))
    if together:
        schema = StructType([StructField("doc_id", kind), *[StructField(n, f.dataType) for f, n in zip(keep, kept, strict=True)], StructField("samples", ArrayType(ids))])
        return texts.mapInArrow(run if held else trimmed(run), schema).toDF("doc_id", *[f.name for f in keep], "samples")
    rows = texts.mapInArrow(run, StructType([StructField("doc_id", kind), *ids.fields]))
    return rows if check else rows.drop("exact")


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds text, spelled by the column ids; null ids are no text."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(ids):
        return ids.map(lambda x: None if x is None else decode(x, shared.value.spelled))

    return rows.withColumn("text", F.pandas_udf(run, "string")("ids"))


def load(spark: SparkSession, path: str = MODEL) -> Pieces:
    return Pieces.load(path)
