"""Most similar vectors for every vector, exactly; and windows on shifted space-filling curves.

An index is fitted on a bounded sample: principal directions of the (for sparse vectors, sign-projected)
unit vectors, several random rotations of them, and for each a random shift, the quantiles of the rotated
directions and a draw of landmarks. A Hilbert curve through the quantile cells orders the landmarks; a
vector's key is the place of its nearest landmark, then its own place on the curve, so that themes stay
together however thin their slice of the space is. A curve is range-partitioned into slots at quantiles of
the sample's keys. Many vectors of one key (a third of all may point one way) are spread over the slots
their key spans, so that slots stay bounded; collections of more than ``MANY_COPIES`` vectors of equal
direction take part with one member only, and the others' neighbours follow from it without a comparison.

``neighbours`` is exact. The slots of one curve are blocks, written once to the shared folder and cut into
cells of similar vectors, each with its centre and radius. A task takes some rows of a block through all
blocks, its own first: cells that by the triangle inequality of angles hold nothing as near as a row's
``k``-th best so far, or the limit, are left out, and so are rows there that by the same rule cannot be near any
of the row's own cell (cells of stragglers are wide, those of themes are not); the others are compared by matrix products. These screen
upper bounds (of sparse vectors the products of the lengths of their parts in groups of terms); what passes
is computed in double precision. Sparse vectors whose leading terms few others have meet only those: what
follows these terms is too short to be as near as the floor by itself. Dense vectors far from all others
meet each other, and common terms grow with the collection, so work grows with the square of their number.

``links`` goes through the same blocks, two of them once, for pairs that connect what all pairs at or above a
limit connect, also exact.

``_best`` compares along a curve only: each block of vectors by matrix products with the ``window`` vectors
around it, so that work is linear in the collection. The hierarchy's neighbour graph (``clusters``) is made of it, on four curves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import Scratch

#: Vectors the index is fitted on, about: one of ``RARE``, within these bounds.
SAMPLE, MAX_SAMPLE, RARE = 16_000, 200_000, 500
#: Vectors of equal direction beyond which a class of copies is represented by its smallest member.
MANY_COPIES = 64
#: Largest number of such classes that is broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
BLOCK = 512
#: Vectors a vector is compared with on a curve, half of them before and half after it.
WINDOW = 4096
#: Windows a slot holds, about.
SPAN = 4
#: One landmark stands for about so many vectors; bounds of their number.
PER_LANDMARK, MIN_LANDMARKS, MAX_LANDMARKS = 160, 64, 4096
#: Bits of a curve's cell coordinate.
BITS = 6
#: Groups of terms by which sparse vectors are screened.
GROUPS = 128
#: Terms that screen by themselves where rows meet one another only.
ALONE = 128
#: Rows a cell of a block holds at most, the similarity to the mean below which rows stand apart and groups are no family, and tasks a small collection is cut into.
CELL, TIGHT, TASKS = 256, 0.7, 32
#: Radius of a cell beyond which its rows are stragglers.
WIDE = 1.0
#: How much dearer than a pair of a matrix product an entry is that is looked up by a shared term, and the length left behind a row's leading terms, of its floor.
SHARED, HEAD = 5, 0.8
#: Columns, and pairs, that are linked at once.
LINKED = 8192
#: How far a screened similarity and an angle may be off by rounding.
ROUNDING, TURN = 1e-5, 3e-3


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, for signs that depend on the term id only."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of +-1 / sqrt(width) for term ids, ``width`` a multiple of 64."""
    words = np.stack([splitmix(terms.astype(np.uint64) * np.uint64(width) + np.uint64(i)) for i in range(width // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(terms), -1), axis=1)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(width))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points ``cells`` (n x m) with ``bits`` bits a coordinate, m * bits <= 62."""
    x = cells.T.astype(np.int64).copy()
    m = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[m - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of n vertices joined by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def spanning(n: int, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Which edges make a maximum spanning forest (ties: the earlier edge), by Borůvka's rounds."""
    order = np.argsort(-sim, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    label, kept, alive = np.arange(n), np.zeros(len(a), dtype=bool), order
    while True:
        u, w = label[a[alive]], label[b[alive]]
        apart = u != w
        if not apart.any():
            return kept
        alive, u, w = alive[apart], u[apart], w[apart]
        best = np.full(n, len(order))
        np.minimum.at(best, u, rank[alive])
        np.minimum.at(best, w, rank[alive])
        chosen = order[np.unique(best[best < len(order)])]
        kept[chosen] = True
        label = roots(n, label[a[chosen]], label[b[chosen]])[label]


@dataclass
class Sparse:
    """Rows of sparse vectors in flat arrays, scaled to unit length."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @cached_property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def project(self, width: int) -> np.ndarray:
        """Unit-length sign projections, float32."""
        distinct, at = np.unique(self.terms, return_inverse=True)
        table = signs(distinct, width)
        lengths = np.diff(self.starts)
        # Rows by falling length: the rows that have a j-th entry are then the first ones.
        order = np.argsort(-lengths, kind="stable")
        starts, falling = self.starts[:-1][order], lengths[order]
        weights = self.weights.astype(np.float32)
        out = np.zeros((len(lengths), width), dtype=np.float32)
        for lo in range(0, len(out), 1024):
            part, first = out[lo : lo + 1024], starts[lo : lo + 1024]
            for j in range(falling[lo]):
                n = int(np.searchsorted(-falling[lo : lo + 1024], -j, side="left"))
                part[:n] += table[at[first[:n] + j]] * weights[first[:n] + j, None]
        out[order] = out.copy()
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def screen(self) -> np.ndarray:
        """The lengths of a row's parts in ``GROUPS`` groups of terms, float32: by Cauchy and Schwarz their dot products are no smaller than the rows'."""
        rows = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        group = (splitmix(self.terms.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)
        out = np.empty((len(self.ids), GROUPS), dtype=np.float32)
        for lo in range(0, len(out), 4096):
            hi = min(len(out), lo + 4096)
            part = slice(self.starts[lo], self.starts[hi])
            out[lo:hi] = np.sqrt(np.bincount((rows[part] - lo) * GROUPS + group[part], self.weights[part] ** 2, minlength=(hi - lo) * GROUPS)).reshape(-1, GROUPS)
        return out

    def own_screen(self) -> np.ndarray:
        """A tighter ``screen`` for rows that meet one another only: the ``ALONE`` weightiest terms by themselves, signed, the others in ``GROUPS`` / 2 groups."""
        n, rest = len(self.ids), GROUPS // 2
        first = np.argsort(-np.bincount(self.places(self), np.nan_to_num(self.weights * self.weights)), kind="stable")[:ALONE]
        group = (splitmix(self.distinct.astype(np.uint64)) % np.uint64(rest)).astype(np.int64) + len(first)
        group[first] = np.arange(len(first))
        cell = self.rows * (rest + len(first)) + group[self.at]
        alone = group[self.at] < len(first)
        out = np.sqrt(np.bincount(cell, np.where(alone, 0, self.weights * self.weights), minlength=n * (rest + len(first)))).astype(np.float32)
        out[cell[alone]] = self.weights[alone]
        return out.reshape(n, -1)

    def dots(self, a: np.ndarray, b: np.ndarray, other: Sparse | None = None) -> np.ndarray:
        """Exact dot products of the rows a[i] and b[i] (of ``other``); ``a`` is sorted.

        The rows of ``a`` are spread over their own terms some at a time, the entries of ``b`` looked up there:
        what is held is bounded by ``SPREAD`` and ``ENTRIES`` beside the terms of one row.
        """
        out = np.zeros(len(a))
        if not len(a):
            return out
        other = self if other is None else other
        theirs_at = self.places(other)
        many = len(self.distinct)
        lengths, their_lengths = np.diff(self.starts), np.diff(other.starts)
        rows, place = np.unique(a, return_inverse=True)
        entries = np.cumsum(lengths[rows])
        ends = np.cumsum(their_lengths[b])
        local = np.zeros(many + 1, dtype=np.int64)
        lo = 0
        while lo < len(a):
            # As many pairs as have few enough rows and entries of a and entries of b, at least one.
            first = place[lo]
            together = int(np.searchsorted(entries, (entries[first - 1] if first else 0) + self.SPREAD // 100, side="right"))
            hi = int(np.searchsorted(place, max(first + 1, min(first + 100, together)), side="left"))
            hi = max(lo + 1, min(hi, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.ENTRIES, side="right"))))
            some = rows[first : place[hi - 1] + 1]
            n = lengths[some]
            mine = np.repeat(self.starts[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            used = np.unique(self.at[mine])
            local[used] = np.arange(1, len(used) + 1)
            spread = np.zeros((len(some), len(used) + 1))
            spread[np.repeat(np.arange(len(some)), n), local[self.at[mine]]] = self.weights[mine]
            n = their_lengths[b[lo:hi]]
            theirs = np.repeat(other.starts[b[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pair = np.repeat(np.arange(hi - lo), n)
            out[lo:hi] = np.bincount(pair, spread[(place[lo:hi] - first)[pair], local[theirs_at[theirs]]] * other.weights[theirs], minlength=hi - lo)
            local[used] = 0
            lo = hi
        return out

    def places(self, other: Sparse) -> np.ndarray:
        """The places of the terms of ``other``'s entries among the distinct ones here; terms that no row here has lead to the place after them."""
        if not hasattr(self, "distinct"):
            if len(self.terms) and self.terms.max() - self.terms.min() < self.ENTRIES:
                counts = np.bincount(self.terms - self.terms.min())
                self.distinct, self.at = np.flatnonzero(counts) + self.terms.min(), (np.cumsum(counts > 0) - 1)[self.terms - self.terms.min()]
            else:
                self.distinct, self.at = np.unique(self.terms, return_inverse=True)
        if other is self:
            return self.at
        if getattr(other, "met", None) is not self.distinct:
            many = len(self.distinct)
            if not many or not len(other.terms):
                met = np.full(len(other.terms), many)
            elif (low := min(self.distinct[0], other.terms.min())) + self.ENTRIES > max(self.distinct[-1], other.terms.max()):
                table = np.full(max(self.distinct[-1], other.terms.max()) - low + 1, many)
                table[self.distinct - low] = np.arange(many)
                met = table[other.terms - low]
            else:
                place = np.minimum(np.searchsorted(self.distinct, other.terms), many - 1)
                met = np.where(self.distinct[place] == other.terms, place, many)
            other.met, other.met_at = self.distinct, met
        return other.met_at

    def leading(self) -> np.ndarray:
        """The order of entries by rows and falling squared weight over the number of rows that have the term: few rows share a row's first ones (``heads``)."""
        n = np.bincount(self.places(self), minlength=1)
        return np.argsort(self.rows - 0.5 * np.nan_to_num(self.weights * self.weights) / n[self.at])

    def heads(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries head their row, and the length of what follows them, which is below ``floor``: beyond its products with a row's head a vector's similarity is no more than that."""
        if not hasattr(self, "rest"):
            squares = np.nan_to_num(self.weights * self.weights)
            before = np.r_[0, np.cumsum(squares)]
            self.rest = 1 - (before[:-1] - before[self.starts[:-1]][self.rows])
        on = self.rest >= (floor * floor)[self.rows]
        last = self.starts[:-1] + np.bincount(self.rows[on], minlength=len(self.ids))
        after = np.where(last < self.starts[1:], np.r_[self.rest, 0][last], 0)
        return on, np.sqrt(np.maximum(after, 0) + 1e-9)

    def sharing(self, other: Sparse, mine: np.ndarray, theirs: np.ndarray, least: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, row of ``other``) whose products in the terms that the entries ``mine`` and ``theirs`` have in common may add up to ``least`` of them or more.

        Products are added in bins that several pairs can have in common, ``BINS`` at a time: a sum can be too high, never too low.
        """
        at = self.places(other)[theirs]
        order = mine[np.argsort(self.at[mine], kind="stable")]
        count = np.bincount(self.at[mine], minlength=len(self.distinct) + 1)
        # A row that isn't of numbers must not empty the bins it shares with others.
        rows, weights, begin = self.rows[order], np.nan_to_num(np.abs(self.weights[order])), np.cumsum(count) - count
        some = np.flatnonzero(count[at])
        at, cols, their_weights = at[some], other.rows[theirs][some], np.nan_to_num(np.abs(other.weights[theirs][some]))
        n = count[at]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(at):
            # Whole rows of ``other``, at least one.
            done = ends[lo] - n[lo]
            hi = int(np.searchsorted(ends, done + self.BINS // 2, side="right"))
            hi = int(np.searchsorted(cols, cols[hi], side="left")) if hi < len(at) else hi
            hi = max(hi, int(np.searchsorted(cols, cols[lo], side="right")))
            m = n[lo:hi]
            e = np.repeat(begin[at[lo:hi]] - (ends[lo:hi] - m - done), m) + np.arange(ends[hi - 1] - done)
            i, j = rows[e], np.repeat(cols[lo:hi], m)
            bins = (i * 40503 + j * 2654435761) & (self.BINS - 1)
            sums = np.bincount(bins, weights[e] * np.repeat(their_weights[lo:hi], m), minlength=self.BINS)
            high = np.flatnonzero(sums[bins] >= least(i, j))
            yield np.divmod(np.unique(i[high] * len(other.ids) + j[high]), len(other.ids))
            lo = hi

    def screened(self, x: np.ndarray, other: Sparse, y: np.ndarray, mine: np.ndarray, theirs: np.ndarray, least: Callable, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``sharing`` pairs whose rows of the screens ``x`` and ``y`` reach the row's ``floor``, about ``ENTRIES`` / 4 at a time."""
        held, n = [], 0
        for i, j in self.sharing(other, mine, theirs, least):
            for lo in range(0, len(i), 32768):
                a, b = i[lo : lo + 32768], j[lo : lo + 32768]
                high = np.einsum("ij,ij->i", x[a], y[b]) >= floor[a]
                held.append((a[high], b[high]))
                n += len(held[-1][0])
            if n > self.ENTRIES // 4:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held)))

    def take(self, order: np.ndarray) -> Sparse:
        n = np.diff(self.starts)[order]
        starts = np.r_[0, np.cumsum(n)]
        entries = np.repeat(self.starts[order] - starts[:-1], n) + np.arange(n.sum())
        return Sparse(self.ids[order], starts, self.terms[entries], self.weights[entries])

    #: Numbers held at once: of the rows spread (a hundred at most, of so many entries together), and entries looked up.
    SPREAD, ENTRIES = 400_000, 4_000_000
    #: Bins for sums of products of pairs, a power of two.
    BINS = 1 << 16


@dataclass
class Dense:
    """Rows of dense vectors of unit length."""

    ids: np.ndarray
    unit: np.ndarray

    def project(self, width: int) -> np.ndarray:
        return self.unit.astype(np.float32)

    def screen(self) -> np.ndarray:
        return self.unit.astype(np.float32)

    def dots(self, a: np.ndarray, b: np.ndarray, other: Dense | None = None) -> np.ndarray:
        out = np.empty(len(a))
        theirs = (self if other is None else other).unit
        for lo in range(0, len(a), 65536):
            out[lo : lo + 65536] = np.einsum("ij,ij->i", self.unit[a[lo : lo + 65536]], theirs[b[lo : lo + 65536]])
        return out

    def take(self, order: np.ndarray) -> Dense:
        return Dense(self.ids[order], self.unit[order])


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, flat values) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(offsets) else np.array([])
    return (offsets - offsets[0]).astype(np.int64), flat


def unpack(table: pa.Table) -> Dense | Sparse:
    """The vectors of a batch with the columns (id, vec) or (id, terms, weights), scaled to unit length."""
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    if "vec" in table.column_names:
        starts, flat = _lists(table.column("vec"))
        width = int(np.diff(starts).max(initial=0))
        x = np.zeros((len(ids), width))
        lengths = np.diff(starts)
        x[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(starts[:-1], lengths)] = flat
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return Dense(ids, x / np.where(norm > 0, norm, 1))
    starts, terms = _lists(table.column("terms"))
    _, weights = _lists(table.column("weights"))
    weights = weights.astype(np.float64)
    rows = np.repeat(np.arange(len(ids)), np.diff(starts))
    norm = np.sqrt(np.bincount(rows, weights * weights, minlength=len(ids)))
    return Sparse(ids, starts, terms.astype(np.int64), weights / np.where(norm > 0, norm, 1)[rows])


@dataclass(frozen=True)
class Curves:
    """The fitted index: where each curve puts a vector."""

    centre: np.ndarray
    directions: list[np.ndarray]
    grids: list[np.ndarray]
    shifts: list[np.ndarray]
    landmarks: list[np.ndarray]
    borders: list[np.ndarray]

    def own(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Places of vectors on the Hilbert curve."""
        y = (x - self.centre) @ self.directions[curve]
        grid, shift = self.grids[curve], self.shifts[curve]
        rank = np.stack([np.searchsorted(grid[:, j], y[:, j]) for j in range(y.shape[1])], axis=1) / (len(grid) + 1)
        return hilbert(np.floor((rank + shift) / 2 * (1 << BITS)).astype(np.int64), BITS)

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Keys of vectors: the nearest landmark's number along the curve, then the vector's own place."""
        near = np.empty(len(x), dtype=np.int64)
        for lo in range(0, len(x), 4096):
            near[lo : lo + 4096] = (x[lo : lo + 4096] @ self.landmarks[curve].T).argmax(1)
        return (near << 48) | self.own(x, curve)

    def slots(self, keys: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Slots of keys; a key that several borders have in common is spread over its slots by the ids."""
        low = np.searchsorted(self.borders[curve], keys, side="left")
        high = np.searchsorted(self.borders[curve], keys, side="right")
        for i in np.flatnonzero(high > low):
            low[i] += zlib.crc32(str(ids[i]).encode()) % (high[i] - low[i] + 1)
        return low


def fit(sample: np.ndarray, total: int, slots: int, curves: int, dims: int = 8, span: int = 20, seed: int = 7) -> Curves:
    """Curves fitted on sampled vectors for a collection of ``total``: rotations of the leading directions, quantiles, landmarks, borders."""
    rng = np.random.RandomState(seed)
    centre = sample.mean(0)
    _, vectors = np.linalg.eigh(np.cov((sample - centre).T)) if len(sample) > 1 else (None, np.eye(sample.shape[1]))
    span = min(span, sample.shape[1])
    dims = min(dims, span)
    lead = vectors[:, ::-1][:, :span]
    out = Curves(centre.astype(np.float32), [], [], [], [], [])
    many = min(len(sample), max(MIN_LANDMARKS, min(MAX_LANDMARKS, total // PER_LANDMARK)))
    for c in range(curves):
        turn = np.linalg.qr(rng.normal(size=(span, span)))[0][:, :dims]
        out.directions.append((lead @ turn).astype(np.float32))
        y = (sample - centre) @ out.directions[c]
        out.grids.append(np.quantile(y, np.linspace(0, 1, 1025)[1:-1], axis=0).astype(np.float32))
        out.shifts.append(rng.uniform(0, 1, dims))
        marks = sample[rng.choice(len(sample), many, replace=False)]
        out.landmarks.append(marks[np.argsort(out.own(marks, c), kind="stable")].astype(np.float32))
        keys = np.sort(out.keys(sample, c))
        # Every other curve's borders lie between the first one's.
        at = (np.arange(1, slots) + (c % 2) * 0.5 - 0.25) / slots
        out.borders.append(keys[np.minimum(len(keys) - 1, (at * len(keys)).astype(int))] if slots > 1 else np.array([], dtype=np.int64))
    return out


def _passing(s: np.ndarray, peaks: np.ndarray, floor: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of ``s`` at or above the row's ``floor`` (and under ``below``), by rows; only chunks whose peak passes are looked into."""
    r, c = np.nonzero(peaks >= floor[:, None])
    inner = s.reshape(len(s), -1, peaks.shape[1])[r, :, c]
    high = inner >= floor[r, None]
    if below is not None:
        high &= inner < below[r, None]
    i, j = np.nonzero(high)
    return r[i], j * peaks.shape[1] + c[i]


#: Width of the sign projections of sparse vectors, for the curves.
PLACE = 128


def slack(similarity: np.ndarray | float, off: float) -> np.ndarray | float:
    """How much lower than ``similarity`` a pair of at least that may be screened, if screened ones are up to ``off`` times 1 - similarity squared too low."""
    return off * (1 - similarity * similarity) + 2e-6


def band(n: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column), ends exclusive, of blocks of rows and the columns their windows span together."""
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        yield lo, hi, max(0, lo - window // 2), min(n, hi + window // 2)


def _best(v: Dense | Sparse, x: np.ndarray, k: int, limit: float, off: float, wide: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, similarity) of the ``k`` best neighbours at or above ``limit`` of each row among the ``window`` rows around it.

    Block products give similarities lower by no more than ``slack`` of them. The largest ``wide`` of a row are
    computed exactly, then all others that may still be among its ``k`` best: those within the slack of the ``k``-th exact value, or of the limit where fewer reach it. Maxima of chunks of columns bound the
    ``wide``-th largest from below, so no row is sorted.
    """
    n = len(x)
    rows, cols, sims = [], [], []
    chunk = 32
    padded = np.concatenate([x, np.zeros((chunk, x.shape[1]), dtype=np.float32)])
    for lo, hi, first, last in band(n, window):
        last += -(last - first) % chunk  # whole chunks
        s = x[lo:hi] @ padded[first : min(last, n + chunk)].T
        m = hi - lo
        s[np.arange(m), np.arange(lo - first, hi - first)] = -2
        if last > n:
            s[:, n - first :] = -2
        # A chunk is every (n / chunk)-th column, so that the maximum runs over whole rows of numbers.
        peaks = s.reshape(m, chunk, -1).max(1)
        if peaks.shape[1] > wide:
            floor = np.partition(peaks, peaks.shape[1] - wide, axis=1)[:, peaks.shape[1] - wide] - 2e-6
        else:
            floor = np.full(m, -2.0)
        floor = np.maximum(floor, limit - slack(limit, off)).astype(np.float32)
        i, j = _passing(s, peaks, floor, None)
        j += first
        sim = np.round(v.dots(i + lo, j), 9)
        rows.append(i + lo)
        cols.append(j)
        sims.append(sim)
        # The k-th exact value so far decides what of the rest may still matter.
        order = np.lexsort((-sim, i))
        place = np.arange(len(i)) - np.searchsorted(i[order], np.arange(m))[i[order]]
        last = np.full(m, float(limit))
        kth = order[place == k - 1]
        last[i[kth]] = np.maximum(sim[kth], limit)
        r, c = _passing(s, peaks, np.minimum(floor, (last - slack(last, off)).astype(np.float32)), floor)
        c += first
        rows.append(r + lo)
        cols.append(c)
        sims.append(np.round(v.dots(r + lo, c), 9))
    a, b, sim = np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)
    keep = sim >= limit
    return _top(v, a[keep], b[keep], sim[keep], k)


def _top(v: Dense | Sparse, a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row ``a``; ties go to the smaller id."""
    rank = np.argsort(np.argsort(v.ids.astype(str), kind="stable"))
    order = np.lexsort((rank[b], -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.array([], dtype=bool)
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else a
    top = place < k
    return a[top], b[top], sim[top]


def _few(v: Dense | Sparse, x: np.ndarray, limit: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows left, row, greater or smaller row, similarity): all pairs at or above ``limit`` of the sparse rows that few rows share a leading term with, so few that a ``window`` is dearer; and the other rows.

    A pair stands here once, whether or not a window holds it. Entries must be in order of ``leading``.
    """
    none = np.array([], dtype=np.int64)
    if isinstance(v, Dense) or limit <= ROUNDING:
        return np.arange(len(x)), none, none, np.array([])
    floor = np.full(len(x), limit - ROUNDING, dtype=np.float32)
    head, after = v.heads(HEAD * floor)
    mine, need = np.flatnonzero(head), floor - after
    met = np.bincount(v.places(v), minlength=1)
    few = np.bincount(v.rows[mine], met[v.at[mine]], minlength=len(x)) * SHARED < min(window, len(x))
    codes = [np.minimum(i, j) * len(x) + np.maximum(i, j) for i, j in v.screened(x, v, x, mine[few[v.rows[mine]]], np.arange(len(v.terms)), lambda i, j: need[i], floor)]
    a, b = np.divmod(np.unique(np.concatenate([none, *codes])), len(x))
    a, b = a[a != b], b[a != b]
    sim = np.round(v.dots(a, b), 9)
    keep = sim >= limit
    return np.flatnonzero(~few), a[keep], b[keep], sim[keep]


def _unique(table: pa.Table) -> pa.Table:
    """The first row of each id."""
    ids = table.column("id").to_pylist()
    if len(set(ids)) == len(ids):
        return table
    seen: dict = {}
    for i, key in enumerate(ids):
        seen.setdefault(key, i)
    return table.take(pa.array(list(seen.values())))


def _id_type(df: DataFrame) -> str:
    return dict(df.dtypes)["id"]


def placed(vectors: DataFrame, total: int, window: int, curves: int, seed: int = 7) -> DataFrame:
    """``vectors`` (id and vec, or id, terms and weights) once per curve, with its ``key`` on it and the number of its ``slot``; ``total`` is how many there are."""
    spark = vectors.sparkSession
    rate = min(1.0, min(MAX_SAMPLE, max(SAMPLE, total // RARE)) / max(1, total))
    sampled = vectors if rate >= 1 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1)
    sample = unpack(sampled.toArrow())
    # A border needs several sampled keys on either side of it.
    count = max(1, min(round(total / (SPAN * window)), len(sample.ids) // 16))
    cast = spark.sparkContext.broadcast(fit(sample.project(PLACE), total, count, curves, seed=seed)) if len(sample.ids) else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            v = unpack(table)
            x = v.project(PLACE)
            for c in range(curves):
                keys = cast.value.keys(x, c)
                slot = cast.value.slots(keys, v.ids, c) + c * count
                yield from table.append_column("key", pa.array(keys)).append_column("slot", pa.array(slot.astype(np.int32))).to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(place, f"{schema}, key long, slot int")


def along(table: pa.Table) -> tuple[pa.Table, Dense | Sparse]:
    """A slot's rows and vectors in the order of their keys, each id once."""
    table = _unique(table)
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    order = np.lexsort((ids.astype(str), table.column("key").to_numpy()))
    table = table.take(pa.array(order))
    return table, unpack(table)


def _length(values: str) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def direction(vectors: DataFrame) -> Column:
    """A 64-bit hash of a vector's direction: its entries over its length, to six decimals, so that rounding to nine makes all of one hash alike."""
    values = "vec" if "vec" in vectors.columns else "weights"
    unit = F.transform(values, lambda x: F.floor(x.cast("double") / _length(values) * 1e6 + 0.5))
    return F.xxhash64(unit, *[c for c in vectors.columns if c == "terms"])


def _bearing(vectors: DataFrame) -> Column:
    """A coarse hash that vectors of one direction share (but for rounding at a bin's edge), at the cost of a few entries: the terms, or ratios of the first entries."""
    if "terms" in vectors.columns:
        return F.xxhash64("terms")
    ratio = [F.try_divide(F.get("vec", F.lit(i)).cast("double"), F.get("vec", F.lit(i + 1)).cast("double")) for i in (0, 2, 4)]
    return F.xxhash64(F.size("vec"), *[F.floor(F.log(F.abs(r)) * 1000) for r in ratio])


def _without_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """``vectors`` with one member of each class of more than ``MANY_COPIES`` of equal direction, those classes, and the number of vectors.

    The classes are ``(rep, h)``, ``h`` the hash of ``direction``. One pass counts vectors by a coarse hash;
    directions are computed only of vectors whose coarse hash that many share, names looked up only where
    such a class exists.
    """
    large = F.col("n") > MANY_COPIES
    rough = vectors.select(_bearing(vectors).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    total, alike = rough.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(large.cast("int")), F.lit(0))).first()
    if not alike:
        return vectors, None, total
    scratch = Scratch(vectors.sparkSession)
    coarse = rough.where(large).select("r")
    suspects = vectors.withColumn("r", _bearing(vectors)).join(F.broadcast(coarse) if alike <= MAX_BROADCAST else coarse, "r", "left_semi").drop("r")
    suspects = scratch.save(suspects.select("id", direction(vectors).alias("h")))
    many = scratch.save(suspects.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where(large).select("h", "rep"))
    size = many.count()
    if not size:
        return vectors, None, total
    h = direction(vectors)
    known = F.broadcast(many) if size <= MAX_BROADCAST else many
    kept = vectors.withColumn("h", h).join(known, "h", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("id")))
    return kept.select(*vectors.columns), many, total


def _blocked(table: pa.Table, limit: float | None = None) -> pa.Table:
    """A slot's rows in cells of similar ones, stragglers apart, each with its ``place``; the first row of a cell has its ``centre`` and ``radius``.

    With a ``limit`` each row has its ``part``, the place of the first row that pairs at or above the limit connect it with inside the block, and the ``links`` that do.
    """
    table, v = along(table)
    x = v.screen()
    n = len(x)
    # Groups about drawn rows, then about the groups' means.
    means = x[np.random.RandomState(7).choice(n, max(1, n // PER_LANDMARK), replace=False)]
    for _ in range(2):
        mark = (x @ means.T).argmax(1)
        by = np.argsort(mark, kind="stable")
        starts = np.flatnonzero(np.r_[True, mark[by][1:] != mark[by][:-1]])
        means = _unit(np.add.reduceat(x[by], starts, axis=0))
    mark = (x @ means.T).argmax(1)
    near = np.einsum("ij,ij->i", x, means[mark])
    # Groups in a chain from each to the most similar one left; similar ones are a family.
    alike = means @ means.T
    left, chain = np.ones(len(means), dtype=bool), [0]
    for _ in range(1, len(means)):
        left[chain[-1]] = False
        chain.append(int(np.where(left, alike[chain[-1]], -2).argmax()))
    place, family = np.empty(len(means), dtype=np.int64), np.empty(len(means), dtype=np.int64)
    place[chain] = np.arange(len(means))
    family[chain] = np.cumsum(np.r_[0, alike[chain[:-1], chain[1:]] < TIGHT])
    loose = near < TIGHT
    order = np.lexsort((-near, place[mark], loose))
    table, x = table.take(pa.array(order)), x[order]
    part = np.where(loose[order], -1, family[mark[order]])
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    begins = np.concatenate([np.arange(lo, hi, CELL) for lo, hi in zip(begins, np.r_[begins[1:], n])])
    centres: list = [None] * n
    radius = np.zeros(n)
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), n]):
        centre = _unit(x[lo:hi].mean(0, keepdims=True))[0]
        centre = centre if centre.any() else x[lo]
        centres[lo], radius[lo] = centre, np.arccos(np.clip((x[lo:hi] @ centre).min(), -1, 1))
    if isinstance(v, Sparse):
        lead = pa.array(v.take(order).leading())
        for c in ("terms", "weights"):
            lists = pa.concat_arrays(table.column(c).chunks)
            table = table.set_column(table.column_names.index(c), c, pa.ListArray.from_arrays(pa.array(_lists(lists)[0].astype(np.int32)), lists.flatten().take(lead)))
    table = table.drop_columns(["key"]).append_column("place", pa.array(np.arange(n, dtype=np.int32)))
    table = table.append_column("centre", pa.array(centres, type=pa.list_(pa.float32()))).append_column("radius", pa.array(radius))
    if limit is None:
        return table
    v = unpack(table)
    found = _Linked(v, x, 0, np.arange(n), limit)
    found.enter(None)
    cells = begins, radius[begins].astype(np.float32), np.stack([centres[lo] for lo in begins])
    _compare(found, v, x, np.r_[begins, n], found.needs(cells[2], cells[1]), True, cells)
    return table.append_column("part", pa.array(found.label.astype(np.int32))).append_column("links", found.lists(table.schema.field("id").type))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _stored(folder: str) -> pa.Table:
    """The rows of a folder of the shared file system, read by a task."""
    files, place = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
    found = [f.path for f in files.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, filesystem=files, partitioning=None) for f in sorted(found)])


class _Nearest:
    """The ``k`` nearest of some rows so far, at or above a limit; ties go to the smaller id."""

    def __init__(self, v: Dense | Sparse, x: np.ndarray, first: int, k: int, limit: float, wide: int):
        self.v, self.x, self.first, self.k, self.wide = v, x, first, k, wide
        self.least = np.full(len(x), float(limit))
        self.sims = np.full((len(x), k), -np.inf)
        self.ids = np.empty((len(x), k), dtype=object)

    def floor(self, rows: np.ndarray | slice) -> np.ndarray:
        """Screened similarities below this are of no use to a row."""
        return (self.least[rows] - ROUNDING).astype(np.float32)

    def needs(self, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(row, cell): whether a cell can hold a vector as near as a row's floor. Angles obey the triangle inequality."""
        reach = np.arccos(np.clip(self.floor(slice(None)), -1, 1)) + TURN
        return np.arccos(np.clip(self.x @ centres.T, -1, 1)) - radius <= reach[:, None]

    def wanted(self, cell: np.ndarray, radius: np.ndarray, centres: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(cell, row of another block): whether the rows here, each in its ``cell``, can have a vector as near as the lowest floor of the cell there."""
        lowest = np.full(len(radius), 1.0)
        np.minimum.at(lowest, cell, self.floor(slice(None)))
        reach = np.arccos(np.clip(lowest, -1, 1)) + TURN
        return ~(centres @ y.T < np.cos(np.minimum(np.pi, reach + radius)).astype(np.float32)[:, None])

    def meet(self, rows: np.ndarray, other: Dense | Sparse, y: np.ndarray, cols: np.ndarray, own: bool) -> None:
        """Compares ``rows`` with the rows ``cols`` of another block, or of the rows' ``own``."""
        m, n, chunk = len(rows), len(cols), 32
        s = self.x[rows] @ y[np.r_[cols, np.repeat(cols[:1], -n % chunk)]].T
        s[:, n:] = -2
        if own:
            at = np.minimum(np.searchsorted(cols, rows + self.first), n - 1)
            same = np.flatnonzero(cols[at] == rows + self.first)
            s[same, at[same]] = -2
        peaks = s.reshape(m, chunk, -1).max(1)
        floor = self.floor(rows)
        if not (peaks >= floor[:, None]).any():
            return
        # The best `wide` of a row first: their exact values raise its floor for the others.
        high = floor
        if peaks.shape[1] > self.wide:
            high = np.maximum(floor, np.partition(peaks, -self.wide, axis=1)[:, -self.wide])
        self.add(rows, other, cols, *_passing(s, peaks, high, None))
        self.add(rows, other, cols, *_passing(s, peaks, np.minimum(high, self.floor(rows)), high))

    def meet_sharing(self, rows: np.ndarray, other: Sparse, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compares the ``rows`` and the rows of another block that few share a leading term with, with those only; the others of either are left."""
        v, floor = self.v, self.floor(slice(None))
        every = np.arange(len(y))
        if not len(rows) or floor[rows].min() <= 0:
            return rows, every

        def meet(mine: np.ndarray, theirs: np.ndarray, least: Callable) -> None:
            for i, j in v.screened(self.x, other, y, mine, theirs, least, floor):
                self.add(np.arange(len(self.x)), other, every, i, j)

        on = np.zeros(len(self.x), dtype=bool)
        on[rows] = True
        head, after = v.heads(HEAD * floor)
        mine = np.flatnonzero(head & on[v.rows])
        met = np.bincount(v.places(other), minlength=len(v.distinct) + 1)
        few = np.bincount(v.rows[mine], met[v.at[mine]], minlength=len(on)) * SHARED < len(y)
        need = floor - after
        meet(mine[few[v.rows[mine]]], np.arange(len(other.terms)), lambda i, j: need[i])
        on &= ~few
        if not on.any():
            return np.flatnonzero(on), every
        head, after = other.heads(np.full(len(y), HEAD * floor[on].min()))
        mine, theirs = np.flatnonzero(on[v.rows]), np.flatnonzero(head)
        met = np.bincount(v.at[mine], minlength=len(v.distinct) + 1)
        few = np.bincount(other.rows[theirs], met[v.places(other)[theirs]], minlength=len(y)) * SHARED < on.sum()
        meet(mine, theirs[few[other.rows[theirs]]], lambda i, j: floor[i] - after[j])
        return np.flatnonzero(on), np.flatnonzero(~few)

    def add(self, rows: np.ndarray, other: Dense | Sparse, cols: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        order = np.argsort(i, kind="stable")
        i, j = i[order], cols[j[order]]
        sim = np.round(self.v.dots(rows[i], j, other), 9)
        # An id delivered twice may stand in two blocks.
        keep = (sim >= self.least[rows[i]]) & (other.ids[j] != self.v.ids[rows[i]])
        i, j, sim = i[keep], j[keep], sim[keep]
        if not len(i):
            return
        changed, i = np.unique(rows[i], return_inverse=True)
        old, place = np.nonzero(self.sims[changed] > -np.inf)
        i, sim, ids = np.r_[old, i], np.r_[self.sims[changed[old], place], sim], np.concatenate([self.ids[changed[old], place], other.ids[j]])
        order = np.lexsort((-sim, i))
        if ((i[order][1:] == i[order][:-1]) & (sim[order][1:] == sim[order][:-1])).any():
            order = np.lexsort((np.array(ids.tolist()), -sim, i))
            once = np.r_[True, (i[order][1:] != i[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
            order = order[once]
        i, sim, ids = i[order], sim[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(changed)))[i]
        top = place < self.k
        i, place = changed[i[top]], place[top]
        self.sims[changed], self.ids[changed] = -np.inf, None
        self.sims[i, place], self.ids[i, place] = sim[top], ids[top]
        self.least[changed] = np.maximum(self.least[changed], self.sims[changed, -1])

    def lists(self, kind: pa.DataType) -> pa.Table:
        rows, place = np.nonzero(self.sims > -np.inf)
        some, n = np.unique(rows, return_counts=True)
        near = pa.StructArray.from_arrays([pa.array(-self.sims[rows, place]), pa.array(self.ids[rows, place].tolist(), type=kind)], names=["s", "n"])
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        return pa.table({"id": pa.array(self.v.ids[some].tolist(), type=kind), "near": pa.ListArray.from_arrays(offsets, near)})


class _Linked(_Nearest):
    """Pairs at or above a limit that join some rows of a block to whatever such pairs join them to.

    ``label`` says which rows of the own block, and after them of the one entered, are known to be joined:
    pairs inside such a part are never computed, and of all others that are screened none is left out.
    """

    def __init__(self, v: Dense | Sparse, x: np.ndarray, first: int, part: np.ndarray, limit: float):
        super().__init__(v, x, first, 0, limit, 0)
        self.many, self.label, self.limit = len(part), part.astype(np.int64), limit
        self.found: list[tuple] = []

    def enter(self, part: np.ndarray | None) -> None:
        """Goes on to a block whose rows are joined as ``part`` says, or to the own one."""
        self.beyond = 0 if part is None else self.many
        self.label = self.label[: self.many] if part is None else np.r_[self.label[: self.many], part + self.many]

    def meet(self, rows: np.ndarray, other: Dense | Sparse, y: np.ndarray, cols: np.ndarray, own: bool) -> None:
        if own:
            cols = cols[cols > rows[0] + self.first]
        for lo in range(0, len(cols), LINKED):
            self._meet(rows, other, y, cols[lo : lo + LINKED])

    def _meet(self, rows: np.ndarray, other: Dense | Sparse, y: np.ndarray, cols: np.ndarray) -> None:
        mine, theirs = self.label[rows + self.first], self.label[cols + self.beyond]
        if (mine == mine[0]).all():
            cols = cols[theirs != mine[0]]
        elif (theirs == theirs[0]).all():
            rows = rows[mine != theirs[0]]
        s = self.x[rows] @ y[cols].T
        least = np.float32(self.limit - ROUNDING)
        high = s >= least
        some = np.flatnonzero(high.any(0))
        s, high, cols = s[:, some], high[:, some], cols[some]
        apart = lambda: self.label[rows + self.first][:, None] != self.label[cols + self.beyond]
        high &= apart()
        # Each column's most similar row first, again as long as that joins any; then whatever is still apart.
        while True:
            j = np.flatnonzero(high.any(0))
            i = np.where(high[:, j], s[:, j], -2).argmax(0)
            high[i, j] = False
            if not self.add(rows, other, cols, i, j):
                break
            high &= apart()
        self.add(rows, other, cols, *np.nonzero(high))

    def add(self, rows: np.ndarray, other: Dense | Sparse, cols: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
        """Whether some of these pairs join what was apart."""
        joined = False
        for lo in range(0, len(i), LINKED):
            a, b = rows[i[lo : lo + LINKED]], cols[j[lo : lo + LINKED]]
            apart = self.label[a + self.first] != self.label[b + self.beyond]
            order = np.flatnonzero(apart)
            order = order[np.argsort(a[order], kind="stable")]
            a, b = a[order], b[order]
            sim = np.round(self.v.dots(a, b, other), 9)
            near = np.flatnonzero(sim >= self.limit)
            if not len(near):
                continue
            a, b, sim = a[near], b[near], sim[near]
            u, w = self.label[a + self.first], self.label[b + self.beyond]
            # Of pairs that join the same only some that are needed.
            parts, at = np.unique(np.r_[u, w], return_inverse=True)
            kept = spanning(len(parts), at[: len(u)], at[len(u) :], sim)
            self.found.append((a[kept], other.ids[b[kept]], sim[kept]))
            least = np.arange(len(self.label))
            least[parts] = parts[roots(len(parts), at[: len(u)], at[len(u) :])]
            self.label = least[self.label]
            joined = True
        return joined

    def lists(self, kind: pa.DataType) -> pa.Array:
        """The links of each row."""
        rows, ids, sims = map(np.concatenate, zip(*self.found)) if self.found else (np.array([], dtype=np.int64), np.array([], dtype=object), np.array([]))
        order = np.argsort(rows, kind="stable")
        near = pa.StructArray.from_arrays([pa.array(sims[order]), pa.array(ids[order].tolist(), type=kind)], names=["s", "n"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(self.x)))].astype(np.int32)), near)


def _compare(found: _Nearest, other: Dense | Sparse, y: np.ndarray, begins: np.ndarray, need: np.ndarray, own: bool, cells: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Compares rows with the cells of a block that they ``need``, which begin at ``begins`` (its last is the number of rows), as far as ``cells`` (first rows, radius, centres) of the rows' own block need the rows there."""
    # Sparse rows with few that share a leading term meet those; the rest goes by cells.
    rest, left = np.arange(len(need)), np.ones(len(y), dtype=bool)
    if isinstance(other, Sparse):
        rest, cols = found.meet_sharing(np.flatnonzero(need.any(1)), other, y)
        left = np.isin(np.arange(len(y)), cols)
    if not len(rest) or not left.any():
        return
    mine = np.searchsorted(cells[0], np.arange(len(need)) + found.first, side="right") - 1
    wanted = found.wanted(mine, cells[1], cells[2], y)
    # Stragglers have little in common but their need of other stragglers: each other cell meets those that need it.
    loose = cells[1][mine[rest]] > WIDE
    apart, every = rest[loose], []
    some = wanted[np.unique(mine[apart])].any(0) & left
    for c in np.flatnonzero(need[apart].any(0)):
        cols = begins[c] + np.flatnonzero(some[begins[c] : begins[c + 1]])
        rows = apart[need[apart, c]]
        if 2 * len(rows) > len(apart):
            every.append(cols)
        elif len(cols):
            for lo in range(0, len(rows), BLOCK):
                found.meet(rows[lo : lo + BLOCK], other, y, cols, own)
    every = np.concatenate(every) if every else apart[:0]
    if len(every):
        for lo in range(0, len(apart), BLOCK):
            found.meet(apart[lo : lo + BLOCK], other, y, every, own)
    # Rows that need most cells apart from the others; rows that need nothing are left out, cells and rows of theirs that no row of some needs too.
    rest = rest[~loose]
    order = rest[np.argsort(need[rest].mean(1) > 0.5, kind="stable")]
    for first in range(0, len(order), BLOCK):
        rows = np.sort(order[first : first + BLOCK])
        rows = rows[need[rows].any(1)]
        if len(rows):
            cols = np.concatenate([np.arange(begins[c], begins[c + 1]) for c in np.flatnonzero(need[rows].any(0))])
            cols = cols[(left & wanted[np.unique(mine[rows])].any(0))[cols]]
            if len(cols):
                found.meet(rows, other, y, cols, own)


@dataclass(frozen=True)
class Blocks:
    """A collection cut into blocks in the shared folder, and the summary of their cells."""

    folder: str
    summary: str
    slots: list[int]
    parts: int

    def read(self, slot: int) -> tuple[pa.Table, Dense | Sparse, np.ndarray]:
        """A block's rows in order, their vectors and what screens them."""
        table = _stored(f"{self.folder}/slot={slot}")
        table = table.take(pa.array(np.argsort(table.column("place").to_numpy())))
        v = unpack(table)
        return table, v, v.screen()

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each cell's slot, first row, radius and centre."""
        known = _stored(self.summary)
        known = known.take(pa.array(np.lexsort((known.column("place").to_numpy(), known.column("slot").to_numpy()))))
        of = known.column("slot").to_numpy()
        return of, known.column("place").to_numpy(), known.column("radius").to_numpy().astype(np.float32), _lists(known.column("centre"))[1].reshape(len(of), -1)


def _blocks(vectors: DataFrame, total: int, window: int, seed: int, scratch: Scratch, limit: float | None = None) -> tuple[DataFrame, Blocks]:
    """``vectors`` along one curve as ``_blocked`` gives them, written once."""
    columns = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    schema = f"{columns}, slot int, place int, centre array<float>, radius double"
    if limit is not None:
        schema += f", part int, links array<struct<s: double, n: {_id_type(vectors)}>>"
    blocks = placed(vectors, total, window, 1, seed).groupBy("slot").applyInArrow(lambda t: _blocked(t, limit), schema)
    blocks = scratch.save(blocks, by="slot")
    cells = scratch.save(blocks.where("centre IS NOT NULL").select("slot", "place", "centre", "radius").coalesce(1))
    slots = [r.slot for r in cells.select("slot").distinct().orderBy("slot").collect()]
    return blocks, Blocks(scratch.paths[id(blocks)], scratch.paths[id(cells)], slots, max(1, min(4, TASKS // max(1, len(slots)))))


def links(vectors: DataFrame, limit: float, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """``(a, b, similarity)``: pairs at or above ``limit`` that connect exactly what all such pairs connect; ``vectors`` as in ``neighbours``.

    Blocks join their own rows as they are written; every two blocks meet once, and what is joined already
    is not compared again. Large classes of copies take part with one member, to which the others are linked.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    own, many, total = _without_copies(vectors)
    kind = _id_type(vectors)
    blocks, stored = _blocks(own, total, window, seed, scratch, limit)
    slots, parts = stored.slots, stored.parts

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                me, part = divmod(task, parts)
                of, begin, radius, centres = stored.cells()
                # Half of the others, so that every two meet once; of an even number the opposite one meets the first half.
                half = (len(slots) - 1) // 2 + (len(slots) % 2 == 0 and me < len(slots) // 2)
                others = [slots[(me + d) % len(slots)] for d in range(1, half + 1)]
                if not others:
                    continue
                table, v, x = stored.read(slots[me])
                lo, hi = len(x) * part // parts, len(x) * (part + 1) // parts
                found = _Linked(v.take(np.arange(lo, hi)), x[lo:hi], lo, table.column("part").to_numpy(), limit)
                mine = of == slots[me]
                cells = begin[mine], radius[mine], centres[mine]
                for at in others:
                    need = found.needs(centres[of == at], radius[of == at])
                    if need.any():
                        theirs, other, y = stored.read(at)
                        found.enter(theirs.column("part").to_numpy().astype(np.int64))
                        _compare(found, other, y, np.r_[begin[of == at], len(y)], need, False, cells)
                ids = table.column("id").combine_chunks().slice(lo, hi - lo)
                yield pa.record_batch([ids, found.lists(table.schema.field("id").type)], names=["id", "links"])

    tasks = len(slots) * parts
    across = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(search, f"id {kind}, links array<struct<s: double, n: {kind}>>")
    near = blocks.select("id", "links").unionByName(across).select("id", F.explode("links").alias("x"))
    edges = near.select(F.least("id", "x.n").alias("a"), F.greatest("id", "x.n").alias("b"), F.col("x.s").alias("similarity")).where("a <> b")
    if many is not None:
        alike = vectors.select("id", direction(vectors).alias("h")).join(F.broadcast(many) if many.count() <= MAX_BROADCAST else many, "h").where("id <> rep")
        edges = edges.unionByName(alike.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    return edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def neighbours(vectors: DataFrame, k: int = 5, limit: float = -1.0, window: int = WINDOW, curves: int = 4, seed: int = 7) -> DataFrame:
    """``(id, neighbour, similarity)``: the ``k`` most similar other vectors of each, at or above ``limit``.

    ``vectors`` has a non-null ``id`` and ``vec`` (array of numbers) or ``terms`` and ``weights``
    (parallel arrays). Rows that are null, empty or all zero must be left out before (``usable``);
    an id delivered twice counts once. Similarity is the cosine, exact, rounded to 9 decimals; ties go
    to the smaller id. Exact: what is not compared cannot be among the nearest. ``window`` only sets the
    size of the blocks; of the ``curves`` the first one orders them.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    own, many, total = _without_copies(vectors)
    wide = 2 * k
    kind = _id_type(vectors)
    _, stored = _blocks(own, total, window, seed, scratch)
    slots, parts = stored.slots, stored.parts

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                slot, part = slots[task // parts], task % parts
                of, begin, radius, centres = stored.cells()
                table, v, x = stored.read(slot)
                lo, hi = len(x) * part // parts, len(x) * (part + 1) // parts
                found = _Nearest(v.take(np.arange(lo, hi)), x[lo:hi], lo, k, limit, wide)
                mine = of == slot
                cells = begin[mine], radius[mine], centres[mine]
                # The own block first, then the others by their nearest cells: floors rise early.
                close = (centres[of == slot] @ centres.T).max(0)
                for at in sorted(slots, key=lambda b: (b != slot, -close[of == b].max())):
                    need = found.needs(centres[of == at], radius[of == at])
                    if not need.any():
                        continue
                    _, other, y = (table, v, x) if at == slot else stored.read(at)
                    begins = np.r_[begin[of == at], len(y)]
                    _compare(found, other, y, begins, need, at == slot, cells)
                yield from found.lists(table.schema.field("id").type).to_batches()

    tasks = len(slots) * parts
    lists = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(search, f"id {kind}, near array<struct<s: double, n: {kind}>>")
    if many is not None:
        lists = _with_copies(scratch.save(lists), vectors, many, k)
    # A vector's list, also if delivered twice, the copies' one and that of its representative.
    merged = lists.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return merged.select("id", F.explode("near").alias("x")).select("id", F.col("x.n").alias("neighbour"), (-F.col("x.s")).alias("similarity"))


def _with_copies(lists: DataFrame, vectors: DataFrame, many: DataFrame, k: int) -> DataFrame:
    """``lists`` completed by the members of large classes of copies.

    A member's nearest are the smallest other members, at similarity 1, and what the representative has;
    whoever has the representative as a neighbour has the class's k smallest members. The smallest k + 1 members of a class are
    found by a rank that Spark limits in each task before the shuffle.
    """
    from pyspark.sql import Window

    members = vectors.select("id", direction(vectors).alias("h")).distinct().join(F.broadcast(many) if many.count() <= MAX_BROADCAST else many, "h")
    order = Window.partitionBy("h").orderBy("id")
    first = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).groupBy("h", "rep").agg(F.array_sort(F.collect_list("id")).alias("first"))
    first = Scratch(vectors.sparkSession).save(first)
    alike = members.join(first.select("h", "first"), "h").select("id", F.transform(F.slice(F.filter("first", lambda x: x != F.col("id")), 1, k), lambda x: F.struct(F.lit(-1.0).alias("s"), x.alias("n"))).alias("near"))
    # Members share what their representative found outside the class: vectors of the same direction tie with copies.
    of_reps = lists.join(first.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), "near")
    of_reps = F.broadcast(of_reps) if first.count() <= MAX_BROADCAST else of_reps
    shared = members.where("id <> rep").join(of_reps, "rep").select("id", F.filter("near", lambda x: x["n"] != F.col("id")).alias("near"))
    flat = lists.select("id", F.explode("near").alias("x")).select("id", F.col("x.s").alias("s"), F.col("x.n").alias("n"))
    more = flat.join(first.select(F.col("rep").alias("n"), "first"), "n").select("id", F.transform(F.filter("first", lambda x: x != F.col("id")), lambda x: F.struct(F.col("s").alias("s"), x.alias("n"))).alias("near"))
    return lists.unionByName(alike).unionByName(shared).unionByName(more.select("id", F.slice("near", 1, k).alias("near")))


def usable(rows: DataFrame, run: str, record: str, *content: str) -> DataFrame:
    """The rows of the highest ``run`` whose id and arrays are not null, not empty and not all zero."""
    # One number: as a literal it reaches the scan and prunes row groups.
    current = rows.agg(F.max(run)).first()[0]
    kept = rows.where(F.col(run) == F.lit(current))
    some = F.col(record).isNotNull()
    for c in content:
        some &= F.col(c).isNotNull() & (F.size(c) > 0)
    kept = kept.where(some & F.exists(F.col(content[-1]), lambda x: (x != 0) & ~F.isnan(x)))
    return kept.select(F.col(record).alias("id"), *content)
