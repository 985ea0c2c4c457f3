"""Adaptive context-mixing range coder for blocks of token ids, many blocks in lockstep.

Each block starts from nothing. The probability of an id is a mixture of four predictions:

- order 2: the id that last followed the last two ids, - order 1: the id that last followed the last id,
- order 0: the ids seen so far in the block, each by how often it was seen,
- ids not seen yet: small ids are likelier, as vocabularies stand in the order of their merges.

The weights of the mixture are learned: how often each prediction gave the id, counted for each pair of confidences of
orders 2 and 1 (how often in a row their cells were right) and over all. The first cut of the range picks the prediction
by its weight, the second the id by that prediction's probability. Ids are known by their place among the distinct ids of
the block; cumulated counts and weights are summed anew every ``PERIOD`` ids, and new ids join at the end at once. All
numbers are integers, so any machine decodes.

The same step runs for all blocks of a batch at once, as numpy operations over a row of blocks.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

BLOCK, BATCH, PERIOD = 4096, 1536, 64
CELL_BITS, ALPHABET, WEIGHT = 10, 1 << 16, 6
SENTINEL = 30_000  # above every sum of counts

_U = np.uint64
_FULL, _LOW, _32, _16 = _U(2**64 - 1), _U(2**32), _U(32), _U(0xFFFF)
_NEW = np.concatenate([[0], np.cumsum(1 + 140_000 // (np.arange(ALPHABET) + 64))]).astype(_U)  # cumulated weights of unseen ids


class _Writer:
    """Range coder over a row of blocks, in units of 32 bits; a carry goes back into units written before."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _FULL)
        self.units, self.at = np.zeros((lanes, steps * 2 + 8), np.uint32), np.zeros(lanes, np.int64)

    def cut(self, lanes: int) -> None:
        self.low, self.range, self.at = self.low[:lanes], self.range[:lanes], self.at[:lanes]

    def _carry(self, lanes: np.ndarray) -> None:
        back = self.at[lanes] - 1
        while len(lanes):
            self.units[lanes, back] += np.uint32(1)
            over = self.units[lanes, back] == 0
            lanes, back = lanes[over], back[over] - 1

    def narrow(self, first: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        r = self.range // total
        low = self.low + r * first
        self._carry(np.flatnonzero(low < self.low))
        self.low, self.range = low, r * size
        self.settle()

    def narrow_some(self, lanes: np.ndarray, first: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        r = self.range[lanes] // total
        old = self.low[lanes]
        low = old + r * first
        self._carry(lanes[low < old])
        self.low[lanes], self.range[lanes] = low, r * size

    def settle(self) -> None:
        lanes = np.flatnonzero(self.range < _LOW)
        if len(lanes):
            low = self.low[lanes]
            self.units[lanes, self.at[lanes]] = low >> _32
            self.at[lanes] += 1
            self.low[lanes] = low << _32
            self.range[lanes] <<= _32

    def end(self, lanes: np.ndarray) -> None:
        self.units[lanes, self.at[lanes]] = self.low[lanes] >> _32
        self.units[lanes, self.at[lanes] + 1] = self.low[lanes] & _U(0xFFFFFFFF)
        self.at[lanes] += 2


class _Reader:
    def __init__(self, units: np.ndarray) -> None:
        self.units, self.at = units, np.full(len(units), 2, np.int64)
        self.code, self.range = (units[:, 0].astype(_U) << _32) | units[:, 1], np.full(len(units), _FULL)

    def cut(self, lanes: int) -> None:
        self.code, self.range, self.at = self.code[:lanes], self.range[:lanes], self.at[:lanes]

    def settle(self) -> None:
        lanes = np.flatnonzero(self.range < _LOW)
        if len(lanes):
            self.code[lanes] = (self.code[lanes] << _32) | self.units[lanes, self.at[lanes]]
            self.range[lanes] <<= _32
            self.at[lanes] = np.minimum(self.at[lanes] + 1, self.units.shape[1] - 1)


class _Model:
    """Predictions and weights of a row of blocks, in places of distinct ids."""

    def __init__(self, lanes: int, distinct: int) -> None:
        self.width = 1 << (distinct + 3).bit_length()
        lane = np.arange(lanes)
        self.cells = [np.zeros(lanes << CELL_BITS, np.uint16) for _ in range(2)]  # place + 1, confidence above it
        self.events, self.overall = np.zeros((lanes * 16, 4), np.uint16), np.ones((lanes, 4), np.uint16)
        self.counts, self.cum = np.zeros(lanes * self.width, np.uint16), np.full(lanes * self.width, 2 * SENTINEL, np.uint16)
        self.counts[lane * self.width] = SENTINEL
        self.cum[lane * self.width] = 0
        self.n_seen = np.zeros(lanes, np.int64)
        self.before, self.last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.row, self.row16, self.row4, self.cell = lane * self.width, lane * 16, lane * 4, lane << CELL_BITS
        self.lanes = lanes

    def cut(self, lanes: int) -> None:
        for name in ("n_seen", "before", "last", "row", "row16", "row4", "cell"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.lanes = lanes

    def sum_up(self) -> None:
        n, w = self.lanes, int(self.n_seen.max(initial=0)) + 2
        counts, cum = self.counts.reshape(-1, self.width), self.cum.reshape(-1, self.width)
        np.cumsum(counts[:n, :w], axis=1, out=cum[:n, 1 : w + 1])
        f = np.cumsum(self.events[: 16 * n].reshape(n, 16, 4) * np.uint16(WEIGHT) + self.overall[:n, None, :], axis=2, dtype=np.uint64)
        self.weights = (f[..., 0] | (f[..., 1] << _U(16)) | (f[..., 2] << _32) | (f[..., 3] << _U(48))).reshape(-1)

    def predict(self) -> np.ndarray:
        """Cumulated weights of the predictions, 16 bits each: order 2, order 1, order 0, new."""
        one = self.last * np.uint32(0x9E3779B1)
        two = (one ^ self.before) * np.uint32(0x85EBCA6B)
        shift = np.uint32(32 - CELL_BITS)
        self.at = [(two >> shift) + self.cell, (one >> shift) + self.cell]
        held = [self.cells[k].take(self.at[k]) for k in range(2)]
        self.guess = [h & np.uint16(0x1FFF) for h in held]
        self.sure = [h >> np.uint16(13) for h in held]
        self.state = self.row16 + (self.sure[0] * np.uint16(4) + self.sure[1])
        return self.weights.take(self.state)

    def learn(self, place: np.ndarray, event: np.ndarray) -> None:
        """``place`` of each id (that of a new one is the number of ids seen before it)."""
        self.events.reshape(-1)[self.state * 4 + event] += np.uint16(1)
        self.overall.reshape(-1)[self.row4 + event] += np.uint16(1)
        new = np.flatnonzero(event == 3)
        if len(new):
            at = self.row[new] + place[new]
            self.counts[at] = 0
            self.counts[at + 1] = SENTINEL
            self.cum[at + 1] = self.cum[at] + np.uint16(1)
            self.cum[at + 2] = 2 * SENTINEL
            self.n_seen[new] += 1
        self.counts[self.row + place] += np.uint16(1)
        coded = (place + 1).astype(np.uint16)
        for k in range(2):
            sure = np.minimum(self.sure[k] + np.uint16(1), np.uint16(3)) * (self.guess[k] == coded)
            self.cells[k][self.at[k]] = coded | (sure << np.uint16(13))
        self.before, self.last = self.last, coded.astype(np.uint32)


def _cut_of(weights: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and size of each block's event among its cumulated weights."""
    shift = event.astype(_U) << _U(4)
    first = ((weights << _U(16)) >> shift) & _16
    return first, ((weights >> shift) & _16) - first


def _sum_now(t: int) -> bool:
    return t % PERIOD == 0 or t < PERIOD and t & (t - 1) == 0


def _alive(sizes: np.ndarray, step: int) -> int:
    """Blocks stand longest first."""
    return int(np.searchsorted(-sizes, -step, "left"))


def places_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a row a block: the place of each id among its distinct ids in order of first sight, and whether it is new."""
    n, steps = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, order, 1)
    first = np.ones((n, steps), bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    new = np.zeros((n, steps), bool)
    np.put_along_axis(new, order, first, 1)
    rank = np.cumsum(new, axis=1, dtype=np.int16) - np.int16(1)
    lead = np.maximum.accumulate(np.where(first, np.arange(steps, dtype=np.int16), np.int16(0)), axis=1)
    of_group = np.take_along_axis(np.take_along_axis(rank, order, 1), lead.astype(np.int64), 1)
    place = np.empty((n, steps), np.int16)
    np.put_along_axis(place, order, of_group, 1)
    return place, new


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of ids below 65,536, each of at most ``BLOCK`` ids, at most ``BATCH`` of them."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    steps, lanes = int(sizes.max(initial=0)), len(order)
    ids = np.zeros((lanes, steps), np.uint16)
    for row, i in enumerate(order):
        ids[row, : len(blocks[i])] = blocks[i]
    place, new = places_of(ids) if steps else (np.zeros((lanes, 0), np.int16), np.zeros((lanes, 0), bool))
    distinct = new.sum(1)
    ids, place, new = np.ascontiguousarray(ids.T), np.ascontiguousarray(place.T), np.ascontiguousarray(new.T)
    writer, model = _Writer(lanes, steps), _Model(lanes, int(distinct.max(initial=0)))
    lengths = np.zeros(lanes, np.int64)
    for t in range(steps + 1):
        alive = _alive(sizes, t)
        if alive < lanes:
            ended = np.arange(alive, lanes)
            writer.end(ended)
            lengths[ended] = writer.at[ended]
            writer.cut(alive)
            model.cut(alive)
            lanes = alive
        if not lanes:
            break
        if _sum_now(t):
            model.sum_up()
        x = place[t, :lanes].astype(np.int64)
        weights = model.predict()
        event = np.where(model.guess[0] == x + 1, 0, np.where(model.guess[1] == x + 1, 1, 2 + new[t, :lanes]))
        writer.narrow(*_cut_of(weights, event), weights >> _U(48))
        seen = np.flatnonzero(event == 2)
        if len(seen):
            at = model.row[seen] + x[seen]
            first = model.cum.take(at)
            size = model.cum.take(at + 1) - first
            total = model.cum.take(model.row[seen] + model.n_seen[seen])
            writer.narrow_some(seen, first.astype(_U), size.astype(_U), total.astype(_U))
        fresh = np.flatnonzero(event == 3)
        if len(fresh):
            own = ids[t, fresh].astype(np.int64)
            writer.narrow_some(fresh, _NEW[own], _NEW[own + 1] - _NEW[own], _NEW[-1])
        writer.settle()
        model.learn(x, event)
    out = [b""] * len(order)
    for row, i in enumerate(order):
        out[i] = np.uint16(distinct[row]).astype("<u2").tobytes() + writer.units[row, : lengths[row]].astype("<u4").tobytes()
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    if not payloads:
        return []
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    n = np.array([sizes[i] for i in order], np.int64)
    steps, lanes = int(n.max(initial=0)), len(order)
    units = np.zeros((lanes, max((len(p) for p in payloads), default=0) // 4 + 4), np.uint32)
    distinct = 0
    for row, i in enumerate(order):
        x = np.frombuffer(payloads[i], "<u4", offset=2)
        units[row, : len(x)] = x
        distinct = max(distinct, int.from_bytes(payloads[i][:2], "little"))
    reader, model = _Reader(units), _Model(lanes, distinct)
    known, out = np.zeros((lanes, distinct + 1), np.uint16), np.zeros((steps, lanes), np.int16)
    for t in range(steps):
        alive = _alive(n, t)
        if alive < lanes:
            reader.cut(alive)
            model.cut(alive)
            lanes = alive
        if _sum_now(t):
            model.sum_up()
        weights = model.predict()
        r = reader.range // (weights >> _U(48))
        at = reader.code // r
        event = (at >= weights & _16).astype(np.int64) + (at >= (weights >> _U(16)) & _16) + (at >= (weights >> _32) & _16)
        first, size = _cut_of(weights, event)
        reader.code -= r * first
        reader.range = r * size
        reader.settle()
        x = np.maximum(np.where(event == 0, model.guess[0], model.guess[1]).astype(np.int64) - 1, 0)
        seen = np.flatnonzero(event == 2)
        if len(seen):
            row = model.row[seen]
            total = model.cum.take(row + model.n_seen[seen]).astype(_U)
            r = reader.range[seen] // np.maximum(total, _U(1))
            code = reader.code[seen]
            at = np.minimum(code // r, total - _U(1)).astype(np.uint16)
            step, p = 1 << int(model.n_seen.max()).bit_length() >> 1, row
            while step:
                p = p + (model.cum.take(p + step) <= at) * step
                step >>= 1
            first = model.cum.take(p)
            reader.code[seen] = code - r * first
            reader.range[seen] = r * (model.cum.take(p + 1) - first)
            x[seen] = p - row
        fresh = np.flatnonzero(event == 3)
        if len(fresh):
            r = reader.range[fresh] // _NEW[-1]
            code = reader.code[fresh]
            own = np.searchsorted(_NEW, np.minimum(code // r, _NEW[-1] - _U(1)), "right") - 1
            reader.code[fresh] = code - r * _NEW[own]
            reader.range[fresh] = r * (_NEW[own + 1] - _NEW[own])
            x[fresh] = place = np.minimum(model.n_seen[fresh], distinct - 1)  # damaged blocks fail by their checksum
            known[fresh, place] = own
        reader.settle()
        out[t, :lanes] = x
        model.learn(x, event)
    ids = [np.zeros(0, np.uint16)] * len(order)
    for row, i in enumerate(order):
        ids[i] = known[row].take(out[: sizes[i], row])
    return ids


def checksum(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())
