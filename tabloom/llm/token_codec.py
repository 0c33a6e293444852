"""Adaptive context-mixing range coder for blocks of token ids.

Each block starts from an empty model. For every id three predictions are mixed: the id that last followed the two
ids before (order 2), the id that last followed the id before (order 1), and the ids of the block so far by their
frequency (order 0); an id that none of them knows is coded evenly over 16 bits. A decision says which prediction holds.
Its probabilities are the mixing weights; they adapt per situation (which predictions exist, whether they agree, whether
the last one held). The decision and, where needed, the id drive a carryless range coder with 16-bit output units.

Many blocks are coded side by side: one numpy step codes the next id of all blocks. The order-0 frequencies are taken
anew each time the block has grown by an eighth, so both sides know them before the ids that follow.
"""

from __future__ import annotations

import zlib

import numpy as np

U = np.uint64
UNIT, SECOND, MASK, LOW_END = U(16), U(32), U((1 << 48) - 1), U(1 << 16)
HIT2, HIT1, SEEN, NOVEL = range(4)
SLOTS = 1 << 14  # places of contexts of one block
LIMIT, STEP = 1 << 13, 24
ABSENT = 0xFFFF
FIRST_REFRESH = 64


class _Coder:
    """Range coder states of all lanes; lanes leave from the end."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=U)
        self.range = np.full(lanes, MASK, dtype=U)

    def narrow(self, at: np.ndarray | slice, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """Go to the part [start, start + size) of ranges that were divided into parts of `unit`. at: lanes, or the first ones."""
        low, wide = self.low[at] + start * unit, size * unit
        self.low[at], self.range[at] = low, wide
        settled = (low ^ (low + wide)) < (U(1) << SECOND)
        ready = np.flatnonzero(settled | (wide < LOW_END))
        while ready.size:
            lanes = ready if isinstance(at, slice) else at[ready]
            low, wide, settled = low[ready], wide[ready], settled[ready]
            # the leading unit is settled, or the range is too small to wait for that: it ends at the next unit border
            wide = np.where(settled, wide, (~low + U(1)) & (LOW_END - U(1))) << UNIT
            self.shift(lanes, low)
            low = (low << UNIT) & MASK
            self.low[lanes], self.range[lanes] = low, wide
            settled = (low ^ (low + wide)) < (U(1) << SECOND)
            ready = np.flatnonzero(settled | (wide < LOW_END))
            at = lanes

    def shift(self, at: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError


class _Encoder(_Coder):
    def __init__(self, lanes: int, longest: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, 3 * longest + 8), dtype=np.uint16)
        self.used = np.zeros(lanes, dtype=np.int64)

    def shift(self, at: np.ndarray, low: np.ndarray) -> None:
        self.out[at, self.used[at]] = (low >> SECOND).astype(np.uint16)
        self.used[at] += 1

    def finish(self) -> list[bytes]:
        at = np.arange(len(self.low))
        for _ in range(3):
            self.shift(at, self.low)
            self.low = (self.low << UNIT) & MASK
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.out, self.used, strict=True)]


class _Decoder(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        sizes = [len(p) // 2 for p in payloads]
        self.units = np.zeros((len(payloads), max(sizes) + 4), dtype=U)
        for row, p, n in zip(self.units, payloads, sizes, strict=True):
            row[:n] = np.frombuffer(p, dtype="<u2")
        self.code = (self.units[:, 0] << SECOND) | (self.units[:, 1] << UNIT) | self.units[:, 2]
        self.used = np.full(len(payloads), 3)

    def target(self, at: np.ndarray | slice, unit: np.ndarray) -> np.ndarray:
        return (self.code[at] - self.low[at]) // unit

    def shift(self, at: np.ndarray, low: np.ndarray) -> None:
        self.code[at] = ((self.code[at] << UNIT) & MASK) | self.units[at, self.used[at]]
        self.used[at] += 1


class _Model:
    """Predictions and weights of all lanes. Tables are flat; `lane` has where a lane's part begins."""

    def __init__(self, lanes: int, longest: int):
        self.next1 = np.full(lanes * SLOTS, ABSENT, dtype=np.uint16)
        self.next2 = np.full(lanes * SLOTS, ABSENT, dtype=np.uint16)
        self.edges = np.tile(np.arange(1, 5, dtype=np.int32)[:, None], (1, lanes * 8))  # cumulative weights of the decisions
        self.ids = np.zeros((lanes, longest), dtype=np.uint16)
        self.history = np.zeros((lanes, longest), dtype=np.uint16)  # the ids so far, in order
        self.first = np.zeros((lanes, longest), dtype=np.uint16)  # of each place in it, where its id begins
        self.count = np.zeros((lanes, longest), dtype=np.uint16)  # and how often it is there
        self.known = 0
        self.lane = np.arange(lanes)
        self.before1 = np.zeros(lanes, dtype=np.int64)
        self.before2 = np.zeros(lanes, dtype=np.int64)
        self.held = np.zeros(lanes, dtype=np.int64)

    def refresh(self, n: int, lanes: int) -> None:
        """Order-0 frequencies of the first n ids."""
        h = np.sort(self.ids[:lanes, :n], axis=1, kind="stable")
        new = np.ones((lanes, n), dtype=bool)
        new[:, 1:] = h[:, 1:] != h[:, :-1]
        begins = np.flatnonzero(new)  # of the runs of equal ids, lane after lane
        sizes = np.diff(np.append(begins, lanes * n))
        self.history[:lanes, :n] = h
        self.first[:lanes, :n] = np.repeat(begins % n, sizes).reshape(lanes, n)
        self.count[:lanes, :n] = np.repeat(sizes, sizes).reshape(lanes, n)
        self.known = n

    def predict(self, n: int) -> None:
        """Predictions and weights for the next id of the first n lanes."""
        lane, one, two = self.lane[:n], self.before1[:n], self.before2[:n]
        self.slot1 = lane * SLOTS + ((one * 0x9E3779B1 >> 9) & (SLOTS - 1))
        self.slot2 = lane * SLOTS + (((two * 40503 + one) * 0x9E3779B1 >> 7) & (SLOTS - 1))
        self.p1, self.p2 = self.next1[self.slot1], self.next2[self.slot2]
        situation = (self.p2 != ABSENT) * np.int64(4) + (self.p1 != self.p2) * np.int64(2)
        self.at = lane * 8 + situation + self.held[:n]
        self.e0, self.e1, self.e2, self.e3 = (e[self.at] for e in self.edges)

    def part(self, decision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of a decision."""
        start = np.where(decision == 0, 0, np.where(decision == 1, self.e0, np.where(decision == 2, self.e1, self.e2)))
        end = np.where(decision == 0, self.e0, np.where(decision == 1, self.e1, np.where(decision == 2, self.e2, self.e3)))
        return start.astype(U), (end - start).astype(U)

    def learn(self, step: int, ids: np.ndarray, decision: np.ndarray) -> None:
        n = len(ids)
        self.ids[:n, step] = ids
        self.next1[self.slot1] = ids
        self.next2[self.slot2] = ids
        for k, (e, old) in enumerate(zip(self.edges, (self.e0, self.e1, self.e2, self.e3), strict=True)):
            e[self.at] = old + STEP * (decision <= k)
        big = self.at[self.e3 > LIMIT]
        if big.size:  # halve all weights, none to zero
            weights = (np.diff(self.edges[:, big], axis=0, prepend=0) + 1) // 2
            self.edges[:, big] = np.cumsum(weights, axis=0)
        self.before2[:n] = self.before1[:n]
        self.before1[:n] = ids
        self.held[:n] = decision <= HIT1


def _refreshes(longest: int) -> set[int]:
    out, n = set(), FIRST_REFRESH
    while n < longest:
        out.add(n)
        n += max(FIRST_REFRESH, n // 8)
    return out


def _open(lengths: list[int], model: _Model, step: int, refreshes: set[int], active: int) -> int:
    while active and lengths[active - 1] <= step:
        active -= 1
    if step in refreshes:
        model.refresh(step, active)
    return active


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of 16-bit ids. Any number of blocks; lengths may differ and be 0. The id 65535 is not allowed."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = [len(blocks[i]) for i in order]
    longest = lengths[0] if lengths else 0
    model, coder = _Model(len(order), longest), _Encoder(len(order), longest)
    ids = np.zeros((len(order), longest), dtype=np.uint16)
    for row, i in zip(ids, order, strict=True):
        row[: len(blocks[i])] = blocks[i]
    place = np.full((len(order), longest), -1, dtype=np.int32)  # of each id in the history it is coded with
    stops = sorted(_refreshes(longest))
    refreshes, active = set(stops), len(order)
    for step in range(longest):
        active = _open(lengths, model, step, refreshes, active)
        if step in refreshes:
            until = next((x for x in stops if x > step), longest)
            for lane in range(active):
                own = model.history[lane, :step]
                at = np.minimum(np.searchsorted(own, ids[lane, step:until]), step - 1)
                place[lane, step:until] = np.where(own[at] == ids[lane, step:until], at, -1)
        model.predict(active)
        x, where = ids[:active, step], place[:active, step]
        decision = np.where(x == model.p2, HIT2, np.where(x == model.p1, HIT1, np.where(where >= 0, SEEN, NOVEL)))
        coder.narrow(slice(0, active), *model.part(decision), coder.range[:active] // model.e3.astype(U))
        at = np.flatnonzero(decision >= SEEN)
        if at.size:
            p, own = where[at], x[at]
            seen = p >= 0
            if model.known:
                start, size = np.where(seen, model.first[at, p], own).astype(U), np.where(seen, model.count[at, p], 1).astype(U)
            else:
                start, size = own.astype(U), np.ones(len(at), dtype=U)
            coder.narrow(at, start, size, coder.range[at] // np.where(seen, U(max(model.known, 1)), U(1 << 16)))
        model.learn(step, x, decision)
    back = [b""] * len(order)
    for i, p in zip(order, coder.finish(), strict=True):
        back[i] = p
    return back


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of the blocks."""
    order = sorted(range(len(payloads)), key=lambda i: -sizes[i])
    lengths = [sizes[i] for i in order]
    if not order:
        return []
    model, coder = _Model(len(order), lengths[0]), _Decoder([payloads[i] for i in order])
    refreshes, active = _refreshes(lengths[0]), len(order)
    for step in range(lengths[0]):
        active = _open(lengths, model, step, refreshes, active)
        model.predict(active)
        lanes = slice(0, active)
        unit = coder.range[lanes] // model.e3.astype(U)
        target = coder.target(lanes, unit).astype(np.int64)
        decision = (target >= model.e0).astype(np.int64) + (target >= model.e1) + (target >= model.e2)
        coder.narrow(lanes, *model.part(decision), unit)
        x = np.where(decision == HIT2, model.p2, model.p1)
        at = np.flatnonzero(decision >= SEEN)
        if at.size:
            seen = decision[at] == SEEN
            total = np.where(seen, U(max(model.known, 1)), U(1 << 16))
            unit = coder.range[at] // total
            target = np.minimum(coder.target(at, unit), total - U(1)).astype(np.int64)
            p = np.where(seen, target, 0)
            x[at] = np.where(seen, model.history[at, p], target)
            coder.narrow(at, np.where(seen, model.first[at, p], target).astype(U), np.where(seen, model.count[at, p], 1).astype(U), unit)
        model.learn(step, x, decision)
    back: list = [None] * len(order)
    for row, (i, n) in enumerate(zip(order, lengths, strict=True)):
        back[i] = model.ids[row, :n].copy()
    return back


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def joined_checksum(first: int, second: int, n_second: int) -> int:
    """CRC-32 of two stretches of ids from their own CRCs (a CRC is affine in what it starts from)."""
    zeros = bytes(4 * n_second)
    return zlib.crc32(zeros, first) ^ second ^ zlib.crc32(zeros)
