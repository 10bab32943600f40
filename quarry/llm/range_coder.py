"""A range coder for blocks of token ids, driven by mixed predictions of order 0 to 2.

A block is laid out as LANES runs of equal length that are coded side by side, one id of
each lane a step, so that a step is a few array operations however many lanes there are.
All lanes of a block share one adaptive model, which starts empty in every block:

- order 2: the id that last followed the two ids before, with a confidence of 0 to 7;
- order 1: the id that last followed the id before, with such a confidence;
- order 0: counts of the block's ids so far, and an escape for an id not seen yet.

The probability of an id is a weighted sum of what the three orders give it. The weights
depend on both confidences and on whether the first two orders agree; they are learnt as
shares of the orders that were right in that situation. An id is coded as the order that
predicts it (12 bits of precision), followed by the id itself for order 0 (18 bits).

All arithmetic is on integers, so that a block decodes alike on every machine. The coder
keeps 48 bits of each lane and gives out 16 at a time; carries are added up at the end.
"""

from __future__ import annotations

import numpy as np

LANES, LANE_LENGTH = 4_096, 256
_ORDER_BITS, _COUNT_BITS = 12, 18
_CODE_BITS, _WORD = 32, np.uint64(16)
_LEAST = np.uint64(1 << _CODE_BITS)
_MASK = np.uint64((1 << _CODE_BITS) - 1)
_U = np.uint64


class _Model:
    """Predictions for one id of each lane, and what is learnt from the ids that came.

    Arrays of two rows are of order 2 and of order 1. `table` has an id and its confidence, as id * 8 + confidence, after
    each hash of two ids and, from 2**PAIR_BITS on, after each id.
    """

    PAIR_BITS = 18
    #: Confidence after a prediction that was wrong (first 8) or right, for each confidence before.
    NEXT = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int32)
    #: The order by which an id is coded, by whether order 1 (1) and order 2 (2) predict it.
    ORDER = np.array([2, 1, 0, 0], np.int64)

    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.vocabulary = vocabulary
        self.escape_bits = max(1, int(vocabulary - 1).bit_length())
        self.table = np.zeros((1 << self.PAIR_BITS) + vocabulary + 1, np.int32)
        self.at = np.empty((2, lanes), np.int64)
        self.hits = np.ones((128, 4), np.int64)  # of each situation: order 2, order 1, order 0, not used
        self.bounds = np.zeros((128, 4), _U)  # where the intervals of the orders begin, and the end
        self.bounds[:, 3] = 1 << _ORDER_BITS
        self.counts = np.zeros(vocabulary + 1, np.int64)
        self.last = np.full(lanes, vocabulary, np.int64)
        self.before = np.full(lanes, vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.taken: list[np.ndarray] = []
        self.steps = 0
        self._weigh()
        self._count()

    def _weigh(self) -> None:
        """Shares of the orders in each situation, in units of 1 / 2**12, each at least one."""
        if self.taken:
            self.hits += np.bincount(np.concatenate(self.taken), minlength=512).reshape(128, 4)
            self.taken = []
        hits = self.hits[:, :3]
        share = 1 + hits[:, :2] * ((1 << _ORDER_BITS) - 3) // hits.sum(1, keepdims=True)
        self.bounds[:, 1:3] = np.cumsum(share, 1)
        self.flat = self.bounds.ravel()

    def _count(self) -> None:
        """Slots of the ids seen and of the escape, 2**18 together. An id not seen yet has the escape's."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary + 1)
            self.recent = []
        self.unseen = self.counts == 0
        room = (1 << _COUNT_BITS) - (self.vocabulary + 1 - int(self.unseen.sum())) - (1 << _COUNT_BITS - 7)
        size = np.where(self.unseen, 0, 1 + self.counts * room // max(1, int(self.counts.sum())))
        size[self.vocabulary] = (1 << _COUNT_BITS) - int(size.sum())
        start = np.cumsum(size) - size
        self._own = size
        size, start = size.astype(_U), start.astype(_U)
        self.size, self.start = np.where(self.unseen, size[-1], size), np.where(self.unseen, start[-1], start)
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(self.vocabulary + 1, dtype=np.int64), self._own)
        return self._slots

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids predicted by order 2 and 1, four times the situation) of each lane."""
        self.at[0] = ((self.before * 0x9E3779B1 + self.last * 0x85EBCA6B) & 0xFFFFFFFF) >> 32 - self.PAIR_BITS
        np.add(self.last, 1 << self.PAIR_BITS, out=self.at[1])
        held = self.table[self.at]
        self.guess, self.sure = held >> 3, held & 7
        situation = (self.sure[0] << 6) + (self.sure[1] << 3)
        situation += (self.guess[0] == self.guess[1]) * np.int32(4)
        self.situation = situation.astype(np.int64)
        return self.guess, self.situation

    def learn(self, ids: np.ndarray, right: np.ndarray, order: np.ndarray) -> None:
        """`right`: which of the two predictions were the id; `order`: that by which it was coded."""
        new = np.where(right | (self.sure > 1), self.guess, ids.astype(np.int32)) << 3
        new += self.NEXT[(right << 3) + self.sure]
        self.table[self.at] = new
        self.taken.append(self.situation + order)
        self.recent.append(ids)
        self.before, self.last = self.last, ids
        self.steps += 1
        if self.steps < 16 or self.steps % 8 == 0:
            self._weigh()
        if len(self.recent) >= min(64, 1 + self.steps // 2):
            self._count()


def _layout(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids; the last ids of the last lanes may be padding."""
    lanes = min(LANES, max(1, n // LANE_LENGTH))
    return lanes, -(-n // lanes)


def encoded(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of all lanes, number of each lane's words), 16-bit words, of a block of ids below `vocabulary`."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    lanes, steps = _layout(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 48) - 1, _U)
    out_lane, out_word = [], []

    def give() -> None:
        at = np.flatnonzero(wide < _LEAST)
        while len(at):
            here = low[at]
            out_lane.append(at.astype(np.uint16))
            out_word.append((here >> _U(_CODE_BITS)).astype(np.int64))  # a carry is its 17th bit
            low[at] = (here & _MASK) << _WORD
            wide[at] <<= _WORD
            at = at[wide[at] < _LEAST]

    for step in range(steps):
        now = columns[step]
        guess, situation = model.predict()
        right = guess == now
        order = model.ORDER[right[0] * 2 + right[1]]
        start = model.flat[situation + order]
        wide >>= _U(_ORDER_BITS)
        low += wide * start
        wide *= model.flat[situation + order + 1] - start
        plain = np.flatnonzero(order == 2)
        if len(plain):
            own = now[plain]
            unit = wide[plain] >> _U(_COUNT_BITS)
            low[plain] += unit * model.start[own]
            wide[plain] = unit * model.size[own]
            new = plain[model.unseen[own]]
            if len(new):
                give()
                unit = wide[new] >> _U(model.escape_bits)
                low[new] += unit * now[new].astype(_U)
                wide[new] = unit
        give()
        model.learn(now, right, order)
    last = (low + _MASK) >> _U(_CODE_BITS)  # a value within the lane's interval, the rest of it zeros
    lane = np.concatenate([*out_lane, np.arange(lanes, dtype=np.uint16)])
    word = np.concatenate([*out_word, last.astype(np.int64)])
    order = np.argsort(lane, kind="stable")
    lane, word = lane[order], word[order]
    while True:
        carry = word >> 16
        if not carry.any():
            break
        word &= 0xFFFF
        word[:-1] += carry[1:]  # a lane's first word never carries
    return word.astype(np.uint16), np.bincount(lane, minlength=lanes).astype(np.uint32)


def decoded(words: np.ndarray, sizes: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps = _layout(n)
    if len(sizes) != lanes or int(sizes.sum()) != len(words):
        raise ValueError("the block's lanes don't fit its number of ids")
    sizes = sizes.astype(np.int64)
    tail = 4  # zeros that a lane may read beyond its words
    at = np.cumsum(sizes + tail) - (sizes + tail)
    source = np.zeros(int(sizes.sum()) + tail * lanes, _U)
    source[np.arange(len(words)) + np.repeat(np.arange(lanes) * tail, sizes)] = words
    code = (source[at] << _U(32)) | (source[at + 1] << _U(16)) | source[at + 2]
    at += 3
    model = _Model(vocabulary, lanes)
    wide = np.full(lanes, (1 << 48) - 1, _U)
    out = np.empty((steps, lanes), np.int64)
    end = len(source) - 1

    def take() -> None:
        here = np.flatnonzero(wide < _LEAST)
        while len(here):
            code[here] = (code[here] << _WORD) | source[np.minimum(at[here], end)]
            at[here] += 1
            wide[here] <<= _WORD
            here = here[wide[here] < _LEAST]

    for step in range(steps):
        guess, situation = model.predict()
        wide >>= _U(_ORDER_BITS)
        value = code // wide
        order = (value >= model.flat[situation + 1]).astype(np.int64)
        order += value >= model.flat[situation + 2]
        start = model.flat[situation + order]
        code -= wide * start
        wide *= model.flat[situation + order + 1] - start
        now = np.where(order == 0, guess[0], guess[1]).astype(np.int64)
        plain = np.flatnonzero(order == 2)
        if len(plain):
            unit = wide[plain] >> _U(_COUNT_BITS)
            value = np.minimum(code[plain] // unit, _U((1 << _COUNT_BITS) - 1)).astype(np.int64)
            slot = model.slots()[value]
            code[plain] -= unit * model.start[slot]
            wide[plain] = unit * model.size[slot]
            now[plain] = slot
            new = plain[slot == vocabulary]
            if len(new):
                take()
                unit = wide[new] >> _U(model.escape_bits)
                now[new] = np.minimum(code[new] // unit, _U(vocabulary - 1)).astype(np.int64)
                code[new] -= unit * now[new].astype(_U)
                wide[new] = unit
        take()
        out[step] = now
        model.learn(now, guess == now, order)
    return np.ascontiguousarray(out.T).reshape(-1)[:n]
