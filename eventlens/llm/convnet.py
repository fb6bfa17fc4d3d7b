"""A byte-level convolutional network in numpy: filter banks, max pooling, dense output.

A filter of width w answers, at each byte, the sum of one learned weight for each of the next
w input symbols, so scoring is table look-ups and additions. A symbol is a byte and, if asked
for, whether it ends a stretch that repeats what stood shortly before. Texts are laid out in cells of
``CELL`` bytes; a chunk is two neighbouring cells, so chunks overlap by half and cover the
whole text, while each byte is convolved once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CELL = 256
CHUNK = 2 * CELL
#: A byte repeats if it ends ``REPEAT`` bytes that equal those up to ``FAR`` bytes before.
REPEAT, FAR = 8, 40
SYMBOLS = 512
#: Cells convolved at a time when scoring.
GROUP = 32


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes of one text, or rows of texts, as input symbols."""
    repeats = np.zeros(data.shape, bool)
    for lag in range(1, min(FAR, data.shape[-1] - REPEAT) + 1):
        same = data[..., lag:] == data[..., :-lag]
        for step in (1, 2, 4):  # stretches of 2, 4 and 8
            same = same[..., step:] & same[..., :-step]
        repeats[..., lag + REPEAT - 1 :] |= same
    return data + (repeats & (data > 0)) * np.uint16(256)


@dataclass
class Bank:
    """``tables[j, symbol, filter]``: what a symbol adds to a filter that begins j before it."""

    tables: np.ndarray
    bias: np.ndarray

    @classmethod
    def of(cls, widths: dict[int, int], rng: np.random.Generator) -> tuple[Bank, np.ndarray]:
        """``widths[w]`` filters of each width w, and the mask of weights that they have."""
        most, count = max(widths), sum(widths.values())
        width = np.repeat(list(widths), list(widths.values()))
        mask = (np.arange(most)[:, None, None] < width).astype(np.float32)
        tables = rng.normal(0, 0.3, (most, SYMBOLS, count)).astype(np.float32) * mask
        return cls(tables, np.zeros(count, np.float32)), mask

    @property
    def reach(self) -> int:
        return len(self.tables) - 1

    def answers(self, data: np.ndarray, n: int, out: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Answers at the first ``n`` bytes of ``data``."""
        np.take(self.tables[0], data[:n], axis=0, out=out[:n], mode="clip")
        for j in range(1, len(self.tables)):
            np.take(self.tables[j], data[j : n + j], axis=0, out=part[:n], mode="clip")
            out[:n] += part[:n]
        return out[:n]

    def cells(self, data: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each cell of ``data`` (whole cells, then the reach)."""
        n = (len(data) - self.reach) // CELL
        most = np.empty((n, len(self.bias)), np.float32)
        out = np.empty((GROUP * CELL, len(self.bias)), np.float32)
        part = np.empty_like(out)
        for a in range(0, n, GROUP):
            b = min(n, a + GROUP)
            x = self.answers(data[a * CELL :], (b - a) * CELL, out, part).reshape(b - a, CELL, -1)
            while x.shape[1] > 1:
                half = x.shape[1] // 2
                x = np.maximum(x[:, :half], x[:, half:])
            most[a:b] = x[:, 0]
        return most + self.bias


def laid_out(data: np.ndarray, offsets: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole cells with at least ``reach`` zero bytes after each, and their first cells."""
    cells = np.maximum(1, -(-(np.diff(offsets) + reach) // CELL))
    first = np.concatenate([[0], np.cumsum(cells)])
    out = np.zeros(first[-1] * CELL + reach, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[first[i] * CELL : first[i] * CELL + b - a] = data[a:b]
    return out, first


def chunks_of(cells: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers of overlapping chunks: each cell with the next of its text; a lone cell is a chunk."""
    last = np.zeros(len(cells), bool)
    last[first[1:] - 1] = True
    joined = cells.copy()
    joined[:-1][~last[:-1]] = np.maximum(cells[:-1], cells[1:])[~last[:-1]]
    alone = np.diff(first) == 1
    keep = ~last
    keep[first[1:][alone] - 1] = True
    return joined[keep], np.concatenate([[0], np.cumsum(np.maximum(1, np.diff(first) - 1))])


def cut_chunks(text: bytes, most: int, reach: int) -> list[bytes]:
    """Up to ``most`` chunks spread evenly over a text, each with the bytes a filter may reach."""
    starts = np.linspace(0, max(0, len(text) - CHUNK), most if len(text) > CHUNK else 1).astype(int)
    size = CHUNK + reach
    return [text[s : s + size].ljust(size, b"\0") for s in np.unique(starts).tolist()]


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def batches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    for a in range(0, n, size):
        yield order[a : a + size]


@dataclass
class Net:
    """Filters, then a dense layer over what a text's chunks give.

    ``pool="document"``: the largest and the mean answer over all chunks make one vector.
    ``pool="chunk"``: each chunk is classified on its own and the probabilities are averaged.
    ``repeats``: whether symbols tell repeated bytes from others.
    """

    bank: Bank
    weights: np.ndarray
    offset: np.ndarray
    pool: str
    repeats: bool

    def features(self, chunks: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.maximum(chunks, 0)
        if self.pool == "chunk":
            return x
        mean = np.add.reduceat(x, at[:-1]) / np.diff(at)[:, None]
        return np.concatenate([np.maximum.reduceat(x, at[:-1]), mean], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class probabilities of each text."""
        laid, first = laid_out(data, offsets, self.bank.reach)
        laid = symbols(laid) if self.repeats else laid
        chunks, at = chunks_of(self.bank.cells(laid), first)
        p = softmax(self.features(chunks, at) @ self.weights + self.offset)
        if self.pool == "chunk":
            p = np.add.reduceat(p, at[:-1]) / np.diff(at)[:, None]
        return p

    @classmethod
    def trained(
        cls, texts: list[list[bytes]], labels: np.ndarray, classes: int, widths: dict[int, int], pool: str,
        repeats: bool, epochs: int = 6, steps: int = 350, size: int = 64, rate: float = 0.01, seed: int = 7,
    ) -> Net:
        """Fits to ``texts`` (chunks of each, see ``cut_chunks``) with class numbers ``labels``.

        ``epochs`` passes over them, or as many as ``steps`` updates need.
        """
        epochs = max(epochs, -(-steps * size // len(texts)))
        rng = np.random.default_rng(seed)
        bank, mask = Bank.of(widths, rng)
        f = len(bank.bias)
        inputs = f if pool == "chunk" else 2 * f
        net = cls(bank, rng.normal(0, 0.1, (inputs, classes)).astype(np.float32), np.zeros(classes, np.float32), pool, repeats)
        adam = Adam([bank.tables, bank.bias, net.weights, net.offset], rate)
        cells = np.arange(f)
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs)
            for rows in batches(len(texts), size, rng):
                own = [texts[i] for i in rows]
                at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                data = np.frombuffer(b"".join(c for x in own for c in x), np.uint8).reshape(at[-1], -1)
                data = symbols(data) if repeats else data
                x = sum(bank.tables[j][data[:, j : j + CHUNK]] for j in range(bank.reach + 1))
                place = x.argmax(axis=1)
                chunks = np.take_along_axis(x, place[:, None], axis=1)[:, 0] + bank.bias
                feats = net.features(chunks, at)
                truth = np.repeat(labels[rows], np.diff(at)) if pool == "chunk" else labels[rows]
                p = softmax(feats @ net.weights + net.offset)
                p[np.arange(len(p)), truth] -= 1
                p /= len(p)
                back = p @ net.weights.T
                if pool == "chunk":
                    d = back
                else:
                    counts = np.diff(at)
                    d = np.repeat(back[:, f:] / counts[:, None], counts, axis=0)
                    relu = np.maximum(chunks, 0)
                    top = np.repeat(np.maximum.reduceat(relu, at[:-1]), counts, axis=0)
                    d = d + (relu == top) * np.repeat(back[:, :f], counts, axis=0)
                d = d * (chunks > 0)
                tables = np.zeros_like(bank.tables)
                who = np.arange(len(data))[:, None]
                for j in range(bank.reach + 1):
                    np.add.at(tables[j], (data[who, place + j], cells), d)
                adam.step([tables * mask, d.sum(axis=0), feats.T @ p, p.sum(axis=0)])
        return net
