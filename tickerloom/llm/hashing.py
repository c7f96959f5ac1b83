"""64-bit hashes of all words of many texts at once, and of runs of words."""

from __future__ import annotations

import numpy as np

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: An odd number, so that its powers have inverses modulo 2^64.
BASE = 0xD6E8FEB86659FD93
#: A number for each byte, the same for both cases of A to Z; 0 for what separates words.
CODES = np.random.default_rng(64).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES[ord("A") : ord("Z") + 1] = CODES[ord("a") : ord("z") + 1]
CODES[[0x20, *range(0x09, 0x0E)]] = 0
SEPARATES = CODES == 0
#: Bytes of text that are hashed at once, but for longer texts.
TOGETHER = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(32))) * C1
        return values ^ (values >> np.uint64(29))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest lot needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, TOGETHER + 2)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                setattr(self, name, np.cumprod(factors))


def words_in(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words in some bytes, which begin and end with a separator, and where each
    word starts and ends.

    A word's hash is a sum over its bytes' codes times powers of their place in it, so that sums
    over all the bytes give all of them. Only A to Z are taken as a to z.
    """
    powers.reach(len(data))
    inside = ~SEPARATES[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.cumsum(CODES[data] * powers.up[: len(data)])
        hashes = (sums[ends - 1] - sums[starts - 1]) * powers.down[starts]
        return mixed(hashes + (ends - starts).astype(np.uint64) * C2), starts, ends


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of UTF-8 ``texts`` in order, and how many words each text has."""
    hashes, starts, _ = words_in(np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8), powers)
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    with np.errstate(over="ignore"):
        found = np.full(max(len(hashes) - width + 1, 0), width, np.uint64) * C2
        for k in range(width):
            found = mixed(found ^ hashes[k : k + len(found)])
        return mixed(found)


def lots(texts: list[bytes]):
    """Ranges of texts with about ``TOGETHER`` bytes each."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > TOGETHER:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], width: int, powers: Powers) -> tuple[list[np.ndarray], list[int]]:
    """For each text the ascending distinct hashes of its ``width``-word shingles, and its words.

    A text of fewer words has one shingle, all of it, and one without words none.
    """
    out: list[np.ndarray] = []
    said: list[int] = []
    for start, stop in lots(texts):
        hashes, counts = word_hashes(texts[start:stop], powers)
        runs = run_hashes(hashes, width)
        at = 0
        for n in counts.tolist():
            found = np.sort(runs[at : at + n - width + 1]) if n >= width else run_hashes(hashes[at : at + n], n)[: n > 0]
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found)
            said.append(n)
            at += n
    return out, said
