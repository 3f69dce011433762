"""Word arithmetic on numpy arrays, used by the operators that run in Arrow batches."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier of the rolling sums over word hashes (the 64-bit golden ratio).
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_shipped: set[str] = set()


#: Rows and bytes to an Arrow batch, in place of Spark's own: whole texts are long, and both JVM and Python hold a batch of each task.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def ship(spark) -> None:
    """Give this package to the executors, once for each application, and keep Arrow batches small unless the session has a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="larkspur-")), "larkspur_package.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    with open(to, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(to)


def lean(run):
    """run (batches to batches) that hands memory back to the system when a task ends, so that reused workers stay small."""

    def wrapped(batches):
        yield from run(batches)
        _release()

    return wrapped


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


class Hashes(dict):
    """XXH64 of a word (bytes); remembers up to `most` words, then starts anew."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


def split(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split() parts at exactly U+0020 and U+0009..U+000D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive items, by doubling; the empty array if there are fewer."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    run, width, out, done = h, 1, None, 0  # run: sums of `width` items; out: sums of the first `done`
    while True:
        if k & width:
            n = len(h) - done - width + 1
            out, done = run if out is None else out[:n] * np.uint64(pow(BASE, width, 1 << 64)) + run[done : done + n], done + width
        if done == k:
            return mixed(out[: len(h) - k + 1])
        run = run[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + run[width:]
        width *= 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: What a byte counts for, powers of BASE and of its inverse (modulo 2**64), and so the bytes that are summed at once.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
PIECE = 1 << 16
_POWERS, _INVERSES = _powers(BASE, PIECE), _powers(pow(BASE, -1, 1 << 64), PIECE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text joined by one space each, as bytes, and where each word starts."""
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= keep[:-1]  # a space stays if a word ends before it
    joined, space = raw[keep], space[keep]
    if len(joined) and space[-1]:
        joined, space = joined[:-1], space[:-1]
    gaps = np.flatnonzero(space)
    joined[gaps] = 0x20
    return joined, np.concatenate(([0], gaps + 1)) if len(joined) else gaps


def token_hashes(joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word that `tokens` found: a difference of running sums; XXH64 for words of over PIECE bytes."""
    ends = np.append(starts[1:] - 1, len(joined))
    if len(joined) <= PIECE:
        return _sums(joined, starts, ends)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        at = starts[a]
        b = int(np.searchsorted(ends, at + PIECE, "right"))
        if b == a:
            out[a] = xxhash.xxh64_intdigest(joined[at : ends[a]].tobytes())
            a += 1
        else:
            out[a:b] = _sums(joined[at : ends[b - 1]], starts[a:b] - at, ends[a:b] - at)
            a = b
    return out


def _sums(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTES[joined] * _POWERS[: len(joined)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _INVERSES[starts])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values, by doubling."""
    width, out = 1, x
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of k that begins at one of starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, n), -1)
    return np.cumsum(steps[:-1]) > 0
