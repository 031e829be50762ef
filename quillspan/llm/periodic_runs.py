"""Runs: stretches of words that repeat with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period q and a length of ``max(LEAST, TIMES * q)`` or more that no
neighbouring word extends keeping the period. At each dyadic scale L the words are cut into blocks of L. The sum of squared
differences between a block and the words d further on is zero where they agree, and for all distances d of a window it comes
from one convolution, computed exactly by a number-theoretic transform. A run whose period belongs to scale L holds three
blocks in a row that agree at its period, so such triples are the seeds; they are checked word by word and extended to both
sides. Only blocks whose words all come again within the window are transformed: others agree at no distance.

Words are numbered afresh in each text, so no match crosses texts, and sums are taken modulo a prime: a sum that is a
multiple of it without being zero is dismissed by the check. Blocks well inside a run found before have nothing new and are left out, so
that long repetitive texts take about n log n steps. A slice of texts is worked on at once; a text is never cut.

Defined cases: a null or empty text has no runs and an empty collapsed text; equal texts have equal results; an empty table gives no rows;
no columns but the text and those named in ``keep`` are read, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import map_texts

#: A run is at least so many words, and so many times its period, long.
LEAST, TIMES = 6, 4
#: Blocks in a row that have to agree; with TIMES = 4 a run's 3q or more agreeing words hold as many of scale(q).
IN_A_ROW = 3
#: Prime of the transform, 119 * 2**23 + 1, and a generator of its multiplicative group.
PRIME, ROOT = np.uint64(998_244_353), 3
#: So many numbers are transformed at once.
AT_ONCE = 1 << 20


def scale_distances(block: int) -> tuple[int, int]:
    """Smallest and largest period that belongs to blocks of ``block`` words: of three blocks in a row, 4 * block - 1 words, 3q hold one."""
    low = 1 if block == 1 else -(-(4 * block - 1) // 3)
    return low, -(-(8 * block - 1) // 3) - 1


def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each round of a transform of ``size``."""
    p, out, half = int(PRIME), [], size // 2
    while half:
        root = pow(ROOT, (p - 1) // (2 * half), p)
        root = pow(root, p - 2, p) if inverse else root
        powers = np.ones(half, np.uint64)
        done = 1
        while done < half:  # by doubling: powers[done + i] = powers[i] * root**done
            more = min(done, half - done)
            powers[done : done + more] = powers[:more] * np.uint64(pow(root, done, p)) % PRIME
            done += more
        out.append(powers)
        half //= 2
    return out


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transform of each row; the order of frequencies is bit-reversed, as ``intt`` takes them."""
    a = rows
    count, size = a.shape
    for powers in _twiddles(size, False):
        half = len(powers)
        x = a.reshape(count, -1, 2, half)
        up, down = x[:, :, 0], x[:, :, 1]
        a = np.stack(((up + down) % PRIME, (up + PRIME - down) * powers % PRIME), axis=2).reshape(count, size)
    return a


def intt(rows: np.ndarray) -> np.ndarray:
    a = rows
    count, size = a.shape
    for powers in reversed(_twiddles(size, True)):
        half = len(powers)
        x = a.reshape(count, -1, 2, half)
        up, down = x[:, :, 0], x[:, :, 1] * powers % PRIME
        a = np.stack(((up + down) % PRIME, (up + PRIME - down) % PRIME), axis=2).reshape(count, size)
    return a * np.uint64(pow(size, int(PRIME) - 2, int(PRIME))) % PRIME


def zero_distances(ids: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) for each block at ``starts`` and each distance of its scale at which the block comes again.

    ``ids`` is padded by four blocks of numbers of their own.
    """
    low, high = scale_distances(block)
    size = 4 * block
    found_at, found = [], []
    chunk = max(1, AT_ONCE // size)
    within = np.arange(size)
    for c in range(0, len(starts), chunk):
        at = starts[c : c + chunk]
        window = ids[at[:, None] + within].astype(np.uint64)
        mine = np.zeros_like(window)
        mine[:, :block] = window[:, :block][:, ::-1]
        squares = np.zeros((len(at), size + 1), np.uint64)
        np.cumsum(window * window % PRIME, axis=1, out=squares[:, 1:])
        products = intt(ntt(mine) * ntt(window) % PRIME)
        # entry block - 1 + d is the sum of products at distance d
        d = np.arange(low, high + 1)
        own = squares[:, block : block + 1] - squares[:, :1]
        other = squares[:, d + block] - squares[:, d]
        total = (own + other + np.uint64(2) * (PRIME - products[:, block - 1 + d])) % PRIME
        i, j = np.nonzero(total == 0)
        found_at.append(at[i])
        found.append(d[j])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def _agree(ids: np.ndarray, at: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    """Whether the blocks at ``at`` agree word by word with those ``d`` further on."""
    chunk, within = max(1, AT_ONCE // block), np.arange(block)
    out = [np.zeros(0, bool)]
    for c in range(0, len(at), chunk):
        place = at[c : c + chunk, None] + within
        out.append((ids[place] == ids[place + d[c : c + chunk, None]]).all(axis=1))
    return np.concatenate(out)


def _rows_of(at: np.ndarray, d: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of first and last of IN_A_ROW or more blocks in a row at one distance, after sorting, and the order."""
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + block))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    long = last - first + 1 >= IN_A_ROW
    return first[long], last[long], order


def _inside(known: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run in ``known`` holds all of ``start`` to ``end``."""
    if not len(known):
        return np.zeros(len(start), bool)
    known = known[np.argsort(known[:, 0], kind="stable")]
    best = np.maximum.accumulate(known[:, 0] + known[:, 1])
    k = np.searchsorted(known[:, 0], start, side="right") - 1
    return (k >= 0) & (best[k] >= end)


def _extend(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``start`` on, in direction ``step``, agree with those ``distance`` further on; at most ``most``."""
    agreed = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    for k in range(most):
        if not len(live):
            break
        at = start[live] + step * k
        same = (at >= 0) & (ids[at] == ids[at + distance[live]])
        live = live[same]
        agreed[live] += 1
    return agreed


def runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """All runs (start, length, period) of ``ids``, whose texts have no numbers in common and ``longest`` words at most."""
    n = len(ids)
    nothing = np.zeros((0, 3), np.int64)
    if n < LEAST:
        return nothing
    top = 1
    while scale_distances(2 * top)[0] * TIMES <= longest:
        top *= 2
    # numbers of their own at the end, and blocks as long as the largest
    ids = np.concatenate((ids, int(ids.max()) + 1 + np.arange(5 * top)))
    n_padded = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.full(n_padded, n_padded, np.int64)  # words until the same comes again
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    widest = again[:n]
    found = nothing
    block = 1
    while block <= top:
        if block > 1:
            widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)
        low, high = scale_distances(block)
        fits = widest <= high
        pair = fits[:-1] & fits[1:]
        triple = pair[:-1] & pair[1:]
        fits[:] = False
        for k in range(IN_A_ROW):
            fits[k : k + len(triple)] |= triple
        at = np.flatnonzero(fits) * block
        # three agreeing blocks in a row inside a run found before agree at a multiple of its period: nothing new
        at = at[~_inside(found, np.maximum(at - (IN_A_ROW - 1) * block, 0), at + IN_A_ROW * block + high)]
        at, d = zero_distances(ids, at, block)
        first, last, order = _rows_of(at, d, block)
        at, d = at[order], d[order]
        new = ~_inside(found, at[first], at[last] + block + d[first])
        seed = np.zeros(len(at) + 1, np.int64)
        np.add.at(seed, first[new], 1)
        np.add.at(seed, last[new] + 1, -1)
        at, d = (x[np.cumsum(seed[:-1]) > 0] for x in (at, d))
        exact = _agree(ids, at, d, block)
        at, d = at[exact], d[exact]
        first, last, order = _rows_of(at, d, block)
        at, d = at[order], d[order]
        start, end, d = at[first], at[last] + block, d[first]  # words start to end agree with those d further on
        new = ~_inside(found, start, end + d)
        start, end, d = start[new], end[new], d[new]
        if len(start):
            start, end = start - _extend(ids, start - 1, d, -1, block), end + _extend(ids, end, d, 1, block)
            enough = end - start + d >= np.maximum(LEAST, TIMES * d)
            found = np.concatenate((found, np.stack((start, end - start + d, d), axis=1)[enough]))
            # one stretch at several multiples of its period counts at the smallest
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))] if len(found) else found
        block *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, a number for each that texts don't share, and where each text starts among them (and the last ends)."""
    words, sizes = [], [0]
    for t in texts:
        words += t.split()
        sizes.append(len(words))
    starts = np.array(sizes, np.int64)
    codes = pa.array(words, pa.large_binary()).dictionary_encode()
    ids = np.asarray(codes.indices).astype(np.int64)
    ids += np.repeat(np.arange(len(texts)) * len(codes.dictionary), np.diff(starts))
    _, small = np.unique(ids, return_inverse=True)  # small numbers keep most sums below the prime
    return words, small.astype(np.int64), starts


def find(texts: list[bytes]) -> dict[str, list]:
    words, ids, starts = _numbered(texts)
    found = runs(ids, int(np.diff(starts).max(initial=0)))
    text_of = np.searchsorted(starts, found[:, 0], side="right") - 1
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(drop[:-1]) == 0
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    found[:, 0] -= starts[text_of]
    listed, collapsed = [], []
    for i in range(len(texts)):
        listed.append([{"start": s, "length": n, "period": q} for s, n, q in found[bounds[i] : bounds[i + 1]].tolist()])
        mine = words[starts[i] : starts[i + 1]]
        if bounds[i] < bounds[i + 1]:
            mine = [mine[k] for k in np.flatnonzero(kept[starts[i] : starts[i + 1]]).tolist()]
        collapsed.append(b" ".join(mine).decode())
    return {"n_words": np.diff(starts), "runs": listed, "collapsed": collapsed}


def periodic_runs(docs: DataFrame, *, text_col: str = "text", keep: dict[str, Column | str] | None = None) -> DataFrame:
    """The columns of ``keep``, ``n_words``, ``runs`` by start and period, and ``collapsed``: the text without the words that a
    run holds after its first period, joined by one space."""
    keep = {"doc_id": "doc_id"} if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[(docs[c] if isinstance(c, str) else c).alias(n) for n, c in keep.items()]).schema.fields)
    schema = ", ".join(filter(None, [kinds, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"]))
    listed = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(columns: dict[str, pa.Array], texts: list[bytes]) -> dict:
        found = find(texts)
        return columns | found | {"runs": pa.array(found["runs"], listed)}

    return map_texts(docs, work, schema, text_col=text_col, keep=keep)
