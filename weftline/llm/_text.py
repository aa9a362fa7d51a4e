"""Vectorised words and shingles over Arrow string columns: hashes of whole texts, no row loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.RandomState(20240117)
_BYTE = _rng.randint(0, 2**63 - 1, 256).astype(U) * U(2) + U(1)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, U), dtype=U)
_STEP = _rng.randint(0, 2**63 - 1, 64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each run of bytes over 0x20, and per text where its words begin (length texts + 1)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = raw > 32
    edge = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[edge] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[edge[1:] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    at = np.searchsorted(start, offsets)
    if not len(start):
        return start, end, np.zeros(0, U), at
    anchor = np.zeros(n, np.int32 if n < 2**31 else np.int64)
    anchor[start] = start
    pos = np.arange(n, dtype=anchor.dtype) - np.maximum.accumulate(anchor)
    value = _BYTE[raw] * _POW[pos & 4095]
    if int((end - start).max()) > 4096:
        value *= (pos >> 12).astype(U) * U(2) + U(1)
    value[~solid] = 0
    return start, end, mix(np.add.reduceat(value, start) + (end - start).astype(U)), at


def shingles(word_hash: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every window of ``k`` words; a text with fewer words has one window of them all."""
    n = np.diff(at)
    total = len(word_hash)
    if not total:
        return np.zeros(0, U), np.zeros(0, np.int64)
    padded = np.concatenate([word_hash, np.zeros(k, U)])
    full = np.zeros(total, U)
    for j in range(k):
        full += padded[j : j + total] * _STEP[j]
    per = np.where(n >= k, n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), per)
    inside = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    out = full[at[:-1][owner] + inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        tail = np.zeros(len(short), U)
        for j in range(k - 1):
            has = n[short] > j
            tail[has] += word_hash[at[short[has]] + j] * _STEP[j]
        out = np.concatenate([out, tail + n[short].astype(U) * _STEP[63]])
        owner = np.concatenate([owner, short])
    return mix(out), owner


def counted(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in that order: key, owner and how often."""
    if not len(keys):
        return keys, owner, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    small = owner.astype(np.uint16) if int(owner.max()) < 65536 else owner
    order = order[np.argsort(small[order], kind="stable")]
    keys, owner = keys[order], owner[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return keys[first], owner[first], np.diff(np.append(first, len(keys)))


def segments(owner: np.ndarray, texts: int) -> np.ndarray:
    """Where each text's run begins in a sorted ``owner`` (length texts + 1)."""
    return np.searchsorted(owner, np.arange(texts + 1))
