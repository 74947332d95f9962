"""Sets of start nodes as bits that go along links: whole rows of words are joined by OR, in numpy inside Spark's tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .tiles import _lists

#: Words of a row at most, words or links that are gathered at once, held for sorting and sent out at once.
WORDS, AT_ONCE, HELD, SENT = 64, 1 << 22, 1 << 24, 1 << 22
ROWS = "grp long, node long, words array<long>"


def packed(batches):
    """From (a, home, b): (a, home, next), the links of a node in one part of those that come together."""
    held, many = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        many += batch.num_rows
        if many >= AT_ONCE:
            yield from _links(*(np.concatenate(x) for x in zip(*held)))
            held, many = [], 0
    if many:
        yield from _links(*(np.concatenate(x) for x in zip(*held)))


def _links(a, home, b):
    order = np.lexsort((home, a))
    a, home, b = a[order], home[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (home[1:] != home[:-1])]))
    at = pa.array(np.append(first, len(a)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(home[first]), pa.ListArray.from_arrays(at, pa.array(b))], names=["a", "home", "next"])


def _batch(grp, node, words, names=("grp", "node", "words")):
    at = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(node), pa.ListArray.from_arrays(at, pa.array(words.reshape(-1)))], names=list(names))


def pushed(batches):
    """From (grp, words, next): for each next node of the rows held together the OR of their words, (grp, node, words)."""
    held, many = [], 0
    for batch in batches:
        grp = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(grp):
            continue
        flat, (next_, to) = _lists(batch.column(1))[0], _lists(batch.column(2))
        held.append((grp, flat.reshape(len(grp), -1), next_, np.diff(to)))
        many += len(flat) + len(next_)
        if many >= HELD:
            yield from _pushed(*(np.concatenate(x) for x in zip(*held)))
            held, many = [], 0
    if held:
        yield from _pushed(*(np.concatenate(x) for x in zip(*held)))


def _pushed(grp, words, node, many):
    row = np.repeat(np.arange(len(grp)), many)
    order = np.argsort(node) if (grp == grp[0]).all() else np.lexsort((node, grp[row]))
    node, row = node[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (grp[row[1:]] != grp[row[:-1]])])) if len(node) else np.empty(0, np.int64)
    step, k = max(1, AT_ONCE // words.shape[1]), 0
    while k < len(first):
        stop = max(k + 1, int(np.searchsorted(first, first[k] + step)))
        high = first[stop] if stop < len(first) else len(node)
        out = np.bitwise_or.reduceat(words[row[first[k] : high]], first[k:stop] - first[k], axis=0)
        yield _batch(grp[row[first[k:stop]]], node[first[k:stop]], out)
        k = stop


def merged(batches):
    """From (grp, node, words, seen) in order of grp and node: the bits of a node that no seen row has."""
    rest = None
    for batch in batches:
        grp, node, seen = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        now = grp, node, _lists(batch.column(2))[0].reshape(len(grp), -1), seen
        if not len(grp):
            continue
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now))
        grp, node = now[:2]
        last = int(np.flatnonzero((grp != grp[-1]) | (node != node[-1]))[-1]) + 1 if (grp[0], node[0]) != (grp[-1], node[-1]) else 0
        yield from _new(*(x[:last] for x in now))
        rest = tuple(x[last:] for x in now)
    if rest is not None:
        yield from _new(*rest)


def _new(grp, node, words, seen):
    if not len(grp):
        return
    first = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (node[1:] != node[:-1])]))
    seen = seen.astype(bool)[:, None]
    zero = np.zeros_like(words)
    out = np.bitwise_or.reduceat(np.where(seen, zero, words), first, axis=0) & ~np.bitwise_or.reduceat(np.where(seen, words, zero), first, axis=0)
    some = out.any(axis=1)
    if some.any():
        yield _batch(grp[first][some], node[first][some], out[some])


def numbers(batches):
    """From (grp, name, depth, words): (grp, name, depth, bits), the numbers of the bits that are set."""
    for batch in batches:
        flat, _ = _lists(batch.column(3))
        words = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
        step = max(1, SENT // (64 * words.shape[1]))
        for k in range(0, batch.num_rows, step):
            row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(words[k : k + step]).view(np.uint8), axis=1, bitorder="little"))
            part = batch.slice(k, step)
            at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.ListArray.from_arrays(at, pa.array(bit.astype(np.int32)))], names=["grp", "name", "depth", "bits"])
