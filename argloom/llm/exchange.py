"""Fingerprint exchange: blocks of rows send sorted, Golomb-coded fingerprints to owners and receive bitmaps of those that occur elsewhere.

A fingerprint's owner is a range of its leading bits, so owners get equal shares
whatever the data; a block sends each value once, so a value that a third of all rows
share costs an owner one entry a block. A block's memory is its rows, an owner's is
its share of all distinct values of all blocks. Nothing reaches the driver.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from argloom.llm.util import ship

MESSAGE = "kind int, owner int, block long, payload binary"
MESSAGE_ARROW = pa.schema([("kind", pa.int32()), ("owner", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
U64 = np.uint64


def golomb(values: np.ndarray) -> bytes:
    """Sorted uint64 values: gaps' quotients in unary, remainders in whole bytes."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    gaps = np.diff(values, prepend=U64(0))
    mean = (float(values[-1]) - float(values[0])) / max(1, n - 1) + 1
    k = min(range(0, 64, 8), key=lambda k: k + 1 + mean / 2.0**k)
    gaps[0] = 0  # the first value goes in full
    quotients = (gaps >> U64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    bits = np.zeros(int(ends[-1]) + 1, np.uint8)
    bits[ends] = 1
    rest = (gaps & U64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - k // 8 :]
    return struct.pack("<IBQ", n, k, int(values[0])) + np.packbits(bits).tobytes() + rest.tobytes()


def ungolomb(data: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<IB", data)
    if not n:
        return np.zeros(0, U64)
    first = struct.unpack_from("<Q", data, 5)[0]
    tail = n * (k // 8)
    rest = np.zeros((n, 8), np.uint8)
    if k:
        rest[:, 8 - k // 8 :] = np.frombuffer(data, np.uint8, tail, len(data) - tail).reshape(n, k // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, len(data) - tail - 13, 13)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(U64) << U64(k)
    gaps += rest.view(">u8").ravel().astype(U64)
    gaps[0] = first
    return np.cumsum(gaps, dtype=U64)


def owner_bounds(values: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's share begins and ends in sorted values."""
    edges = np.array([-(-(o << 64) // owners) for o in range(1, owners)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def messages(kind: int, block: int, owners: int, values: np.ndarray, again: np.ndarray, extra: np.ndarray | None = None) -> list[tuple]:
    """Rows of MESSAGE for sorted distinct values; again: which of them the block has twice; extra: uint32 that belong to the values."""
    bounds, out = owner_bounds(values, owners), []
    for o in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[o], bounds[o + 1])
        coded = golomb(values[part])
        payload = struct.pack("<I", len(coded)) + coded + np.packbits(again[part]).tobytes()
        out.append((kind, int(o), block, payload + (b"" if extra is None else extra[part].astype("<u4").tobytes())))
    return out


def table(rows: list[tuple], schema: pa.Schema = MESSAGE_ARROW) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _read(payload: bytes, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = struct.unpack_from("<I", payload)[0]
    values = ungolomb(payload[4 : 4 + size])
    n = len(values)
    again = np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, 4 + size), count=n).astype(bool)
    rest = 4 + size + (n + 7) // 8
    return values, again, np.frombuffer(payload, "<u4", n, rest) if len(payload) > rest else np.zeros(n, "<u4")


def _answer(asked: pa.Table) -> pa.Table:
    """What an owner returns: for each message, a bit for each value that occurs twice anywhere."""
    kinds, owners, blocks = (asked.column(c).to_pylist() for c in ("kind", "owner", "block"))
    read = [_read(p, k) for p, k in zip(asked.column("payload").to_pylist(), kinds, strict=True)]
    values, again, extra = (np.concatenate([r[i] for r in read]) for i in range(3))
    order = np.lexsort((extra, values))
    v, x = values[order], extra[order]
    same = (v[1:] == v[:-1]) & (x[1:] == x[:-1])
    twice = again[order]
    twice[1:] |= same
    twice[:-1] |= same
    flags = np.empty(len(values), bool)
    flags[order] = twice
    cuts = np.cumsum([len(r[0]) for r in read])[:-1]
    return table([(k, o, b, np.packbits(f).tobytes()) for k, o, b, f in zip(kinds, owners, blocks, np.split(flags, cuts), strict=True)])


def answers(sent: DataFrame) -> DataFrame:
    """MESSAGE rows with bitmaps in place of values."""
    ship(sent.sparkSession)
    return sent.groupBy("kind", "owner").applyInArrow(_answer, MESSAGE)


def flags_of(answer: pa.Table, kind: int, values: np.ndarray, owners: int) -> np.ndarray:
    """Which of a block's sorted values occur twice, from the bitmaps it received."""
    bounds, out = owner_bounds(values, owners), np.zeros(len(values), bool)
    for k, o, bits in zip(*(answer.column(c).to_pylist() for c in ("kind", "owner", "payload")), strict=True):
        if k == kind:
            a, b = bounds[o], bounds[o + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out
