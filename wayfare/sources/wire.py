"""Protocol buffer wire format: fields of a message, and the codecs of packed numbers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint has more than ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; lengths give bytes, fixed widths their little-endian bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("a field runs over the end")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def signed32(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def signed64(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def packed(data: bytes) -> np.ndarray:
    """Unsigned numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def packed_deltas(data: bytes) -> np.ndarray:
    """Running sums of the zigzag numbers of a packed field."""
    n = packed(data)
    return np.cumsum((n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64))


def put_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(number: int, value: int | bytes | str | float | None) -> bytes:
    """One field; None gives nothing, floats are 32 bits."""
    if value is None:
        return b""
    if isinstance(value, float):
        return put_varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return put_varint(number << 3) + put_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return put_varint(number << 3 | 2) + put_varint(len(raw)) + raw
