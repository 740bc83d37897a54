"""Codecs of integer lists: unary and variable-byte, as functions over whole Arrow batches, and their sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unary_bytes(values: np.ndarray) -> bytes:
    """n as n - 1 ones and a zero, most significant bit first; a spare byte follows unless the bits fill theirs."""
    total = int(values.sum())
    bits = np.ones(-(-total // 8) * 8 + (8 if total % 8 else 0), np.uint8)
    bits[total:] = 0
    bits[np.cumsum(values) - 1] = 0
    return np.packbits(bits).tobytes()


def unary_values(raw: bytes, count: int) -> np.ndarray:
    """The first `count` numbers."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)) == 0)[:count]
    return np.diff(ends, prepend=-1)


def vbyte_bytes(values: np.ndarray) -> bytes:
    """Groups of 7 bits, lowest first; the top bit says that more follow. Zero takes no byte."""
    v = values.astype(np.uint64)
    groups = np.zeros(len(v), np.int64)
    left = v.copy()
    while left.any():
        groups += left > 0
        left >>= np.uint64(7)
    place = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    out = (np.repeat(v, groups) >> (np.uint64(7) * place.astype(np.uint64))) & np.uint64(127)
    return (out + np.where(place < np.repeat(groups, groups) - 1, 128, 0).astype(np.uint64)).astype(np.uint8).tobytes()


def vbyte_values(raw: bytes) -> np.ndarray:
    """All numbers of a list."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    if not len(b):
        return np.empty(0, np.int64)
    last = b < 128
    number = np.concatenate([[0], np.cumsum(last)[:-1]])
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - first[number]
    return np.add.reduceat((b & 127) << (7 * place), first)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All numbers of a list column, each list's number of them, and which lists are null (they count as empty)."""
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(np.int64), sizes, values.is_null()


def _joined(raw: np.ndarray, sizes: np.ndarray, null: pa.Array) -> pa.Array:
    """A binary column from all its bytes and each value's number of them."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] >= 2**31:
        raise OverflowError("a batch of lists takes more than 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw.tobytes())])
    return pc.if_else(null, pa.scalar(None, pa.binary()), out)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and each value's number of them."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), np.uint8), sizes


def _lists(values: np.ndarray, sizes: np.ndarray, null: pa.Array) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.if_else(null, pa.scalar(None, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())))


@F.arrow_udf(T.BinaryType())
def unary_encode(values: pa.Array) -> pa.Array:
    flat, sizes, null = _flat(values)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros(len(sizes), np.int64)
    np.add.at(total, owner, flat)
    width = -(-total // 8) + (total % 8 > 0)
    begins = 8 * np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(int(begins[-1]), np.uint8)
    ends = np.cumsum(flat) - np.repeat(np.cumsum(total) - total, sizes) + begins[:-1][owner]  # where each number's bits end
    step = np.zeros(len(bits) + 1, np.int8)
    full = total > 0
    step[begins[:-1][full]] += 1
    step[(begins[:-1] + total)[full]] -= 1
    bits[:] = np.cumsum(step[:-1])
    bits[ends - 1] = 0
    return _joined(np.packbits(bits), width, null)


@F.arrow_udf(T.ArrayType(T.LongType()))
def unary_decode(raw: pa.Array, count: pa.Array) -> pa.Array:
    data, sizes = _bytes(raw)
    begins = 8 * (np.cumsum(sizes) - sizes)
    wanted = pc.fill_null(pc.if_else(raw.is_null(), 0, count), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    zeros = np.flatnonzero(np.unpackbits(data) == 0)
    low = np.searchsorted(zeros, begins)  # a list's first zero; as many as it has numbers are theirs
    at = np.arange(int(wanted.sum())) - np.repeat(np.cumsum(wanted) - wanted, wanted) + np.repeat(low, wanted)
    ends = zeros[at]
    before = np.concatenate([[-1], ends[:-1]]) if len(ends) else ends
    head = (np.cumsum(wanted) - wanted)[wanted > 0]
    before[head] = begins[wanted > 0] - 1
    return _lists(ends - before, wanted, raw.is_null())


@F.arrow_udf(T.BinaryType())
def vbyte_encode(values: pa.Array) -> pa.Array:
    flat, sizes, null = _flat(values)
    v = flat.astype(np.uint64)
    groups, left = np.zeros(len(v), np.int64), v.copy()
    while left.any():
        groups += left > 0
        left >>= np.uint64(7)
    width = np.zeros(len(sizes), np.int64)
    np.add.at(width, np.repeat(np.arange(len(sizes)), sizes), groups)
    return _joined(np.frombuffer(vbyte_bytes(flat), np.uint8), width, null)


@F.arrow_udf(T.ArrayType(T.LongType()))
def vbyte_decode(raw: pa.Array) -> pa.Array:
    data, sizes = _bytes(raw)
    last = np.concatenate([[0], np.cumsum(data < 128)])
    ends = np.cumsum(sizes)
    return _lists(vbyte_values(data), last[ends] - last[ends - sizes], raw.is_null())


def unary_size(total: Column) -> Column:
    """Bytes of a unary list whose numbers add up to total."""
    return (F.ceil(total / 8) + F.when(total % 8 == 0, 0).otherwise(1)).cast("long")


def vbyte_size(value: Column) -> Column:
    """Bytes of one number."""
    return F.when(value == 0, 0).otherwise(F.floor((F.length(F.bin(value)) + 6) / 7)).cast("long")
