"""Sums over the arrays of a task; the function travels to the executors by value."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sums_of_arrays(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, member, units, n): per key and member of its arrays the sum of units x times, if over ``least``, and the rows.

    Batches have key, units, members and times, the last two arrays of one length, no nulls; without
    units and times every member counts once. All of a task's cells are sorted once, so the caller
    bounds what a task gets.
    """
    parts = []
    for batch in batches:
        key, members = batch.column("key"), batch.column("members")
        lengths, member = members.value_lengths().to_numpy(zero_copy_only=False), members.flatten().to_numpy(zero_copy_only=False)
        if "times" in batch.schema.names:
            units, times = (batch.column(c) for c in ("units", "times"))
            worth = np.repeat(units.to_numpy(zero_copy_only=False), lengths) * times.flatten().to_numpy(zero_copy_only=False)
        else:
            worth = np.ones(len(member), np.int8)
        parts.append((key.to_numpy(zero_copy_only=False), lengths, member, worth))
    if not sum(len(p[2]) for p in parts):
        return
    key, lengths, member, worth = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    keys, key = np.unique(key, return_inverse=True)
    if member.dtype == np.int32:
        low, width = -(2**31), 2**32
        members, member = None, member.astype(np.int64) - low
    else:
        members, member = np.unique(member, return_inverse=True)
        low, width = 0, len(members)
    cell = np.repeat(key, lengths) * np.int64(width) + member
    del member
    if (worth == 1).all():
        cell.sort()
        worth = worth.astype(np.int64)
    else:
        order = np.argsort(cell)
        cell, worth = cell[order], worth[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    units, n = np.add.reduceat(worth, starts), np.diff(np.r_[starts, len(cell)])
    if np.add.reduceat(worth.astype(float), starts).max() > 2.0**62:
        raise OverflowError("a sum does not fit a BIGINT")
    kept = units > least
    cell = cell[starts[kept]]
    place = cell % width
    member = (place + low).astype(np.int32) if members is None else members[place]
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[cell // width]), pa.array(member), pa.array(units[kept]), pa.array(n[kept].astype(np.int64))],
        ["key", "member", "units", "n"],
    )
