"""Buckets of the substring operator are sorted some windows at a time, with the same outcome."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import substrings


def bucket(n: int, rows: int, kind: str, ranks: int) -> pa.Table:
    rng = np.random.default_rng(7)
    batches = []
    for _ in range(rows):
        doc = np.sort(rng.integers(0, 500, n // rows))
        batches.append(substrings._dealt(np.zeros(len(doc), np.int32), doc, [rng.integers(0, ranks, len(doc), np.uint64)], lambda v: v.astype(kind).tobytes()))
    return pa.Table.from_batches(batches)


def keys(table: pa.Table) -> dict:
    return {k: sorted((t, x) for t, b in zip(table.column("team").to_pylist(), table.column(k).to_pylist(), strict=True) for x in np.frombuffer(b, substrings.KINDS[k]).tolist()) for k in substrings.KINDS}


@pytest.mark.parametrize(("last", "kind"), [(False, "<u4"), (True, "<u8")])
def test_parts_of_a_bucket_find_what_the_whole_finds(last, kind, monkeypatch):
    table = bucket(40_000, 7, kind, 30_000)
    whole = keys(substrings._matched(table, last, 5))
    monkeypatch.setattr(substrings, "SORTED", 10_000)
    parts = keys(substrings._matched(table, last, 5))
    assert {k: sorted(set(v)) for k, v in parts.items()} == {k: sorted(set(v)) for k, v in whole.items()} and whole["repeated" if last else "shared"]


def test_a_buckets_windows_are_not_unpacked_together():
    n = 6_000_000
    table = bucket(n, 20, "<u4", 1 << 32)
    tracemalloc.start()
    substrings._matched(table, False, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
