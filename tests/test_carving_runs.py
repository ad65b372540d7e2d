"""Carving in many short runs of lines."""

import pyarrow as pa

from logweave.operators import telemetry


def test_summaries_of_short_runs_share_batches():
    rows = [(f"f{k // 500}", k % 500, 1, 1) for k in range(10_000)]
    names = ["file", "block", "total", "opens"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    out = list(telemetry._summaries(iter(table.to_batches(2000))))
    assert sum(b.num_rows for b in out) == 10_000
    assert len(out) <= 5
