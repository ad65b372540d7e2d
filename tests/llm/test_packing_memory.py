"""Memory of packing in a worker that has run other stages."""

import re

import numpy as np
import pyarrow as pa

from logweave.llm import chunks, packing


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_freed_memory_is_given_back():
    before = held_mb()
    for _ in range(3):
        texts = pa.array(np.arange(3_000_000).astype(str))
        del texts
    chunks.give_back()
    assert held_mb() - before < 60


def test_blocks_of_packing_are_small():
    texts = pa.array(["x" * 1000] * 3000)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    sizes = [len(t) for _, t in chunks.blocks(batch, "text", packing.BLOCK_CHARS)]
    assert sum(sizes) == 3000 and max(sizes) <= 1000
