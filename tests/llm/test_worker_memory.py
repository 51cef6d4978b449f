"""Memory of a Python worker, which its executor's limit holds beside the heap."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from gristmill.llm import _store

PLAIN = """
import ctypes, gc, io, sys
import numpy as np, pyarrow as pa
from gristmill.llm import _linear, _store, decontaminate, quality

def mb(kind):
    return next(int(x.split()[1]) / 1024 for x in open("/proc/self/status") if x.startswith(kind))

rng = np.random.default_rng(5)
some = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(5000)]
texts = [" ".join(some[k] for k in rng.integers(0, 5000, 400)) for _ in range(8000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts)], ["doc_id", "text"])
out = io.BytesIO()
with pa.ipc.new_stream(out, batch.schema) as to:
    to.write_batch(batch)
raw = out.getvalue()
items = [decontaminate.item_words(" ".join(some[k:k + 12])) for k in range(0, 4800, 12)]
counts = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(items), return_counts=True))))
model = _linear.Linear(rng.normal(size=(_linear.FAMILIES, _linear.BUCKETS)).astype(np.float32), 5.0)
stages = {"quality": lambda: quality._filtered(model), "decontamination": lambda: decontaminate._cleaned(decontaminate._by_length(list(range(len(items))), items, len(items), 12.0, counts))}
del texts, batch, out, to
run, held = stages[sys.argv[1]](), getattr(_store, "frugal", lambda x: x)
gc.collect()
ctypes.CDLL(None).malloc_trim(0)
pa.default_memory_pool().release_unused()
open("/proc/self/clear_refs", "w").write("5")
before = mb("VmRSS")
with pa.ipc.open_stream(pa.BufferReader(raw)) as source:
    rows = sum(x.num_rows for x in held(run)(iter(source)))
gc.collect()
print(rows, mb("VmHWM") - before, mb("VmRSS") - before)
"""


@pytest.mark.parametrize("stage", ["quality", "decontamination"])
def test_worker_takes_and_keeps_little(stage):
    """A task over 22 MB of text takes less than 35 MB besides it, and an idle worker keeps less than 25."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "OMP_NUM_THREADS": "1"}
    said = subprocess.run([sys.executable, "-c", PLAIN, stage], env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    rows, took, kept = map(float, said.split())
    assert rows == 8000 and took < 35 and kept < 25


def test_slices_are_whole_and_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64())], ["k"]) for a, b in ((0, 0), (0, 3), (3, 3 + 2 * _store.SLICE_ROWS + 1))]
    got = list(_store.frugal(lambda xs: xs)(iter(batches)))
    assert max(x.num_rows for x in got) <= _store.SLICE_ROWS
    assert [k for x in got for k in x.column(0).to_pylist()] == list(range(4 + 2 * _store.SLICE_ROWS))
