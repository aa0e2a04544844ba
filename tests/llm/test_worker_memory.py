import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import common as C


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_idle_workers_give_memory_back(spark):
    """A worker that is done stays beside its executor's later tasks, and must not stay as large as its largest task."""

    def hoard(batches):
        """Some 160 MB in small pieces, all freed but the last, which keeps the heap's end where it is; the worker's pid for each row."""
        for batch in batches:
            held = [np.ones(2000) for _ in range(10_000)]
            np.last_held = held[-1]
            del held
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows, pa.int64())], batch.schema.names)

    pids = {r[0] for r in C.batches_of(spark.range(0, 4, 1, 1), hoard).collect()}
    for pid in pids:
        anonymous = int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1])
        assert anonymous < 120 * 1024


def test_lean_passes_rows_and_errors_on():
    rows = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(C.lean(iter)(iter(rows))) == rows

    def breaks(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        list(C.lean(breaks)(iter(rows)))
