import pyarrow as pa
import pytest

from zonewatch.llm.text import narrow, runs, starts, wide


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("least", [1, 5, 1000])
def test_runs_never_cut_a_group(size, least):
    keys = [1, 1, 1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4, 4, 5]
    whole = pa.table({"g": keys, "x": list(range(len(keys)))})
    out = list(runs([pa.RecordBatch.from_arrays([], names=[])] * 0 + whole.to_batches(max_chunksize=size), "g", least))
    assert [x for t in out for x in t["x"].to_pylist()] == list(range(len(keys)))
    assert sum(len(set(t["g"].to_pylist())) for t in out) == 5
    assert all(t.num_rows >= least for t in out[:-1])
    assert list(runs([], "g")) == []


def test_ids_and_starts():
    import numpy as np

    ids = np.array([0, 1, 65535, 65536, 2**31, 2**32 - 1], dtype=np.uint32)
    assert list(wide(narrow(ids))) == list(ids)
    assert list(starts(np.array([5, 5, 1, 1, 1, 2]))) == [0, 2, 5, 6] and list(starts(np.array([]))) == [0]
