import numpy as np
import pyarrow as pa

from memspark.llm import neighbours


def test_share_of_lists_asked_does_not_shrink():
    for lists in (1, 30, 486, 500, 501, 1000, 2048):
        asked = neighbours.probes_of(40, lists)
        assert min(40, lists) <= asked <= lists and asked / lists >= 40 / 500
    assert [neighbours.probes_of(12, k) for k in (5, 50, 486, 2048)] == [5, 12, 12, 50]


def test_queries_are_sent_to_so_many_lists():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((1000, 8)).astype(np.float32)
    index = neighbours.ListIndex(np.eye(8, dtype=np.float32), centres, np.zeros(1000, np.int64), np.ones(1, np.int64))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(rng.standard_normal((2, 8)).astype(np.float32).tolist()), pa.array([True, True])], names=["id", "vec", "ask"])
    sent = pa.Table.from_batches(neighbours._send(index, 8, 40)(iter([rows])))
    assert [len(x) for x in sent.column("probes").to_pylist()] == [80, 80]
