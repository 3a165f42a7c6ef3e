import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from karst.operators import search


def test_a_task_holds_bounded_distances():
    """6,000 queries by a batch of 6,000 nodes would be 288 MB of distances, and several times that as they are ranked."""
    rng = np.random.default_rng(3)
    queries, nodes = rng.normal(size=(6000, 4)), rng.normal(size=(6000, 4))
    nodes[3000:3100] = nodes[:100]  # ties
    queries /= np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    uris = [f"u{i:05}" for i in rng.permutation(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(uris[a : a + 4500]), pa.array(nodes[a : a + 4500].tolist(), pa.list_(pa.float64()))], names=["uri", "embedding"]) for a in (0, 4500)]
    tracemalloc.start()
    out = pa.Table.from_batches(search._nearest(SimpleNamespace(value=queries), 3, ["q", "u", "d"])(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
    got = {}
    for q, u, d in zip(*(c.to_pylist() for c in out.columns), strict=True):
        got.setdefault(q, []).append((d, u))
    unit = nodes / np.sqrt((nodes * nodes).sum(axis=1, keepdims=True))
    for q in range(0, 6000, 97):
        assert got[q] == sorted(zip(np.round(1 - queries[q] @ unit.T, 12).tolist(), uris, strict=True))[:3]
    assert len(got) == 6000 and all(len(x) == 3 for x in got.values())


def test_fewer_nodes_than_k():
    batch = pa.RecordBatch.from_arrays([pa.array(["b", "a"]), pa.array([[1.0, 0.0], [0.0, 0.0]], pa.list_(pa.float64()))], names=["uri", "embedding"])
    out = pa.Table.from_batches(search._nearest(SimpleNamespace(value=np.array([[1.0, 0.0]])), 5, ["q", "u", "d"])(iter([batch])))
    assert [c.to_pylist() for c in out.columns] == [[0, 0], ["b", "a"], [0.0, 1.0]]
