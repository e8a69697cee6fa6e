import pyarrow as pa

from quern.llm import _spark as S


def test_slices_are_of_bounded_size_and_whole():
    texts = ["a" * 10, None, "", "b" * 5000, "c" * 3, "d" * 90]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "text"])
    got = list(S.slices(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= 100 for b in got)
