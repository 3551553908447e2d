import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.common import pieces


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=60), st.integers(1, 9), st.integers(1, 60))
def test_pieces_are_small_and_whole(texts, rows, size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(pieces([batch], rows, size / 1e6))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(0 < p.num_rows <= rows for p in parts)
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= size for p in parts)
