"""Workers' memory: batches of any size are coded in pieces of bounded bytes."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from weightlake.functions import kernels

#: Bytes that the coder may be given at once.
MOST = 4 << 20


@pytest.mark.parametrize("name", ["roundtrip_split", "method_listing", "roundtrip_bf16", "roundtrip_rans"])
def test_large_batches_are_coded_in_pieces(spark, monkeypatch, tmp_path, name):
    # 20 MB of 64 symbols, which the range coder codes by their counts
    texts = [x.tobytes().decode() for x in np.random.default_rng(7).integers(48, 112, (1000, 20_000), dtype=np.uint8)]
    pq.write_table(pa.table({"doc_id": range(1000), "source": ["a"] * 1000, "lang": ["en"] * 1000, "text": texts}), tmp_path / "documents.parquet")
    steps, given = [], []
    kind = type(spark.range(1))
    through = kind.mapInArrow

    def recorded(self, run, schema):
        steps.append((self, run))
        return through(self, run, schema)

    def counted(coder, sizes):
        code = getattr(kernels, coder)

        def call(*args):
            given.append(sum(sizes(*args)))
            return code(*args)

        monkeypatch.setattr(kernels, coder, call)

    monkeypatch.setattr(kind, "mapInArrow", recorded)
    counted("range_encode_many", lambda datas, *_: map(len, datas))
    counted("range_decode_many", lambda _, sizes: sizes)
    entry.queries()[name](spark, str(tmp_path))
    # the query's own steps in this process, each on all rows as one batch
    whole = lambda table: table.combine_chunks().to_batches()[0]
    batch = whole(steps[0][0].toArrow())
    for _, run in steps:
        batch = whole(pa.Table.from_batches(list(run(iter([batch])))))
    assert batch.num_rows == 1000 and sum(given) >= sum(map(len, texts)) and max(given) <= MOST
    if "data" in batch.schema.names:
        got = dict(zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()))
        assert got == {i: x.encode() for i, x in enumerate(texts)}


def test_pieces():
    from weightlake.functions.batches import pieces, row_bytes

    stream = pa.struct([("method", pa.int32()), ("payload", pa.binary())])
    rows = [[{"method": 1, "payload": b"x" * n}] * 2 if n else None for n in (5, 0, 3000, 7, 1000, 900)]
    table = pa.table({"k": pa.array(range(6)), "streams": pa.array(rows, pa.list_(stream)), "rlen": pa.array([1, None, -5, 1 << 60, 1, 1])})
    batch = table.to_batches()[0]
    assert row_bytes(batch.column(1)).tolist() == [26, 0, 6016, 30, 2016, 1816]
    # also of a slice, in which offsets do not begin with 0
    assert row_bytes(batch.slice(2, 3).column(1)).tolist() == [6016, 30, 2016]
    got = list(pieces(batch, 3900))
    assert [p.num_rows for p in got] == [2, 1, 2, 1] and pa.Table.from_batches(got).equals(table)
    # damaged lengths do no harm; a row that grows is a piece of its own
    assert [p.num_rows for p in pieces(batch, 4000, raw="rlen")] == [2, 1, 1, 2]
    assert list(pieces(batch.slice(0, 0))) == []
