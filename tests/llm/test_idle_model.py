"""A Python worker that has encoded texts stays beside later stages, without the words it met."""

import public_tokenizers
import pyarrow as pa
import pytest

from lexiforge.llm import pieces


@pytest.mark.parametrize("idle, left", [(100, 0), (5000, 1000)])
def test_a_model_rests_after_a_task(spark, monkeypatch, idle, left):
    monkeypatch.setattr(pieces, "IDLE", idle, raising=False)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    model = pieces.model_of(data)
    model.encoded.clear(), model.decoded.clear()
    task, run = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema, **k: (task.append(f), run(df, f, schema, **k))[1])
    texts = [f"word{i}x other{i}y" for i in range(1000)]
    pieces.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": texts})
    first, again = (pa.Table.from_batches(list(task[0](iter([rows])))) for _ in range(2))
    assert first == again and first.num_rows == 1000
    met = len(model.encoded) + len(model.encoded.old)
    assert met == 0 if left == 0 else met >= left
    assert ",".join(model.encode(texts[5])) == ",".join(model.encode(texts[5])) and model.decode(model.encode(texts[5])) == texts[5]
