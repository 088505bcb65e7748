"""What a worker holds while it packs, and between tasks."""

import sys
import types

import numpy as np
import pyarrow as pa
import pyspark

from querysentry.llm import frames, packing
from querysentry.llm.queries import model_path


class Table:
    """A table of one partition whose tasks run in this process."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batches(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return [pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])]


def own_process(monkeypatch, module):
    """The calls of ``give_back`` in this process, which is no executor's."""
    given = []
    monkeypatch.setitem(sys.modules, "_querysentry_kept", types.ModuleType("_querysentry_kept"))
    monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    monkeypatch.setattr(module, "doc_columns", lambda *a: [], raising=False)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 0)))
    return given


def test_rest_of_a_long_document_holds_no_other_ids():
    *full, rest = [p[2] for p in packing._pieces(1, np.arange(10_000, dtype=np.int32), 4096)]
    assert [len(p) for p in full] == [4096, 4096] and rest.tolist() == list(range(8192, 10_000))
    assert rest.base is None or rest.base.nbytes == rest.nbytes


def test_packing_gives_back_after_every_step(monkeypatch):
    given = own_process(monkeypatch, packing)
    waiting = []
    dealt = packing.windows_for
    monkeypatch.setattr(packing, "windows_for", lambda sizes, capacity: waiting.append(len(sizes)) or dealt(sizes, capacity))
    texts = ["some words " * 60_000, "other words " * 60_000, "", "last"]
    run = packing.pack_documents(Table(), model_path("word_bpe_49k.json"), end_id=2)
    made = pa.Table.from_batches(run(iter(batches(texts)))).to_pylist()
    whole = {k: b"".join(r["ids"] for r in sorted(made, key=lambda r: r["start"]) if r["doc_id"] == k) for k in range(4)}
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    for k, text in enumerate(texts):
        wanted = [*model.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(whole[k], "<u4").tolist() == wanted
    # One for each of the two steps or more, one at the end of the task.
    assert len(given) >= 3 and sum(waiting) == 4


def test_what_is_kept_is_made_without_what_was_kept_before(monkeypatch):
    given = own_process(monkeypatch, frames)
    frames.kept_in_process(("powers", 1), lambda: "table")
    assert not given
    assert frames.kept_in_process(("words", 1), lambda: "one") == "one"
    assert given == [1, 1]
    left = []
    frames.kept_in_process(("words", 2), lambda: left.extend(k for k in vars(sys.modules["_querysentry_kept"]) if isinstance(k, tuple)))
    assert left == [("powers", 1)]
    frames.kept_in_process(("words", 2), lambda: 1 / 0)
    assert given == [1, 1, 1, 1]


def test_a_keeping_stage_gives_back_when_its_task_ends(monkeypatch):
    given = own_process(monkeypatch, frames)
    run = frames.map_steps(Table(), [], lambda part: part, "doc_id bigint, text string", keeps=True)
    assert sum(b.num_rows for b in run(iter(batches(["a", "b"])))) == 2
    assert given == [1]
