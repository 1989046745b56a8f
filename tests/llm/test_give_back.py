import pyarrow as pa

from tesserae.llm import common


def test_workers_give_back_memory_after_the_last_slice(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.record_batch({"text": ["a" * 10, "b" * 10, None]})
    assert sum(s.num_rows for s in common.slices(iter([batch, batch]), "text", 12)) == 6
    assert calls == [1]
    monkeypatch.undo()
    common.give_back()
