import gc
import weakref

import pytest
from tablemill.llm import packing, store


class Table:
    def __init__(self, size):
        self.size = size


def test_a_worker_keeps_the_tables_of_one_operator():
    first = store.kept("a", Table, 3)
    assert store.kept("a", Table, 3) is first and store.kept("a", Table, 4).size == 4
    gone = weakref.ref(first)
    del first
    assert [x for x in store.lean("b", lambda batches: batches)([1, 2])] == [1, 2]
    gc.collect()
    assert gone() is None


def test_other_tasks_let_go_of_the_encoder():
    gone = weakref.ref(packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"), packing.public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert gone() is not None
    store.alone("repeats")
    assert gone() is None


def test_memory_is_given_back_where_a_task_fails(monkeypatch):
    given = []
    monkeypatch.setattr(store, "give_back", lambda: given.append(1))

    def fails(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(store.lean("a", fails)([1]))
    assert given
