"""Parts of the language model's counting and look-ups against plain ones."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import lm

NUMBERS = st.lists(st.integers(0, 2**40) | st.integers(0, 30), max_size=40)


@given(NUMBERS, NUMBERS)
@settings(max_examples=100, deadline=None)
def test_absent_equals_set_difference(x, known):
    got = lm.absent(np.array(sorted(x), np.uint64), np.unique(np.array(known, np.uint64)))
    assert got.tolist() == sorted(set(x) - set(known)) and got.dtype == np.uint64


@given(NUMBERS, NUMBERS)
@settings(max_examples=100, deadline=None)
def test_find_equals_first_place(values, asked):
    values = sorted(values)
    own = lm.EliasFano(lm.EliasFano.build(np.array(values, np.uint64)))
    asked = [*asked, *values]
    assert own.find(np.array(asked, np.uint64)).tolist() == [values.index(x) if x in values else -1 for x in asked]


def test_counting_does_not_sort_keys_again(monkeypatch, tmp_path):
    """Pairs and triples come sorted; what the pairs lack is found without a further pass of hashing or sorting."""
    texts = ["a b c a b c d", "b c", "", "d d d d"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    words = list(lm._word_counter(1)(iter([batch])))
    key = (pa.scalar(0),)
    first = list(lm._word_merger(str(tmp_path))(key, iter(words)))[0].to_pylist()[0]
    model = lm.Model(str(tmp_path), [0, first["v"]], first["n"], first["v"] - 1, 1)
    monkeypatch.setattr(np, "setdiff1d", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(lm, "SLICE", 6)
    rows = [r for x in lm._gram_counter(model)(iter([batch])) for r in x.to_pylist()]
    assert sum(int(lm.unpack(r["pair_counts"]).sum()) for r in rows) == sum(len(t.split()) + 1 for t in texts)
    assert sum(int(lm.unpack(r["triple_counts"]).sum()) for r in rows) == sum(len(t.split()) for t in texts)
