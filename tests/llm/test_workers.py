"""What Python workers keep from task to task."""

import public_tokenizers
import pyarrow as pa

from codeloom.llm import neardup, pieces, planes, quality

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_workers_let_go_of_what_earlier_stages_kept():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "label": [1], "text": ["one two three"]})
    for stage in (quality._features, neardup._sketcher(5), neardup._set_maker(2)):
        assert len(pieces.codec(PIECES).encode("one two")) and pieces._codecs
        assert len(list(stage(iter([batch])))) == 1 and not pieces._codecs


def test_workers_keep_one_operator_at_a_time():
    own = pieces.codec(PIECES)
    assert pieces.codec(PIECES) is own
    assert len(next(planes.word_encoder(WORDS)()([b"one"]))) and planes._encoders and not pieces._codecs
    assert pieces.codec(PIECES) is not own and not planes._encoders
