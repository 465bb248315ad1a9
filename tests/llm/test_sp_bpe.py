import hashlib
import random
import time

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as hs

from laminara.llm import sp_bpe as s
from tests.llm.helpers import ODD, empty, odd, table

CODEC = s.Codec(s.load_vocabulary(s.default_model()))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=s.default_model())


def same(text):
    ids = LIBRARY.encode(text)
    joined, n, back = CODEC.both(text)
    assert CODEC.encode(text) == ids and joined == ",".join(map(str, ids)) and n == len(ids)
    assert back == LIBRARY.decode(ids) == CODEC.decode(ids)


@settings(max_examples=300, deadline=None)
@given(hs.text(max_size=60))
def test_any_text(text):
    same(text)


def test_spaces_repeats_and_specials():
    rng = random.Random(0)
    for t in ["", " ", "   ", "  a  b ", " " * 40 + "x" + " " * 17, "\n\n\t a\n", "<s> </s> <unk> <0x0A>", "▁▁a▁b", "aaaa" * 50, "0123456789" * 5, "\x00", "é" * 9, "日本語 😀😀"]:
        same(t)
    for _ in range(2000):
        same("".join(rng.choice("abethinors ▁\n.,é1") for _ in range(rng.randint(1, 60))))


def test_many_characters_outside_the_vocabulary():
    for c in ("\U00013000", "\u9fff"):
        began = time.time()
        same(c * 100_000)
        assert time.time() - began < 10


def test_a_full_memory_starts_anew():
    m = s.Memory(lambda k: k * 2, size=3)
    assert [m[k] for k in (1, 2, 3, 4, 1, 2, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 4, 10, 12, 14, 2] and len(m) <= 3


def test_query_against_the_library(spark, sf):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: r for r in s.op10_sentencepiece(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_odd_rows(spark):
    out = s.encode_decode(odd(spark), s.load_vocabulary(s.default_model())).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.decoded, list(r.ids)) for r in out), key=key) == sorted(((i, LIBRARY.decode(LIBRARY.encode(t or "")), LIBRARY.encode(t or "")) for i, t in ODD), key=key)
    assert s.encode_decode(empty(spark), s.load_vocabulary(s.default_model())).count() == 0


def test_long_segments_inside_the_vocabulary_take_linear_time():
    """Pieces of a text without spaces are looked for a little way ahead only."""
    took = []
    for n in (25_000, 100_000):
        began = time.process_time()
        ids = CODEC.encode("ab" * n)
        took.append(time.process_time() - began)
        assert ids == LIBRARY.encode("ab" * n)
    assert took[1] < 8 * max(took[0], 0.1) and took[1] < 3
