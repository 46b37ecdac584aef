"""Texts made to collide under polynomial hashes, and forced collisions, change no result."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugewright.llm import neardup, quality, tokenfiles, tokens
from gaugewright.llm.words import span_hashes

#: The word of Thue and Morse and its complement: equal under every polynomial modulo a power of two.
MORSE = "".join("ab"[i.bit_count() & 1] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))
DOCS = "doc_id long, text string, lang string, source string"


def test_spans_of_all_lengths_differ():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in [*range(40), 4096] for _ in range(300)})
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    hashes = span_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(words)
    again = np.frombuffer(b"xyz" + b"".join(words).upper(), dtype=np.uint8)
    assert (span_hashes(again, ends - [len(w) for w in words] + 3, ends + 3, fold_case=True) == hashes).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_one_hash_keep_their_ids(name, monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: span_hashes(*a) % np.uint64(4))
    own, tool = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):
        texts = ["the cat it's sat on a mat 12", "a dog sat, it'll stay", f"{MORSE} 1 {OTHER}", ""]
        ids, begin = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [x.ids for x in tool.encode_batch(texts, add_special_tokens=False)]


def test_operators_tell_such_words_apart(spark, tmp_path):
    rows = [(1, MORSE, "en", "a"), (2, OTHER, "en", "a"), (3, f"x y z w {MORSE}", "en", "a"), (4, f"x y z w {OTHER}", "en", "a"), (5, f"{MORSE}\n{OTHER}\n{MORSE}", "en", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    near = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, numerator=85, denominator=100).collect()}
    assert near == {i: i for i in range(1, 6)}
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(docs).collect()}[5] == 1
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfiles.write_token_files(docs, str(tmp_path / "t"), path, end_id=2)
    tool = Tokenizer.from_file(path)
    found = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in tokenfiles.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert found == {r[0]: [*tool.encode(r[1], add_special_tokens=False).ids, 2] for r in rows}
