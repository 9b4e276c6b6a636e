"""Characters above U+FFFF and their neighbours, against the tokenizers library."""

import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelfill.llm import lexicon_bpe

TEXTS = ["smile 😀", "😀", "a\U00020000b 𠮷野家", "\uffff\U00010000 \ue000x", "\ud7ff\ufffd", "𝔘𝔫𝔦 code 1\u00bd", "plain words only", None, ""]


def test_astral_characters(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    for r in lexicon_bpe.with_ids(docs, decode=True).collect():
        want = own.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == want
        assert r.decoded == own.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_one_text_alone(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert lexicon_bpe.with_ids(docs).first().n_tokens == len(own.encode(text, add_special_tokens=False).ids)
