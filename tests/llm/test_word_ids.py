"""Ids by distinct words are the tokenizer's own, whatever the text."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from monthmatch.llm import packing
from monthmatch.llm.packing import END_OF_TEXT, WordIds, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = list("aZé́ÀßÿµªİıſΩдЖ中  \t\r\x0b\x85.,'’-0９²½😀‍﻿̀ \n\n  Åç") + [
    "'s", "'LL", " foo", "Bar.", "baz,.", "..", ",", "ÀÉ.", "straße", "Dž", "ﬁ", "é.", " ́", "가",
]


def odd_texts(count, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("remembered", [packing.REMEMBERED, 10])
def test_odd_texts_have_the_tokenizers_ids(remembered, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    tokenizer = Tokenizer.from_file(PATH)
    ids = WordIds(tokenizer)
    for seed in range(3):
        texts = odd_texts(15_000, seed)
        want = [[*e.ids, END_OF_TEXT] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in ids(pa.array(texts))] == want


def test_no_texts_and_empty_ones():
    ids = WordIds(Tokenizer.from_file(PATH))
    assert ids(pa.array([], pa.string())) == []
    assert [x.tolist() for x in ids(pa.array([None, "", " ", "\n"]))] == [[END_OF_TEXT]] * 4
    assert [len(x) for x in ids(pa.array(["left out", "a", "b b"]).slice(1))] == [2, 3]


def test_documents_without_an_id(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (3, None), (3, "four"), (3, "four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).coalesce(1)
    got = pack_documents(df, PATH).collect()
    lengths = [len(x) for x in WordIds(Tokenizer.from_file(PATH))(pa.array([t for _, t in rows]))]
    assert sum(r["length"] for r in got) == sum(lengths)
    assert sorted(str(r["doc_id"]) for r in got if r["start"] == 0) == ["3", "3", "3", "None", "None", "None"]
