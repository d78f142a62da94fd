"""The corpus pipeline, each stage against a plain version over what the one before kept."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from monthmatch.llm.quality import features, learn

SF_DIR = "/root/testdata/sf0.001"
_SECRETS = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""",
    re.IGNORECASE | re.ASCII,
)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, beginning with the documents."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF_DIR).write.parquet(f"{folder}/{k}")
        frames.append(spark.read.parquet(f"{folder}/{k}"))
    return frames


def test_columns(kept):
    assert all(tuple(df.columns) == corpus_pipeline.COLUMNS for df in kept[:-1])


def test_quality(spark, kept):
    docs, good = rows(kept[0]), rows(kept[1])
    model = learn(kept[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    score = model.score(np.stack([features(d.text or "") for d in docs.values()]))
    assert set(good) == {i for i, s in zip(docs, score, strict=True) if s >= 0.3}
    assert all(good[i] == docs[i] for i in good) and 0 < len(good) < len(docs)


def test_one_of_each_group(kept):
    docs, single = rows(kept[1]), rows(kept[2])

    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(d.text) for i, d in docs.items()}
    near = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    first, seen = set(), set()
    for i in sorted(sets):
        if i not in seen:
            first.add(i)
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in seen:
                    seen.add(j)
                    stack += near[j]
    assert set(single) == first and all(single[i] == docs[i] for i in first)


def test_secrets(kept):
    docs, clean = rows(kept[2]), rows(kept[3])
    assert set(clean) == set(docs) and all(len(d.text) == d.n_chars for d in clean.values())
    assert not any(_SECRETS.search(d.text) for d in clean.values())
    assert all(clean[i] == d for i, d in docs.items() if not _SECRETS.search(d.text) and clean[i].text.count("[secret]") == d.text.count("[secret]"))


def test_mixing_and_packing(kept):
    docs, mixed = rows(kept[3]), rows(kept[4])
    assert all(mixed[i] == docs[i] for i in mixed) and 0 < len(mixed) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = kept[5].collect()
    ids = {i: np.asarray([*tokenizer.encode(d.text, add_special_tokens=False).ids, 2], "<u4") for i, d in mixed.items()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())


def test_whole_run(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))[0][:1] == (min(rows(kept[4])),)


def test_odd_documents_go_through(spark):
    rows = [
        (None, "a text without an id that goes on for some words.", "en", "s", 1, "x"),
        (1, None, None, None, None, "x"),
        (2, "", "en", "s", 0, "x"),
        (3, "the same words again and again and once more here", "en", "s", 1, "x"),
        (3, "the same words again and again and once more here", "en", "s", 1, "x"),
        (4, "the same words again and again and once more here", "en", "s", 1, "x"),
        (5, "word " * 60_000, "en", "s", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    single = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR)
    assert sorted((r.doc_id or -1) for r in single.collect()) == [-1, 1, 3, 5]
    for stage in (corpus_pipeline.secrets, corpus_pipeline.mixing, corpus_pipeline.quality, corpus_pipeline.packing):
        assert stage(spark, docs, SF_DIR).count() >= 0
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), SF_DIR).count() == 0
