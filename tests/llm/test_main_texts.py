"""Main texts of pages of all lengths and scripts, with and without anything around them."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from monthmatch.llm.html_blocks import blocks_of, extract_main_text, main_texts, trained_labeller

WORDS = {
    "three words": "alpha beta gamma",
    "english": "the quick brown fox jumps over a lazy dog while many others watch from afar and wonder about it",
    "cyrillic": "привет мир это большой текст слово город река дом лес",
    "chinese": None,
}
BEFORE = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
AFTER = (
    "<aside class='sidebar'><h3>Popular</h3><ul><li><a href='/c'>Thing</a></li></ul></aside>"
    "<footer>Copyright 2024. All rights reserved.</footer>"
)


def paragraphs(words, count, r):
    if WORDS[words] is None:
        return ["".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(40)) + "。" for _ in range(count)]
    return [" ".join(r.choice(WORDS[words].split()) for _ in range(20)) + "." for _ in range(count)]


@pytest.mark.parametrize("words", WORDS)
@pytest.mark.parametrize("around", ["article", "main", "div", 'div class="content"', None])
def test_all_paragraphs_and_nothing_else(words, around):
    r, pages, want = random.Random(len(words)), [], []
    for count in (5, 10, 50, 300, 3000):
        for before, after in (("", ""), (BEFORE, AFTER)):
            texts = paragraphs(words, count, r)
            inner = "".join(f"<p>{t}</p>" for t in texts)
            if around:
                inner = f"<{around}>{inner}</{around.split()[0]}>"
            pages.append(f"<html><body>{before}{inner}{after}</body></html>")
            want.append("\n".join(texts))
    assert main_texts(pages, trained_labeller()) == want


def test_given_pages_are_read_like_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "html")
    got = extract_main_text(pages, separator="\n\n").collect()
    assert len(got) == pages.count() > 2000
    for row in got:
        blocks = blocks_of(row.html or "")
        want = "\n\n".join(b.text for b in blocks if any(e[0] == "article" for e in b.path))
        assert (row.text, row.n_chars) == (want, len(want)), row.page_id


FIT = (
    "import hashlib; from monthmatch.llm.html_blocks import trained_labeller; w = trained_labeller(300, 9).weights;"
    "print(hashlib.sha256(b''.join(w[k].tobytes() for k in sorted(w))).hexdigest())"
)


def test_weights_do_not_depend_on_the_number_of_threads():
    shown = set()
    for threads in ("1", "4"):
        env = dict(os.environ, PYTHONPATH=str(Path(__file__).parents[2]))
        env |= dict.fromkeys(("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"), threads)
        done = subprocess.run([sys.executable, "-c", FIT], env=env, capture_output=True, text=True, timeout=600, check=True)
        shown.add(done.stdout)
    assert len(shown) == 1
