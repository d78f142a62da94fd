"""URL filter: all rules run at once as one bit-parallel wildcard automaton.

Every rule becomes a run of bits in a few 64-bit words. One step per character
of the URL moves all rules on together (Shift-And with self-loops for the
wildcards). URLs of a batch are stepped side by side as rows of a matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import code_points

ALLOW, BLOCK = "allow", "block"
_HOST = r"://([^/?#]*)"
_PATH = r"://[^/?#]*([^?#]*)"
_REST = r"://[^/?#]*([^#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """Holds for a host with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the registered query, from the contract of that query.
SITE_RULES = (
    SiteRule("org", "/", ALLOW),
    SiteRule("example.org", "/es/", BLOCK),
    SiteRule("example.org", "/en/1", BLOCK),
    SiteRule("com", "/fr/", ALLOW),
    SiteRule("com", "/de/", BLOCK),
)
#: Globs over ``host/path?query`` that block what no site rule decides.
BLOCK_GLOBS = (
    "**spam-farm.**",
    "**cheap-pills.**",
    "*casino*/**",
    "**/wp-login*",
    r"**\?*sessionid=**",
    "**/cart/**",
)

# Kinds of tokens: one given character, one character of a segment, any run
# within a segment, any run at all.
_CHAR, _ONE, _RUN, _ANY = range(4)


def glob_tokens(glob: str) -> list[tuple[int, str]]:
    """``**`` is any run, ``*`` a run without ``/`` or ``?``, ``?`` one such character, ``\\`` quotes."""
    tokens, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            tokens.append((_CHAR, glob[i + 1]))
            i += 2
        elif glob.startswith("**", i):
            tokens.append((_ANY, ""))
            i += 2
        else:
            kind = {"*": _RUN, "?": _ONE}.get(glob[i], _CHAR)
            tokens.append((kind, glob[i]))
            i += 1
    return tokens


def site_tokens(rule: SiteRule) -> list[list[tuple[int, str]]]:
    """A site rule as two patterns: the host itself and its subdomains."""
    tail = [(_CHAR, c) for c in rule.host + rule.path] + [(_ANY, "")]
    return [tail, [(_RUN, ""), (_CHAR, "."), *tail]]


class GlobAutomaton:
    """Patterns packed into the words of one Shift-And automaton.

    A pattern with m single-character tokens takes m + 1 bits; bit i is set
    while its first i tokens match what was read. Runs are self-loops on bits.
    """

    def __init__(self, patterns: Sequence[list[tuple[int, str]]]):
        letters = sorted({ord(c) for p in patterns for kind, c in p if kind == _CHAR} | {47, 63})
        self.letters = np.asarray(letters, dtype=np.int64)
        bits = sum(1 + sum(kind in (_CHAR, _ONE) for kind, _ in p) for p in patterns)
        words = max(1, -(-bits // 64))
        # Class 0 is every character that no pattern names.
        self.step = np.zeros((len(letters) + 1, words), dtype=np.uint64)
        self.loop = np.zeros_like(self.step)
        self.start = np.zeros(words, dtype=np.uint64)
        of = {c: k + 1 for k, c in enumerate(letters)}
        inside = np.asarray([k for k in range(len(letters) + 1) if k not in (of[47], of[63])])
        self.accept = []
        bit = 0
        for pattern in patterns:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
            for kind, c in pattern:
                if kind in (_RUN, _ANY):
                    at = inside if kind == _RUN else slice(None)
                    self.loop[at, bit // 64] |= np.uint64(1 << bit % 64)
                else:
                    bit += 1
                    at = inside if kind == _ONE else of[ord(c)]
                    self.step[at, bit // 64] |= np.uint64(1 << bit % 64)
            self.accept.append((bit // 64, np.uint64(bit % 64)))
            bit += 1

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """A row per text and a column per pattern: whether the pattern fits the whole text."""
        flat, starts = code_points(texts)
        found = np.searchsorted(self.letters, flat)
        found[found == len(self.letters)] = 0
        classes = np.where(self.letters[found] == flat, found + 1, 0)
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        begin = starts[:-1][order]
        # How many texts are longer than t, for every t: those still being read.
        alive = len(order) - np.cumsum(np.bincount(lengths, minlength=1))
        state = np.tile(self.start, (len(order), 1))
        for t in range(int(lengths.max(initial=0))):
            n = alive[t]
            c, now = classes[begin[:n] + t], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.loop[c])
        result = np.empty((len(order), len(self.accept)), dtype=bool)
        for k, (word, shift) in enumerate(self.accept):
            result[order, k] = (state[:, word] >> shift) & np.uint64(1)
        return result


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def judge_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[SiteRule] = SITE_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``verdict`` and ``glob`` to every row.

    The longest site rule that fits decides (ties: the longer host, then the
    text). Where none fits, the URL is blocked if a glob fits, else allowed;
    ``glob`` is the first such glob in any case. Null URLs and URLs without
    ``://`` have an empty host and path, fit nothing that names a character
    and are allowed. Columns of these five names are replaced; all others,
    repeated rows included, stay. No shuffle.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    automaton = GlobAutomaton(
        [p for r in ranked for p in site_tokens(r)] + [glob_tokens(g) for g in block_globs]
    )
    texts = np.asarray([r.text for r in ranked] + [None], dtype=object)
    verdicts = np.asarray([r.verdict for r in ranked] + [None], dtype=object)
    globs = np.asarray([*block_globs, None], dtype=object)
    sites = 2 * len(ranked)

    def first(hits: np.ndarray) -> np.ndarray:
        if not hits.shape[1]:
            return np.full(len(hits), -1)
        return np.where(hits.any(axis=1), hits.argmax(axis=1), -1)

    @F.pandas_udf("rule string, verdict string, glob string")
    def judged(canonical: pd.Series) -> pd.DataFrame:
        hits = automaton.matches(canonical.tolist())
        rule = first(hits[:, 0:sites:2] | hits[:, 1:sites:2])
        glob = first(hits[:, sites:])
        verdict = np.where(rule >= 0, verdicts[rule], np.where(glob >= 0, BLOCK, ALLOW))
        return pd.DataFrame({"rule": texts[rule], "verdict": verdict, "glob": globs[glob]})

    own = F.col(f"`{url}`")
    rest = F.regexp_extract(F.coalesce(own, F.lit("")), _REST, 1)
    return (
        df.withColumns({"host": host_of(own), "path": path_of(own)})
        .withColumn("__judged", judged(F.concat("host", rest)))
        .withColumns({c: F.col(f"__judged.{c}") for c in ("rule", "verdict", "glob")})
        .drop("__judged")
    )
