"""Packing documents into training sequences: best-fit decreasing.

Documents are tokenized where they are read. A document longer than a window
is first cut into full windows; what remains goes, longest first, into the open
window whose remaining capacity is smallest among those that hold it. A segment
tree over the remaining capacities finds that window.

Documents are packed in groups of one task, so that nothing is shuffled and no
task holds more ids than a group has. Windows that a group leaves badly
filled are emptied and their documents cut to fill windows without gaps; what
is left at last goes into sequences whose lengths are powers of two, which need
no padding.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from monthmatch.llm.common import slices, text_or_empty

WINDOW = 4096
END_OF_TEXT = 2
#: Tokens of documents that are packed together, about; a longer document is a group of its own.
GROUP_TOKENS = 4 << 20
#: Windows filled less than this are repacked at the end of a group.
FILL = 0.99
#: Units whose ids a tokenizing task remembers.
REMEMBERED = 300_000
_CHUNK_BYTES = 4 << 20
#: Words given to the tokenizer at once; what it returns is much larger than ids.
_ENCODED = 4096


class CapacityTree:
    """Counts of open windows by remaining capacity, in a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open window with the smallest capacity of at least ``least``, removed from the tree."""
        node = least + self.leaves
        if not self.count[node]:
            # Up to the first subtree to the right that has a window, then down its left edge.
            while node > 1 and (node & 1 or not self.count[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Window and offset of each length; the same lengths give the same result."""
    tree, opened = CapacityTree(window), 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, at = found
        out[i] = (at, window - capacity)
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], at)
    return out


#: document in the group, start in it, length
Piece = tuple[int, int, int]


def pack_lengths(lengths: list[int], window: int = WINDOW, fill: float = FILL) -> list[tuple[Piece, int, int]]:
    """Pieces of documents of these lengths with their sequence and offset; each token in one piece."""
    out: list[tuple[Piece, int, int]] = []
    rest: list[Piece] = []
    sequences = 0
    for doc, length in enumerate(lengths):
        full = length // window
        for k in range(full):
            out.append(((doc, k * window, window), sequences, 0))
            sequences += 1
        if length % window:
            rest.append((doc, full * window, length % window))
    placed = best_fit_decreasing([p[2] for p in rest], window)
    filled: dict[int, int] = {}
    for piece, (at, _) in zip(rest, placed, strict=True):
        filled[at] = filled.get(at, 0) + piece[2]
    # A power of two needs no padding, so it counts as full.
    good = {w: n for n, w in enumerate(w for w, f in filled.items() if f >= fill * window or f & (f - 1) == 0)}
    loose: list[Piece] = []
    for piece, (at, offset) in zip(rest, placed, strict=True):
        if at in good:
            out.append((piece, sequences + good[at], offset))
        else:
            loose.append(piece)
    sequences += len(good)
    total = sum(p[2] for p in loose)
    sizes = [window] * (total // window)
    sizes += [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
    # Shortest first, so that few short documents are cut.
    out.extend(_cut(sorted(loose, key=lambda p: (p[2], p[0])), sizes, sequences))
    return out


def _cut(pieces: list[Piece], sizes: list[int], sequence: int) -> Iterator[tuple[Piece, int, int]]:
    """Lay the pieces end to end and cut them into sequences of the sizes."""
    k, offset = 0, 0
    for doc, start, length in pieces:
        while length:
            taken = min(length, sizes[k] - offset)
            yield (doc, start, taken), sequence + k, offset
            start, length, offset = start + taken, length - taken, offset + taken
            if offset == sizes[k]:
                k, offset = k + 1, 0


#: Letters whose lower case is one letter, too, and no part of another one: all below U+0100.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = f"^[{_LETTERS}]+[.,]*$"


def _laid_out(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a flat array that the index names, end to end, and where each of them begins."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    taken = lengths[index]
    begins = np.concatenate([[0], np.cumsum(taken)])
    # Half the memory where places are small numbers, as they are but for giant texts.
    kind = np.int32 if max(begins[-1], starts[-1]) < 1 << 31 else np.int64
    places = np.repeat((starts[index] - begins[:-1]).astype(kind), taken)
    places += np.arange(begins[-1], dtype=kind)
    return flat[places], begins


class WordIds:
    """Token ids of texts, tokenizing each distinct unit of the task once.

    The tokenizer splits at white space before anything else, so the ids of a
    text are those of its words. A word of plain letters with full stops and
    commas behind it is two units of this tokenizer, and letters are
    lower-cased, so such words share units. All other words are units as they
    are. Only distinct words are looked at one by one; ids are laid out by arrays.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        # Ids as bytes, which join fast and are no work for the garbage collector.
        self.known: dict[str, bytes] = {"": b""}
        #: How the model spells a letter.
        self.spelt: dict[int, str] = {}

    def _whole(self, units: list[str]) -> list[bytes]:
        """Ids of units that the tokenizer takes apart itself."""
        out = []
        for i in range(0, len(units), _ENCODED):
            encoded = self.tokenizer.encode_batch_fast(units[i : i + _ENCODED], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in encoded]
        return out

    def _plain(self, units: list[str]) -> list[bytes]:
        """Ids of units of plain lower-case letters, each of which is one piece for the model."""
        for letter in set().union(*units).difference(map(chr, self.spelt)):
            self.spelt[ord(letter)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)[0][0]
        tokenize, spelt = self.tokenizer.model.tokenize, self.spelt
        return [array("I", [t.id for t in tokenize(u.translate(spelt))]).tobytes() for u in units]

    def _units(self, units: list[str], learn) -> list[bytes]:
        """Ids of distinct units; what is new is learnt and remembered while there is room."""
        new = [u for u in units if u not in self.known]
        learnt = dict(zip(new, learn(new), strict=True))
        ids = [self.known[u] if u in self.known else learnt[u] for u in units]
        if len(self.known) < REMEMBERED:
            self.known |= learnt
        return ids

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each word has."""
        plain = pc.match_substring_regex(words, _PLAIN)
        cores = pc.utf8_rtrim(words, ".,")
        units = pc.if_else(plain, pc.utf8_lower(cores), words).dictionary_encode()
        behind = pc.if_else(plain, pc.subtract(pc.utf8_length(words), pc.utf8_length(cores)), 0).to_numpy()
        ending = np.flatnonzero(behind)
        listed = words.take(pa.array(ending)).to_pylist()
        endings = [w[-n:] for w, n in zip(listed, behind[ending].tolist(), strict=True)]
        # The units of both kinds side by side; the endings are few.
        kinds = sorted(set(endings))
        names = units.dictionary.to_pylist()
        is_plain = np.zeros(len(names), dtype=bool)
        is_plain[units.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = True
        ids: list[bytes] = [b""] * len(names)
        for mask, learn in ((is_plain, self._plain), (~is_plain, self._whole)):
            at = np.flatnonzero(mask).tolist()
            for k, unit in zip(at, self._units([names[k] for k in at], learn), strict=True):
                ids[k] = unit
        ids += [*self._units(kinds, self._whole), b""]
        place = {m: len(names) + k for k, m in enumerate(kinds)}
        second = np.full(len(words), len(ids) - 1)
        second[ending] = [place[m] for m in endings]
        pairs = np.stack([units.indices.to_numpy(), second], axis=1).ravel()
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        out, begins = _laid_out(flat, lengths, pairs)
        return out, np.diff(begins[::2])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, with ``END_OF_TEXT`` behind them."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        flat, lengths = self._words(words.dictionary)
        # The end of a text is one more word.
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        index = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(lengths))
        flat = np.append(flat, np.uint32(END_OF_TEXT)).astype("<u4")
        ids, begins = _laid_out(flat, np.append(lengths, 1), index)
        borders = begins[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One per worker process, so that tasks share what it has learnt."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


_PIECE = pa.schema(
    [
        (n, pa.int64())
        for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
)
PIECE_SCHEMA = ", ".join(f"{f.name} long" for f in _PIECE)


def _packed(group: list[tuple[int, np.ndarray]], first: int, window: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a group, whose sequences are numbered from ``first``, and the next number."""
    rows, following = [], first
    for (doc, start, length), sequence, offset in pack_lengths([len(ids) for _, ids in group], window):
        doc_id, ids = group[doc]
        crc = zlib.crc32(ids[start : start + length].tobytes())
        rows.append((doc_id, start, length, crc, len(ids), first + sequence, offset))
        following = max(following, first + sequence + 1)
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECE), following


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most ``window`` tokens.

    ``tokenizer`` is the path of a word tokenizer's file, which every machine
    has. A document's ids are the tokenizer's without special tokens, then
    ``END_OF_TEXT``; a null or empty text has that id only. Repeated rows are
    documents of their own, a null id stays null. Other columns are not read.
    An empty table gives an empty result. ``sequence_id`` is unique in the
    result; it holds the number of the input partition in its upper bits, so a
    task that runs again numbers its sequences alike.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = _word_ids(tokenizer)
        following = TaskContext.get().partitionId() << 40
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for piece in slices(batch, "text", _CHUNK_BYTES):
                encoded = word_ids(piece.column("text"))
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoded, strict=True):
                    if group and held + len(ids) > group_tokens:
                        out, following = _packed(group, following, window)
                        yield out
                        group, held = [], 0
                    group.append((doc_id, ids))
                    held += len(ids)
                # What is free goes back at once: workers stay, and other stages run beside them.
                pa.default_memory_pool().release_unused()
        if group:
            yield _packed(group, following, window)[0]

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pack, PIECE_SCHEMA)
