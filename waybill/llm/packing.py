"""Sequence packing: first-fit decreasing with a tournament tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import lean, numbered, stage
from waybill.llm.textscan import scans

SEQUENCE = 4096
END_ID = 2
#: Pieces a group holds on average.
GROUP_PIECES = 4096
#: Distinct words a worker keeps the ids of; beyond, it starts anew.
WORD_CACHE = 1_000_000

_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[list(b".,;:!?")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True


class WordIds:
    """Token ids of texts, from the ids of their distinct words.

    The vocabulary's pattern never matches across white space, so the ids of a
    text are those of its words in turn, and a run of ``.,;:!?`` behind a Latin
    letter is a piece of its own.  Words are told apart by 64-bit hashes.  Texts
    that hold the string of a special token are left to the tokenizer: it looks
    for these before it folds case.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        #: Whole texts, special tokens among them; words, in which folding may have made their strings.
        self.plain, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [token.content for token in self.plain.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a piece.
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def holds_special(self, texts: pa.Array) -> np.ndarray:
        """Whether each text holds the string of a special token."""
        found = np.zeros(len(texts), dtype=bool)
        for string in self.special:
            found |= pc.fill_null(pc.match_substring(texts, string), False).to_numpy(zero_copy_only=False)
        return found

    def ids_of_whole(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _clear(self) -> None:
        #: Hashes of the known words in order, and the place of each in start and count.
        self.known = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words, how many each has, and the order they are in.

        A word of letters alone is one piece and ends in one id of the kind that
        ends pieces, so such words are coded as one text and told apart by these.
        """
        plain = np.fromiter((w.lower().isalpha() for w in words), dtype=bool, count=len(words))
        parts, lengths, order = [np.zeros(0, dtype=np.uint32)], [], []
        letters = np.flatnonzero(plain)
        runs = [letters[i : i + 500].tolist() for i in range(0, len(letters), 500)]
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(run):
                parts.append(ids)
                lengths.append(np.diff(ends, prepend=0))
                order += run
            else:
                plain[run] = False
        rest = np.flatnonzero(~plain).tolist()
        coded = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        parts += [np.array(x, dtype=np.uint32) for x in coded]
        lengths.append(np.array([len(x) for x in coded], dtype=np.int64))
        return np.concatenate(parts), np.concatenate(lengths).astype(np.int64), np.array(order + rest, dtype=np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words; ``hashes`` ascends and holds none that is known."""
        ids, lengths, order = self._ids_of(words)
        n, total = len(self.known), len(ids)
        while n + len(words) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.count[n : n + len(words)] = lengths
        self.ids[self.used : self.used + total] = ids
        self.used += total
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(n, n + len(words))
        at = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, at, hashes), np.insert(self.place, at, place)

    def encode(self, scan) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a scan and where each document's begin."""
        scan = _split_trails(scan)
        values, example, turn = np.unique(scan.word_hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(values) > WORD_CACHE:
            self._clear()
        at = np.searchsorted(self.known, values)
        new = np.ones(len(values), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != values[inside]
        if new.any():
            text, first = scan.data.tobytes(), example[new]
            words = [text[a:b].decode("utf-8", "replace") for a, b in zip(scan.start[first].tolist(), scan.end[first].tolist(), strict=True)]
            self._learn(values[new], words)
        place = self.place[np.searchsorted(self.known, values)][turn]
        lengths = self.count[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.start[place] - (ends - lengths), lengths)
        ends = np.concatenate([[0], ends])
        return self.ids[index], ends[scan.first]


def _split_trails(scan):
    """Cut runs of closing punctuation off words; the parts count as words of the scan."""
    data, start, end = scan.data, scan.start, scan.end
    cut = end.copy()
    open_ = np.arange(len(cut))
    while len(open_):
        open_ = open_[(cut[open_] > start[open_]) & _TRAIL[data[np.maximum(cut[open_] - 1, 0)]]]
        cut[open_] -= 1
    split = (cut < end) & (cut > start) & _LETTER[data[np.maximum(cut - 1, 0)]]
    extra = np.cumsum(split) - split
    at = np.arange(len(start)) + extra
    n = len(start) + int(split.sum())
    new_start, new_end = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    new_start[at], new_end[at] = start, np.where(split, cut, end)
    new_start[at[split] + 1], new_end[at[split] + 1] = cut[split], end[split]
    grown = np.concatenate([at, [n]])
    scan.first = grown[scan.first]
    scan.start, scan.end = new_start, new_end
    return scan


_CODERS: dict[str, WordIds] = {}

PIECE_SCHEMA = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_batches(path: str, sequence: int, end_id: int):
    """A mapInArrow function from (doc_id, row, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = WordIds(path)
        coder = _CODERS[path]
        for batch in batches:
            doc_ids, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            special = coder.holds_special(texts)
            out: list[list] = [[] for _ in range(6)]
            for first, scan in scans(texts, fold=True):
                ids, at = coder.encode(scan)
                for i in range(scan.n_docs):
                    own = coder.ids_of_whole(texts[first + i].as_py()) if special[first + i] else ids[at[i] : at[i + 1]]
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), sequence):
                        piece = own[start : start + sequence]
                        for column, value in zip(out, (doc_ids[first + i], rows[first + i], start, len(piece), zlib.crc32(piece.tobytes()), len(own)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it for each length, longest first.

    A tournament tree holds the greatest room left below each node, so the
    leftmost bin with room is found in one walk from the root.
    """
    n = len(lengths)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
    return bins, offsets


def _pack_group(sequence: int):
    def run(table: pa.Table) -> pa.Table:
        # One order for equal inputs, whatever order the shuffle brought.
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "row")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), sequence)
        group = table["grp"].to_numpy()
        ids = pa.array(group.astype(np.int64) * (1 << 32) + bins, pa.int64())
        return table.drop_columns(["grp"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, key: str | None = None) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of ``sequence`` tokens.

    A document's ids, with ``end_id`` behind, are cut at multiples of
    ``sequence``.  The pieces are dealt by a seeded hash to groups of about
    ``group_pieces``, and each group is packed alone by first-fit decreasing.
    Returns one row a piece: doc_id, row, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A null or blank text is the end id alone; repeated
    rows are packed each; ``row`` is the caller's ``key``, if one is named.
    Without rows the result is empty.  Other columns are not read.
    """
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key=key)
    pieces = stage(rows.select("doc_id", "row", "text").mapInArrow(lean(piece_batches(tokenizer_path, sequence, end_id)), PIECE_SCHEMA), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(_pack_group(sequence), PIECE_SCHEMA + ", sequence_id long, offset long")
