"""Substring deduplication by hashed units of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import lean, numbered, partitions, stage
from waybill.llm.textscan import Scan, _powers_for, mix64, scans

#: A run of repeated units goes if it has so many words.
MIN_WORDS = 20
#: A line that stands as a whole earlier goes if it has so many words; shorter ones are headings and the like.
LINE_WORDS = 3
#: Lines are numbered from here among a document's units.
_LINES = 1 << 30
_LINE_SALT = np.uint64(0xA0761D6478BD642F)
_CHECK_SALT = np.uint64(0x8EBC6AF09C88C6E3)
_CLOSERS = np.zeros(256, dtype=bool)
_CLOSERS[list(b".!?")] = True


class Units:
    """The units of a scan: lines, cut further behind words that end in ``.``, ``!`` or ``?``.

    ``word`` holds each unit's first word and ``first`` each document's first
    unit; ``digest`` and ``check`` are two 64-bit hashes of the unit's folded
    words in turn, so that case of A-Z and white space do not count.  ``line`` holds each line's
    first unit, ``line_first`` each document's first line, ``line_words`` a
    line's words, ``line_digest`` and ``line_check`` their hashes, unlike any
    unit's.
    """

    def __init__(self, scan: Scan):
        n = len(scan.start)
        lines = np.concatenate([[0], np.cumsum(scan.data == 0x0A)])
        ends = np.zeros(n, dtype=bool)
        if n:
            breaks = np.zeros(n, dtype=bool)
            breaks[:-1] = lines[scan.start[1:]] > lines[scan.end[:-1]]
            ends[:-1] = breaks[:-1] | _CLOSERS[scan.data[scan.end[:-1] - 1]]
            last = scan.first[1:][np.diff(scan.first) > 0] - 1
            ends[last] = breaks[last] = True
        self.word = np.concatenate([[0], np.flatnonzero(ends) + 1])[: int(ends.sum())]
        self.after = np.flatnonzero(ends) + 1
        up, down = _powers_for(n)
        hashes = scan.word_hashes()
        totals = np.zeros((2, n + 1), dtype=np.uint64)
        np.cumsum(hashes * up[:n], out=totals[0, 1:])
        np.cumsum(mix64(hashes ^ _CHECK_SALT) * up[:n], out=totals[1, 1:])

        def digest(total, word, after):
            return mix64((total[after] - total[word]) * down[word] + (after - word).astype(np.uint64))

        self.digest, self.check = (digest(t, self.word, self.after) for t in totals)
        self.first = np.searchsorted(self.word, scan.first)
        after = np.flatnonzero(breaks) + 1 if n else self.after
        word = np.concatenate([[0], after])[: len(after)]
        self.line, self.line_words = np.searchsorted(self.word, word), after - word
        self.line_digest, self.line_check = (mix64(digest(t, word, after) ^ _LINE_SALT) for t in totals)
        self.line_first = np.searchsorted(word, scan.first)


def _unit_batches(batches: Iterator[pa.RecordBatch], line_words: int = LINE_WORDS) -> Iterator[pa.RecordBatch]:
    """From (doc_id, row, text) to units and, numbered from _LINES on, lines of at least ``line_words`` words.

    Of equal units in a batch only the earliest goes on to meet those of other
    batches (digest set); the others are known to be repeats (digest null).
    """
    for batch in batches:
        nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        doc_ids = batch.column(0).fill_null(0).to_numpy()
        rows = batch.column(1).to_numpy()
        digests, checks, docs, units = [], [], [], []
        for first_row, scan in scans(batch.column(2), fold=True):
            u = Units(scan)
            owner = np.repeat(np.arange(scan.n_docs), np.diff(u.first))
            digests.append(u.digest)
            checks.append(u.check)
            docs.append(owner + first_row)
            units.append(np.arange(len(u.digest)) - u.first[owner])
            owner = np.repeat(np.arange(scan.n_docs), np.diff(u.line_first))
            long = u.line_words >= line_words
            digests.append(u.line_digest[long])
            checks.append(u.line_check[long])
            docs.append((owner + first_row)[long])
            units.append((_LINES + np.arange(len(owner)) - u.line_first[owner])[long])
        if not digests:
            continue
        digest, check, doc, unit = np.concatenate(digests), np.concatenate(checks), np.concatenate(docs), np.concatenate(units)
        order = np.lexsort((unit, rows[doc], doc_ids[doc], nameless[doc], check, digest))
        digest, check, doc, unit = digest[order], check[order], doc[order], unit[order]
        fresh = np.ones(len(digest), dtype=bool)
        fresh[1:] = (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest.view(np.int64), mask=~fresh), pa.array(check.view(np.int64), mask=~fresh), batch.column(0).take(pa.array(doc)), pa.array(rows[doc]), pa.array(unit.astype(np.int32))],
            ["digest", "check", "doc_id", "row", "unit"],
        )


def _later_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of units sorted by digest and rank: those that are not the first of their digest."""
    last = None
    for batch in batches:
        digest, check = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(digest):
            continue
        later = np.zeros(len(digest), dtype=bool)
        later[1:] = (digest[1:] == digest[:-1]) & (check[1:] == check[:-1])
        later[0] = last == (digest[0], check[0])
        last = (digest[-1], check[-1])
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(later)) for k in (3, 4)], ["row", "unit"])


_CLEAN_SCHEMA = "doc_id long, row long, text string, removed array<struct<start:long,end:long>>, n_words long, removed_words long"
_CLEAN = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_words", pa.int64()), ("removed_words", pa.int64())])


def runs_of(repeated: np.ndarray, words: np.ndarray, lines: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """What goes, as maximal unit ranges: runs of repeated units with at least ``min_words`` words, and ``lines``."""
    total = np.concatenate([[0], np.cumsum(words)])
    gone = np.zeros(len(repeated), dtype=bool)
    for a, b in _ranges(repeated):
        gone[a:b] = total[b] - total[a] >= min_words
    for a, b in lines:
        gone[a:b] = True
    return _ranges(gone)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist()]


def _clean_batches(min_words: int):
    """From (doc_id, row, text, units) to cleaned texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flags = batch.column(2), batch.column(3)
            out_text, out_spans, out_words, out_removed = [], [], [], []
            for first, scan in scans(texts, fold=True):
                u = None
                for i in range(scan.n_docs):
                    text = texts[first + i].as_py()
                    marked = flags[first + i].as_py()
                    spans, gone = [], 0
                    if marked:
                        u = u or Units(scan)
                        a, b = int(u.first[i]), int(u.first[i + 1])
                        marks = np.array(marked, dtype=np.int64)
                        repeated = np.zeros(b - a, dtype=bool)
                        repeated[marks[marks < _LINES]] = True
                        line = u.line[u.line_first[i] : u.line_first[i + 1]] - a
                        line_end = np.append(line[1:], b - a)
                        lines = [(int(line[k]), int(line_end[k])) for k in marks[marks >= _LINES] - _LINES]
                        words = u.after[a:b] - u.word[a:b]
                        raw, origin = (text or "").encode(), int(scan.origin[i])
                        pieces, at, at_char = [], 0, 0
                        for x, y in runs_of(repeated, words, lines, min_words):
                            start = int(scan.start[u.word[a + x]]) - origin
                            end = int(scan.start[u.word[a + y]]) - origin if a + y < b else int(scan.end[u.after[a + y - 1] - 1]) - origin
                            kept = raw[at:start].decode()
                            cut = raw[start:end].decode()
                            pieces.append(kept)
                            spans.append({"start": at_char + len(kept), "end": at_char + len(kept) + len(cut)})
                            at, at_char = end, at_char + len(kept) + len(cut)
                            gone += int(words[x:y].sum())
                        if spans:
                            text = "".join(pieces) + raw[at:].decode()
                    out_text.append(text)
                    out_spans.append(spans)
                    out_words.append(int(scan.first[i + 1] - scan.first[i]))
                    out_removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_text, pa.string()), pa.array(out_spans, _CLEAN.field("removed").type), pa.array(out_words, pa.int64()), pa.array(out_removed, pa.int64())], schema=_CLEAN)

    return run


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, key: str | None = None) -> DataFrame:
    """Remove passages of ``docs`` (doc_id, text) that stand earlier in the corpus.

    Units (see ``Units``) are ranked by doc_id, row and place; the first of each
    digest stays and the others are repeats.  A maximal run of repeats in a
    document goes if it has at least ``min_words`` words, so that stock phrases
    inside lines stay; with ``min_words`` and ``line_words`` of 1 every repeat goes.  Lines are ranked alike, and those that stand earlier as a
    whole go if they have at least ``line_words`` words.  Returns one row per row of ``docs``: doc_id,
    row, text (cleaned), removed (spans of the original text in characters, with
    the white space up to the next unit), n_words and removed_words of the
    original.  A document that only repeats others becomes empty.  Null text
    stays null and has no units; a null doc_id ranks last; repeated rows repeat
    each other; ``row`` is the caller's ``key``, if one is named.  Without rows the result is empty.  Other columns are not read.
    """
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key=key).select("doc_id", "row", "text")
    units = stage(rows.mapInArrow(lean(lambda batches: _unit_batches(batches, line_words)), "digest long, check long, doc_id long, row long, unit int"), "units")
    n = partitions(docs.sparkSession)
    order = [F.col("digest"), F.col("check"), F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("unit")]
    later = units.where("digest is not null").repartition(n, "digest").sortWithinPartitions(*order).mapInArrow(lean(_later_batches), "row long, unit int")
    repeats = units.where("digest is null").select("row", "unit").union(later)
    marked = repeats.groupBy("row").agg(F.collect_list("unit").alias("units"))
    joined = rows.join(marked.hint("merge"), "row", "left").select("doc_id", "row", "text", "units")
    return joined.mapInArrow(lean(_clean_batches(min_words)), _CLEAN_SCHEMA)
