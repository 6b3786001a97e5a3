"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import SPACE_CLASS, attach_groups, lean, numbered, partitions, stage, text_or_empty

SLOTS = 4
MAX_KICKS = 200
#: Bytes of a digest.
WIDTH = 32
#: Digests a shard of the index holds on average, at most; one takes about 80 bytes.
SHARD_DIGESTS = 2_000_000
#: The doc_id of an entry whose rows have none; it ranks last.
_NAMELESS = (1 << 63) - 1


class CuckooIndex:
    """Live digests with four integers each: nameless (0 or 1), doc_id, row and number of copies.

    The filter's buckets have ``SLOTS`` places for a mark of 16 bits and the
    number of the entry it stands for.  A digest has two buckets, the second
    told from the first and the mark, so that marks can move.  A mark is only a
    hint: the digest is compared with the entry's.  When an insertion finds no
    place after ``MAX_KICKS`` moves, the buckets double and are filled again
    from the stored entries, so no digest is ever lost and a deletion never
    removes another.  Everything lies in flat arrays.
    """

    def __init__(self, buckets: int = 1 << 13):
        size = 1
        while size < buckets:
            size *= 2
        self.resizes = self.size = 0
        self.keys = bytearray()
        self.nameless, self.doc_ids, self.rows, self.copies = array("b"), array("q"), array("q"), array("q")
        #: Entries of deleted digests, to be used again.
        self.free = array("I")
        self._reset(size)

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        #: Marks, 0 where a place is free, and their entries.
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("I", bytes(4 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _find(self, digest: bytes) -> int:
        """The place of a live digest, or -1."""
        mark, a, b = self._places(digest)
        marks, entries, keys = self.marks, self.entries, self.keys
        for bucket in (a, b):
            for place in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if marks[place] == mark:
                    at = WIDTH * entries[place]
                    if keys[at : at + WIDTH] == digest:
                        return place
        return -1

    def find(self, digest: bytes) -> int:
        """The entry of a live digest, or -1."""
        place = self._find(digest)
        return -1 if place < 0 else self.entries[place]

    def get(self, digest: bytes) -> tuple[int, int, int, int] | None:
        entry = self.find(digest)
        return None if entry < 0 else (self.nameless[entry], self.doc_ids[entry], self.rows[entry], self.copies[entry])

    def insert(self, digest: bytes, value: tuple[int, int, int, int]) -> None:
        """A digest that isn't live, or another value for one that is."""
        entry = self.find(digest)
        if entry >= 0:
            self._set(entry, value)
            return
        if self.free:
            entry = self.free.pop()
            self.keys[WIDTH * entry : WIDTH * entry + WIDTH] = digest
            self._set(entry, value)
        else:
            entry = len(self.copies)
            self.keys += digest
            for column, x in zip((self.nameless, self.doc_ids, self.rows, self.copies), value, strict=True):
                column.append(x)
        self.size += 1
        if not self._place(digest, entry):
            self._grow()

    def _set(self, entry: int, value: tuple[int, int, int, int]) -> None:
        self.nameless[entry], self.doc_ids[entry], self.rows[entry], self.copies[entry] = value

    def merge(self, digest: bytes, value: tuple[int, int, int, int]) -> None:
        """Insert a digest, or add its copies to a live one, whose row becomes the lesser."""
        entry = self.find(digest)
        if entry < 0:
            self.insert(digest, value)
            return
        copies = self.copies[entry] + value[3]
        if value[:3] < (self.nameless[entry], self.doc_ids[entry], self.rows[entry]):
            self._set(entry, value)
        self.copies[entry] = copies

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; whether it was there."""
        place = self._find(digest)
        if place < 0:
            return False
        entry = self.entries[place]
        self.marks[place] = 0
        self.copies[entry] = 0
        self.free.append(entry)
        self.size -= 1
        return True

    def live(self) -> Iterator[int]:
        return (entry for entry, n in enumerate(self.copies) if n)

    def key(self, entry: int) -> bytes:
        return bytes(self.keys[WIDTH * entry : WIDTH * entry + WIDTH])

    def items(self) -> Iterator[tuple[bytes, tuple[int, int, int, int]]]:
        for entry in self.live():
            yield self.key(entry), (self.nameless[entry], self.doc_ids[entry], self.rows[entry], self.copies[entry])

    def _settle(self, bucket: int, mark: int, entry: int) -> bool:
        for place in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.marks[place]:
                self.marks[place], self.entries[place] = mark, entry
                return True
        return False

    def _place(self, digest: bytes, entry: int) -> bool:
        mark, a, b = self._places(digest)
        if self._settle(a, mark, entry) or self._settle(b, mark, entry):
            return True
        bucket = b
        for kick in range(MAX_KICKS):
            place = SLOTS * bucket + (mark + kick) % SLOTS
            mark, self.marks[place] = self.marks[place], mark
            entry, self.entries[place] = self.entries[place], entry
            bucket = self._other(bucket, mark)
            if self._settle(bucket, mark, entry):
                return True
        return False

    def _grow(self) -> None:
        while True:
            self.resizes += 1
            self._reset(self.buckets * 2)
            if all(self._place(self.key(entry), entry) for entry in self.live()):
                return


_INDEXED = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _values(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple[int, int, int, int]]]:
    for digest, doc_id, row, n in zip(*(batch.column(c).to_pylist() for c in _INDEXED.names), strict=True):
        yield digest, (doc_id is None, _NAMELESS if doc_id is None else doc_id, row, n)


def _live_batches(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for digest, (nameless, doc_id, row, n) in index.items():
        part.append((digest, None if nameless else doc_id, row, n))
        if len(part) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _INDEXED, strict=True)], schema=_INDEXED)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _INDEXED, strict=True)], schema=_INDEXED)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows of equal digests through the index.

    It runs once on each map task's rows, where copies meet before they are
    shuffled, and once on each shard of digests.
    """
    index = CuckooIndex()
    for batch in batches:
        for digest, value in _values(batch):
            index.merge(digest, value)
    yield from _live_batches(index)


def _retire_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert the live digests of a shard, delete the retired ones (no copies), return what lives."""
    index, dead = CuckooIndex(), []
    for batch in batches:
        for digest, value in _values(batch):
            if value[3]:
                index.insert(digest, value)
            else:
                dead.append(digest)
    for digest in dead:
        index.delete(digest)
    yield from _live_batches(index)


INDEX_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long"


def digest_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, row and SHA-256 of the normalised text for each row, written once."""
    text = F.regexp_replace(text_or_empty(), SPACE_CLASS, " ")
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 8 * WIDTH)).alias("digest"), key=key)
    return stage(rows.select("doc_id", "row", "digest"), "digests")


def build_index(digests: DataFrame, per_shard: int = SHARD_DIGESTS) -> DataFrame:
    """The live index: one row a digest with the row that stays and the number of copies.

    It has so many shards that each holds ``per_shard`` digests at most on average.
    """
    ones = digests.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    met = ones.mapInArrow(lean(_index_batches), INDEX_SCHEMA)
    shards = max(partitions(digests.sparkSession), -(-digests.count() // per_shard))
    return met.repartition(shards, "digest").mapInArrow(lean(_index_batches), INDEX_SCHEMA)


def retire(index: DataFrame, digests: DataFrame, per_shard: int = SHARD_DIGESTS) -> DataFrame:
    """The index without the digests of ``digests`` (a column digest); unknown ones are ignored."""
    dead = digests.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_row"), F.lit(0).cast("long").alias("group_size")).dropDuplicates(["digest"])
    both = index.select(*dead.columns).unionByName(dead)
    shards = max(partitions(index.sparkSession), -(-both.count() // per_shard))
    return both.repartition(shards, "digest").mapInArrow(lean(_retire_batches), INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), dropped ones too.

    Returns doc_id, row, keep_id, group_size, kept, digest.  Texts are equal
    when their normalised forms are, by SHA-256; the row with the smallest doc_id
    stays.  Of rows that share text and doc_id exactly one stays; a null doc_id
    ranks last; a null text counts as empty, and empty texts are equal to each
    other.  Without rows the result is empty.  ``row`` is the caller's ``key``,
    if one is named; other columns are not read.
    """
    digests = digest_rows(docs, key)
    index = stage(build_index(digests), "index")
    out = attach_groups(digests, index, "digest", "group_size", F.col("row"))
    return out.select("doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
