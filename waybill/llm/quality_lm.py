"""Perplexity under an interpolated modified Kneser-Ney bigram model of words.

Folded words are hashed to cells, so that the model is open to any word.  With
c a bigram's count in trusted text and D its discount, the probability is

    P(w | v) = (c - D) / total(v) + back(v) P1(w)
             = back(v) P1(w) * (1 + (c - D) / (total(v) back(v) P1(w)))

and P1 is made from continuation counts in the same way.  ``total``, ``back``
and ``P1`` have 1 << WORD_BITS cells each, whatever the corpus, and are
broadcast; counts of bigrams grow with the corpus and are sharded by a hash of
the whole bigram, so that no frequent word makes a shard heavy.  A map task adds
up log(back P1) of its documents by itself and asks the shards for the sum of
the last factor's logarithm, the gain, which is 0 for bigrams that the model
lacks.  Only hashes of bigrams with the numbers of their documents, and sums a
document and shard, go through shuffles; texts never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import attach_groups, key_of, lean, numbered, partitions, stage, text_or_empty
from waybill.llm.textscan import mix64, scans

#: log2 of the cells that words are hashed to; a bigram has two.  Cells 0 and 1 stand for a text's start and end.
WORD_BITS = 21
#: Bytes of text and rows in a piece, the unit in which a task asks; one longer text is a piece by itself.
PIECE_BYTES, DOC_BITS = 6 << 20, 15
#: Bits of a bigram's hash beyond those that number the trusted words: one bigram in so many powers of two takes another's count.
SPARE_BITS = 9
#: Bytes of trusted text a shard stands for, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 8 << 20, 16
#: Rows of trusted text whose keys are broadcast (8 bytes each); beyond, texts are joined with them.
MOST_MARKS = 4 << 20
#: Parts in which the cells' counts are added up.
SEGMENTS = 512
#: Gains are sent as multiples of 1 / GAIN_STEPS.
GAIN_STEPS = 64
#: A document stays while its perplexity is at most this quantile of its language's trusted text.
QUANTILE = 0.99
#: One trusted text in so many is held out of the counts, to see what good text costs that they don't hold.
FOLDS = 5
#: A language with fewer held-out rows takes the bound under which a new row of a log-normal like theirs stays with that chance.
LEAST_HELD = 100
#: Perplexities are told apart by so much of their logarithms when quantiles are taken.
BIN = 1e-3
_CELLS, _BITS = 1 << WORD_BITS, np.uint64(WORD_BITS)
_MASK = np.uint64(_CELLS - 1)


def bigrams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every document's bigrams of cells, one for each word and for its end, and whose they are."""
    words, n = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for _, scan in scans(texts, fold=True):
        words.append(np.maximum(scan.word_hashes() >> np.uint64(64 - WORD_BITS), np.uint64(2)))
        n.append(np.diff(scan.first))
    words, n = np.concatenate(words), np.concatenate(n)
    docs = np.arange(len(n))
    line, owner = np.zeros(len(words) + 2 * len(n), dtype=np.uint64), np.repeat(docs, n + 2)
    line[np.arange(len(words)) + 2 * np.repeat(docs, n) + 1] = words
    line[np.cumsum(n + 2) - 1] = 1
    whole = owner[:-1] == owner[1:]
    return (line[:-1] << _BITS | line[1:])[whole], owner[:-1][whole]


def hash_bits(trusted_bytes: int) -> int:
    """Bits of the hashes of bigrams, by the size of the trusted text."""
    return min(48, max(1, trusted_bytes // 4).bit_length() + SPARE_BITS)


def hashed(code: np.ndarray, bits: int) -> np.ndarray:
    """The bigrams' hashes; in their order those of a shard stand together."""
    return mix64(code) >> np.uint64(64 - bits)


def shard_of(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return (keys * np.uint64(shards) >> np.uint64(bits)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Integer arrays, each as planes of its bytes, compressed; upper planes of small numbers cost nothing."""
    head = np.array([x for c in columns for x in (len(c), c.dtype.itemsize)], dtype="<u4")
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(np.uint32(len(columns)).tobytes() + head.tobytes() + b"".join(planes), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    k = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    head, at, out = np.frombuffer(raw, dtype="<u4", count=2 * k, offset=4).astype(np.int64), 4 + 8 * k, []
    for n, width in head.reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += n * width
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of an ascending array."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """From (row, text) to the rows and texts of pieces."""
    rows, texts, size, count = [], [], 0, 0
    for batch in batches:
        bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            # As many rows as still fit, at least one.
            to = int(np.searchsorted(bytes_, bytes_[at] + max(0, PIECE_BYTES - size), side="right")) - 1
            to = min(batch.num_rows, at + (1 << DOC_BITS) - count, max(to, at + (0 if count else 1)))
            if to > at:
                rows.append(batch.column(0).slice(at, to - at).to_numpy())
                texts.append(batch.column(1).slice(at, to - at).cast(pa.large_string()))
                size, count, at = size + int(bytes_[to] - bytes_[at]), count + to - at, to
            if at < batch.num_rows or size >= PIECE_BYTES or count == 1 << DOC_BITS:
                yield np.concatenate(rows), pa.concat_arrays(texts)
                rows, texts, size, count = [], [], 0, 0
    if rows:
        yield np.concatenate(rows), pa.concat_arrays(texts)


_MESSAGE = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("piece", pa.int64()), ("data", pa.binary())])
MESSAGE_SCHEMA = "shard int, kind int, piece long, data binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


def _count_batches(marks, bits: int, shards: int):
    """From (row, text) to the counted bigrams of trusted texts (``marks``; None: all), a message a piece and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if marks is None else np.frombuffer(marks.value, dtype="<i8")

        def trusted():
            for batch in batches:
                if known is not None:
                    rows = batch.column(0).to_numpy()
                    at = np.minimum(np.searchsorted(known, rows), max(0, len(known) - 1))
                    batch = batch.filter(pa.array(known[at] == rows)) if len(known) else batch.slice(0, 0)
                yield batch

        for rows, texts in _pieces(trusted()):
            values, counts = np.unique(bigrams_of(texts)[0], return_counts=True)
            shard = shard_of(hashed(values, bits), bits, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for s in range(shards):
                own = order[cuts[s] : cuts[s + 1]]
                if len(own):
                    out.append((s, 0, int(rows[0]), _pack(_steps(values[own]), counts[own].astype("<u4"))))
            if out:
                yield _messages(out)

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams and counts of several lists as one."""
    values, turn = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(turn, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)).astype(np.int64)


def _table_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From messages sorted by shard to each shard's counts (piece -1), and what all cells need of them in SEGMENTS (shard -1).

    A segment's numbers are, for each cell v: its count as the first word, the
    bigrams it begins that occur once, twice and more often, and the bigrams it
    ends; and, on the first segment alone, the bigrams that occur one to four times.
    """
    cells, often = np.zeros((5, _CELLS), dtype=np.int64), np.zeros(4, dtype=np.int64)
    shard, parts, seen = None, [], False

    def out():
        values, counts = _merged(parts)
        first, last = (values >> _BITS).astype(np.int64), (values & _MASK).astype(np.int64)
        cells[0] += np.bincount(first, weights=counts, minlength=_CELLS).astype(np.int64)
        for k, which in ((1, counts == 1), (2, counts == 2), (3, counts > 2)):
            cells[k] += np.bincount(first[which], minlength=_CELLS)
        cells[4] += np.bincount(last, minlength=_CELLS)
        often[:] += counts_of_counts(counts)
        return _messages([(shard, 0, -1, _pack(_steps(values), counts.astype("<u8")))])

    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if s != shard and parts:
                yield out()
                parts = []
            shard, seen = s, True
            steps, counts = _unpack(data)
            parts.append((np.cumsum(steps, dtype=np.uint64), counts))
            if len(parts) > 16:
                parts = [_merged(parts)]
    if parts:
        yield out()
    if seen:
        width = _CELLS // SEGMENTS
        for k in range(SEGMENTS):
            yield _messages([(-1, 1, k, _pack(*cells[:, k * width : (k + 1) * width].astype("<u8"), (often if k == 0 else often * 0).astype("<u8")))])


def _add_segments(table: pa.Table) -> pa.Table:
    total = None
    for blob in table["data"]:
        columns = [c.astype("<u8") for c in _unpack(blob.as_py())]
        total = columns if total is None else [a + b for a, b in zip(total, columns, strict=True)]
    return pa.table({"piece": table["piece"][:1], "data": pa.array([_pack(*total)], pa.binary())})


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(coc: list[int]) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts; a half where the counts are too thin."""
    n1, n2, n3, n4 = coc
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def word_order(counts: np.ndarray) -> np.ndarray:
    """The probabilities of order 1 for all cells, from their continuation counts, interpolated with all cells alike."""
    total, uniform = counts.sum(), 1 / len(counts)
    if not total:
        return np.full(len(counts), uniform)
    part = discounted(counts, discounts(counts_of_counts(counts)))
    return part / total + (total - part.sum()) / total * uniform


class Model:
    """What is broadcast: total, back and P1 of all cells, whether a cell ends a known bigram, and the discounts."""

    def __init__(self, cells: np.ndarray, often: list[int]):
        total, one, two, more, ends = cells
        self.cut = discounts(often)
        self.total, self.ends = total.astype(np.float32), ends > 0
        self.back = np.where(total > 0, (self.cut[0] * one + self.cut[1] * two + self.cut[2] * more) / np.maximum(total, 1), 1.0).astype(np.float32)
        self.p1 = word_order(ends).astype(np.float32)

    def base(self, code: np.ndarray) -> np.ndarray:
        """log(back P1) of bigrams."""
        return np.log(self.back[(code >> _BITS).astype(np.int64)].astype(np.float64) * self.p1[(code & _MASK).astype(np.int64)])

    def may_gain(self, code: np.ndarray) -> np.ndarray:
        """Whether both words are known in their places; else the model lacks the bigram."""
        return (self.total[(code >> _BITS).astype(np.int64)] > 0) & self.ends[(code & _MASK).astype(np.int64)]

    def gain(self, code: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = (code >> _BITS).astype(np.int64)
        return np.log1p(discounted(counts, self.cut) / (self.total[first].astype(np.float64) * self.back[first] * self.p1[(code & _MASK).astype(np.int64)]))


def _ask_batches(model, bits: int, shards: int):
    """From (row, text) to a directory a piece (kind 2: rows, bigrams and base sums) and its requests (kind 1), a message a shard.

    A request has the distinct hashes, how many documents ask for each, their
    numbers and how often each holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, texts in _pieces(batches):
            code, owner = bigrams_of(texts)
            n = np.bincount(owner, minlength=len(rows))
            base = np.bincount(owner, weights=m.base(code), minlength=len(rows))
            piece = int(rows[0])
            out = [(piece % shards, 2, piece, _pack(rows.astype("<i8").view("<u8"), n.astype("<u4"), base.view("<u8")))]
            open_ = m.may_gain(code)
            code, owner = code[open_], owner[open_]
            pair, times = np.unique(hashed(code, bits) << np.uint64(DOC_BITS) | owner.astype(np.uint64), return_counts=True)
            del code, owner
            key, doc = pair >> np.uint64(DOC_BITS), (pair & np.uint64((1 << DOC_BITS) - 1)).astype("<u2")
            cuts = np.searchsorted(shard_of(key, bits, shards), np.arange(shards + 1))
            for s in range(shards):
                a, b = int(cuts[s]), int(cuts[s + 1])
                if a < b:
                    start = np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
                    out.append((s, 1, piece, _pack(_steps(key[a:b][start]), np.diff(np.append(start, b - a)).astype("<u4"), doc[a:b], times[a:b].astype("<u4"))))
            yield _messages(out)

    return run


def _answer_batches(model, bits: int):
    """From messages sorted by shard and kind to sums of gains, sparse over a piece's documents (kind 0), and the directories (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        shard, keys, gains = None, np.zeros(0, dtype=np.uint64), np.zeros(0)
        for batch in batches:
            for s, kind, piece, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != shard:
                    shard, keys, gains = s, np.zeros(0, dtype=np.uint64), np.zeros(0)
                if kind == 0:
                    steps, counts = _unpack(data)
                    code = np.cumsum(steps, dtype=np.uint64)
                    keys, first = np.unique(hashed(code, bits), return_index=True)
                    gains = m.gain(code[first], counts[first])
                elif kind == 2:
                    yield _messages([(0, 2, piece, data)])
                elif len(keys):
                    steps, n, doc, times = _unpack(data)
                    asked = np.cumsum(steps, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    gain = np.repeat(np.where(keys[at] == asked, gains[at], 0.0), n)
                    total = np.round(GAIN_STEPS * np.bincount(doc, weights=gain * times)).astype(np.uint32)
                    docs = np.flatnonzero(total)
                    if len(docs):
                        yield _messages([(0, 0, piece, _pack(_steps(docs).astype("<u2"), total[docs]))])

    return run


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From answers sorted by piece to (row, n, logp)."""
    piece, directory, parts = None, None, []

    def out():
        rows, n, base = directory
        logp = base.view("<f8").copy()
        for docs, total in parts:
            logp[docs] += total / GAIN_STEPS
        return pa.RecordBatch.from_arrays([pa.array(rows.view("<i8")), pa.array(n.astype(np.int64)), pa.array(logp)], ["row", "n", "logp"])

    for batch in batches:
        for p, kind, data in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if p != piece:
                if directory is not None:
                    yield out()
                piece, directory, parts = p, None, []
            if kind == 2:
                directory = _unpack(data)
            else:
                steps, total = _unpack(data)
                parts.append((np.cumsum(steps, dtype=np.int64), total))
    if directory is not None:
        yield out()


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(row, perplexity, trusted, held) for each row of ``docs`` (doc_id, text, row).

    The model counts the rows whose doc_id is in ``trusted`` (doc_id), whole,
    but for those held out: one in FOLDS by a hash of the text, so that a
    text's copies go one way.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    own = docs.select("doc_id", "row", (F.pmod(F.xxhash64(text_or_empty()), F.lit(FOLDS)) == 0).alias("held"), F.octet_length(text_or_empty()).alias("bytes"))
    known = stage(own.join(trusted.select("doc_id").where("doc_id is not null").distinct(), "doc_id").select("row", "held", "bytes"), "trusted")
    counted = known.where("not held").select("row", "bytes")
    size = counted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    bits, shards = hash_bits(size.bytes), max(LEAST_SHARDS, -(-size.bytes // SHARD_BYTES))

    texts, marks = docs.select("row", F.col("text").cast("string").alias("text")), None
    if size.rows <= MOST_MARKS:
        rows = np.sort(counted.select("row").toArrow()["row"].to_numpy().astype("<i8"))
        marks, good = spark.sparkContext.broadcast(rows.tobytes()), texts
    else:
        good = texts.join(counted.select("row"), "row", "left_semi").select("row", "text")
    counts = good.mapInArrow(lean(_count_batches(marks, bits, shards)), MESSAGE_SCHEMA)
    tables = stage(counts.repartition(min(n, shards), "shard").sortWithinPartitions("shard").mapInArrow(lean(_table_batches), MESSAGE_SCHEMA), "tables")
    segments = tables.where("shard = -1").select("piece", "data").groupBy("piece").applyInArrow(_add_segments, "piece long, data binary").collect()  # SEGMENTS rows, 5 numbers a cell in all
    cells, often = np.zeros((5, _CELLS), dtype=np.int64), [0] * 4
    for part in segments:
        *columns, few = _unpack(bytes(part.data))
        width = _CELLS // SEGMENTS
        cells[:, part.piece * width : (part.piece + 1) * width] = np.stack(columns).astype(np.int64)
        often = [a + int(b) for a, b in zip(often, few, strict=True)]
    model = spark.sparkContext.broadcast(Model(cells, often))

    asked = tables.where("shard >= 0").union(texts.mapInArrow(lean(_ask_batches(model, bits, shards)), MESSAGE_SCHEMA))
    answers = asked.repartition(min(n, shards), "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(_answer_batches(model, bits)), MESSAGE_SCHEMA)
    scores = answers.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(lean(_score_batches), "row long, n long, logp double")
    return scores.join(known.select("row", "held", F.lit(True).alias("trusted")), "row", "left").select("row", F.exp(-F.col("logp") / F.col("n")).alias("perplexity"), F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("held", F.lit(False)).alias("held"))


def _normal_bound(n, mean, deviation, quantile: float):
    """The bound under which one more row of a normal variable stays with that chance, told from n rows."""
    # Student's t by its expansion, since so few rows know mean and deviation only roughly.
    z, free = NormalDist().inv_cdf(quantile), F.greatest(n - 1, F.lit(1)).cast("double")
    t = F.lit(z) + F.lit((z**3 + z) / 4) / free + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (free * free)
    return F.exp(mean + t * F.sqrt(1 + 1 / (free + 1)) * deviation)


def _quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """(key, q): the quantile of each key's perplexities, rounded up to a whole number of BIN on the scale of logarithms."""
    bins = rows.groupBy("key", F.ceil(F.log("perplexity") / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("key")
    bins = bins.withColumn("upto", F.sum("n").over(every.orderBy("bin"))).withColumn("all", F.sum("n").over(every))
    return bins.where(F.col("upto") >= F.col("all") * quantile).groupBy("key").agg(F.exp(F.min("bin") * BIN).alias("q"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, key: str | None = None) -> DataFrame:
    """Perplexity and verdict for each row of ``docs`` (doc_id, text, lang).

    A row's threshold is the quantile of the held-out trusted rows'
    perplexities in its language, or in all languages where its own has fewer
    than two; a language without trusted rows takes all its rows.  Returns doc_id, row, lang, perplexity, threshold, kept.  An empty or
    null text is judged by its end alone; a null lang is a language of its own;
    a null doc_id is never trusted; repeated rows count each.  Without trusted
    rows every word is equally likely.  Without rows the result is empty.  ``row``
    is the caller's ``key``, if one is named; other columns are not read.
    """
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), key=key)
    scored = perplexities(rows, trusted.select(F.col("doc_id").cast("long").alias("doc_id")))
    scored = stage(rows.select("doc_id", "row", "lang", key_of("lang").alias("key")).join(scored, "row"), "perplexities")
    held = scored.where("held")
    figures = [F.count(F.lit(1)).alias("n"), F.avg(F.log("perplexity")).alias("mean"), F.stddev_samp(F.log("perplexity")).alias("deviation")]
    bound = F.when(F.col("n") >= LEAST_HELD, F.col("q")).when(F.col("n") > 1, _normal_bound(F.col("n"), F.col("mean"), F.col("deviation"), quantile))
    together = held.withColumn("key", F.lit(""))
    everywhere = together.groupBy("key").agg(*figures).join(_quantiles(together, quantile), "key").select(bound.alias("q")).first()
    own = held.groupBy("key").agg(*figures).join(_quantiles(held, quantile), "key").select("key", bound.alias("own"))
    groups = scored.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("trusted").alias("good")).join(own, "key", "left").join(_quantiles(scored, quantile), "key", "left")
    told = F.when(F.col("good"), F.coalesce("own", F.lit(everywhere.q if everywhere else None).cast("double")))
    groups = stage(groups.select("key", "members", F.coalesce(told, "q").alias("threshold")), "thresholds")
    out = attach_groups(scored, groups, "key", "members", F.col("row"))
    return out.select("doc_id", "row", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), (F.col("perplexity") <= F.col("threshold")).alias("kept"))
