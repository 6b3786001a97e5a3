"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording is a WAV file (16-bit PCM) in a binary column.  Its pitch-class
frames are summed into an integral image; sixteen rectangle filters, each
quantised to two bits in Gray code, make one 32-bit integer a frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import attach_groups, numbered, stage

RATE, FRAME, HOP = 4000, 1024, 256
CLASSES = 12
LOW_HZ, HIGH_HZ = 60.0, 1800.0
FILTERS = 16
WIDEST = 16
#: Filter responses (means of normalised energies) between -STEP and STEP are "small".
STEP = 0.04
#: Codes are looked up without their last bits, which flip first.
LOOKUP_SHIFT = 8
#: A match needs so many frames in common and at most this share of wrong bits.
LEAST_FRAMES, MOST_ERRORS = 8, 0.25
#: A search's match covers at least this share of the query's frames.
SEARCH_SHARE = 0.5
#: The code of silence, all responses zero: it says nothing about an offset.
SILENCE = 0x55555555
#: Of the two bits of each filter the one that tells the response's sign.
SIGNS = 0xAAAAAAAA
#: A search lays each query in so many index shards, so that no frequent key meets all recordings in one task.
SALTS = 8
#: A search takes as queries the rows whose id is a multiple of this.
QUERY_STEP = 20


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Samples in [-1, 1] as a mono WAV file."""
    pcm = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def read_wav(media: bytes | None) -> tuple[np.ndarray, str | None]:
    """Mono samples at RATE of a 16-bit PCM WAV file, and what is wrong with media that isn't one."""
    none = np.zeros(0, dtype=np.float32)
    if not media:
        return none, "no media"
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return none, "no WAV file"
    at, layout = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(media):
            layout = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif name == b"data":
            if layout is None:
                return none, "no format ahead of the data"
            kind, channels, rate, _, _, bits = layout
            # 0xFFFE leaves the kind to an extension, of which PCM is the usual one.
            if kind not in (1, 0xFFFE) or bits != 16 or not channels or not rate:
                return none, f"format {kind} with {bits} bits, {channels} channels, {rate} Hz"
            pcm = np.frombuffer(media, dtype="<i2", offset=at + 8, count=min(size, len(media) - at - 8) // (2 * channels) * channels)
            return resampled(pcm.reshape(-1, channels), rate), None
        at += 8 + size + (size & 1)
    return none, "no data"


def samples_of(media: bytes | None) -> np.ndarray:
    return read_wav(media)[0]


#: Samples that are read, filtered or transformed in one go.
_BLOCK = 1 << 18


def resampled(pcm: np.ndarray, rate: int) -> np.ndarray:
    """16-bit samples (one column a channel) as mono at RATE, block by block.

    Above RATE a windowed sinc first takes away what RATE can't hold; then
    samples are interpolated linearly.
    """
    n = len(pcm)
    if rate == RATE:
        return np.concatenate([np.zeros(0, dtype=np.float32), *[(pcm[i : i + _BLOCK].mean(axis=1) / 32768.0).astype(np.float32) for i in range(0, n, _BLOCK)]])
    taps = np.ones(1)
    if rate > RATE:
        half = 16 * -(-rate // RATE)
        t = np.arange(-half, half + 1)
        taps = np.sinc(t * 0.9 * RATE / rate) * np.hanning(len(t) + 2)[1:-1]
        taps /= taps.sum()
    half, out = len(taps) // 2, [np.zeros(0, dtype=np.float32)]
    step = max(1, _BLOCK * RATE // rate)
    total = max(0, (n - 1) * RATE // rate + 1) if n else 0
    for first in range(0, total, step):
        at = np.arange(first, min(first + step, total)) * (rate / RATE)
        lo, hi = max(0, int(at[0]) - half), min(n, int(at[-1]) + half + 2)
        mono = pcm[lo:hi].mean(axis=1) / 32768.0
        size = 1 << (len(mono) + len(taps)).bit_length()
        smooth = np.fft.irfft(np.fft.rfft(mono, size) * np.fft.rfft(taps, size), size)[half : half + len(mono)] if rate > RATE else mono
        out.append(np.interp(at, np.arange(lo, hi), smooth).astype(np.float32))
    return np.concatenate(out)


def _pitch_class_of_bins() -> np.ndarray:
    """Each FFT bin's pitch class, or -1 outside the band."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    inside = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    semitone = np.round(12 * np.log2(np.maximum(hz, 1) / 440.0)).astype(int) % CLASSES
    return np.where(inside, semitone, -1)


_BIN_CLASS = _pitch_class_of_bins()
_FOLD = np.stack([(_BIN_CLASS == c).astype(float) for c in range(CLASSES)], axis=1)
_WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch-class energies, each of length one."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    step, out = _BLOCK // FRAME, []
    for at in range(0, len(frames), step):
        energy = np.abs(np.fft.rfft(frames[at : at + step] * _WINDOW, axis=1)) ** 2 @ _FOLD
        out.append(energy / np.maximum(np.sqrt((energy**2).sum(axis=1, keepdims=True)), 1e-9))
    return np.concatenate(out)


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, height and width of each filter, by rule: every kind at four widths."""
    return [(i % 4, (5 * i) % 7, 4 + (3 * i) % 3 + i % 2, WIDEST * (i // 4 + 1) // 4) for i in range(FILTERS)]


def codes(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that WIDEST frames follow from."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def mean(t0, t1, y0, y1):
        area = image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]
        return area / max(1, (t1 - t0) * (y1 - y0))

    packed = np.zeros(n, dtype=np.uint32)
    for kind, y, height, width in _filters():
        top, half, mid = min(CLASSES, y + height), width // 2, y + height // 2
        if kind == 0:  # low against high pitch
            value = mean(0, width, y, mid) - mean(0, width, mid, top)
        elif kind == 1:  # early against late
            value = mean(0, half, y, top) - mean(half, width, y, top)
        elif kind == 2:  # one diagonal against the other
            value = mean(0, half, y, mid) + mean(half, width, mid, top) - mean(half, width, y, mid) - mean(0, half, mid, top)
        else:  # the middle in time against its sides
            a = max(1, width // 4)
            value = mean(a, width - a, y, top) - (mean(0, a, y, top) + mean(width - a, width, y, top)) / 2
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return packed


def align(a: np.ndarray, b: np.ndarray, share: float = 0.0) -> tuple[int, float, int] | None:
    """Where ``b`` starts in ``a``, the share of wrong bits and the frames in common.

    Equal lookup keys, silence apart, vote for an offset; of all offsets with a
    vote, and with LEAST_FRAMES and ``share`` of ``b`` in common, the one with
    the least share of wrong bits wins, then the longer overlap, then the lesser
    offset.
    """
    if not len(a) or not len(b):
        return None
    ka, kb = a >> np.uint32(LOOKUP_SHIFT), b >> np.uint32(LOOKUP_SHIFT)
    order = np.argsort(ka, kind="stable")
    lo, hi = np.searchsorted(ka[order], kb), np.searchsorted(ka[order], kb, side="right")
    votes = np.zeros(len(a) + len(b), dtype=np.int64)
    for j in np.flatnonzero((hi > lo) & (b != SILENCE)).tolist():
        votes[order[lo[j] : hi[j]] - j + len(b)] += 1
    offsets = np.flatnonzero(votes) - len(b)
    common = np.minimum(len(a), offsets + len(b)) - np.maximum(0, offsets)
    offsets = offsets[common >= max(min(LEAST_FRAMES, len(b)), share * len(b))]
    best = None
    within, step = np.arange(len(b)), max(1, _BLOCK // len(b))
    for at in range(0, len(offsets), step):
        offset = offsets[at : at + step]
        place = offset[:, None] + within
        inside = (place >= 0) & (place < len(a))
        wrong = np.where(inside, np.bitwise_count(a[np.clip(place, 0, len(a) - 1)] ^ b), 0).sum(axis=1, dtype=np.int64)
        n = inside.sum(axis=1)
        k = np.lexsort((offset, -n, wrong / n))[0]
        found = (float(wrong[k]) / (32 * int(n[k])), -int(n[k]), int(offset[k]))
        best = found if best is None or found < best else best
    return None if best is None else (best[2], best[0], -best[1])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, problems = [], []
        for media in batch.column(2):
            samples, problem = read_wav(media.as_py())
            found.append(codes(chroma(samples)).astype(np.int64).tolist())
            problems.append(problem or (None if found[-1] else "too short"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(problems, pa.string())], ["id", "row", "codes", "problem"])


def fingerprint(recordings: DataFrame) -> DataFrame:
    """(id, row, codes, problem) for each row of ``recordings`` (id, row, media).

    Null, empty, short or unreadable media has no codes, and ``problem`` says
    why; media of any sample rate is resampled to RATE.
    """
    return recordings.select("id", "row", "media").mapInArrow(_fingerprint_batches, "id long, row long, codes array<long>, problem string")


def _align_batches(share: float):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("offset", pa.int64()), ("bit_errors", pa.float64()), ("overlap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [align(np.array(a or [], dtype=np.uint32), np.array(b or [], dtype=np.uint32), share) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*[x or (None, None, None) for x in out], strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, schema.field(i + 2).type) for i, c in enumerate(columns)]], schema=schema)

    return run


def align_pairs(pairs: DataFrame, share: float = 0.0) -> DataFrame:
    """(id, row, offset, bit_errors, overlap) for each row of ``pairs`` (id, row, codes, other); null where they don't align."""
    return pairs.select("id", "row", "codes", "other").mapInArrow(_align_batches(share), "id long, row long, offset long, bit_errors double, overlap long")


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """(row, key) for the distinct index keys of the array ``name``.

    A key holds the signs of the responses, which noise flips least, of two
    codes LEAST_FRAMES apart; two silent codes make none.
    """
    n = F.greatest(F.size(name) - LEAST_FRAMES, F.lit(0))

    def signs(a, b):
        key = a.bitwiseAND(F.lit(SIGNS)).bitwiseOR(F.shiftright(b.bitwiseAND(F.lit(SIGNS)), 1))
        return F.when((a != SILENCE) | (b != SILENCE), key)

    keys = F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(1 + LEAST_FRAMES), n), signs)
    return rows.select("row", F.explode(F.array_compact(F.array_distinct(keys))).alias("key"))


def _single_keys(rows: DataFrame, name: str) -> DataFrame:
    """(row, key) with the signs of each code that isn't silent, apart from all keys of two codes."""
    keys = F.transform(name, lambda a: F.when(a != SILENCE, a.bitwiseAND(F.lit(SIGNS)).bitwiseOR(F.lit(1 << 40))))
    return rows.select("row", F.explode(F.array_compact(F.array_distinct(keys))).alias("key"))


def search(recordings: DataFrame, queries: DataFrame) -> DataFrame:
    """Align each of ``queries`` (row, other) with each of ``recordings`` (row, codes) that shares an index key.

    Returns row (the query's), found_row, offset, bit_errors and overlap for the
    pairs with at most MOST_ERRORS wrong bits over SEARCH_SHARE of the query.
    The index proposes every recording that shares a key, however many those
    are.  A query of LEAST_FRAMES codes or fewer has no key of two codes; such
    queries are looked up by single codes.  A query of silence finds nothing.
    """
    asked, index = _keys(queries, "other"), _keys(recordings, "codes")
    short = queries.where(F.size("other").between(1, LEAST_FRAMES))
    if short.limit(1).count():
        asked, index = asked.union(_single_keys(short, "other")), index.union(_single_keys(recordings, "codes"))
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    index = index.select(F.col("row").alias("found_row"), "key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = index.join(salted, ["key", "salt"]).select("row", "found_row").distinct()
    pairs = pairs.join(recordings.select(F.col("row").alias("found_row"), "codes"), "found_row").join(queries, "row")
    aligned = align_pairs(pairs.select(F.col("found_row").alias("id"), "row", "codes", "other"), SEARCH_SHARE)
    return aligned.where(F.col("bit_errors") <= MOST_ERRORS).withColumnRenamed("id", "found_row")


def tune(vector) -> np.ndarray:
    """A melody for a vector: a note a component, its pitch by the value."""
    values = np.array([0.0 if v is None or v != v else v for v in vector or []], dtype=float)
    if not len(values):
        return np.zeros(0)
    semitone = np.clip(np.round(values * 40) + 14, 0, 35)
    hz = np.repeat(110.0 * 2 ** (semitone / 12), 2 * HOP)
    phase = 2 * np.pi * np.cumsum(hz) / RATE
    return 0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)


def excerpt(samples: np.ndarray, key: int) -> tuple[np.ndarray, int]:
    """Two thirds of a recording from a place that ``key`` draws, with noise; and that place."""
    length = 2 * len(samples) // 3
    start = (key * 7919) % max(1, len(samples) - length + 1)
    noise = np.random.default_rng(key & 0x7FFFFFFF).normal(0, 0.02, length)
    return samples[start : start + length] + noise, start


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, row, vector) to a recording and an excerpt of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            whole, cut, starts = [], [], []
            for key, vector in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                samples = tune(vector)
                piece, start = excerpt(samples, key or 0)
                whole.append(wav(samples))
                cut.append(wav(piece))
                starts.append(start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(whole, pa.binary()), pa.array(cut, pa.binary()), pa.array(starts, pa.int64())], ["id", "row", "media", "cut", "start"])


def _digest(values: list) -> bytes | None:
    return hashlib.sha256(np.array(values, dtype="<i8").tobytes()).digest() if values else None


def recordings_of(vectors: DataFrame, key: str | None = None) -> DataFrame:
    """(id, row, media, cut, start): a rendered recording of each row of ``vectors`` (id, vector), and an excerpt."""
    rows = numbered(vectors, F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), key=key)
    return rows.select("id", "row", "vector").mapInArrow(_render_batches, "id long, row long, media binary, cut binary, start long")


def find_excerpts(recordings: DataFrame) -> DataFrame:
    """Align each recording's excerpt with it, tell recordings with equal codes, and search all for the queries' excerpts.

    ``recordings`` has id, row, media, cut, start; the queries are the rows whose
    id is a multiple of QUERY_STEP.  Returns two kinds of rows.  One ``recording`` a row:
    id, row, n_codes, problem (see ``fingerprint``), class_id (the least id with the same codes, its own if it
    has none), class_size, start_frame, found_frame, bit_errors and matched:
    whether the offset was found within one frame and the errors are at most
    MOST_ERRORS.  One ``match`` a query and class that ``search`` finds: id and
    row of the query, class_id, class_size, start_frame, found_frame,
    bit_errors and overlap.  Null, empty, short or unreadable media has no codes
    and matches nothing; a null id is no query; repeated rows are one class.
    Without rows the result is empty.
    """

    def both(batches):
        for batch in batches:
            heard = [next(_fingerprint_batches(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(k)], ["id", "row", "media"])]))) for k in (2, 3)]
            digests = pa.array([_digest(c) for c in heard[0].column("codes").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *[h.column("codes") for h in heard], digests, heard[0].column("problem")], ["id", "row", "start", "codes", "other", "digest", "problem"])

    found = recordings.select("id", "row", "media", "cut", "start").mapInArrow(both, "id long, row long, start long, codes array<long>, other array<long>, digest binary, problem string")
    found = stage(found, "codes")
    aligned = align_pairs(found)
    names = found.select("id", "row", "start", "problem", F.size("codes").alias("n_codes"), F.coalesce(F.hex("digest"), F.concat(F.lit("none"), F.col("row").cast("string"))).alias("key"))
    groups = names.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"), F.max("n_codes").alias("codes"), F.count(F.lit(1)).alias("class_size"))
    groups = stage(groups.select("key", F.col("least.id").alias("class_id"), F.col("least.row").alias("class_row"), "class_size", "codes"), "classes")
    frame = F.col("start") / HOP
    start_frame, errors = F.round(frame, 3).alias("start_frame"), F.round("bit_errors", 6).alias("bit_errors")

    out = attach_groups(names.join(aligned.drop("id"), "row"), groups.select("key", "class_id", "class_size"), "key", "class_size", F.col("row"))
    matched = (F.abs(F.col("offset") - frame) <= 1) & (F.col("bit_errors") <= MOST_ERRORS)
    out = out.select("id", "row", F.lit("recording").alias("kind"), "n_codes", "class_id", "class_size", start_frame, F.col("offset").alias("found_frame"), errors, "overlap", F.coalesce(matched, F.lit(False)).alias("matched"), "problem")

    classes = groups.where("codes > 0").select(F.col("class_row").alias("found_row"), "class_id", "class_size")
    asked = found.where(F.col("id") % QUERY_STEP == 0)
    firsts = found.select(F.col("row").alias("found_row"), "codes").join(classes.select("found_row"), "found_row", "left_semi").withColumnRenamed("found_row", "row")
    hits = search(firsts, asked.select("row", "other")).join(classes, "found_row").join(asked.select("row", "id", "start"), "row")
    hits = hits.select("id", "row", F.lit("match").alias("kind"), F.lit(None).cast("int").alias("n_codes"), "class_id", "class_size", start_frame, F.col("offset").alias("found_frame"), errors, "overlap", F.lit(None).cast("boolean").alias("matched"), F.lit(None).cast("string").alias("problem"))
    return out.unionByName(hits)
