"""Operators without SQL against plain versions, and the cases that real files bring."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from test_llm import FOLD, SCHEMA, WORD, brute_components, corpus, prose


def plain_dedup(rows, min_words, line_words):
    """The text of each row without its repeats: units and whole lines ranked by doc_id and row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    cut, seen_units, seen_lines, out = {}, set(), set(), {}
    for i in order:
        text, units, lines = rows[i][1] or "", [], []
        for line in re.finditer(r"[^\n]+", text):
            words = [(m.start() + line.start(), m.end() + line.start()) for m in WORD.finditer(line[0])]
            if not words:
                continue
            first, start = len(units), 0
            for k, (_, end) in enumerate(words):
                if text[end - 1] in ".!?" or k + 1 == len(words):
                    units.append(words[start : k + 1])
                    start = k + 1
            lines.append((first, len(units), words))
        name = lambda ws: tuple(text[a:b].translate(FOLD) for a, b in ws)  # noqa: B023, E731
        repeated = []
        for u in units:
            repeated.append(name(u) in seen_units)
            seen_units.add(name(u))
        gone, k = [False] * len(units), 0
        while k < len(units):
            to = k
            while to < len(units) and repeated[to] == repeated[k]:
                to += 1
            if repeated[k] and sum(len(u) for u in units[k:to]) >= min_words:
                gone[k:to] = [True] * (to - k)
            k = to
        for first, last, words in lines:
            if len(words) >= line_words:
                if name(words) in seen_lines:
                    gone[first:last] = [True] * (last - first)
                seen_lines.add(name(words))
        kept, at = "", 0
        for k, u in enumerate(units):
            if gone[k]:
                kept += text[at : u[0][0]] if not (k and gone[k - 1]) else ""
                at = units[k + 1][0][0] if k + 1 < len(units) else u[-1][1]
        out[i] = kept + text[at:]
    return out


def test_substring_dedup_against_plain(spark):
    from waybill.llm.substring_dedup import substring_dedup

    r = random.Random(12)
    stock = [prose(k, r.randrange(1, 15)) + r.choice([".", "!", ""]) for k in range(25)]
    rows = []
    for i in range(60):
        parts = [r.choice(stock) if r.random() < 0.6 else prose(1000 + 50 * i + k, r.randrange(1, 20)) for k in range(r.randrange(0, 9))]
        text = "".join(p.upper() + s if r.random() < 0.1 else p + s for p, s in zip(parts, r.choices([" ", "\n", " \n\t", "  "], k=len(parts)), strict=True))
        rows.append((r.choice([i, i, None, 7]), None if i == 9 else text, i))
    df = spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(4)
    for least in ((20, 3), (1, 1)):
        want = plain_dedup(rows, *least)
        got = {x.row: x for x in substring_dedup(df, *least, key="at").collect()}
        for i, (_, text, _) in enumerate(rows):
            assert (got[i].text or "") == want[i], (least, i)
            assert (got[i].text is None) == (text is None)


def test_sharding_order(spark):
    """Each row's shard and slot from the plain order, and the mixture of every shard."""
    from waybill.llm.sharding import SEED, interleave

    rows = [(i, f"text {i}", ["a"] * 7 + ["b"] * 2 + [None]) for i in range(600)]
    rows = [(i, t, s[i % 10]) for i, t, s in rows]
    got = interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=12).collect()
    by = defaultdict(list)
    for x in got:
        draw = hashlib.md5(f"{SEED}|{x.doc_id}|{x.text_crc32}|{x.size}".encode()).hexdigest()
        by[x.source].append((draw, x.doc_id))
    order = sorted(((2 * k + 1) / (2 * len(own)), draw, d) for own in by.values() for k, (draw, d) in enumerate(sorted(own)))
    place = {d: k for k, (_, _, d) in enumerate(order)}
    for x in got:
        assert (x.shard, x.slot) == (place[x.doc_id] // 50, place[x.doc_id] % 50)
    counts = Counter((x.shard, x.source) for x in got)
    assert all(abs(counts[s, k] - n) <= 1 for s in range(12) for k, n in (("a", 35), ("b", 10), (None, 5)))


def test_language_fusion_against_plain(spark):
    """Posteriors from the model's likelihoods, votes, declared labels and host priors, worked out row by row."""
    import pyarrow as pa

    from waybill.llm import language_id as m
    from waybill.llm.textscan import scans

    r = random.Random(2)
    stems = {"en": "the that with this have from there".split(), "de": "der die und nicht auch eine werden".split()}
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, " ".join(r.choice(stems[lang]) for _ in range(r.randrange(0, 9))), r.choice([lang, lang, None, "xx"]), r.choice(["h1", "h2", None])))
    model = m.TextModel(("de", "en"), m.fit_text_model(spark.createDataFrame([(" ".join(w) * 3, k) for k, w in stems.items()], "text string, lang string")).logs, [m.NO_LANGUAGE] * 2, [0.0] * 2)
    df = spark.createDataFrame([(i, i, t, d, h) for i, t, d, h in rows], "row long, row_id long, text string, declared string, host string").selectExpr("*", "cast(null as string) domain", "cast(null as string) suffix")
    got = {x.row_id: x for x in m.identify(df, model, levels=("host",)).collect()}
    table = np.frombuffer(model.logs, dtype="<f4").reshape(3, -1)
    (scored,) = [scan for _, scan in scans(pa.array([t for _, t, *_ in rows]), fold=True)]
    code, doc = m.cells(scored.data, scored.origin)
    text, votes, fits = [], [], []
    for i in range(len(rows)):
        own = code[doc == i]
        mean = table[:, own].astype(float).mean(axis=1) if len(own) else np.zeros(3)
        logs = mean * min(len(own), m.FULL_TEXT) * m.TEXT_WEIGHT
        ok = [bool(len(own)) and x > m.NO_LANGUAGE + 1e-6 for x in mean[:2]] + [False]
        said = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        text.append(logs)
        fits.append(ok)
        votes.append(said if any(ok) else np.array([0, 0, 1.0 if len(own) else 0]))
    label = [d if d in ("de", "en") else "other" if d else "" for _, _, d, _ in rows]
    seen = {x: sum((v for v, y in zip(votes, label, strict=True) if y == x), np.zeros(3)) for x in ("de", "en", "other", "")}
    total, everything = sum(seen.values()) + 4, sum(votes)
    for i, (_, t, _, h) in enumerate(rows):
        prior = (everything + 1) / (everything.sum() + 3)
        if h:
            others = sum((v for k, v in enumerate(votes) if rows[k][3] == h), np.zeros(3)) - votes[i]
            prior = (others + m.PULL * prior) / (others.sum() + m.PULL)
        told = text[i] + (np.log((seen[label[i]] + 1) / total) if label[i] else 0) + np.log(prior)
        fused = np.exp(told - told.max()) / np.exp(told - told.max()).sum()
        best = int(fused.argmax())
        assert got[i].lang == ("de", "en", m.OTHER)[best] and abs(got[i].posterior - fused[best]) < 2e-6
        assert got[i].kept == (bool(re.search("[a-z]", t)) and fits[i][best] and fused[best] >= m.ACCEPT)


def test_pipeline_against_plain(spark, tmp_path):
    """What each stage keeps, by plain versions where there are any, and an empty table."""
    import corpus_pipeline as p

    rows = corpus() + [(50 + i, prose(60 + i, 30 + i), f"s{i % 4}", "en") for i in range(25)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", n_chars long, row string").write.parquet(path)
    docs = spark.read.parquet(path)
    stages = dict(p.STAGES)
    spaced = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    kept = stages["exact_dedup"](spark, docs, str(tmp_path)).collect()
    assert Counter(spaced(x.text) for x in kept) == Counter({spaced(t) for _, t, *_ in rows})
    least = defaultdict(list)
    for d, t, *_ in rows:
        least[spaced(t)].append((d is None, d or 0))
    assert all((x.doc_id is None, x.doc_id or 0) == min(least[spaced(x.text)]) for x in kept)

    near = stages["ngram_join"](spark, docs, str(tmp_path)).collect()
    want = Counter({(d, n, c): 1 for d, n, c in brute_components(rows) if d == c and n}) + Counter({k: v for k, v in brute_components(rows).items() if not k[1]})
    assert Counter(x.doc_id for x in near) == Counter(d for d, _, _ in want.elements())

    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = sum(size(t) for _, t, *_ in rows)
    assert all(n <= 3 * Counter(map(str, docs.collect()))[x] for x, n in Counter(map(str, mixed)).items())
    assert abs(sum(size(x.text) for x in mixed) - total) <= sum(max(size(t) for _, t, s, _ in rows if s == k) for k in {s for _, _, s, _ in rows})

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in packed if not x.start) == Counter(d for d, *_ in rows)

    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_warc_gz_and_damage(spark, tmp_path):
    from waybill.llm import warc

    bodies = [bytes([65 + i % 26]) * 1500 for i in range(40)]
    members = [warc.member(i, "u", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    for name in ("a.warc", "a.warc.gz"):
        (tmp_path / name).write_bytes(b"".join(members))
        rows = warc.read_archives(spark, str(tmp_path / name)).collect()
        assert {x.page_id: bytes(x.payload) for x in rows} == dict(enumerate(bodies))
    broken = bytearray(members[7])
    broken[60] ^= 0xFF
    broken[61] ^= 0xFF
    (tmp_path / "b.warc").write_bytes(b"".join(members[:7]) + bytes(broken) + b"".join(members[8:])[:-4])
    for size in ("3000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = warc.read_archives(spark, str(tmp_path / "b.warc"), errors="row").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert {x.page_id for x in rows if x.record_type == "response"} == set(range(40)) - {7, 39}
        assert 1 <= sum(x.record_type == "damaged" for x in rows) <= 2


def test_audio_rates_lengths_and_clashes(spark):
    from pyspark.sql import functions as F

    from waybill.llm import audio_fingerprint as m

    def sound(rate, seconds, seed=3):
        r = np.random.default_rng(seed)
        hz = np.repeat(110 * 2 ** (r.integers(0, 24, seconds * 4) / 12), rate // 4)
        return m.wav(0.6 * np.sin(2 * np.pi * np.cumsum(hz) / rate), rate)

    base = m.codes(m.chroma(m.samples_of(sound(4000, 20))))
    for rate in (8000, 16000, 44100):
        other = m.codes(m.chroma(m.samples_of(sound(rate, 20))))
        offset, errors, _ = m.align(base, other[20:])
        assert abs(offset - 20) <= 1 and errors < 0.12
    long = m.samples_of(sound(8000, 900))
    assert abs(len(long) - 900 * 4000) <= 1 and len(m.chroma(long)) == (len(long) - m.FRAME) // m.HOP + 1
    eight = bytearray(sound(4000, 1))
    eight[34:36] = b"\x08\x00"
    assert m.read_wav(bytes(eight))[1] and m.read_wav(b"")[1] == "no media" and m.read_wav(b"MP3")[1] == "no WAV file"
    # A short query finds the long recording that holds it, by single codes.
    piece = base[30:36].astype(np.int64).tolist()
    recordings = spark.createDataFrame([(1, base.astype(np.int64).tolist()), (2, base[::-1].astype(np.int64).tolist())], "row long, codes array<long>")
    found = m.search(recordings, spark.createDataFrame([(9, piece)], "row long, other array<long>")).collect()
    assert [(x.found_row, x.offset) for x in found if x.bit_errors == 0] == [(1, 30)]
    vectors = spark.createDataFrame([(20 * i, [float(x) for x in np.random.default_rng(i).normal(0, 0.2, 64)]) for i in range(3)], "id long, vector array<float>")
    clash = vectors.withColumns({c: F.lit("x") for c in ("row", "codes", "media", "key", "start")})
    assert m.find_excerpts(m.recordings_of(clash)).where("kind = 'recording' and matched").count() == 3
    assert m.find_excerpts(m.recordings_of(vectors.limit(0))).count() == 0
