"""The corpus operators on small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "."]) for _ in range(n))


def corpus():
    """(doc_id, text, source, lang): every awkward case."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", " \t\n", "one", "One", "two words", "two\t words", base, base.replace(" ", "\n"), near, base.upper(), prose(2, 40), "é ü " * 30, prose(3, 6000), "a" * 70000, base]
    rows = [(i, t, [None, "b", "a", "ä"][i % 4], [None, "en", "de", "xx"][i % 4]) for i, t in enumerate(texts)]
    return rows + [(7, base, "a", "en"), (None, base, "a", "en"), (None, None, None, None)]


SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    # The extra columns have the names that operators give their own.
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "size", "digest", "cls", "n", "key", "shard", "start", "target", "own", "piece")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, nothing):
    from waybill.llm.mixing import mix

    rows = mix(docs).collect()
    assert len(rows) == len(corpus()) and mix(nothing).count() == 0
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken == r.times * r.size <= 3 * r.size
        sizes[r.source_size] += r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(t <= 3 * s + 1e-9 for s, t in target.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)


def test_water_filling(spark):
    from waybill.llm.mixing import source_targets

    r = random.Random(5)
    for _ in range(3):
        sizes = [(f"s{chr(97 + i)}", r.choice([0, 1, 10, 1000, r.randrange(10**6)])) for i in range(8)]
        got = {x.skey: x.target for x in source_targets(spark.createDataFrame(sizes, "skey string, source_size long")).collect()}
        weights = {k: i % 3 + 1 for i, (k, _) in enumerate(sorted(sizes))}
        caps, total, open_, want = {k: 3 * s for k, s in sizes}, sum(s for _, s in sizes), dict(weights), {}
        while open_:
            left = total - sum(want.values())
            share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
            over = [k for k in open_ if share[k] >= caps[k]]
            want |= {k: caps[k] for k in over} if over else share
            open_ = {k: w for k, w in open_.items() if k not in want}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_sharding(docs, nothing):
    from waybill.llm.sharding import interleave

    rows = interleave(docs, shards=4).collect()
    assert interleave(nothing).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_exact_dedup(docs, nothing):
    from waybill.llm.exact_dedup import exact_dedup

    rows = exact_dedup(docs).collect()
    assert exact_dedup(nothing).count() == 0
    groups = defaultdict(list)
    for d, t, _, _ in corpus():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()].append(d)
    want = Counter((d, min((x for x in ids if x is not None), default=None), len(ids), dig) for dig, ids in groups.items() for d in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in rows) == want
    assert Counter(bytes(r.digest) for r in rows if r.kept) == Counter(groups.keys())


def test_cuckoo_index():
    from waybill.llm.exact_dedup import CuckooIndex

    index, live = CuckooIndex(buckets=2), {}
    r = random.Random(3)
    for i in range(5000):
        d = hashlib.sha256(str(r.randrange(1500)).encode()).digest()
        if r.random() < 0.4:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            index.insert(d, (i % 2, i, -i, i + 1))
            live[d] = (i % 2, i, -i, i + 1)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 0
    assert all(index.get(d) == v for d, v in live.items())
    d = next(iter(live))
    index.merge(d, (0, -5, 7, 2))
    assert index.get(d) == (0, -5, 7, live[d][3] + 2)


def test_retired_digests(spark, docs):
    from waybill.llm.exact_dedup import build_index, digest_rows, retire

    digests = digest_rows(docs)
    index = build_index(digests)
    gone = digests.where("doc_id = 3")
    left = retire(index, gone)
    assert left.count() == index.count() - 1 and left.join(gone, "digest").count() == 0


def sets_of(rows):
    out = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_components(rows):
    """n_shingles and component_id of each row, by all pairs."""
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    return Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else d) for i, (d, s) in enumerate(sets))


def test_ngram_join(docs, nothing):
    from waybill.llm.ngram_join import ngram_join

    assert ngram_join(nothing).count() == 0
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs).collect()) == brute_components(corpus())


@pytest.mark.parametrize("most", [4096, 12])
def test_ngram_join_large_groups(spark, most):
    """Near copies around a base, linked mostly through it; with a small limit blocks and clusters go in parts."""
    from waybill.llm import ngram_join as m

    r = random.Random(most)
    rows = []
    for g in range(3):
        base = prose(100 + g, 80).split()
        for k in range(30):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{g}{k}"
            rows.append((len(rows), " ".join(w), "s", "en"))
    want = brute_components(rows)
    for df in (spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(rows, SCHEMA).repartition(1).where("doc_id >= 0")):
        assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in m.ngram_join(df, most=most).collect()) == want


@pytest.mark.parametrize("size", [3, 7, 10, 64])
def test_ngram_join_blocks_across_batches(size):
    """Blocks with repeated rows, cut by batches and by the limit, keep every pair of close sizes."""
    from waybill.llm.components import Forest
    from waybill.llm.ngram_join import _shared_batches

    r = random.Random(size)
    for _ in range(40):
        most, sizes, rows = r.choice([5, 8, 20]), {}, []
        for gram in range(8):
            for cls in r.sample(range(60), r.choice([1, 2, 3, 4, 5, 7, 9, 12, 30])):
                rows += [(gram, sizes.setdefault(cls, r.randrange(40, 80)), cls)] * r.randrange(1, 6)
        rows.sort()
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[i : i + size]]) for k in (0, 2, 1)], ["gram", "cls", "n"]) for i in range(0, len(rows), size)]
        out = [x for b in _shared_batches(iter(batches), most) for x in b.to_pylist()]
        assert all(x["a"] != x["b"] for x in out)
        forest, blocks = Forest(60), defaultdict(list)
        for x in out:
            if x["b"] is None:
                blocks[x["gram"]].append(x["a"])
            else:
                forest.join(x["a"], x["b"])
        for members in blocks.values():
            assert len(set(members)) == len(members)
            for a in members:
                forest.join(members[0], a)
        for gram in range(8):
            own = {c for g, _, c in rows if g == gram}
            assert all(forest.find(a) == forest.find(b) for a in own for b in own if 80 * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]))
            # A block is handed out whole or not at all.
            assert gram not in blocks or set(blocks[gram]) == own


def test_count_tree():
    from waybill.llm.ngram_join import CountTree, needed, vector

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, r.integers(20, 45)).astype(np.uint64)) for _ in range(300)]
    points = np.stack([vector(s).astype(np.int32) if len(vector(s)) == 8 else np.bincount((s & np.uint64(7)).astype(int), minlength=8) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes)
    for i in range(0, 300, 17):
        bound = np.minimum(points, points[i]).sum(axis=1)
        ok = (bound >= needed(sizes[i], sizes)) & (10 * sizes >= 8 * sizes[i]) & (8 * sizes <= 10 * sizes[i])
        assert set(tree.near(points[i], int(sizes[i])).tolist()) == set(np.flatnonzero(ok).tolist())


def test_scan_words():
    from waybill.llm.textscan import scans

    texts = [t for _, t, *_ in corpus()]
    seen = {}
    for at, scan in scans(pa.array(texts), fold=True, chunk_bytes=1000):
        hashes = scan.word_hashes()
        for i in range(scan.n_docs):
            words = [scan.word(j).decode() for j in range(scan.first[i], scan.first[i + 1])]
            assert words == WORD.findall((texts[at + i] or "").translate(FOLD))
            for w, h in zip(words, hashes[scan.first[i] : scan.first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    from waybill.llm.packing import pack

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = pack(docs, path, sequence=64, group_pieces=50).collect()
    assert pack(nothing, path).count() == 0
    coder = Tokenizer.from_file(path)
    want = Counter()
    for d, t, *_ in corpus():
        ids = coder.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 64):
            want[(d, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], dtype="<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_special_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    from waybill.llm.packing import PIECE_SCHEMA, piece_batches

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    pieces = ["<|endoftext|>", "<|EndOfText|>", "foo<|startoftext|>bar", "<|", "|>", " ", "\n", "end", "É.", "I'LL", "!?", "42"]
    r = random.Random(5)
    texts = [None, *pieces, *["".join(r.choices(pieces, k=r.randint(2, 12))) for _ in range(2000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "row", "text"])
    (found,) = piece_batches(path, 4096, 2)(iter([batch]))
    assert found.schema.names == [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    coder = Tokenizer.from_file(path)
    want = [zlib.crc32(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for t in texts]
    assert found["ids_crc32"].to_pylist() == want


def test_first_fit_decreasing():
    from waybill.llm.packing import first_fit_decreasing

    lengths = np.random.default_rng(2).integers(1, 100, 400)
    bins, _ = first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= lengths[i]
        want[int(i)] = k
    assert {i: int(b) for i, b in enumerate(bins)} == want


def test_warc(spark):
    from waybill.llm.warc import round_trip

    big = "ü" * 600
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "", None), (6, "u", ""), (7, "v", "W" * 200_000), (2, "again", big), (None, "z", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect())
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and p != 2
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)] += 1
    assert got == want and round_trip(df.limit(0)).count() == 0


def test_warc_ranges(spark, tmp_path):
    """Small ranges, and payloads full of gzip magics in stored blocks."""
    from waybill.llm import warc

    want = {}
    with open(tmp_path / "a.warc", "wb") as f:
        for i in range(30):
            body = b"x".join(warc.MAGIC + random.Random(i * 9 + k).randbytes([0, 50, 2000][k % 3]) for k in range(6))
            want[i] = (len(body), hashlib.sha1(body).hexdigest())
            record = zlib.decompress(warc.member(i, None, body, want[i][1], None), 31)
            packer = zlib.compressobj(0, zlib.DEFLATED, 31)
            f.write(packer.compress(record) + packer.flush())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_substring_dedup(spark, docs, nothing):
    from waybill.llm.substring_dedup import substring_dedup

    assert substring_dedup(nothing).count() == 0 and substring_dedup(docs).count() == len(corpus())
    passage = ". ".join(prose(50 + k, 12).replace(".", "") for k in range(5)) + "."
    rows = [(1, f"Own start here. {passage} Own end."), (2, f"Other words first.\n{passage.upper()}\nAnd a tail é."), (3, "Stock phrase."), (4, "Stock phrase.\nMore."), (5, passage)]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and not got[1].removed
    assert got[2].text == "Other words first.\nAnd a tail é." and got[5].text == ""
    assert got[4].text == rows[3][1]
    for d, text in rows:
        at, out = 0, ""
        for s in got[d].removed:
            out, at = out + text[at : s.start], s.end
        assert out + text[at:] == got[d].text


def test_substring_dedup_whole_lines(spark):
    """Short lines that repeat as a whole go, also of several sentences; parts of lines and tiny lines stay."""
    from waybill.llm.substring_dedup import substring_dedup

    rows = [
        (1, "Read more about this.\nOwn text one. Click here.\nThe end."),
        (2, "Other text two.\nread  more about THIS.\nOwn text one. Click here.\nThe end."),
        (3, "Third é text. Read more about this. Goes on.\nClick here. Own text one."),
        (4, "All rights reserved here\nA b c\nAll rights reserved here\nEnd"),
    ]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other text two.\nThe end." and got[2].removed_words == 9
    assert got[4].text == "All rights reserved here\nA b c\nEnd"
    for d, text in rows:
        at, out = 0, ""
        for x in got[d].removed:
            out, at = out + text[at : x.start], x.end
        assert out + text[at:] == got[d].text


def test_language_id(spark, docs, nothing):
    from waybill.llm.language_id import address_parts, identify_documents, identify_pages

    assert identify_documents(nothing).count() == 0
    rows = {r.doc_id: r for r in identify_documents(docs).collect()}
    assert len(rows) == 17 and not rows[2].kept and not rows[1].kept
    en, de = "the cat with this thing that they have there ", "der Hund und nicht die Katze auch mit einer "
    train = spark.createDataFrame([(en * 9, "en"), (de * 9, "de")], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://u@www.a.de:80/x", f"<html lang='de-DE'><p>{de * 3}"), (2, "https://b.com/", f'<HTML LANG="de"><p>{en * 9}'), (3, "http://www.a.de/", "<html></html>"), (4, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.lang, r.kept) for r in identify_pages(pages, train).collect()}
    assert got[1] == ("de", True) and got[2] == ("en", True) and not got[3][1] and not got[4][1]
    host, domain, suffix = address_parts(pages.url)
    assert tuple(pages.where("page_id = 1").select(host, domain, suffix).first()) == ("www.a.de", "a.de", "de")


def test_language_id_rejects_other_languages(spark):
    """Texts in unlisted languages and letter junk, among and declared as listed ones."""
    from waybill.llm.language_id import identify_documents

    r = random.Random(9)
    stems = {"en": "the that with this have from there which would their about other".split(), "de": "der die und nicht auch eine werden sich nach über können schon".split()}
    rows = []
    for i in range(600):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(r.choice(stems[lang]) for _ in range(r.randrange(3, 120))), f"s{i % 3}", lang))
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由,在尊严和权利上一律平等",
        *[" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(100)) for _ in range(5)],
    ]
    strange = [(1000 + i, t, "s0", [None, "fi", "xx"][i % 3]) for i, t in enumerate(other)]
    got = {x.doc_id: x for x in identify_documents(spark.createDataFrame(rows + strange, "doc_id long, text string, source string, lang string")).collect()}
    assert not [d for d, *_ in strange if got[d].kept]
    assert sum(got[d].kept and got[d].lang == lang for d, _, _, lang in rows) >= 0.98 * len(rows)


def test_quality_model(spark, docs, nothing):
    from waybill.llm.quality_lm import classify

    ids = spark.createDataFrame([(i,) for i in range(20, 60)], "doc_id long")
    assert classify(nothing, ids).count() == 0
    assert classify(docs, ids.limit(0)).count() == len(corpus())
    rows = [(i, prose(i, 80), "en") for i in range(20, 70)] + [(90, "QX!! ZZ%% " * 30, "en"), (91, "", "en"), (92, None, None)]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ids).collect()}
    assert all(got[i].kept for i in range(20, 70)) and not got[90].kept


def test_quality_model_word_order(spark):
    """Shuffled words cost more than the order that trusted text has."""
    from waybill.llm.quality_lm import classify

    r = random.Random(11)
    phrases = [[f"w{p}x{k}" for k in range(6)] for p in range(30)]
    line = lambda: [w for _ in range(12) for w in r.choice(phrases)]
    rows = [(i, " ".join(line()), "en") for i in range(60)]
    for i in range(20):
        words = line()
        rows.append((100 + i, " ".join(words), "en"))
        r.shuffle(words)
        rows.append((200 + i, " ".join(words), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in classify(df, spark.range(60).toDF("doc_id")).collect()}
    assert not any(got[200 + i].kept for i in range(20))
    assert all(got[200 + i].perplexity > 3 * got[100 + i].perplexity for i in range(20))


def test_quality_threshold_is_the_quantile(spark):
    """The threshold is the quantile of held-out trusted rows, without a factor."""
    from pyspark.sql import functions as F

    from waybill.llm.quality_lm import QUANTILE, classify, perplexities

    df = spark.createDataFrame([(i, prose(i, 30), "en") for i in range(800)], "doc_id long, text string, lang string")
    ids = spark.range(700).toDF("doc_id")
    scored = perplexities(df.withColumn("row", F.col("doc_id")), ids).collect()
    held = sorted(x.perplexity for x in scored if x.held)
    assert 100 <= len(held) < 200 and all(x.trusted for x in scored if x.held)
    got = classify(df, ids).collect()
    (threshold,) = {x.threshold for x in got}
    want = held[-(-round(100 * QUANTILE) * len(held) // 100) - 1]
    assert want - 1e-6 <= threshold <= want * 1.0011
    assert sum(x.kept for x in got if x.doc_id >= 700) >= 90


def plain_kneser_ney(good):
    """(v, w) to its probability under an interpolated modified Kneser-Ney bigram model of the texts' words."""
    from waybill.llm.quality_lm import WORD_BITS

    def discounts(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0]
        return [0, *[min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw)]]

    pairs = Counter(p for t in good for p in pairs_of(t))
    after, ends = Counter(), Counter()
    for (v, w), c in pairs.items():
        after[v] += c
        ends[w] += 1
    d, d1, cells = discounts(pairs.values()), discounts(ends.values()), 1 << WORD_BITS
    types = sum(ends.values())
    spare = sum(d1[min(c, 3)] for c in ends.values()) / types
    back = Counter()
    for (v, _), c in pairs.items():
        back[v] += d[min(c, 3)]

    def prob(v, w):
        p1 = (ends[w] - d1[min(ends[w], 3)]) / types + spare / cells
        c = pairs[v, w]
        return (c - d[min(c, 3)]) / after[v] + back[v] / after[v] * p1 if v in after else p1

    return prob


def pairs_of(text):
    words = ["<", *WORD.findall((text or "").translate(FOLD)), ">"]
    return list(zip(words[:-1], words[1:], strict=True))


def test_perplexity_against_a_plain_model(spark, monkeypatch):
    """Every document's perplexity, with pieces of a few documents and several shards."""
    from waybill.llm import quality_lm as q

    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus())] + [(100 + i, prose(i % 30, 40)) for i in range(60)] + [(300, "Foreign words here and alpha beta")]
    trusted = [i for i, _ in rows if i % 3 != 1 and i != 300]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, row long").repartition(4)
    for most in (q.MOST_MARKS, 0):  # 0: trusted texts are joined instead of marked
        monkeypatch.setattr(q, "MOST_MARKS", most)
        got = {x.row: x for x in q.perplexities(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
        assert {i for i, x in got.items() if x.trusted} == set(trusted) and {i for i, x in got.items() if x.held} < set(trusted)
        prob = plain_kneser_ney([t for i, t in rows if i in trusted and not got[i].held])
        for i, t in rows:
            pairs = pairs_of(t)
            want = -sum(np.log(prob(v, w)) for v, w in pairs) / len(pairs)
            assert abs(np.log(got[i].perplexity) - want) < 0.02, (i, got[i].perplexity, np.exp(want))


def test_pieces():
    from waybill.llm import quality_lm as q

    r = random.Random(8)
    texts = [r.choice([None, "", "x" * r.randrange(q.PIECE_BYTES // 3), "y" * (q.PIECE_BYTES + 5)]) for _ in range(25)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 5)), pa.array(texts[i : i + 5], pa.string())], ["row", "text"]) for i in range(0, 25, 5)]
    found = list(q._pieces(iter(batches)))
    assert [x for rows, _ in found for x in rows] == list(range(25))
    assert [t for _, own in found for t in own.to_pylist()] == texts
    assert all(len(rows) == 1 or sum(len(t or "") for t in own.to_pylist()) <= q.PIECE_BYTES for rows, own in found)


def test_packed_columns():
    from waybill.llm.quality_lm import _pack, _steps, _unpack

    r = np.random.default_rng(3)
    columns = [np.sort(r.integers(0, 1 << 60, 999)).astype("<u8"), np.zeros(0, dtype="<u4"), r.integers(0, 1 << 16, 7).astype("<u2")]
    found = _unpack(_pack(_steps(columns[0]), *columns[1:]))
    assert (np.cumsum(found[0], dtype=np.uint64) == columns[0]).all() and not len(found[1]) and (found[2] == columns[2]).all()


def test_audio(spark):
    from waybill.llm.audio_fingerprint import align, chroma, codes, excerpt, find_excerpts, fingerprint, recordings_of, samples_of, tune, wav

    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 64)]) for i in range(12)] + [(3, None), (None, []), (20, [None] * 3)]
    rows.append((30, rows[5][1]))
    got = find_excerpts(recordings_of(spark.createDataFrame(rows, "id long, vector array<float>"))).where("kind = 'recording'").collect()
    assert len(got) == len(rows) and sum(x.matched for x in got) >= 12
    assert {x.class_id for x in got if x.id in (5, 30)} == {5}
    sound = tune(rows[0][1])
    assert np.abs(samples_of(wav(sound)) - sound).max() < 1e-4
    piece, start = excerpt(sound, 11)
    a, b = codes(chroma(sound)), codes(chroma(piece))
    # Brute force: the offset with fewest wrong bits.
    errors = {o: np.bitwise_count(a[o : o + len(b)] ^ b[: len(a) - o]).mean() for o in range(len(a) - len(b) + 1)}
    assert align(a, b)[0] == min(errors, key=errors.get)
    bad = spark.createDataFrame([(1, 1, bytearray(b"junk")), (2, 2, None), (3, 3, bytearray(b"RIFF1234WAVE"))], "id long, row long, media binary")
    assert all(x.codes == [] for x in fingerprint(bad).collect())


def test_audio_search(spark):
    """Recall against brute force over all offsets, with near and exact copies."""
    from waybill.llm import audio_fingerprint as m

    r = np.random.default_rng(6)
    vectors = r.normal(0, 0.15, (160, 64))
    for i in range(0, 160, 20):
        vectors[i + 1] = vectors[i]
        vectors[i + 2] = vectors[i] + (np.arange(64) % 16 == 0) * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(None, None), (40, []), (40, [float(x) for x in vectors[40]])]
    got = m.find_excerpts(m.recordings_of(spark.createDataFrame(rows, "id long, vector array<float>"))).where("kind = 'match'").collect()
    assert not [x for x in got if x.id % 20 or x.bit_errors > m.MOST_ERRORS]
    found = {(x.id, x.class_id) for x in got}
    whole = [m.codes(m.chroma(m.samples_of(m.wav(m.tune([np.float32(y) for y in v]))))) for v in vectors]
    want = set()
    for i in range(0, 160, 20):
        cut = m.codes(m.chroma(m.samples_of(m.wav(m.excerpt(m.tune([np.float32(y) for y in vectors[i]]), i)[0]))))
        for j, a in enumerate(whole):
            first = next(k for k in range(j + 1) if np.array_equal(whole[k], a))
            errors = []
            for offset in range(-len(cut), len(a)):
                lo, hi = max(0, offset), min(len(a), offset + len(cut))
                if hi - lo >= max(m.LEAST_FRAMES, m.SEARCH_SHARE * len(cut)):
                    errors.append(np.bitwise_count(a[lo:hi] ^ cut[lo - offset : hi - offset]).sum() / (32 * (hi - lo)))
            if min(errors, default=1) <= m.MOST_ERRORS:
                want.add((i, first))
    assert len(want) >= 16 and len(found & want) >= 0.9 * len(want) and found <= want
    assert next(x.class_size for x in got if x.id == 40 and x.class_id == 40) == 3
    silent = np.full(50, m.SILENCE, dtype=np.uint32)
    assert m.align(silent, silent) is None


def test_row_keys_are_stable(spark, tmp_path):
    """A row's key is the same whatever cores, columns and filters the next reading has; other inputs are written once."""
    from pyspark.sql import functions as F

    from waybill.llm.common import forget, numbered

    path = str(tmp_path / "a b" / "t")
    spark.range(20_000).withColumn("text", F.md5(F.col("id").cast("string"))).withColumn("row", F.lit("x")).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    want = {r.id: r.row for r in numbered(docs, "id").collect()}
    assert len(set(want.values())) == len(want) == 20_000
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        again = numbered(docs.where("id % 7 > 2").select("id", "text"), "id", "text")
        assert again.rdd.getNumPartitions() > 6 and all(want[r.id] == r.row for r in again.collect())
    finally:
        for name in ("files.openCostInBytes", "files.maxPartitionBytes", "leafNodeDefaultParallelism"):
            spark.conf.unset(f"spark.sql.{name}")
    dealt = numbered(docs.repartition(5), "id", "text")
    assert {r.id: r.row for r in dealt.collect()} == {r.id: r.row for r in dealt.select("row", "id").repartition(2).collect()}
    forget(dealt)
    with pytest.raises(Exception, match="not exist"):
        dealt.count()
    assert numbered(docs, "text", key="id").columns == ["row", "text"]


def test_hot_groups(spark):
    from pyspark.sql import functions as F

    from waybill.llm.common import attach_groups

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = attach_groups(rows, groups, "k", "n", F.col("id"))
    assert out.count() == 3000 and out.where("k = 'hot' and n = 1000 and least = 0").count() == 1000


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, 5, "x") for r in corpus()], SCHEMA + ", n_chars long, row string").write.parquet(path)
    docs = spark.read.parquet(path)
    for name, function in p.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "ngram_join":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(n == 1 for n in Counter(c for *_, c in brute_components(kept).elements() if c is not None).values())
    assert p.run(spark, str(tmp_path)).count() > 0
