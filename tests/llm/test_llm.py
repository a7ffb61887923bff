"""The training-data operators against brute force, the libraries they stand for, and odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from lodestrata.llm import archive, common, fingerprint, language, license_scan, neardup, packing, pieces, quality, registry, scoring, suffix_dedup
from lodestrata.llm.suffix_sort import InducedSorter

tokenizers_files = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, t string, _row long, score string"


def prose(seed, n, words="the a of on and in was tion ing ent er re st nd hat shed".split()):
    r = random.Random(seed)
    return ". ".join(" ".join("".join(r.choices(words, k=r.randint(1, 3))) for _ in range(8)) for _ in range(n)) + "."


LONG = prose(1, 12)
TEXTS = [LONG, LONG, LONG.replace("the", "xyz", 1), "", None, " ", "a", "é\n\nü x", prose(2, 400), prose(3, 9) + "\n" + LONG[100:260], "Released under the MIT License.\nmit license mit license", "\x00 ### | % \U0001f9ff"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, ties, repeated rows and columns whose names clash with the operators' own."""
    data = [(i, t, "en" if i % 2 else None, "x", 7, "s") for i, t in enumerate(TEXTS)]
    data += [(3, "", None, None, None, None), (None, "lost " + LONG, "en", None, None, None), data[0]]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_blocks_lie_in_the_shared_folder(spark, docs):
    with common.work_tables(spark):
        blocks, name = suffix_dedup._blocks(docs.withColumn("_row", suffix_dedup.F.monotonically_increasing_id()), "doc_id")
        shared = common.shared_dir(spark).removeprefix("file://")
        assert blocks.inputFiles() and all(f.removeprefix("file://").startswith(shared) for f in blocks.inputFiles())
        spark.sql(f"DROP TABLE {name}")
    assert not os.path.exists(os.path.dirname(blocks.inputFiles()[0].removeprefix("file://")))


def test_license_filters_drop_pairs_and_lose_none(spark):
    """Blocks of template words in every mixture: each filter drops pairs, and what is left is what all pairs give."""
    r = random.Random(6)
    words = sorted({w for _, text in license_scan.TEMPLATES for w in license_scan.template_words(text)})
    lengths = sorted({license_scan.block_lines(text) for _, text in license_scan.TEMPLATES})
    rows = []
    for i in range(1500):
        own = license_scan.template_words(r.choice(license_scan.TEMPLATES)[1])
        held = {w for w in own if r.random() < r.choice([0.5, 0.82, 0.95])} | set(r.sample(words, r.randrange(0, 60)))
        rows.append((i, r.choice(lengths), sorted(held)))
    df = spark.createDataFrame(rows, "_row long, lines int, words array<string>")
    pairs = license_scan.candidates(df)
    counts = [pairs.count(), license_scan.long_enough(pairs).count(), license_scan.can_reach(license_scan.long_enough(pairs)).count()]
    want = {}
    for i, lines, held in rows:
        for label, text in license_scan.TEMPLATES:
            own = license_scan.template_words(text)
            shared = len({*own} & {*held})
            if license_scan.block_lines(text) == lines and shared >= 0.8 * len(own) - 1e-9:
                want[i, label] = max(want.get((i, label), 0), shared / len(own))
    assert {(x._row, x.label): x.score for x in license_scan.matches(df).collect()} == want and want
    compared = sum(lines == license_scan.block_lines(text) for _, lines, _ in rows for _, text in license_scan.TEMPLATES)
    distinct = pairs.select("_row", "label", "size").distinct().count()
    assert distinct < compared and counts[0] > counts[1] > counts[2]
    # a text that meets a template holds a word of its own prefix in any order
    probes = {*license_scan.probes()}
    assert all(len({*license_scan.template_words(text)} - probes) < license_scan._need(len(license_scan.template_words(text))) for _, text in license_scan.TEMPLATES)


def test_pieces_match_the_library(spark, docs, none):
    import sentencepiece

    path = tokenizers_files.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    r = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("aabbde then\n\té=-▁1🧿") for _ in range(r.randrange(40))) for _ in range(500)] + ["a" * 3000]
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(1 << 20))
    texts += [letters[:300], letters[:5000], "ab" * 2000 + letters[:900], prose(7, 20) + letters[:3000], letters]  # the last: a megabyte without a space
    for text, got in zip(texts, pieces.Encoder(model).digests(texts), strict=True):
        ids = sp.encode(text, add_eos=True)
        assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randrange(8))]
        assert model.decode(ids) == sp.decode(ids)
    assert pieces.encode_digests(docs, path).count() == docs.count()
    assert pieces.encode_digests(none, path).collect() == []


def test_archive_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, None, big + "y"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "n", big), (7, "é", "ü" * 600)]
    path = f"file://{tmp_path}/a"
    archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in archive.archived_pages(spark, path).collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert got[None].refers_to == 2 and got[4].record_type == got[5].record_type == "response"
    assert got[7].payload_bytes == 1200 and got[6].payload_digest == hashlib.sha1(b"").hexdigest()
    data = b"".join(bytes(r.record) for r in archive.record_bytes(archive.read_archive(spark, path)).collect())
    records = archive.parse_records(data)
    assert len(records) == len(rows)
    for fields, block in records:
        payload = block.split(b"\r\n\r\n", 1)[1]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        else:
            assert payload == b""


def brute_scores(rows, depth):
    """(n_tokens, n_known, train_tokens, base, score) by the definitions, node by node; rows are (text, whether it teaches)."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    data = [((t or "").encode().translate(lower), used) for t, used in rows]
    coded = lambda t: [((b"\0" * depth + t + b"\xff")[i : i + depth], (t + b"\xff")[i]) for i in range(len(t) + 1)]
    n, children = {}, {}
    for t, used in data:
        for context, byte in coded(t) if used else []:
            for bit in range(8):
                prefix, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
                for d in range(depth + 1):
                    node = (context[depth - d :], prefix)
                    n.setdefault(node, [0, 0])[one] += 1
                    if d:
                        children.setdefault((node[0][1:], prefix), set()).add(node)
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    weighted = {}
    for node in sorted(n, key=lambda x: -len(x[0])):
        own = kt(*n[node])
        weighted[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in children[node])) + math.log(0.5)

    def log_byte(context, byte):
        out = 0.0
        for bit in range(8):
            prefix, one, p = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1, 0.5
            for d in range(depth, -1, -1):
                node = (context[depth - d :], prefix)
                z, o = n.get(node, (0, 0))
                own = 1.0 if d == depth else math.exp(kt(z, o) + math.log(0.5) - weighted[node]) if node in n else 0.5
                p = own * (o + 0.5) / (z + o + 1) + (1 - own) * p
            out += math.log10(p if one else 1 - p)
        return out

    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t, _ in data]
    count = collections.Counter(w for ws, (_, used) in zip(words, data, strict=True) if used for w in ws)
    ends = sum(used for _, used in data)
    total, distinct = sum(count.values()) + ends, len(count) + (ends > 0)
    base = lambda c: math.log10((c + 1) / (total + distinct + 1))
    return [
        (len(ws) + 1, sum(count[w] > 0 for w in ws) + (ends > 0), total, sum(base(count[w]) for w in ws) + base(ends), sum(log_byte(*x) for x in coded(t)))
        for ws, (t, _) in zip(words, data, strict=True)
    ]


@pytest.mark.parametrize(("head", "part", "run", "depth"), [(1 << 19, 8 << 20, 4 << 20, 6), (40, 200, 300, 6), (0, 1, 1, 2), (40, 200, 300, 3)])
def test_scores_against_brute_force(spark, none, monkeypatch, head, part, run, depth):
    for name, value in (("HEAD_GRAMS", head), ("HEAD_WORDS", head // 10), ("PART_BYTES", part), ("RUN_BYTES", run), ("HELD", 10 * head + 50)):
        monkeypatch.setattr(scoring, name, value)
    texts = [prose(1, 3), prose(1, 3), prose(1, 3).upper(), "", None, " ", "a", "\u00e9\n\n\u00fcx \x00 \U0001f9ff ABC", prose(2, 4), "held out words unseen", "zq" * 40, prose(1, 3) + " held out"]
    rows = [(i, t, i % 4 != 1, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, used boolean, _row long")
    got = {r.doc_id: r for r in scoring.score(df, scoring.F.col("used"), ["doc_id"], depth).collect()}
    for (i, t, _, _), want in zip(rows, brute_scores([(t, used) for _, t, used, _ in rows], depth), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert abs(r.base_score - want[3]) < 1e-6 and abs(r.score - want[4]) < 1e-6 * max(1, abs(want[4]))
        assert abs(r.bits_per_byte + want[4] * math.log2(10) / (len((t or "").encode()) + 1)) < 1e-6


def test_scores_of_odd_rows(spark, docs, none):
    got = scoring.score(docs, scoring.F.expr("doc_id != 8"), ["doc_id"]).collect()
    assert len(got) == docs.count() and all(r.n_known <= r.n_tokens for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 4] == [1]
    assert scoring.score(none, scoring.F.lit(True), ["doc_id"]).collect() == []
    untaught = scoring.score(docs, scoring.F.lit(None).cast("boolean"), ["doc_id"]).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.bits_per_byte - 8) < 1e-9 for r in untaught)


def test_work_folder_is_shared_or_refused(spark):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x")))
    alone = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="y"))
    assert common.shared_dir(alone) == common.shared_dir(alone)


def test_packing_places_every_id_once(spark, docs, none):
    from tokenizers import Tokenizer

    p = tokenizers_files
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    args = (p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    got = packing.pack(docs.where("doc_id <> 0 and doc_id <> 3"), *args).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for i, text in enumerate(TEXTS):
        if i in (0, 3):
            continue
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert packing.pack(none, *args).collect() == []


def test_tokens_on_both_sides_of_the_limit(monkeypatch):
    p = tokenizers_files
    r = random.Random(8)
    texts = [prose(4, 60), "a" * 3000, " " * 3000, "\n\t x" * 700, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F300, 0x1F600)])) for _ in range(4000)), "don't '' 12345 _-_" * 200]
    args = (p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    fast = [packing.ByteTokenizer(*args)(t) for t in texts]
    monkeypatch.setattr(packing, "LONG_TEXT", 100)
    assert all((packing.ByteTokenizer(*args)(t) == ids).all() for t, ids in zip(texts, fast, strict=True))
    monkeypatch.undo()
    long = " ".join([prose(6, 40)] * 200)  # above the limit as it stands
    assert len(long) > packing.LONG_TEXT and (packing.ByteTokenizer(*args)(long) == packing.ByteTokenizer(args[0], None, None)(long)).all()


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("seed", range(40))
def test_induced_sorting_against_brute_force(seed):
    r = random.Random(seed)
    alphabet = r.choice([b"a", b"ab", b"\x00\xffa", bytes(range(256))])
    texts = [bytes(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 8))] * r.choice([1, 2])
    order, lcp = InducedSorter(texts, r.choice([1, 3, 1000]), r.choice([0, 1000])).sort()
    suffixes, at = [], 0
    for k, t in enumerate(texts):
        suffixes += [(t[i:], k, at + i) for i in range(len(t))]
        at += len(t) + 1
    suffixes.sort(key=lambda s: [b + 1 for b in s[0]] + [0, s[1]], reverse=True)
    assert order[: len(suffixes)].tolist() == [s[2] for s in suffixes]
    for i in range(1, len(suffixes)):
        a, b, m = suffixes[i - 1][0], suffixes[i][0], 0
        while m < min(len(a), len(b)) and a[m] == b[m]:
            m += 1
        assert lcp[i] == m


def brute_gone(rows):
    """Of each row (id, bytes), which bytes go."""
    smaller = {}
    for doc, data in rows:
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            smaller[w] = min(smaller.get(w, doc), doc)
    for doc, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if smaller[data[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        yield gone


def brute_repeats(rows):
    out = {}
    for k, ((doc, data), gone) in enumerate(zip(rows, brute_gone(rows), strict=True)):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[k] = (len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split", [2, 1 << 16])  # with 2 every minimizer in several stretches is split
def test_repeats_against_brute_force(spark, none, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT_STRETCHES", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_STRETCHES", 3 if split == 2 else 1 << 12)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000 if split == 2 else 1 << 20)
    r = random.Random(9)
    pool = [prose(i, 3) for i in range(6)] + ["a" * 120, "é" * 70]
    rows = [(d, "".join(r.choice(pool)[r.randrange(20) :] for _ in range(r.randrange(4)))) for d in range(60)]
    rows += [(5, rows[9][1]), (5, rows[9][1]), (61, None)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "_row long, doc_id long, text string")
    want = brute_repeats([(d, (t or "").encode()) for d, t in rows])
    got = {x._row: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_only_stretches_that_may_share_a_window_reach_the_suffix_array(spark):
    """Texts that share 40 bytes share minimizers and no window; those that share 60 share windows."""
    r = random.Random(51)
    letters = lambda n, of="0123456789+-": "".join(r.choices(of, k=n))
    for size, asks in ((40, False), (60, True)):
        passages = [letters(size) for _ in range(60)]
        rows = [(i, i, "".join(letters(60, of) + p for p in passages)) for i, of in enumerate(("abcdefghijkl", "ABCDEFGHIJKL", "mnopqrstuvwx"))]
        with common.work_tables(spark):
            blocks, name = suffix_dedup._blocks(spark.createDataFrame(rows, "_row long, doc_id long, text string"), "doc_id")
            shared = common.materialize(suffix_dedup._shared_keys(blocks, 3), "shared")
            told = suffix_dedup._verdicts(blocks, shared, 3).collect()
            assert shared.count() > 0 and any(suffix_dedup.ASK in x.verdicts for x in told) == asks
            spark.sql(f"DROP TABLE {name}")


def test_a_block_does_not_work_for_each_bucket():
    """Blocks times buckets grow with the square of the corpus, so a block's time must not follow the number of buckets."""
    data = random.Random(52).randbytes(200_000)
    block = suffix_dedup.Block(data, np.array([len(data)], np.int64).tobytes(), suffix_dedup._Powers())
    ids, took, gone = np.array([7], np.int64).tobytes(), {}, {}
    for buckets in (1, 8192):
        bucket = (block.key >> np.uint64(32)) * np.uint64(0x85EBCA6B) % np.uint64(buckets)
        low = (block.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets))).tolist() + [len(order)]
        answers = [{"bucket": int(bucket[order[a]]), "keys": np.unique(low[order[a:b]]).tobytes(), "verdicts": bytes([suffix_dedup.GO]) * (b - a), "windows": None} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            gone[buckets] = suffix_dedup._covered(block, ids, answers, buckets)
            times.append(time.perf_counter() - begin)
        took[buckets] = min(times)
    assert gone[1].all() and gone[8192].all()
    assert took[8192] < 6 * took[1], took


def test_repeats_in_documents_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    long = prose(31, 200)
    rows = [(4, long), (1, long[3000:3400]), (2, long[3350:9000] + "x" + long[100:400]), (3, prose(32, 5)), (9, long), (7, "z" + long[5000:5049]), (8, "z" + long[5000:5050])]
    clash = "_row long, doc_id long, text string, _id string, block long, data string"
    df = spark.createDataFrame([(i, d, t, "x", 1, "y") for i, (d, t) in enumerate(rows)], clash)
    got = {x._row: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats([(d, t.encode()) for d, t in rows])


def test_archive_of_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string, payload string, owner long"
    for k, rows in enumerate(([], [(None, None, "x" * 1200, "d", "p", 1), (None, "u", "x" * 1200, "d", "p", 1), (3, "u", "x" * 1200, None, None, None), (3, "u", "x" * 1200, "d", "p", 9)])):
        path = f"file://{tmp_path}/{k}"
        archive.write_archive(spark.createDataFrame(rows, schema), path)
        got = archive.archived_pages(spark, path).collect()
        assert len(got) == len(rows)
        assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == ([("3", "response", None)] * 2 + [("None", "revisit", 3)] * 2 if rows else [])
    data = "\x00\r\n\r\nWARC/1.1\r\n" * 90
    path = f"file://{tmp_path}/binary"
    archive.write_archive(spark.createDataFrame([(1, "u", data)], "page_id long, url string, html string"), path)
    (record,) = archive.parse_records(bytes(archive.record_bytes(archive.read_archive(spark, path)).first().record))
    assert record[1].split(b"\r\n\r\n", 1)[1] == data.encode()


def test_license_scan_finds_phrases_and_templates(spark, docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert len(license_scan.scan(docs, ["doc_id"]).collect()) == docs.count()
    r = got[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 3, 3, 7, "mit")
    assert got[4].n_words == 0 and got[4].first_word is None and got[0].score == 0
    text = next(t for label, t in license_scan.TEMPLATES if label == "bsd")
    notice = text.replace("binary", "object")
    one = license_scan.scan(spark.createDataFrame([(1, "x\n" + notice)], "doc_id long, text string"), ["doc_id"]).first()
    words = license_scan.template_words(text)
    assert one.labels == "bsd" and one.base_labels == "" and abs(one.score - (len(words) - 1) / len(words)) < 1e-9
    assert license_scan.scan(none, ["doc_id"]).collect() == []


@pytest.mark.parametrize("width", [60, 72, 80, 10_000])
def test_wrapped_licenses_are_found(spark, width):
    body = prose(11, 60).split(". ")
    rows = [(i, "\n".join([*body[: 7 * i % 40], *textwrap.wrap(" ".join(text.split()), width), "", *body[7 * i % 40 :]])) for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1, (label, got[i])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_operators_give_the_rows_of_their_sql(spark, name, tmp_path):
    """On odd rows: nulls, ties, repeated rows, wrapped licenses and long texts."""
    license_text = "\n".join(textwrap.wrap(" ".join(license_scan.TEMPLATES[1][1].split()), 60))
    texts = [*TEXTS, license_text, LONG + "\n" + license_text, LONG.replace(". ", ".\n"), prose(21, 200), "\n".join(["home | news | sport | about", "Read more: https://a.b/c", "x"] * 400), "mit  LICENSE\ncc by cc by"]
    documents = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "", None), (None, LONG, None), (0, texts[0], "en")]
    documents = [(i, t, lang, [None, "", "a", "b"][n % 4]) for n, (i, t, lang) in enumerate(documents)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(1, None, 1), (2, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(160)]
    vectors += [(200, vectors[0][1]), (201, vectors[0][1]), (250, [2 * x for x in vectors[1][1]]), (300, [0.0] * 64), (301, None), (302, [float("nan")] * 64), (303, [1.0, None] * 32)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    pages = [(i, f"u{i}", t) for i, t in enumerate([*texts, LONG * 2, LONG * 2, None])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    registry.QUERIES[name](spark, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/out")
    con.sql(f"CREATE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.sql(f"CREATE TABLE o AS {registry.SQL[name]}")
    c = ", ".join(sorted(r[0] for r in con.sql("DESCRIBE o").fetchall()))
    assert con.sql(f"SELECT {c} FROM o EXCEPT ALL SELECT {c} FROM s").fetchall() == []
    assert con.sql(f"SELECT {c} FROM s EXCEPT ALL SELECT {c} FROM o").fetchall() == []


def digests_of(text, long_line=1000):
    """Spark's 64-bit digests of a text's paragraphs."""
    pieces = [p for line in text.split("\n") for p in (re.split(r"(?<=[.!?\u2026\u061f\u0964]\s)|(?<=[\u3002\uff01\uff1f])", line) if len(line) > long_line else [line])]
    return {xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces if p}


def inverted(fingerprint):
    """The digests that a fingerprint names, by peeling each of its parts."""
    size, *parts = fingerprint.split("|")
    found, signed = set(), lambda x: x - (1 << 64) if x >> 63 else x
    for part in parts:
        name, _, listed = part.partition(":")
        level = int(name.split(".")[0])
        cells = {int(i): [int(n), int(k, 16), int(c, 16)] for i, n, k, c in (x.split(",") for x in listed.split(";"))}
        while cells:
            i = next(i for i, (n, k, c) in cells.items() if n == 1 and xxhash.xxh64_intdigest(b"check", xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)) == c)
            _, k, c = cells[i]
            found.add(k)
            for t in range(3):
                cell = t * 8 + xxhash.xxh64_intdigest((level * 3 + t).to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)) % 8
                cells[cell] = [cells[cell][0] - 1, cells[cell][1] ^ k, cells[cell][2] ^ c]
                if cells[cell] == [0, 0, 0]:
                    del cells[cell]
    assert len(found) == int(size)
    return found


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_tell_the_likeness_of_paragraphs(spark, none):
    r = random.Random(3)
    texts = ["\n".join(str(r.randrange(40)) for _ in range(r.choice([0, 1, 5, 60, 300]))) for _ in range(40)]
    texts += ["\n".join(str(r.randrange(9000)) for _ in range(3000)), "\n".join(str(r.randrange(9000)) for _ in range(3000)), prose(5, 60).replace("\n", " "), prose(5, 70)]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        own, other, following = inverted(got[i].fingerprint), inverted(got[i].edited_fingerprint), inverted(got[(i + 1) % len(texts)].fingerprint)
        assert own == digests_of(t) and other == digests_of(edited)
        # from the fingerprints alone
        assert abs(got[i].near_edited - alike(own, other)) < 1e-9 and abs(got[i].near_next - alike(own, following)) < 1e-9
    assert got[42].near_edited > 0.3  # one long line
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "x"), (2, "y")], "doc_id long, text string")
    assert fingerprint.fingerprints(odd).count() == 5
    clash = spark.createDataFrame([(1, "x", 1, [1], "k"), (2, "y", 2, [2], "k")], "doc_id long, text string, _row long, _a array<long>, _k string")
    assert fingerprint.fingerprints(clash).count() == 2
    assert fingerprint.fingerprints(none).collect() == []


def test_fingerprints_of_texts_with_very_many_lines(spark):
    texts = ["\n".join(f"line {k} of {i}" for k in range(200_000)) for i in range(2)] + ["one line"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).select("doc_id", "near_edited", "near_next").collect()}
    assert got[0].near_next == 0 and abs(got[0].near_edited - 1 / 3) < 0.01 and got[2].near_next == 0


def test_quality_rules(spark, docs, none):
    got = {r.doc_id: r for r in quality.measure(docs, ["doc_id"]).collect()}
    assert got[0].kept and got[8].kept and not got[4].kept and got[4].n_words == 0
    menu = "\n".join(["home | news | sport | about | login | more"] * 5 + ["One line of text that ends as it should."])
    rows = quality.measure(spark.createDataFrame([(1, menu), (2, " ".join(["a b c d e"] * 9) + ".")], "doc_id long, text string"), ["doc_id"]).collect()
    assert rows[0].n_dup_lines == 4 and not rows[0].kept and rows[0].clean_text == "One line of text that ends as it should."
    assert rows[1].n_repeat_words == 44 and rows[1].base_failed  # the last word, with its stop, stands in no repeated window
    assert quality.measure(none, ["doc_id"]).collect() == []
    good = ["Ein Satz endet hier.", "これは文です。", "यह एक वाक्य है।", "هل هذا سؤال؟", "See https://a.b/c for more on this and that, it says."]
    bad = ["no end of a sentence", "https://a.b www.c.d here.", "a › b › c › d.", "Datenschutz und Impressum.", "Subscribe to our newsletter now!", "x | y | z | w.", "STOP!! NOW!! HERE.", "# # # and % &."]
    lines = quality.measure(spark.createDataFrame([(1, "\n".join(good + bad)), (2, "\n".join(good * 2 + bad[:1])), (3, prose(1, 30_000))], "doc_id long, text string"), ["doc_id"]).collect()
    assert lines[0].clean_text.split("\n") == good and lines[1].n_dup_lines == 5 and lines[2].kept and len(lines[2].clean_text) > 1 << 20


def test_masks_count_languages_one_by_one():
    r, size = random.Random(2), 1 << 12
    texts = [prose(i, 6).encode() for i in range(12)] + [b"", b"xy"]
    langs = [set(r.sample(sorted(set(language._grams(texts)[0].tolist())), 60)) for _ in range(70)]
    cells = np.zeros((2, size), np.uint64)
    for i, held in enumerate(langs):
        for probe in language._cells(np.array(sorted(held), np.uint32), size):
            np.bitwise_or.at(cells[i // 64], probe, np.uint64(1 << (i % 64)))
    best, share = language.Filters([str(i) for i in range(70)], cells, np.arange(70) / 70).predict(texts)
    for text, found, score in zip(texts, best, share, strict=True):
        gram = language._grams([text])[0]
        wanted = []
        for i in range(70):
            bit = lambda c: int(cells[i // 64][c]) >> (i % 64) & 1  # noqa: E731, B023
            held = sum(all(bit(int(p[0])) for p in language._cells(np.array([g]), size)) for g in gram)
            assert held >= sum(int(g) in langs[i] for g in gram)  # a filter holds what it was given
            rate = (sum(bit(c) for c in range(size)) / size) ** language.PROBES
            wanted.append(min(1, max(0, (held - rate * len(gram)) / max(len(gram) * (1 - rate), 1e-9))))
        assert abs(score - max(wanted)) < 1e-6 and wanted[found] >= max(wanted) - 1e-6


def test_texts_without_a_letter_have_no_language():
    assert not any(map(language.has_letter, [None, "", " 1_2", "\u00b2\u00bd\u2460", "\U0001f9ff"])) and all(map(language.has_letter, ["a", "\u00e9", "\u4e2d", "1\u0431"]))


def test_language_on_held_out_texts(spark, docs, none):
    words = {"en": "the of and tion ing with that".split(), "de": "der und ung schen nicht ein zu".split(), "fr": "le des eaux ment que tion pour".split()}
    rows = [(i, prose(i, 4, words[lang]), lang) for i, lang in ((k, list(words)[k % 3]) for k in range(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, df.where("doc_id < 90"), ["doc_id", "lang"]).where("doc_id >= 90").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    odd = language.identify(docs, df, ["doc_id"]).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 5)} == {"und"} and len(odd) == docs.count()
    assert {r.lang_pred for r in language.identify(docs, none, ["doc_id"]).collect()} == {"und"}


def test_probability_jaccard_and_signatures():
    r = np.random.default_rng(1)
    a, b = np.unique(r.integers(0, 60, 50).astype(np.uint64)), np.unique(r.integers(0, 60, 50).astype(np.uint64))
    wa, wb = r.integers(1, 4, len(a)), r.integers(1, 4, len(b))
    x, y = dict(zip(a.tolist(), wa / wa.sum(), strict=True)), dict(zip(b.tolist(), wb / wb.sum(), strict=True))
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert abs(neardup.probability_jaccard(a, wa, b, wb) - want) < 1e-9
    doc = np.repeat([0, 1], [len(a), len(b)])
    s = neardup.signatures(doc, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def brute_classes(rows):
    """({id: smallest id of its class}, linked pairs of different texts) by the exact probability Jaccard similarity of all pairs that share a shingle."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {}
    for i, t in rows:
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)))
        texts.setdefault(words or i, []).append(i)
    keys = [w for w in texts if isinstance(w, tuple)]
    sets = [collections.Counter(w[k : k + 5] for k in range(max(1, len(w) - 4))) for w in keys]
    holders, parent, links = {}, list(range(len(keys))), []
    for k, shingles in enumerate(sets):
        for x in shingles:
            holders.setdefault(x, []).append(k)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, shingles in enumerate(sets):
        shared = collections.Counter(j for x in shingles for j in holders[x] if j < k)
        for j, n in shared.items():
            if n < 0.3 * min(len(shingles), len(sets[j])):  # far below: the similarity is at most what either text's weight can share
                continue
            number = {x: i for i, x in enumerate(shingles.keys() | sets[j].keys())}
            a, b = ((np.array([number[x] for x in s]), np.array(list(s.values()))) for s in (shingles, sets[j]))
            a, b = ((x[np.argsort(x)], n[np.argsort(x)]) for x, n in (a, b))
            if neardup.probability_jaccard(*a, *b) >= 0.8 - 1e-9:
                links.append((keys[j], keys[k]))
                parent[max(find(j), find(k))] = min(find(j), find(k))
    smallest = {}
    for k, w in enumerate(keys):
        smallest[find(k)] = min(smallest.get(find(k), 1 << 60), *texts[w])
    out = {i: smallest[find(k)] for k, w in enumerate(keys) for i in texts[w]}
    return {**{i: i for w, ids in texts.items() if not isinstance(w, tuple) for i in ids}, **out}, links


def near_rows():
    r = random.Random(4)
    base = prose(50, 30, "alpha beta gamma delta kappa lambda sigma omega theta zeta".split()).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 8, 30])):
            words[r.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words) + " so it goes and so it goes again" * r.choice([0, 0, 5])))
    return rows + [(100 + i, prose(i + 200, 20)) for i in range(10)] + [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c")]


@pytest.mark.parametrize("rounds", [0, 1, 3])  # with few rounds the block-wise rest takes part; 3 is the default
def test_near_duplicates_against_brute_force(spark, docs, none, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    if rounds == 0:
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    rows = near_rows()
    staged = neardup.stage_rows(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"])
    got = neardup.near_duplicates(staged).collect()
    want, _ = brute_classes(rows)
    assert {x.doc_id: x.class_id for x in got} == want
    for x in got:  # a class of several texts is held together by links
        assert (x.links > 0) == (len({" ".join((t or "").lower().split()) for i, t in rows if want[i] == want[x.doc_id]}) > 1)
    if rounds == 3:
        odd = neardup.near_duplicates(neardup.stage_rows(docs, ["doc_id", "text"])).collect()
        assert len(odd) == docs.count() and {x.class_id for x in odd if x.doc_id in (0, 1, 2)} == {0}
        assert neardup.near_duplicates(neardup.stage_rows(none, ["doc_id", "text"])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_no_link_of_the_documents_is_lost(spark):
    """All documents of a table at default settings: every class is that of brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, links = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.op10_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert links and got == want


def test_no_pair_alike_is_above_its_bound():
    r = np.random.default_rng(7)
    for k in range(300):
        a, b = (np.flatnonzero(r.random(60) < r.choice([0.3, 0.9])).astype(np.uint32) for _ in range(2))
        wa, wb = ((r.integers(1, 5, len(x)) if k % 2 else np.ones(len(x), int)) for x in (a, b))
        want = neardup.probability_jaccard(a, wa, b, wb)
        ((_, _, bound),) = neardup._sharing([(a, wa)], [(b, wb)], np.ones((1, 1), bool))
        assert bound[0] >= want - 1e-9 and (k % 2 or abs(bound[0] - want) < 1e-9)


def test_pairs_in_blocks_are_verified_however_signatures_agree(spark):
    # one pair at similarity 39/41, signatures that share the bucket's band and no other component, and a pair that is not alike
    sets = {1: range(40), 2: range(1, 41), 3: range(500, 540)}
    short = {t: np.r_[np.arange(4), 10 * t + 1000 * np.arange(1, 93) % 60000].astype(np.uint16) for t in sets}
    members = spark.createDataFrame([(9, 0, t, t) for t in sets], "bucket long, band int, t long, c long")
    signed = spark.createDataFrame([(t, bytearray(x.tobytes())) for t, x in short.items()], "t long, short binary")
    weighted = spark.createDataFrame([(t, bytearray(np.array(x, np.uint32).tobytes()), bytearray()) for t, x in sets.items()], "t long, s binary, n binary")
    assert [(r.t, r.u) for r in neardup._in_blocks(members, signed, weighted).collect()] == [(1, 2)]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on a fixture whose lines are known to pass or fail: what is left of each text, and where its ids are packed."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    german = "der und ung schen nicht ein zu mit auf lich".split()
    passage = prose(77, 12)
    bad = ["home | news | sport | about | login", "no closing mark here", "### $$$ %%% &&&.", "Subscribe to our newsletter now!"]
    rows = []  # (id, lines that pass, lines that fail, language)
    for i in range(40):
        lines = [prose(1000 * i + k, 3, german if i % 4 == 0 else "the a of on and in was tion ing ent er re st nd hat shed".split()) for k in range(5)]
        if i % 5 == 1:
            lines.insert(2, passage)  # shared by kept documents
        rows.append((i, lines, bad[: i % 4] if i % 3 else [], "de" if i % 4 == 0 else "en"))
    rows += [(100 + i, list(rows[i][1]), [], rows[i][3]) for i in range(5)]  # copies
    for i in range(5):  # near copies: one word changed
        words = rows[10 + i][1][0].split(" ")
        words[5] = "changed"
        rows.append((200 + i, [" ".join(words), *rows[10 + i][1][1:]], [], rows[10 + i][3]))
    texts = {}
    for i, good, failing, _ in rows:
        lines = failing[:1] + good + failing[1:]
        texts[i] = ("\n".join(lines), "\n".join(x for x in lines if x in good))
    table = [(i, texts[i][0], lang, "s", len(texts[i][0]), "x") for i, _, _, lang in rows]
    table += [(300, "12 34 ### $$$", None, None, None, None), (301, None, None, None, None, None), (302, "", "en", "s", 0, None), (303, "\n".join(bad * 6), "en", "s", 0, None), (304, "\u4e00\u4e8c\u4e09\u3002 " * 30, None, None, None, None)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, _row string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    cleaned = [(i, texts[i][1]) for i in sorted(texts)]  # languages and rules: the rows from 300 on go
    keep = brute_classes(cleaned)[0]
    kept = [(i, t.encode()) for i, t in cleaned if keep[i] == i]
    assert {i for i, _ in kept} == set(range(40))
    tokenizer = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    assert {x.doc_id for x in got} == {i for i, _ in kept}
    for (i, _), gone in zip(kept, brute_gone(kept), strict=True):
        text = bytes(b for b, g in zip(kept[[k for k, _ in kept].index(i)][1], gone, strict=True) if not g).decode("utf-8", "ignore")
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for x in sorted((x for x in got if x.doc_id == i), key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
