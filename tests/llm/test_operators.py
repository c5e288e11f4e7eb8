"""The ten operators and the pipeline against brute force, round trips and held-out rows, and their edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from boutlake.llm import bpe_fst, language_id, license_scan, mpeg_audio, neighbours, packing, quality, queries, sharding, simhash, token_counts
from boutlake.llm.common import fold_of, py_fold

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n", "a", "é€😀", "x" * 50_000, "word " * 30_000, None, "<|endoftext|> a<|endoftext|>", "a  \n b \t c\x1c d", "Ünï cödé ß", "0 1 2", "Released under the MIT License.", "don't we'll 's"]


def frame(spark, texts, extra=True):
    rows = [(i if i % 7 else None, t, "en" if i % 2 else None, None, None, 1, "z") for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 1, 2, "z")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, fp string")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def apply_all(docs, labels):
    """Every operator on documents, by its general interface."""
    import public_tokenizers as P

    ranks = queries._file("byte_bpe_multi_50k.tiktoken")
    yield "op1", mpeg_audio.store_texts(docs)
    yield "op2", language_id.predict(docs, language_id.fit(docs, fold_of("doc_id", 5) != 0))
    yield "op3", license_scan.scan(docs)
    yield "op4", packing.pack(docs, packing.word_count(F.col("text")))
    yield "op5", quality.apply(docs, quality.fit(docs, labels, fold_of("doc_id", 3) != 1))
    yield "op6", sharding.shard_by_bytes(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, ["doc_id"], 40, [F.col("doc_id")])
    yield "op7", token_counts.count_tokens(docs, queries._file("byte_bpe_50k.json").decode())
    yield "op8", bpe_fst.encode_column(docs, ranks, P.PATTERN)
    yield "op10", simhash.near_duplicates(docs)


def test_edge_cases(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns: every row comes back."""
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2 if i % 3 else None, None) for i in range(20)], "doc_id long, quality int, toxic int")
    n = len(ODD) + 2
    for name, df in apply_all(docs, labels):
        got = df.count()
        assert got == n or name == "op3" and got >= 1 or name == "op4" and got > n, (name, got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in apply_all(docs, labels):
        assert df.count() == 0, name
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 0


# --- op1


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 767, 768, 769, 5000])
def test_media_round_trip(n):
    payload, size = mpeg_audio.text_payload("aé"[: n % 3] + "b" * n)
    stream = mpeg_audio.wrap_payload(payload, size)
    parsed = mpeg_audio.parse_stream(stream)
    assert mpeg_audio.read_payload(stream, parsed) == payload
    assert parsed["frames"] == parsed["table"]["frames"] == parsed["crc_ok"] and parsed["music_ok"] and parsed["table"]["tag_ok"]
    assert parsed["samples"] == 1152 * parsed["frames"] and parsed["rate"] == 48000 and parsed["skipped"] == 0
    assert parsed["tags"]["TXXX:payload_crc32"] == str(zlib.crc32(payload)) and int(parsed["tags"]["TXXX:payload_bytes"]) == size


def test_media_resynchronises_and_notices_damage():
    stream = mpeg_audio.wrap_payload(b"x" * 768 * 6, 768 * 6)
    whole = mpeg_audio.parse_stream(stream)
    cut = whole["offsets"][3]
    junk = stream[:cut] + b"\xff\xfb\x00junk\xff\xe0" + stream[cut:]
    p = mpeg_audio.parse_stream(junk)
    assert p["frames"] == 6 and p["skipped"] == 9 and p["music_ok"] is False
    bad = bytearray(stream)
    bad[cut + 10] ^= 1  # in the side information
    p = mpeg_audio.parse_stream(bytes(bad))
    assert (p["crc_ok"], p["crc_bad"]) == (5, 1)
    assert mpeg_audio.parse_stream(b"no audio here")["frames"] == 0 and mpeg_audio.parse_stream(b"")["duration_us"] == 0
    assert mpeg_audio.parse_stream(stream[: cut + 100])["frames"] == 3


def test_media_damaged_tags_and_false_families():
    """Tag sizes that can't be right and headers of other families ahead hide no frame."""
    stream = mpeg_audio.wrap_payload(b"z" * 768 * 8, 768 * 8)
    whole = mpeg_audio.parse_stream(stream)
    music = stream[whole["offsets"][0] - 240 : -128]
    id3 = stream[: whole["offsets"][0] - 240]
    broken = mpeg_audio.parse_stream(id3[:6] + b"\x7f\x7f\x7f\x7f" + id3[10:] + music)
    assert broken["frames"] == 8 and broken["skipped"] == len(id3) - 10 and broken["music_ok"] and broken["tags"]["TXXX:payload_bytes"] == "6144"
    for size in (0, 31, 0x7FFFFFFF, len(music) + 5000):
        ape = b"APETAGEX" + struct.pack("<IIII", 2000, size, 1, 0) + bytes(8)
        p = mpeg_audio.parse_stream(music + ape)
        assert p["frames"] == 8 and p["skipped"] == 0 and p["music_ok"]
    false = bytes((0xFF, 0xF3, 0x10, 0x04))  # layer III of MPEG-2, 8 kbit/s, 22.05 kHz
    short = mpeg_audio.frame_header(int.from_bytes(false, "big"))["length"]
    p = mpeg_audio.parse_stream(false.ljust(short, b"\0") * 2 + music)
    assert p["frames"] == 8 and p["rate"] == 48000 and p["skipped"] == 2 * short and p["table"]["kind"] == "Xing"
    lone = mpeg_audio.parse_stream(false.ljust(short, b"\0"))
    assert lone["frames"] == 1 and lone["rate"] == 22050


def test_media_other_layouts():
    """Layer II without checks, an APE tag, an ID3v2.3 tag and a VBRI table."""
    head = bytes((0xFF, 0xFD, 0x80, 0x04))  # layer II, 128 kbit/s, 44.1 kHz
    size = 144 * 128000 // 44100
    ape_items = struct.pack("<II", 3, 0) + b"Title\0abc"
    ape = ape_items + b"APETAGEX" + struct.pack("<IIII", 2000, len(ape_items) + 32, 1, 0) + bytes(8)
    id3 = b"ID3\x03\0\0" + mpeg_audio._syncsafe(16) + b"TIT2" + struct.pack(">IH", 6, 0) + b"\0hello"
    p = mpeg_audio.parse_stream(id3 + (head + bytes(size - 4)) * 5 + ape)
    assert p["frames"] == 5 and p["layer"] == 2 and p["tags"] == {"TIT2": "hello", "APE:Title": "abc"} and p["samples"] == 5 * 1152
    head = mpeg_audio._header_bytes(80, False)
    vbri = head + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 720, 2, 2, 1, 2, 1) + struct.pack(">HH", 240, 240)
    p = mpeg_audio.parse_stream(vbri.ljust(240, b"\0") + (head + bytes(236)) * 2)
    assert p["table"]["kind"] == "VBRI" and p["table"]["frames"] == 2 and p["frames"] == 2


def bitwise_checksum(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 != b else 0)
    return crc


@pytest.mark.parametrize("layer,mode,extension,widths", [(1, 0, 0, [4] * 32), (1, 3, 0, [4] * 32), (2, 0, 0, [4] * 11 + [3] * 12 + [2] * 7), (2, 1, 1, [4] * 11 + [3] * 12 + [2] * 7), (2, 3, 0, [4] * 11 + [3] * 12 + [2] * 7)])
def test_media_checks_of_layers_one_and_two(layer, mode, extension, widths):
    """Frames written bit by bit: 44.1 kHz, 192 (mono 96 or more) kbit/s, protected, with random allocations."""
    rng = random.Random(layer * 10 + mode)
    index = {1: 6, 2: 10}[layer] if mode != 3 else {1: 6, 2: 7}[layer]
    head = bytes((0xFF, {1: 0xFE, 2: 0xFC}[layer], index << 4, mode << 6 | extension << 4))
    h = mpeg_audio.frame_header(int.from_bytes(head, "big"))
    bound, channels = 4 * extension + 4 if mode == 1 else 32, 1 if mode == 3 else 2
    stream, broken = b"", b""
    for _ in range(4):
        bits, chosen = [], 0
        for sb, w in enumerate(widths):
            for _ in range(1 if sb >= bound else channels):
                a = rng.choice((0, rng.randrange(1 << w)))
                bits += [a >> w - 1 - k & 1 for k in range(w)]
                chosen += (channels if sb >= bound else 1) if a else 0
        bits += [rng.randrange(2) for _ in range(2 * chosen if layer == 2 else 0)]
        header = [head[i] >> 7 - k & 1 for i in (2, 3) for k in range(8)]
        crc = bitwise_checksum(header + bits)
        covered = len(bits)
        bits += [rng.randrange(2) for _ in range(-len(bits) % 8)]
        body = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        frame = (head + crc.to_bytes(2, "big") + body).ljust(h["length"], b"\x11")
        stream += frame
        at = rng.randrange(covered)
        broken += frame[: 6 + at // 8] + bytes([frame[6 + at // 8] ^ 0x80 >> at % 8]) + frame[7 + at // 8 :]
    p, q = mpeg_audio.parse_stream(stream), mpeg_audio.parse_stream(broken)
    assert (p["frames"], p["crc_ok"], p["crc_bad"]) == (4, 4, 0) and p["layer"] == layer
    assert (q["frames"], q["crc_bad"]) == (4, 4)


def test_media_column(spark):
    stream = mpeg_audio.wrap_payload(b"y" * 1536, 1500)
    df = spark.createDataFrame([(1, stream, "k"), (2, None, "k"), (3, b"", "k")], "id int, media binary, tags string")
    got = {r.id: r.audio for r in mpeg_audio.media_columns(df).collect()}
    assert got[1].frames == 2 and got[1].duration_us == 48000 and len(got[1].frame_offsets) == 2 and got[2] is None and got[3].frames == 0


def test_music_checksum_by_bits():
    data = bytes(random.Random(2).randrange(256) for _ in range(1000))
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    assert mpeg_audio.music_checksum(data) == crc


# --- op2 and op5


def test_language_held_out(spark):
    p = queries.op2_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    held = p[p.held_out]
    assert all(h == (py_fold(i, 5) == 0) for i, h in p.held_out.items())
    assert (held.lang_pred == d.lang[held.index]).mean() > 0.97 and p.score.between(0, 1).all()


def test_language_without_letters(spark):
    m = language_id.LanguageModel(("de", "en"), np.ones(1024), np.zeros(1024, np.int32), np.zeros((1, 2)), np.zeros(2), 1.0)
    assert language_id.predict_text("123 !!", m) == ("und", 0.0) and language_id.predict_text(None, m) == ("und", 0.0)
    assert language_id.predict_text("a", m) == ("de", 0.5)


def test_ftrl_is_sparse_and_temperature_helps():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 10 + int(rng.integers(50))]), np.array([1.0, 0.3]), y) for y in rng.integers(0, 2, 400).tolist()]
    seen, w, _ = language_id.train_ftrl(rows, 2, 3, 1.0, 1.0, 0.5, 0.01)
    assert seen.tolist() == [0, 1, *range(10, 60)] and w[0, 0] > 0 > w[1, 0] and np.count_nonzero(w[2:]) < 100
    logits = 10 * rng.standard_normal((500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]) ** 0.1)).astype(int)
    assert language_id.fit_temperature(logits, y) > 3


def plain_ftrl(rows, n_langs, epochs, alpha, beta, l1, l2):
    """The definition, a coordinate at a time: (z, n) of every (bucket, class), the bias under bucket -1 without penalties."""
    z, n = {}, {}

    def weight(key):
        a, b = (l1, l2) if key[0] >= 0 else (0.0, 0.0)
        v = z.get(key, 0.0)
        return 0.0 if abs(v) <= a else -(v - math.copysign(a, v)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + b)

    for _ in range(epochs):
        for at, x, y in rows:
            put = [*zip(at.tolist(), x.tolist()), (-1, 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in put for c in range(n_langs)}
            e = [math.exp(sum(w[f, c] * v for f, v in put)) for c in range(n_langs)]
            for f, v in put:
                for c in range(n_langs):
                    g = (e[c] / sum(e) - (c == y)) * v
                    old = n.get((f, c), 0.0)
                    n[f, c] = old + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(n[f, c]) - math.sqrt(old)) / alpha * w[f, c]
    return {k: weight(k) for k in z}


def test_ftrl_by_its_definition():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(60)]
    seen, w, bias = language_id.train_ftrl(rows, 3, 2, 1.0, 1.0, 0.02, 0.01)
    want = plain_ftrl(rows, 3, 2, 1.0, 1.0, 0.02, 0.01)
    assert np.allclose(w, [[want[b, c] for c in range(3)] for b in seen.tolist()], atol=1e-12) and np.allclose(bias, [want[-1, c] for c in range(3)], atol=1e-12)


def test_language_fit_by_brute_force(spark):
    """The whole fit and the probabilities, from collected rows."""
    rng = random.Random(6)
    words = {lang: ["".join(rng.choices(letters, k=4)) for _ in range(12)] for lang, letters in (("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "ghijka"))}
    rows = [(i, lang, " ".join(rng.choices(words[lang], k=5))) for i in range(40) for lang in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").cache()
    m = language_id.fit(docs, F.lit(True), shards=2, epochs=2)
    part = docs.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(10)).alias("part")).collect()
    grams = {r.text: collections.Counter(r.text[i : i + n] for n in (1, 2, 3) for i in range(len(r.text) - n + 1)) for r in part}
    bucket = {}
    for g in {g for c in grams.values() for g in c}:
        known = language_id.ngram_counts(g)[0] if len(g) == 1 else np.setdiff1d(language_id.ngram_counts(g)[0], np.concatenate([language_id.ngram_counts(h)[0] for h in {g[:-1], g[1:]}]))
        bucket[g] = int(known[0])
    trained = [r for r in part if r.part >= 2]
    counts = {t: {b: sum(n for g, n in c.items() if bucket[g] == b) for b in {bucket[g] for g in c}} for t, c in grams.items()}
    idf = lambda b: math.log((1 + len(trained)) / (1 + sum(b in counts[r.text] for r in trained))) + 1

    def vector(text):
        v = {b: (1 + math.log(n)) * idf(b) for b, n in sorted(counts[text].items())}
        size = math.sqrt(sum(x * x for x in v.values()))
        return np.array(list(v)), np.array(list(v.values())) / size

    langs, mean = sorted(words), collections.Counter()
    for shard in (0, 1):
        data = [(*vector(r.text), langs.index(r.lang)) for r in trained if r.part % 2 == shard]
        data.sort(key=lambda r: (r[0].astype(np.int32).tobytes(), r[2]))
        for key, w in plain_ftrl([data[i] for i in np.random.default_rng(2).permutation(len(data))], 3, 2, 1.0, 1.0, 0.02, 0.01).items():
            mean[key] += w / 2
    assert m.langs == tuple(langs) and np.allclose(m.bias, [mean[-1, c] for c in range(3)], atol=1e-9)
    for r in language_id.predict(docs, m, keep=("text",)).collect():
        at, x = vector(r.text)
        s = np.array([sum(mean[b, c] * v for b, v in zip(at.tolist(), x.tolist())) + mean[-1, c] for c in range(3)]) / m.temperature
        p = np.exp(s) / np.exp(s).sum()
        assert r.lang_pred == langs[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-9)


def test_no_language_is_left_out(spark):
    """More languages than 2 to the BITS buckets hold at their full number: buckets halve, all are learned."""
    assert [language_id.bits_for(n) for n in (1, 256, 257, 512, 6000)] == [16, 16, 15, 15, 11]
    rows = [(i, f"l{i % 300:03d}", " ".join([f"{chr(0x4E00 + i % 300)}{chr(0x5E00 + i % 300)}"] * 3)) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = language_id.fit(docs, F.lit(True), epochs=2)
    assert len(m.langs) == 300 and m.bits == 15
    found = language_id.predict(docs, m, keep=("lang",)).where("lang = lang_pred").count()
    assert found > 1700


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    p = queries.op5_quality(spark, d).toPandas()
    l = spark.read.parquet(f"{d}/labels.parquet").toPandas().merge(p, on="doc_id")
    held = l[l.held_out & l.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.95 and p.score.between(0, 1).all()
    assert (p.predicted == (p.score >= 0.5)).all()


# --- op3


def test_license_spans():
    ix = license_scan.build_index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"].replace("restriction", "any limit at all")
    text = "intro words here.\n" + mit + "\nAll rights reserved."
    found = {f[0]: f for f in license_scan.scan_text(text, ix, 0.6, 16)}
    assert set(found) == {"MIT", "All-rights-reserved"}
    name, coverage, words, spans = found["MIT"]
    assert coverage == pytest.approx(1 - 1 / len(license_scan.words_of(license_scan.TEMPLATES["MIT"]))) and len(spans) == 2
    assert text[spans[0][0] :].startswith("Permission") and text[: spans[-1][1]].endswith("THE SOFTWARE")
    assert license_scan.scan_text("nothing of the kind", ix, 0.6, 16) == [] == license_scan.scan_text(None, ix, 0.6, 16)


def test_license_every_template_is_found():
    ix = license_scan.build_index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        found = license_scan.scan_text(f"lorem ipsum {text.upper()} dolor sit", ix, 0.6, 16)
        assert any(f[0] == name and f[1] == 1.0 for f in found), name


@pytest.mark.parametrize("name", ["All-rights-reserved", "MIT-notice", "GPL-3.0-notice"])
@pytest.mark.parametrize("between", ["", "word ", "one two three "])
def test_license_occurrences_side_by_side(name, between):
    ix = license_scan.build_index(license_scan.TEMPLATES)
    text = "".join(f"{license_scan.TEMPLATES[name]} {between}" for _ in range(40))
    found = [f for f in license_scan.scan_text(text, ix, 0.6, 16) if f[0] == name]
    assert len(found) == 40 and all(f[1] == 1.0 for f in found)
    assert all(text[f[3][0][0] : f[3][-1][1]] == license_scan.TEMPLATES[name].rstrip(".") for f in found)


def test_license_lines_by_brute_force(spark):
    got = {(r.doc_id, r.license) for r in queries.op3_license_scan(spark, "/root/testdata/sf0.01").collect()}
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        words = license_scan.words_of(r.text or "")
        for name in ("MIT-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice", "All-rights-reserved", "Apache-2.0-notice"):
            t = license_scan.words_of(license_scan.TEMPLATES[name])
            if any(words[i : i + len(t)] == t for i in range(len(words))):
                want.add((r.doc_id, name))
    assert want <= got and all(name != "MIT" for _, name in got)


# --- op4


def check_packing(rows, lengths, caps):
    bins: dict = {}
    for doc, piece, start, n, b, off, cap in rows:
        if n == 0:
            assert b is None and cap is None
            continue
        assert start == piece * max(caps)
        bins.setdefault((b, cap), []).append((off, n))
    for (b, cap), items in bins.items():
        items.sort()
        at = 0
        for off, n in items:
            assert off == at
            at += n
        assert at <= cap and cap == min(c for c in caps if c >= at)
    assert len({b for b, _ in bins}) == len(bins)
    assert sum(r[3] for r in rows) == sum(lengths)
    return bins


def test_packing(spark):
    rng = random.Random(4)
    lengths = [rng.choice((0, 1, 3, 7, 7, 7, 50, 51, 120, 127, 128, 300)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n int")
    caps = (32, 64, 128)
    rows = [tuple(r) for r in packing.pack(df, F.col("n"), caps, rank_parts=5).collect()]
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    bins = check_packing(rows, lengths, caps)
    # no worse than best fit with the largest capacity only, which is one of the choices
    left: list[int] = []
    for n in sorted((m for x in lengths for m in [128] * (x // 128) + ([x % 128] if x % 128 else [])), reverse=True):
        fit = [i for i, r in enumerate(left) if r >= n]
        if fit:
            i = min(fit, key=lambda i: left[i])
            left[i] -= n
        else:
            left.append(128 - n)
    assert sum(c for _, c in bins) <= 1.02 * 128 * len(left)


def test_plan_counts_every_item():
    rng = random.Random(1)
    for _ in range(30):
        h = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 30))}
        placed: dict = {}
        for run in packing.plan(h, (25, 50, 100)):
            assert sum(n * e for n, e, _ in run.parts) + run.left == run.capacity
            for n, e, r in run.parts:
                placed.setdefault(n, []).append((r, r + e * run.bins))
        for n, spans in placed.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == h[n] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert set(placed) == set(h)


# --- op6


def test_sharding_by_brute_force(spark):
    rows = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    total, before, want, slots = sum(r[1] for r in rows), 0, {}, {}
    for doc, size, crc in rows:
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        want[doc] = (size, crc, shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in queries.op6_sharding(spark, SF).collect()}
    assert got == want


# --- op7 and op8


def test_token_counts_by_library(spark):
    from tokenizers import Tokenizer

    voc = queries._file("byte_bpe_50k.json").decode()
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("ab 's\n\t\r  1.!é<|endoftext|>\x1c\x85\xa0\u2003\u3000²") for _ in range(80)) for _ in range(300)]
    texts += ["".join(rnd.choice("ab1!é²") for _ in range(20_000)) for _ in range(3)]
    t = Tokenizer.from_str(voc)
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    assert token_counts.SegmentCounter(voc).count([x or "" for x in texts]) == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.count_tokens(df, voc).collect()}
    assert got == {i: (n, len((x or "").encode()), n > 1024) for i, (n, x) in enumerate(zip(want, texts))}


def test_bpe_by_library(spark):
    import public_tokenizers as P
    import tiktoken

    raw = queries._file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    letters = "".join(chr(c) for r in ((32, 127), (0xC0, 0x180), (0x3B1, 0x3C9), (0x430, 0x450), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640)) for c in range(*r))
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) for _ in range(500)] + ["ab" * 3000, " " * 2000, "́e" * 700]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    codec = bpe_fst.Codec(raw, P.PATTERN)
    for t in [x or "" for x in texts + docs]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t[:80]
        assert codec.decode(ids) == (t.encode(), True)
    for _ in range(300):  # ids that cut code points, or aren't UTF-8
        some = np.array([rnd.choice((rnd.randrange(len(ranks)), rnd.randrange(256))) for _ in range(rnd.randrange(12))], "<u4")
        raw_bytes = b"".join(codec.tokens[i] for i in some)
        try:
            raw_bytes.decode("utf-8")
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert codec.decode(some.tobytes()) == (raw_bytes, valid)
    d = bpe_fst.StreamingDecoder(codec.fst.text)
    for t in texts[:60]:
        assert "".join(d.feed(i) for i in enc.encode_ordinary(t or "")) + d.close() == (t or "")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "doc_id long, text string")
    for r in bpe_fst.encode_column(df, raw, P.PATTERN, with_ids=True).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_utf8_machine():
    for raw in (b"\x80", b"\xc0\x80", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\xe2\x82", b"\xf0\x8f\x80\x80"):
        state = bpe_fst.START
        for b in raw:
            state = bpe_fst.utf8_step(state, b)
        assert state != bpe_fst.START
    for c in (0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF):
        state = bpe_fst.START
        for b in chr(c).encode():
            state = bpe_fst.utf8_step(state, b)
        assert state == bpe_fst.START


# --- op9


def brute(ids, x, queries_, k):
    s = x[queries_] @ x.T
    out = {}
    for row, q in zip(s, queries_):
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-row[i], ids[i]))[:k]
        out[ids[q]] = [ids[i] for i in order]
    return out


def recall_of(got, ids, x, asked, k=20):
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    place, hits = {v: i for i, v in enumerate(ids)}, []
    for q in asked:
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, k + 1)) and len({r[1] for r in rows}) == k
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:]))
        s = x @ x[place[q]]
        assert np.allclose([r[2] for r in rows], s[[place[r[1]] for r in rows]], rtol=1e-12, atol=1e-12)
        s[place[q]] = -np.inf
        hits.append(len({r[1] for r in rows} & {ids[i] for i in np.argpartition(-s, k)[:k]}) / k)
    return float(np.mean(hits))


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_neighbours_recall(spark, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    asked = [v for v in ids if v % 20 == 0]
    assert recall_of(queries.op9_neighbours(spark, f"/root/testdata/{table}").collect(), ids, x, asked) >= 0.9


def generated(kind, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clustered":  # a hundred vectors about each centre
        x = x[: n // 100][rng.integers(0, n // 100, n)] + 0.04 * rng.standard_normal((n, 64))
    if kind == "norms":
        x *= np.exp(0.7 * rng.standard_normal((n, 1)))
    return x.astype(np.float32)


@pytest.mark.parametrize("kind,most", [("random", (0.65, 0.45)), ("clustered", (0.12, 0.05)), ("norms", (0.6, None))])
def test_neighbours_recall_and_work(spark, tmp_path, kind, most):
    """Recall holds, and the share of the rows that a query is compared with (repeats in several tables counted) falls with their number."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    shares = []
    for n, top in zip((20_000, 100_000), most):
        if top is None:
            continue
        x = generated(kind, n)
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/{n}.parquet")
        compared = spark.sparkContext.accumulator(0)
        got = neighbours.nearest(spark.read.parquet(f"{tmp_path}/{n}.parquet"), F.col("vec_id") % 250 == 0, compared=compared).collect()
        asked = list(range(0, n, 250))
        assert recall_of(got, list(range(n)), x.astype(np.float64), asked[:100]) >= 0.9
        shares.append(compared.value / len(asked) / n)
        assert shares[-1] <= top, (kind, n, shares)
    assert shares == sorted(shares, reverse=True)


def test_probability_of_axes_by_trial():
    rng = np.random.default_rng(5)
    y = rng.standard_normal((1, 16))
    y /= np.linalg.norm(y)
    odds = neighbours.axis_odds(y, np.array([0.6]), 16)[0]
    z = 0.6 * y + 0.8 / 4 * rng.standard_normal((200_000, 16))
    seen = np.bincount(neighbours.nearest_axis(z), minlength=32) / len(z)
    assert np.abs(odds - seen).max() < 0.02


def test_neighbours_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    hot = [float(v) for v in rng.standard_normal(8)]
    rows = [(i, hot, 0) for i in range(100)] + [(100 + i, [float(v) for v in rng.standard_normal(8)], 0) for i in range(60)]
    rows += [(500, None, 0), (520, [0.0] * 8, 0), (540, [float("nan")] + [1.0] * 7, 0), (560, [None] + [1.0] * 7, 0), (580, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    x = np.array([np.array(r[1], dtype=np.float32).astype(float) for r in rows[:160]])
    want = brute(list(range(160)), x, list(range(0, 160, 20)), 20)
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e300, 5e-324])
def test_neighbours_of_extreme_norms(spark, size):
    """Norms whose squares over- or underflow; a product that is no number counts as minus infinity."""
    rng = np.random.default_rng(8)
    x = np.clip(rng.standard_normal((90, 8)), -1.7, 1.7)
    x[:30] *= size
    x[(x == 0).all(axis=1), 0] = size
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 60, 80]
    with np.errstate(over="ignore", invalid="ignore"):
        for q, found in got.items():
            s = np.cumsum(x[q] * x, axis=1)[:, -1]  # one product after the other, as the operator adds
            s[np.isnan(s)] = -np.inf
            want = sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:20]
            assert [i for i, _ in found] == want and [float(v) for _, v in found] == [float(s[i]) for i in want]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 24))
    y = neighbours.rotate(x, 2)
    assert y.shape == (5, 32) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))
    i, sign = neighbours.nearest_axis(y) // 2, 1 - 2 * (neighbours.nearest_axis(y) % 2)
    assert (y[np.arange(5), i] * sign == np.abs(y).max(axis=1)).all()


# --- op10


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_brute_force(fp):
    ids = sorted(fp)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 3:
                x, y = root(ids[a]), root(ids[b])
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    comp = components_by_brute_force(fp)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_covering_masks_miss_nothing():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    rng = random.Random(6)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("block", [8, 1024])
def test_chains_and_hot_groups(spark, block):
    """Long chains of neighbours and a dense ball, with buckets cut into small blocks."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(200)}
    at = rng.getrandbits(64)
    for i in range(120):
        at ^= 1 << (i * 7 % 64) | 1 << (i * 11 % 64)
        fps.add(at)
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3))) for _ in range(150)}
    fp = dict(enumerate(sorted(fps)))
    want = components_by_brute_force(fp)
    nodes = spark.createDataFrame([(i, simhash._signed(x)) for i, x in fp.items()], "id long, fp long")
    reached = {r.id: r.rep for r in simhash.components(simhash.links(nodes, 3, block)).collect()}
    got: dict = {}
    for i in fp:
        got.setdefault(reached.get(i, ("alone", i)), []).append(i)
    expected: dict = {}
    for i, c in want.items():
        expected.setdefault(c, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def similar(a: str | None, b: str | None) -> float:
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited_copies(groups: int = 60, seed: int = 12) -> list[str]:
    """Texts of 60 to 300 words, each with up to five copies that differ by up to a twelfth of their words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(60, 300))
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_similar_texts_by_brute_force(spark):
    """No link below the similarity; what all pairs within radius and similarity connect is connected."""
    texts = [*edited_copies(), None, "", " \n", "one", "ONE", "one two", *edited_copies(3)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 6, similarity=0.8).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fp = [slow_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 6 and similar(texts[i], texts[j]) >= 0.8]
    for i, j in near:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(texts))}
    far = [(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 6 and similar(texts[i], texts[j]) < 0.8]
    assert len(near) > 40 and len(far) > 5 and any(got[i] != got[j] for i, j in far)


def test_similar_texts_in_one_hot_group(spark):
    """Thousands of copies and hundreds of near copies of one text are one component, whatever their ids."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in rng.sample(range(150), 120)]
    texts = [" ".join(base)] * 3000 + near + ["something else entirely"]
    docs = spark.createDataFrame([(5 if i % 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(7)
    got = simhash.near_duplicates(docs, 6, similarity=0.8).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got)[-1] >= 3100 and sum(r["count"] for r in got) == len(texts)


def test_near_copies_are_compared_with_few(spark):
    """Thousands of near copies of one text: a few pairs each are checked, and one component comes out."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:k] + [f"x{rng.random()}"] + base[k + 1 :]) for k in (rng.randrange(300) for _ in range(4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = docs.withColumn("node", F.unhex(F.md5("text")))
    nodes = simhash.fingerprints(rows, "node", "text").select(F.col("node").alias("id"), "fp").persist()
    stars = simhash.star_pairs(simhash.bucket_members(nodes, 5), 5).count()
    assert stars < 32 * 4000  # at most one a table and node, of 8 million pairs
    got = simhash.near_duplicates(docs, 5, similarity=0.8).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert (got[0], got[1]) >= (0, 3900)


def test_no_similar_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs, 5, similarity=0.8).count() == 0
    alone = spark.createDataFrame([(1, "a b c d e f g"), (2, "t u v w x y z")], docs.schema)
    assert sorted(map(tuple, simhash.near_duplicates(alone, 5, similarity=0.8).select("doc_id", "component_id").collect())) == [(1, 1), (2, 2)]


# --- bounds, hot keys and names


def test_samples_are_bounded_by_rows(spark):
    """60,000 rows over 20 ids, or over none, give at most the documented bound; copies count once."""
    from boutlake.llm.common import sampled_rows

    many = spark.range(60_000).selectExpr("IF(id % 3 = 0, NULL, id % 20) AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")
    assert sampled_rows(many, 6000).count() == 6000
    assert sampled_rows(many.union(many).select("doc_id", "lang"), 6000).count() == 21
    seen = []
    real = language_id.sampled_rows
    language_id.sampled_rows = lambda df, n: seen.append(real(df, n)) or seen[-1]
    try:
        language_id.fit(many, F.lit(True), epochs=1)
    finally:
        language_id.sampled_rows = real
    assert seen[0].count() == 6000
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    scored = []
    apply = quality.apply
    quality.apply = lambda df, *a, **k: scored.append(df.count()) or apply(df, *a, **k)
    try:
        quality.fit(many, labels, F.lit(True), max_docs=600)
    finally:
        quality.apply = apply
    assert 100 < scored[0] < 300


def test_null_lengths_are_not_packed(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 0)], "`a.b` long, n int")
    got = {r["a.b"]: (r.length, r.bin_id, r.capacity) for r in packing.pack(df, F.col("n"), (8, 16), id_col="a.b").collect()}
    assert got == {1: (0, None, None), 2: (3, 0, 8), 3: (0, None, None)}


def test_one_id_or_none_in_all_rows(spark):
    """Packing and near duplicates where all rows share one id, or have none."""
    for doc_id in ("7", "CAST(NULL AS long)"):
        df = spark.range(2000, numPartitions=6).selectExpr(f"{doc_id} AS doc_id", "concat('a b c d', IF(id % 2 = 0, '', ' e')) AS text", "CAST(id % 5 + 1 AS int) AS n")
        packed = packing.pack(df, F.col("n"), (8, 16), rank_parts=4)
        assert packed.count() == 2000 and packed.select("bin_id", "bin_offset").distinct().count() == 2000
        assert packed.groupBy("bin_id", "capacity").agg(F.sum("length").alias("s")).where("s > capacity").isEmpty()
        groups = simhash.near_duplicates(df)
        assert groups.count() == 2000 and [r[0] for r in groups.select("component_id").distinct().collect()] == [7 if doc_id == "7" else None]


def test_neighbours_in_small_blocks(spark):
    """Buckets cut into blocks lose nothing."""
    rng = np.random.default_rng(4)
    x = (np.eye(8)[rng.integers(0, 2, 400)] + 0.05 * rng.standard_normal((400, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(list(range(400)), x.astype(float), list(range(0, 400, 20)), 20)
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, recall=0.999, bucket=200, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.95


CLASHING = ["score", "diff", "lang_pred", "_q", "_part", "_hash", "a.b", "n", "fp", "rep", "component_id"]


def test_ids_of_any_name(spark):
    """An id column with a dot or a blank in its name."""
    for name in ("a.b", "an id"):
        df = spark.createDataFrame([(1, "MIT License text, permission is hereby granted")], "id long, text string").toDF(name, "text")
        vocabulary = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
        for got in (mpeg_audio.store_texts(df, name), license_scan.scan(df, id_col=name, min_coverage=0.05), bpe_fst.encode_column(df, vocabulary, public_tokenizers.PATTERN, name)):
            assert {r[0] for r in got.collect()} <= {1} and got.columns[0] == name


def test_operators_ignore_other_columns(spark):
    """Columns with the operators' own names, and odd ones, change no value."""
    docs = frame(spark, ODD, extra=False).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for (name, a), (_, b) in zip(apply_all(docs, labels), apply_all(wide, labels)):
        if name == "op4":  # the deal of equal rows to bins is free
            a, b = (x.groupBy("length", "capacity").count() for x in (a, b))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


# --- the pipeline


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_pipeline_with_clashing_names(spark, tmp_path, case):
    """Each filter keeps the same documents whatever else documents holds."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = docs.select("*", *[F.lit(i).alias(case(c)) for i, c in enumerate(CLASHING)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, d)
        assert kept.columns == wide.columns
        assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in stage(spark, docs, d).select("doc_id").collect())
    assert corpus_pipeline.packing_stage(spark, wide, d).count() == corpus_pipeline.packing_stage(spark, docs, d).count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.01")
        assert kept.columns == docs.columns
        kept.write.mode("overwrite").parquet(str(tmp_path / stage.__name__))
        kept = spark.read.parquet(str(tmp_path / stage.__name__))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").join(docs, "doc_id")
    first = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.01")
    assert good.join(first, "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_pipeline_keeps_all_where_nothing_was_learned(spark, tmp_path):
    """All lang null and labels of one class only: neither filter has grounds to reject a document."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"plain words number {i} of a short text", None, "s", 40) for i in range(60)], EMPTY)
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.language_stage):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == 60
