"""Fill-in-middle, whitening and the streaming merge-list transducer against brute force, libraries and SQL, and their edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex
from oracle import connection, difference
from pyspark.sql import functions as F

from boutlake.llm import bpe_stream, fim, queries, whitening

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "é€😀", "a" * 70_000, "é😀x " * 20_000, None, "<|endoftext|> a<|endoftext|>", "x<P>y", "<S>", "a<M", "<", "<P", "S>", "a  \n b \t c\x1c d", "Ünï cödé ß", "0 1 2", "don't we'll 's", " x    y", "٣٤ 漢字かな", "!" * 5000 + "?!" * 3000, "end   "]


def odd_frame(spark):
    rows = [(i if i % 7 else None, t, 1, "z", b"q") for i, t in enumerate(ODD)] + [(1, ODD[1], 2, None, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, ids binary")


# --- op11


@pytest.mark.parametrize("run", [1, 3, 64])
def test_skip_list_finds_every_rank(run):
    rng = random.Random(run)
    for size in (0, 1, 2, 63, 64, 65, 500, 3000):
        text = "".join(rng.choice("aé€😀\n ") for _ in range(size))
        parts = fim.SkipList.of_points(text.encode(), run)
        assert parts.units == parts.points == size
        for rank in {0, size, *(rng.randrange(size + 1) for _ in range(200))}:
            assert parts.descend(rank) == (rank, len(text[:rank].encode()))


def test_skip_list_of_patterns_carries_both_widths():
    rng = random.Random(5)
    for size in (0, 1, 7, 2000):
        text = "".join(rng.choice(["word", "été ", "😀", " ", "\n"]) for _ in range(size))
        units, at = [], 0
        for m in regex.finditer(r"\w+\s*", text):
            units += list(text[at : m.start()]) + [m.group()]
            at = m.end()
        units += list(text[at:])
        parts = fim.SkipList.of_pattern(text.encode(), r"\w+\s*")
        assert (parts.units, parts.points) == (len(units), len(text))
        for rank in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(100))}:
            before = "".join(units[:rank])
            assert parts.descend(rank) == (len(before), len(before.encode()))


def test_skip_list_follows_few_links():
    parts = fim.SkipList.of_points(b"x" * 1_000_000, 1)
    for rank in range(0, 1_000_000, 9973):
        parts.descend(rank)
    assert parts.steps < 101 * 60


def test_blocks_of_the_list_meet(monkeypatch):
    text = "aé€😀" * 1000
    whole = fim.SkipList.of_points(text.encode())
    monkeypatch.setattr(fim, "BLOCK", 97)
    cut = fim.SkipList.of_points(text.encode())
    assert [whole.descend(r) for r in range(0, 4001, 7)] == [cut.descend(r) for r in range(0, 4001, 7)]


def test_fill_in_middle_with_sql(spark):
    sql = queries.oracle_sql()["op11_fill_in_middle"]
    assert difference(queries.op11_fill_in_middle(spark, SF).toPandas(), connection(SF).sql(sql).df()) == ""


def test_fill_in_middle_edge_cases(spark):
    rule = fim.Rule(rate=100)
    rows = fim.fill_in_middle(odd_frame(spark), rule, most_bytes=1000).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    given = odd_frame(spark).collect()
    assert len(rows) == len(given)
    for r, g in zip(rows, given):
        text = g.text or ""
        assert r.back == text and r.n == len(text)
        h1, h2, _, h4 = (int(hashlib.sha256(f"1:{'' if g.doc_id is None else g.doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4))
        if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")):
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == ("plain", text, None, None)
            continue
        lo, hi = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        assert (r.prefix_chars, r.middle_chars) == (lo, hi - lo)
        p, m, s = text[:lo], text[lo:hi], text[hi:]
        assert (r.form, r.output) == (("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(empty).count() == 0
    assert fim.fill_in_middle(empty.withColumnRenamed("doc_id", "a.b"), id_col="a.b").count() == 0


# --- op12


def brute(vectors):
    x = [[int(np.floor(np.float64(c) * 1024)) + 100000 for c in v] for v in vectors]
    n = len(x)
    total = [sum(col) for col in zip(*x)]
    y = np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x], float)
    cov = y.T @ y / n
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x], y, cov


def check_whitening(rows, ids, vectors, components=8):
    n, deviation, y, cov = brute(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(vectors[0]))
    assert len(rows) == len(vectors) * k
    want = dict(zip(ids, zip(deviation, y @ axes[:, :k] / np.sqrt(values[:k]))))
    signs = {}
    for r in rows:
        d, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, d)
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) <= 1e-6
        if abs(r.whitened) > 1e-3:
            signs.setdefault(r.component, set()).add(r.whitened * w[r.component - 1] > 0)
        assert r.identity_error <= 1e-4
    assert all(len(s) == 1 for s in signs.values()) and len({r.identity_error for r in rows}) == 1


def test_whitening_of_the_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = queries.op12_whitening(spark, SF).collect()
    check_whitening(rows, [r.vec_id for r in t], [r.embedding for r in t])


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 5)) * [1, 20, 3, 0.5, 7]).tolist()
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf"), 1.0, 2.0, 3.0, 4.0], []]
    rows = [(i, v, 1, "d") for i, v in enumerate(x)] + [(1000 + i, v, 2, "e") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, dim string")
    check_whitening(whitening.whiten(df, 3).collect(), list(range(60)), x, 3)
    far = [[c * 1e9 for c in v] for v in x]  # squares beyond 64 bits
    check_whitening(whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(far)], "vec_id long, embedding array<double>"), 5).collect(), list(range(60)), far, 5)
    two = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(100 + i, v[:2]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening.whiten(two).collect()
    check_whitening([r for r in got if r.vec_id < 100], list(range(60)), x)
    check_whitening([r for r in got if r.vec_id >= 100], list(range(100, 160)), [v[:2] for v in x])
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 4, "vec_id long, embedding array<float>")).collect()
    assert len(same) == 8 and all((r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (None, 4, 0, None, None, None) for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and all(r.identity_error < 1e-9 for r in line)
    with pytest.raises(Exception, match="grid"):
        whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_covariance_is_exact():
    rng = random.Random(1)
    x = [[rng.randrange(10**12) for _ in range(3)] for _ in range(7)]
    total = [sum(c) for c in zip(*x)]
    z = [[a - s // 7 for a, s in zip(r, total)] for r in x]
    squares = {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in z) for i in range(3) for j in range(i, 3)}
    got = whitening.covariance(7, total, squares)
    for i in range(3):
        for j in range(3):
            assert got[i, j] == float(sum((7 * r[i] - total[i]) * (7 * r[j] - total[j]) for r in x)) / 7**3 or abs(got[i, j] / (sum((7 * r[i] - total[i]) * (7 * r[j] - total[j]) for r in x) / 7**3) - 1) < 1e-15


# --- op13


def toy(rng, letters=3, rules=9):
    """A random merge list over a few bytes, each token made once."""
    text, out, made = {i: bytes([97 + i]) for i in range(letters)}, [], {bytes([97 + i]) for i in range(letters)}
    while len(out) < rules:
        a, b = rng.choice(list(text)), rng.choice(list(text))
        if len(text[a] + text[b]) > 8 or text[a] + text[b] in made:
            continue
        text[len(text)] = text[a] + text[b]
        made.add(text[a] + text[b])
        out.append((a, b, len(text) - 1))
    return out, text


def by_definition(merges, tokens):
    tokens = list(tokens)
    while True:
        found = [(merges.rank[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in merges.rank]
        if not found:
            return tokens
        i = min(found)[1]
        tokens[i : i + 2] = [merges.rank[tokens[i], tokens[i + 1]][1]]


def test_lookahead_is_sufficient():
    rng = random.Random(8)
    for _ in range(60):
        rules, text = toy(rng)
        merges = bpe_stream.MergeList(rules, {i: len(t) for i, t in text.items()})
        for _ in range(60):
            whole = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
            cut = rng.randrange(len(whole) + 1)
            ends = [set(np.cumsum([merges.size[t] for t in by_definition(merges, w)]).tolist()) for w in (whole, whole[:cut])]
            stable = cut - merges.lookahead
            assert {e for e in ends[0] if e <= stable} == {e for e in ends[1] if e <= stable}


def test_stream_of_toy_merges():
    rng = random.Random(9)
    for _ in range(40):
        rules, text = toy(rng)
        merges = bpe_stream.MergeList(rules, {i: len(t) for i, t in text.items()})
        fst = bpe_stream.Transducer(merges, [0] * 97 + list(range(3)) + [0] * 156)
        fst.held = 2 * merges.lookahead + 4
        whole = [rng.randrange(3) for _ in range(300)]
        want = by_definition(merges, whole)
        raw = bytes(97 + t for t in whole)
        assert fst.encode(raw) == want == merges._merge_many(list(whole))
        parts = [raw[i : i + n] for i, n in enumerate(rng.choices(range(1, 12), k=50))] + [raw]
        assert [np.frombuffer(i, "<u4").tolist() for i in fst.encode_each(parts)] == [by_definition(merges, [b - 97 for b in p]) for p in parts]
        got, at = [], 0
        while at < len(raw):  # in parts of any length
            n = rng.randrange(1, 30)
            for ids in fst.feed(raw[at : at + n]):
                got += ids
            assert len(fst.tail) <= fst.held
            at += n
        assert got + fst.finish() == want


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        bpe_stream.MergeList([(0, 1, 3), (2, 3, 4), (1, 1, 3)], {i: 1 for i in range(5)})


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_against_the_library(library):
    vocabulary = queries._file("byte_bpe_50k.json").decode()
    codec, machine = bpe_stream.Encoder(vocabulary), bpe_stream._machine(vocabulary)
    rng = random.Random(2)
    texts = [t for t in ODD if t] + ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3040, 0x3100), rng.randrange(0x1F300, 0x1F5FF)))) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(rng.choice("ab -=_") for _ in range(9000)), "-" * 9000 + "a", "".join(rng.choice("etaoinshr") for _ in range(20_000))]
    for t in texts:
        ids = codec.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:80]
        assert machine.decode(np.frombuffer(ids, "<u4")) == library.decode(want, skip_special_tokens=False)


def test_text_machine_replaces_as_the_library(library):
    vocabulary = queries._file("byte_bpe_50k.json").decode()
    codec, machine = bpe_stream.Encoder(vocabulary), bpe_stream._machine(vocabulary)
    rng = random.Random(3)
    single = [i for i, t in enumerate(codec.tokens) if len(t) == 1 and t[0] >= 0x80]
    for _ in range(2000):
        ids = [rng.choice(single) if rng.random() < 0.8 else rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert machine.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_bpe_stream_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_bpe_stream(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_stream_edge_cases(spark, library):
    vocabulary = queries._file("byte_bpe_50k.json").decode()
    got = bpe_stream.decode_ids(bpe_stream.encode_texts(odd_frame(spark), vocabulary), vocabulary).collect()
    for r, g in zip(got, odd_frame(spark).collect()):
        want = library.encode(g.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.text, r.n_tokens) == (g.doc_id, g.text or "", len(want)) and np.frombuffer(bytes(r.ids), "<u4").tolist() == want
    empty = spark.createDataFrame([], "`a.b` long, text string, ids string")
    assert bpe_stream.encode_texts(empty, vocabulary, id_col="a.b").count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe_stream.decode_ids(nothing, vocabulary).collect()[0].text is None
