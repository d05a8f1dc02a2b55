"""Line dedup, tokenizer alignment and whitening against brute force, and on awkward tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from procstats.llm import alignment, lines, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATHS = P.path(queries.RANKS_A), P.PATTERN, P.path(queries.MODEL_B)
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def parquet(spark, tmp_path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# lines

def lines_by_hand(docs, least=20, documents=3):
    holders = defaultdict(set)
    low = -2 ** 63
    key = lambda x: x.strip(BLANK).translate(LOWER)
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(low if i is None else i)
    out = []
    for i, t, *_ in docs:
        own = (t or "").split("\n")
        gone = [len(holders[key(x)]) >= documents and max(holders[key(x)]) != (low if i is None else i) for x in own]
        out.append((i, len(own), sum(gone), sha("\n".join(x for x, g in zip(own, gone) if not g))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_docs():
    rng = random.Random(3)
    common = ["A very common line of the corpus", "  a VERY common line of the corpus\t", "short line", "Zeile mit Umläuten äöüß ÄÖÜ", "é" * 20, "é" * 19, "x" * 19,
              "\x0b\x0cform feeds around this line\r", "İstanbul is not lowered beyond ASCII", "i̇stanbul is not lowered beyond ascii"]
    out = []
    for i in range(120):
        own = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randint(0, 60)} of many that repeat" for _ in range(rng.randint(0, 12))]
        out.append((rng.choice([None, i, i, i, i // 2]), "\n".join(own)))
    out += [(500, None), (501, ""), (502, "\n\n"), (None, None), (503, "a line held by three documents only\n" * 2000), (504, "a line held by three documents only"),
            (7, "a line held by three documents only"), (504, "a line held by three documents only"), (505, "a line that two rows of one id hold"), (505, "a line that two rows of one id hold"),
            (506, "a line that two rows of one id hold")]
    return [(i, t, "en", "s", 0) for i, t in out]


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_lines_equal_brute_force(spark, tmp_path, line_docs, partitions):
    folder = parquet(spark, tmp_path, line_docs, DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(queries.op12_line_dedup(spark, folder)) == lines_by_hand(line_docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_line_that_all_documents_hold_spans_ranges(spark, monkeypatch):
    docs = [(i, "the line that every document holds\nown line number %d" % i) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = spark.createDataFrame(docs, "doc_id long, text string")
        spread = lines.line_hashes(out).repartitionByRange("h1", "h2", "doc_id").rdd.glom().map(len).collect()
        assert max(spread) < 2 * 6000 / 16
        assert rows(lines.report(out)) == lines_by_hand(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_runs_in_batches_of_any_size(size, monkeypatch):
    """The stream alone, over cuts into partitions and batches, also when more rows wait than are held."""
    monkeypatch.setattr(lines, "HELD", 3)
    rng = random.Random(size)
    table = sorted([(rng.randint(0, 12), 0, -rng.randint(0, 6), rng.randint(0, 2), p) for p in range(400)])
    table = np.array([(a, b, -c, h, p) for a, b, c, h, p in table], np.int64)
    holders = defaultdict(set)
    for r in table.tolist():
        holders[r[0]].add(r[2])
    expect = {tuple(r[2:]) for r in table.tolist() if len(holders[r[0]]) >= 3 and r[2] != max(holders[r[0]])}
    # rows of one key and document never part
    ends = np.flatnonzero((table[1:, [0, 2]] != table[:-1, [0, 2]]).any(axis=1)) + 1
    for cuts in ([], [ends[len(ends) // 2]], sorted(rng.sample(ends.tolist(), 20))):
        found, late, runs = [], [], []
        for part in np.split(table, cuts):
            state = lines.Runs(3)
            given = [x for at in range(0, len(part), size) for x in state.add(part[at:at + size])]
            state.out = []
            state.end(last=True)
            for kind, r in given + state.out:
                (found, late, runs)[kind].extend(map(tuple, r.tolist()))
        n, keeper = Counter(), {}
        for h1, _, doc, _, count in runs:
            n[h1] += count
            keeper[h1] = max(keeper.get(h1, doc), doc)
        found = [r[2:] for r in found] + [r[2:] for r in late if n[r[0]] >= 3 and r[2] < keeper[r[0]]]
        assert len(found) == len(set(found)) and set(found) == expect


def test_line_bitmaps_and_texts(spark):
    docs = [(1, "the first line of some length\nb"), (2, "the first line of some length\nc\n"), (3, "THE FIRST LINE of some length ")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, h long")
    assert rows(lines.strip(df)) == [(1, "b"), (2, "c\n"), (3, docs[2][1])]
    assert [(r.doc_id, r.n_lines, r.n_dropped) for r in sorted(lines.keep_bitmaps(df).collect())] == [(1, 2, 1), (2, 3, 1)]


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, keep string, at int")
    assert lines.report(empty).count() == 0 and lines.keep_bitmaps(empty).count() == 0
    odd = [(None, None, "x"), (None, None, "y"), (1, "y" * 3_000_000, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, h1 string")
    assert rows(lines.report(df)) == lines_by_hand([r[:2] for r in odd])


# alignment

def byte_level():
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in zip(plain, plain)} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def coders():
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def aligned_by_hand(coders, docs):
    a, b = coders
    back = byte_level()
    found = []
    for i, t, *_ in docs:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        bx = [bytes(back[c] for c in a.id_to_token(k)) for k in x]
        by = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if b"".join(bx) != (" " + (t or "")).encode() or b"".join(by) != b"".join(bx):
            x, y, bx, by = [], [], [], []
        end_x, end_y = np.cumsum([len(k) for k in bx]), np.cumsum([len(k) for k in by])
        cuts = sorted(set(end_x.tolist()) & set(end_y.tolist()))
        groups, low = [], 0
        for c in cuts:
            groups.append(([k for k, e in zip(x, end_x) if low < e <= c], [k for k, e in zip(y, end_y) if low < e <= c]))
            low = c
        found.append((i, x, y, groups))
    count = Counter(p for *_, g in found for p in {(u, v) for us, vs in g for u in us for v in vs})
    most = Counter()
    for (u, _), n in count.items():
        most[u] = max(most[u], n)
    out = []
    for i, x, y, groups in found:
        links = [(u, v) for us, vs in groups for u in us for v in vs]
        text = ";".join(f"{','.join(map(str, us))}|{','.join(map(str, vs))}" for us, vs in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(text) if x else ""))
    return sorted(out, key=repr), count


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(11)
    alphabet = list("aeh stn'l1.,\n\t\r é中😀ß") + [chr(c) for c in (0, 0x1C, 0x85, 0xA0, 0x1680, 0x200B, 0x2028, 0x3000, 0x2581)]
    words = "the quick brown fox überfährt jumps over lazy dogs 1234 don't <|endoftext|> <unk> <0x41> </s> 东京 наука".split()
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(150)]
    return [*out, None, "", " ", "  x  ", "\n", "x" * 5000, "ab " * 3000, "中" * 3000, out[0], out[200], "▁", "a▁b"]


def test_alignment_equals_brute_force(spark, tmp_path, coders, strange, monkeypatch):
    docs = [(None if k % 50 == 3 else k // 2, t, "en", "s", 0) for k, t in enumerate(strange)]
    folder = parquet(spark, tmp_path, docs, DOCS)
    expect, count = aligned_by_hand(coders, docs)
    assert rows(queries.op13_alignment(spark, folder)) == expect
    monkeypatch.setattr(alignment, "CHUNK", 300)
    monkeypatch.setattr(alignment, "MEMORY", 50)
    monkeypatch.setattr(alignment, "ROWS", 7)
    assert rows(queries.op13_alignment(spark, folder)) == expect
    table = alignment.link_table(spark.createDataFrame(docs, DOCS), *PATHS).collect()
    assert {(r.a, r.b): r["count"] for r in table} == count
    most = Counter()
    for (u, _), n in count.items():
        most[u] = max(most[u], n)
    assert all(r.best == (r["count"] == most[r.a]) for r in table)


def test_ranks_are_the_json_vocabulary(coders):
    """Every code point between letters, digits and blanks: the rank file and the json file give the same ids."""
    a, _ = coders
    aligner = alignment.Aligner(open(PATHS[0], "rb").read(), PATHS[1], open(PATHS[2], "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{c}1{c} {c}" for c in points[k:k + 512]) for k in range(0, len(points), 512)]
    for t, e in zip(texts, a.encode_batch_fast(texts, add_special_tokens=False)):
        assert aligner.coder_a.encode_ordinary(t) == e.ids


def test_segments_are_encoded_once_and_align_as_whole_texts(strange):
    files = open(PATHS[0], "rb").read(), PATHS[1], open(PATHS[2], "rb").read()
    aligner, whole = alignment.Aligner(*files), alignment.Aligner(*files)
    odd = ["two  blanks and one", " led", "ends ", "a\n b \n\nc\td", "x\u00a0 y \u3000z \x1c q", "a\u2581 b", "plain a b", "it's 'll 's !? ??!", "w" * 300 + " x", "\r\n "]
    texts = [t or "" for t in (*strange, *odd)]
    seen = []
    encode = aligner.encode
    aligner.encode = lambda some: seen.extend(some) or encode(some)
    for t, found, (a, b) in zip(texts, aligner.aligned(texts), whole.encode(texts)):
        groups, links, wide = alignment.groups_of(a.tolist(), b.tolist(), whole.a.sizes, whole.b.sizes)
        assert b";".join(x[0] for x in found) == groups and [sum(x[k] for x in found) for k in (3, 4)] == [len(a), len(b)], t
        count = lambda parts: sum((Counter(np.frombuffer(y, np.int64).tolist()) + (w or Counter()) for y, w in parts), Counter())
        assert count([x[1:3] for x in found]) == count([(links, wide)])
    seen.clear()
    aligner.aligned(["new words and plain a b", "plain a b and words"] * 3)
    assert len(seen) == 1 and sorted(seen[0].split()) == ["new", "words"]


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk string, pairs int")
    assert alignment.align(empty, *PATHS).count() == 0
    df = spark.createDataFrame([(None, None, "x"), (1, None, None), (1, "", None)], "doc_id long, text string, n_a string")
    assert rows(alignment.align(df, *PATHS)) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (None, 1, 1)], key=repr)


# whitening

def whitened_by_hand(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    d = x * n - sums
    c = d / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (d * d).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


def check_whitened(out, ids, vectors, k=32):
    n, deviation, white, explained = whitened_by_hand(vectors, k)
    k = white.shape[1]
    assert len(out) == len(ids) * k
    found = {(r.vec_id, r.component): r for r in out}
    got = np.array([[found[i, j + 1].whitened for j in range(k)] for i in ids])
    for j in range(k):
        sign = np.sign(got[:, j] @ white[:, j])
        assert np.allclose(got[:, j], sign * white[:, j], atol=1e-8)
    assert all(found[i, 1].deviation == int(x) for i, x in zip(ids, deviation)) and {r.n for r in out} == {n}
    assert np.allclose([found[ids[0], j + 1].explained for j in range(k)], explained, rtol=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and 0 <= out[0].identity_error < 1e-9


def test_whitening_of_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check_whitened(queries.op11_whitening(spark, folder).collect(), [r.vec_id for r in t], [r.embedding for r in t])


def test_whitening_leaves_bad_vectors_out(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLS", 3)
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) * 3).astype(np.float32).tolist()
    bad = [None, [], [1.0, 2.0, None, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, 3.0, 4.0, float("inf")], [1e30] * 5, [1.0, 2.0], [-float("inf")] * 5]
    table = [(i, v, "x") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, deviation string").repartition(7)
    check_whitened(whitening.whiten(df).collect(), list(range(90)), good)
    twice = df.unionByName(df.withColumn("vec_id", df.vec_id + 1000))
    check_whitened(whitening.whiten(twice).collect(), [i + a for a in (0, 1000) for i in range(90)], good + good)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, component int, row long"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1), (None, [], 1, 1), (2, [None], 1, 1)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1, 1), (None, [1.0, 2.0], 1, 1)], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 2, 0, None, None, None) for c in (1, 1, 2, 2)] or \
        sorted(r.component for r in one) == [1, 1, 2, 2] and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(2, 0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1, 1) for i in range(10)], schema)).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in line} == {(1, False, 1.0), (2, True, 0.0)} and line[0].identity_error < 1e-9


def test_deviation_stays_exact_beyond_machine_integers(spark):
    df = spark.createDataFrame([(i, [2.0 ** 44 * (i + 1), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    x = [int(64 * 2.0 ** 44) * (i + 1) for i in range(3)]
    expect = [(3 * v - sum(x)) ** 2 for v in x]
    assert {r.vec_id: r.deviation for r in out} == {i: v if v < 2 ** 63 else None for i, v in enumerate(expect)}
