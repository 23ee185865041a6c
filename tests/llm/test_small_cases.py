"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moiety.llm import (ann, common, embedding_dedup, html_extract, html_training, line_dedup, ngram_join, packing, quality,
                        sentencepiece_io, suffix_dedup, token_output, tokens)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, short, empty, null and long texts."""
    r = random.Random(seed)
    base, passage = prose(r, 80), prose(r, 60)
    out = [(0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (7, passage * 40), (8, "x" * 3000),
        (9, "é" * 49), (10, "é" * 49 + "ü")]
    for k in range(11, n):
        words = base.split()
        kind = r.random()
        if kind < 0.4:
            for _ in range(r.randint(1, 5)):
                words[r.randrange(len(words))] = "w%d" % r.randrange(1000)
            out.append((k, " ".join(words)))
        elif kind < 0.7:
            out.append((k, prose(r, r.randint(1, 50)) + "\n" + passage + "\n" + prose(r, r.randint(1, 50))))
        else:
            out.append((k, prose(r, r.randint(1, 150))))
    return out


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use themselves
        df = df.withColumns({c: F.lit("z") for c in ("d", "t", "gone", "bucket", "token", "rep", "n", "tag", "gone_doc", "cut_text", "label", "n_shingles")})
    return df.repartition(3)


# ---------------------------------------------------------------- 10

def brute_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets, links):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def brute_similar(rows):
    sets = brute_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(sets, links)


@pytest.mark.parametrize("block,hot", [(300, 1 << 17), (2000, 3), (200_000, 1)])
def test_ngram_join(spark, block, hot):
    rows = corpus(2)
    sets, want = brute_similar(rows)
    got = {r.doc_id: r for r in ngram_join.similarity_components(table(spark, rows, True), block=block, hot=hot).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert want[4] == 3 and want[0] == 0 and want[1] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_of_a_passage_in_a_third_of_the_documents(spark, seed):
    """Texts that are mostly one passage: some pairs reach the threshold, most fall short of it."""
    r = random.Random(seed)
    passage = prose(r, 60).split()
    rows = []
    for k in range(240):
        if k % 3:
            rows.append((k, prose(r, r.randint(5, 60))))
        else:
            at, own = r.randrange(len(passage)), prose(r, r.randint(0, 14)).split()
            words = passage[:at] + ["w%d" % r.randrange(9)] * r.randint(0, 2) + passage[at + r.randint(0, 3):]
            rows.append((k, " ".join(own + words if r.random() < 0.5 else words + own)))
    got = {x.doc_id: x.component_id for x in ngram_join.similarity_components(table(spark, rows), block=3000).collect()}
    want = brute_similar(rows)[1]
    assert got == want and 1 < len({want[k] for k in range(0, 240, 3)}) < 80


def test_ngram_join_of_repeated_ids(spark):
    """Rows of one doc_id are one vertex."""
    r = random.Random(6)
    a, b = prose(r, 60), prose(r, 90)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, prose(r, 50)), (4, prose(r, 50)), (5, a), (5, a)]
    got = {(x.doc_id, x.component_id) for x in ngram_join.similarity_components(table(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1)}


@pytest.mark.parametrize("percent", [75, 90])
def test_shingles_that_prefixes_have_to_share(percent):
    """No two similar sets share fewer shingles of their prefixes than ``enough`` says."""
    r = np.random.RandomState(3)
    for _ in range(400):
        n = r.randint(1, 60)
        x = set(r.choice(200, n, replace=False).tolist())
        y = set(x)
        for _ in range(r.randint(0, 9)):
            y.add(int(r.randint(200))) if r.rand() < 0.5 else y.discard(next(iter(y), None))
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        lx, ly = (int(r.randint(1, 9)) for _ in "xy")
        px, py = (sorted(s)[:len(s) - -(-percent * len(s) // 100) + k] for s, k in ((x, lx), (y, ly)))
        lx, ly = (min(k, -(-percent * len(s) // 100)) for s, k in ((x, lx), (y, ly)))
        need = ngram_join.enough(len(x), lx, px[-1] // 20, len(y), ly, py[-1] // 20, percent)
        assert len(set(px) & set(py)) >= need


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similarity_components(table(spark, [])).count() == 0
    assert ngram_join.similarity_components(table(spark, [(1, None), (2, "")])).count() == 2


def test_words_of_pieces():
    text = "Ab cd\x0bEF  g h\n".encode() + b"x" * 50 + b" yz"
    data = np.frombuffer(text, np.uint8)
    whole, n = common.word_hashes(data, np.array([0, len(text)]))
    pieces, _ = common.word_hashes(data, np.array([0, len(text)]), chunk=7)
    assert n.tolist() == [0, len(text.split())] and (whole == pieces).all()
    lower, _ = common.word_hashes(np.frombuffer(text.lower(), np.uint8), np.array([0, len(text)]))
    assert (whole == lower).all() and len(set(whole.tolist())) == len(set(text.lower().split()))


# ---------------------------------------------------------------- 6

def brute_repeats(rows, length=50):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p:p + length], i) < i:
                gone[p:p + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    rows = corpus(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, rows, True)).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_of_repeated_ids_and_nothing(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    a, b = "q" * 60, "r" * 60
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, [(1, a), (1, a), (1, b), (2, b + a)])).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 120)]


def test_long_documents_are_cut_with_context(monkeypatch):
    r = random.Random(5)
    rows = [prose(r, 400).encode() for _ in range(3)]
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(rows), strict=True)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 97)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(rows), strict=True)]
    strings = lambda x: {(i, p + k, t, h) for i, p, m, t, h in zip(*(v.tolist() for v in x), strict=True) for k in range(m + 1)}
    assert strings(whole) == strings(parts) and len(strings(whole)) == sum(len(b) - 49 for b in rows)


# ---------------------------------------------------------------- 4

def brute_lines(rows, window=2, long_line=50):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for j, k in enumerate(full):
            keys = [(tuple(lines[q].strip(" ") for q in full[j:j + window]), full[j:j + window])] if j + window <= len(full) else []
            keys += [((lines[k].strip(" "),), [k])] if len(lines[k].strip(" ")) >= long_line else []
            for key, places in keys:
                if key in seen:
                    gone |= set(places)
                seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup(spark, window):
    r = random.Random(6)
    lines = [prose(r, k % 9 + 1) for k in range(14)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(100, None), (101, ""), (102, "a\n" * 50)]
    got = line_dedup.remove_repeated_lines(table(spark, rows, True).withColumn("n_chars", F.lit(7)), window=window).collect()
    want = brute_lines(rows, window)
    assert {r.doc_id: r.text or "" for r in got} == want
    assert all(r.n_chars == (7 if want[r.doc_id] == (dict(rows)[r.doc_id] or "") else len(r.text)) and r.gone == "z" for r in got)
    assert next(r.text for r in got if r.doc_id == 100) is None


def test_line_dedup_of_repeated_rows(spark):
    text = "x" * 60
    assert [r.text for r in line_dedup.remove_repeated_lines(table(spark, [(1, text), (1, text)])).collect()] == [text, text]
    assert line_dedup.remove_repeated_lines(table(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 and 7

def whole_ids(text, path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.env_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["it's", "a b", "İstanbul x", "J̌ y", "<|endoftext|> z", "x<|startoftext|>y", "12,5 a1b", "日本語 漢字", "🙂🙂", "\x1ca\x1cb", "é a",
    "don't,", "A.B.C. end.", "q" * 300]


def test_words_give_the_ids_of_texts(monkeypatch):
    texts = ODD + [t or "" for _, t in corpus(7)]
    own = tokens.WordEncoder(common.env_path("word_bpe_49k.json"))
    for limit in (10 ** 6, 20):
        monkeypatch.setattr(tokens, "MOST_WORDS", limit)
        for t in texts:
            flat, n = own.encode([t.encode()])
            assert flat.tolist() + [1] == whole_ids(t) and n.tolist() == [len(flat)]


def test_packing(spark):
    rows = corpus(8) + [(200 + k, prose(random.Random(k), 40 * k)) for k in range(30)] + [(300, "word " * 9000)]
    got = packing.pack(table(spark, rows, True), common.env_path("word_bpe_49k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = np.array(whole_ids(text), "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, a, len(ids[a:a + 4096]),
            zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert -(-total // 4096) <= len(bins) <= -(-total // 4096) + 1
    assert packing.pack(table(spark, []), common.env_path("word_bpe_49k.json")).count() == 0


def test_plans_are_packings():
    r = random.Random(9)
    for _ in range(60):
        capacity = r.choice([7, 10, 30])
        counts = {r.randint(1, capacity): r.randint(1, 6) for _ in range(r.randint(1, 8))}
        plan = packing.make_plan(counts, capacity)
        fill, numbers = {}, {}
        for length, first, b, offset, n in plan.rows:
            numbers.setdefault(length, []).extend(range(first, first + n))
            for k in range(n):
                fill.setdefault(b + k, []).append((offset, length))
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(n)) for k, n in counts.items()}
        assert sorted(fill) == list(range(plan.bins))
        for b in fill.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity


def least_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r = random.Random(10)
    for _ in range(150):
        capacity = r.choice([9, 12, 17])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        counts = np.bincount(items, minlength=capacity + 1)
        plan = packing.Plan()
        packing.reduce_by_dominance(counts, capacity, plan)
        rest = [k for k in range(1, capacity + 1) for _ in range(counts[k])]
        assert plan.bins + (least_bins(rest, capacity) if rest else 0) == least_bins(items, capacity)


def test_token_files(spark, tmp_path):
    rows = corpus(11) + [(500 + k, t) for k, t in enumerate(ODD)]
    token_output.write_files(table(spark, rows, True), common.env_path("word_bpe_49k.json"), f"file://{tmp_path}/f")
    got = token_output.read_files(spark, f"file://{tmp_path}/f").orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(got, sorted(rows), strict=True):
        ids = np.array(whole_ids(text), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_output.write_files(table(spark, []), common.env_path("word_bpe_49k.json"), f"file://{tmp_path}/e")
    assert token_output.read_files(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_control_bytes_round_trip(n):
    r = np.random.RandomState(n)
    ranks = (r.randint(0, 2 ** 31, n) >> r.randint(0, 31, n)).astype(np.uint32)
    control, data = token_output.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_output.decode_ranks(control, data, n) == ranks).all()


# ---------------------------------------------------------------- 1 and 3

def vectors(seed=1, n=150, dim=24):
    r = np.random.RandomState(seed)
    x = r.normal(size=(n, dim))
    for k in range(1, n, 3):
        x[k] = x[k - 1] + r.normal(size=dim) * r.choice([0.0, 0.02, 0.03, 0.05, 0.2])
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(r.randint(0, 3))) for i in range(n)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, rows[0][1], None), (1004, [None] * dim, 1),
        (1005, [], 1), (1006, [v * 5 for v in rows[3][1]], rows[3][2]), (1007, [1.0, 2.0], 0),
        (1008, [float("inf")] + [1.0] * (dim - 1), 0)]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def as_arrays(rows):
    out = {}
    for i, v, label in rows:
        x = None if v is None or not v or any(c is None for c in v) else np.array(np.float32(v), float)
        out[i] = (x if x is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None, label)
    return out


@pytest.mark.parametrize("piece", [8192, 2])
def test_embedding_dedup(spark, piece):
    rows = vectors()
    x = as_arrays(rows)
    links = [(a, b) for a in x for b in x if a < b and x[a][1] is not None and x[a][1] == x[b][1] and x[a][0] is not None and x[b][0] is not None and len(x[a][0]) == len(x[b][0]) and x[a][0] @ x[b][0] / (np.linalg.norm(x[a][0]) * np.linalg.norm(x[b][0])) >= 0.98]
    want = brute_components(x, links)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vector_table(spark, rows), piece=piece).collect()}
    assert len(links) > 12
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i in x}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(vector_table(spark, [])).count() == 0


def test_parts_are_merged():
    label = embedding_dedup.merged(np.arange(6), np.array([5, 4, 1]), np.array([4, 2, 0]))
    assert label.tolist() == [0, 0, 2, 3, 2, 2]


def test_nearest_neighbours(spark):
    rows = vectors(2, 400)
    df = vector_table(spark, rows)
    x = {i: v for i, (v, _) in as_arrays(rows).items() if v is not None}
    got = ann.search(df, df.where("vec_id % 5 = 0"), lot=64).collect()
    hit = total = 0
    for q in (i for i in x if i % 5 == 0):
        score = {i: v @ x[q] / (np.linalg.norm(v) * np.linalg.norm(x[q])) for i, v in x.items() if i != q and len(v) == len(x[q])}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1)) and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(best)), total + len(best)
    assert hit / total >= 0.9
    assert ann.search(vector_table(spark, []), vector_table(spark, [])).count() == 0


# ---------------------------------------------------------------- 8

def test_quality_learns_and_bears_odd_rows(spark):
    r = random.Random(12)
    good = [(i, "\n".join(prose(r, 12).capitalize() + "." for _ in range(r.randint(1, 6)))) for i in range(200)]
    bad = [(i, "\n".join("BUY!! NOW!! " * 4 if r.random() < 0.7 else prose(r, 5) for _ in range(r.randint(1, 6)))) for i in range(200, 300)]
    odd = [(400, None), (401, ""), (402, "\n\n"), (403, "x" * 200_000), (403, "x" * 200_000)]
    docs = table(spark, good + bad + odd, True)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(999, 1, 0), (5, None, 0)],
        "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i].predicted == int(i < 200) for i in range(300) if got[i].held_out]
    assert sum(right) / len(right) > 0.9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in quality.score(docs, labels).collect())
    none = quality.score(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.score(table(spark, []), labels).count() == 0


def test_marginals_are_those_of_all_labellings():
    field = quality.Field(np.zeros((len(quality.NAMES), quality.BINS - 1)))
    r = np.random.RandomState(13)
    field.step, field.first = r.normal(size=(2, 2)), r.normal(size=2)
    u, before = r.normal(size=7), np.array([0, 3, 3, 7])
    good, _ = field.marginals(u, before)
    for a, b in ((0, 3), (3, 7)):
        total, each = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = np.exp(field.first[y[0]] + sum(u[a + k] * y[k] for k in range(b - a)) + sum(field.step[y[k], y[k + 1]] for k in range(b - a - 1)))
            total, each = total + w, each + w * np.array(y)
        assert np.allclose(good[a:b], each / total)


# ---------------------------------------------------------------- 2

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li></ul></nav>
<div class="ad">Buy now sale.</div><article><h1>Fish &amp; chips</h1><p><b>Some   text here.<br><p>More <i>te</i>xt &lt;3 &amp;lt;.</article><div class="comments"><p>anna says hi</p></div><footer>&copy; all rights</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE), (5, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == got[4].text == "Fish & chips Some text here. More text <3 &lt;."
    assert [(got[i].text, got[i].n_chars) for i in (2, 3, 5)] == [("", 0)] * 3 and got[1].n_chars == len(got[1].text)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_labeller_on_held_out_made_up_pages():
    r, right, n = random.Random(77), 0, 0
    model = html_extract.trained()
    for _ in range(150):
        found = html_extract.blocks(html_training.made_up(r), {})
        y = np.array([html_training.MARK in t for _, t, _ in found])
        x = html_extract.block_vectors([(p, t.replace(html_training.MARK, "").strip() or ".", k) for p, t, k in found], {})
        right, n = right + int((y == (model.probabilities([x])[0] >= 0.5)).sum()), n + len(y)
    assert right / n > 0.98


def other_layouts(r):
    """(page, text): layouts of another generator, with plain, missing or meaningless class names."""
    words = "river stone market evening winter garden letter engine harvest bridge window captain silver northern morning quiet school doctor village paper".split()
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    c = r.choice([lambda k: "", lambda k: f' class="{k}"', lambda k: f' class="_{zlib.crc32(k.encode()) % 9973:x}"'])
    title, parts = line(6)[:-1], [line(r.randint(15, 60)) for _ in range(r.randint(3, 9))]
    menu = "".join(f'<li{c("item")}><a href="/{w}">{w.capitalize()}</a></li>' for w in r.sample(words, r.randint(3, 8)))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts)
    main = r.choice([f"<article>{body}</article>", f'<div{c("content")}>{body}</div>', f'<main><div{c("post")}>{body}</div></main>',
        f'<section{c("story")}>{body}</section>'])
    comments = "".join(f'<li{c("comment")}><b>{r.choice(words).capitalize()}</b> <i>{r.randint(2, 9)} days ago</i><p>{line(r.randint(5, 12))}</p><a href="#">Reply</a></li>' for _ in range(r.randint(1,
        3)))
    page = f'<!DOCTYPE html><html><head><title>{title}</title></head><body><div{c("nav")}><ul>{menu}</ul></div>'
    page += r.choice(["", f'<div{c("cookie-notice")}>We use cookies on this site. Accept all cookies or read our privacy policy.</div>'])
    page += main + r.choice(["", f'<div{c("comments")}><h3>Comments</h3><ul>{comments}</ul></div>'])
    page += f'<div{c("footer")}>&copy; 2021 {r.choice(words).capitalize()} Press. All rights reserved. <a href="/t">Terms of use</a></div></body></html>'
    return page, " ".join([title, *parts])


def test_pages_of_another_generator():
    """Whole texts of held-out layouts, most of them without telling names."""
    r = random.Random(12)
    pages = [other_layouts(r) for _ in range(150)]
    got = html_extract.main_texts([p for p, _ in pages], html_extract.trained(), {}, {})
    assert sum(g == t for g, (_, t) in zip(got, pages, strict=True)) >= 142


def test_driver_pages_give_their_article():
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if h]
    want = [" ".join(t for p, t, _ in html_extract.blocks(h, {}) if any(x[0] == "article" for x in p)) for h in pages]
    got = html_extract.main_texts(pages, html_extract.trained(), {}, {})
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(pages)


class Splitter(HTMLParser):
    """A plain block splitter on the standard library's parser: text between block-level tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.skip = [], [], 0

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.parts += [" "] if tag == "br" else []
        if tag not in html_extract.INLINE and tag != "br":
            self.cut()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in html_extract.INLINE and tag != "br":
            self.cut()

    def handle_data(self, data):
        self.parts += [] if self.skip else [data]


def test_blocks_are_those_of_a_plain_parser():
    r = random.Random(5)
    pages = [html_training.made_up(r).replace(html_training.MARK, "") for _ in range(60)] + [other_layouts(r)[0] for _ in range(30)]
    pages += ['<div><a title="a > b" href=x>One</a> two<p data-x=\'1 > 0\'>Three</p></div>', "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after"]
    for page in pages:
        plain = Splitter()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert [t for _, t, _ in html_extract.blocks(page, {})] == plain.out


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>x</title><body><article><h1>A title</h1><p>Some text of the article that goes on for a while.</p></article>",
        "A title Some text of the article that goes on for a while."),
    ("Plain text without tags.", "Plain text without tags."),
    ("a &lt; b &amp; c\n\n d", "a < b & c d"),
    ('<article><a title="a > b" href=x>Link</a> and text of the article goes here.</article>', "Link and text of the article goes here."),
])
def test_text_of_odd_pages(page, want):
    assert html_extract.main_texts([page], html_extract.trained(), {}, {}) == [want]


def test_gradients_are_right():
    r = np.random.RandomState(3)
    own = html_extract.Labeller()
    x, mask, y = r.normal(size=(4, 2, html_extract.INPUT)).astype(np.float32) * 0.3, np.ones((4, 2), bool), r.randint(0, 2, (4, 2)).astype(np.float32)
    mask[3, 1] = False

    def loss():
        p = own.forward(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    g = own.gradients(x, mask, y)
    for k in ("fh", "bh", "fx", "bb", "o"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        own.p[k][at] += 1e-2
        high = loss()
        own.p[k][at] -= 2e-2
        low = loss()
        own.p[k][at] += 1e-2
        assert (high - low) / 2e-2 == pytest.approx(g[k][at], rel=0.05, abs=1e-4)


# ---------------------------------------------------------------- 9

def test_sentencepiece(spark):
    import sentencepiece

    path = common.env_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = corpus(14) + [(600 + k, t) for k, t in enumerate([*ODD, "  a  b \n c\t", " ", "a   b", "▁x"])]
    coded = sentencepiece_io.encode(table(spark, rows, True), path)
    got = {r.doc_id: r for r in coded.collect()}
    for i, text in rows:
        ids = library.encode(text or "")
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].parity
        assert got[i].round_trip == ("▁" not in (text or ""))
    back = {r.doc_id: r.text for r in sentencepiece_io.decode(coded, path).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t in rows)
    assert sentencepiece_io.encode(table(spark, []), path).count() == 0


def test_unigram_models_are_rebuilt():
    def field(n, kind, value):
        head = bytes([n << 3 | kind])
        return head + (bytes([len(value)]) + value if kind == 2 else value)

    import struct

    piece = lambda p, s, t=1: field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t])))
    data = piece("<unk>", 0.0, 2) + piece("▁a", -1.0) + piece("b", -2.0) + piece("▁ab", -1.5) + field(2, 2, field(3, 0, b"\x01")) + field(3,
        2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    model = sentencepiece_io.Model(data)
    assert model.kind == sentencepiece_io.UNIGRAM and model.by_units
    assert model.tokenizer().encode("ab a").ids == [3, 1]


def proto(n, kind, value):
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])
    return number(n << 3 | kind) + (number(len(value)) + value if kind == 2 else value)


def made_model(pieces, kind, dummy=1, trim=0, byte_fallback=0):
    import struct

    data = b"".join(proto(1, 2, proto(1, 2, p.encode()) + proto(2, 5, struct.pack("<f", s)) + proto(3, 0, bytes([t]))) for p, s, t in pieces)
    data += proto(2, 2, proto(3, 0, bytes([kind])) + proto(35, 0, bytes([byte_fallback])))
    return data + proto(3, 2, proto(1, 2, b"identity") + proto(3, 0, bytes([dummy])) + proto(4, 0, bytes([trim])) + proto(5, 0, b"\x01"))


def test_unigram_model_of_real_size(tmp_path):
    """All 32,000 pieces as a unigram model: ids and texts of the rebuilt backend are sentencepiece's."""
    import sentencepiece

    pieces = sentencepiece_io.Model(open(common.env_path("piece_bpe_32k.model"), "rb").read()).pieces
    scored = [(p, -4.0 - 0.37 * (k % 997) / 97 - k / 3001 if t == sentencepiece_io.NORMAL else 0.0, t) for k, (p, _, t) in enumerate(pieces)]
    path = tmp_path / "unigram.model"
    path.write_bytes(made_model(scored, sentencepiece_io.UNIGRAM, byte_fallback=1))
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_io.Codec(str(path))
    assert own.model.kind == sentencepiece_io.UNIGRAM
    # in a run of one letter several cuts have the same score, and either library may take any
    texts = [t for _, t in corpus(15) if t and len(set(t)) > 3] + ODD + ["The quick brown fox jumps over the lazy dog, 1234 times.", "naïve café — 東京 🙂"]
    got = own.encode([t.encode() for t in texts])
    for t, (ids, same) in zip(texts, got, strict=True):
        assert ids == library.encode(t) and same, t
        assert own.decode([ids])[0] == library.decode(ids), t


def test_ids_come_from_the_backend_and_the_library_only_checks():
    class Wrong:
        def encode(self, x, **_):
            return [[0] for _ in x]

    own = sentencepiece_io.Codec(common.env_path("piece_bpe_32k.model"))
    want = own.tokenizer.encode("some text here", add_special_tokens=False).ids
    texts = [b"some text here", b"", b"one  two"]
    right = [ids for ids, _ in own.encode(texts)]
    assert right[0] == want
    own.library, own.units = Wrong(), None
    wrong = own.encode(texts)
    assert [ids for ids, _ in wrong] == right and not wrong[0][1]


def test_control_and_user_pieces(tmp_path):
    """Control pieces are spelled by no text and decode to nothing; user-defined ones are found first; unknown shows as such."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("[X]", 0.0, 4), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1),
        ("a", -2.5, 1), ("▁ab", -1.5, 1)]
    path = tmp_path / "small.model"
    path.write_bytes(made_model(pieces, sentencepiece_io.UNIGRAM))
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_io.Codec(str(path))
    assert not own.model.by_units
    for t in ("ab a", "a[X]b", "ab [X] a", "a<s>b", "zz a"):
        (ids, same), = own.encode([t.encode()])
        assert same == (ids == library.encode(t))
        assert own.decode([[1, *ids, 2]])[0] == library.decode([1, *ids, 2]), t
    assert 1 not in own.encode([b"a<s>b"])[0][0] and 3 in own.encode([b"a[X]b"])[0][0]


# ---------------------------------------------------------------- rows without an id

def test_rows_without_ids(spark):
    text = "same words all over again " * 5
    df = table(spark, [(None, text), (None, None), (1, text), (2, text)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()) == [(0, 0), (0, 0), (1, 0), (2, len(text))]
    assert sorted((r.doc_id or 0, r.text or "") for r in suffix_dedup.without_repeats(df).collect()) == [(0, ""), (0, text), (1, text), (2, "")]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similarity_components(df).collect()) == [(0, 0), (0, 0), (1, 1), (2, 1)]
    assert sorted(r.text or "" for r in line_dedup.remove_repeated_lines(df).collect()) == ["", "", "", text]
    assert packing.pack(df, common.env_path("word_bpe_49k.json")).count() == 4
    assert corpus_pipeline.join_near_copies(spark, df, "").count() == 3
    x = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in embedding_dedup.near_duplicates(x).collect()) == [(0, 0), (1, 1), (2, 1)]


# ---------------------------------------------------------------- the pipeline

def test_pipeline(spark, tmp_path):
    r = random.Random(15)
    rows = corpus(15) + [(700 + k, "CLICK!! HERE!! " * 30) for k in range(20)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    named = [(i, int(i < 700), 0) for i, _ in rows if r.random() < 0.9]
    spark.createDataFrame(named, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    kinds, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = (before.select("doc_id", "text").collect(), docs)
    assert all(seen[n][1].dtypes == kinds for n in list(seen)[:-1])
    texts = lambda rows_: [(x.doc_id, x.text) for x in rows_]
    before, after = seen["line dedup"]
    want = brute_lines(texts(before))
    assert {x.doc_id: x.text or "" for x in after.collect()} == {i: want[i] for i, t in texts(before) if want[i] == (t or "") or want[i].strip(" ")}
    before, after = seen["n-gram Jaccard join"]
    sets = brute_sets(texts(before))
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(x.doc_id for x in after.collect()) == sorted(i for i, c in brute_components(sets, links).items() if i == c)
    before, after = seen["suffix-array dedup"]
    hashes = brute_repeats(texts(before))
    assert all(hashlib.sha256((x.text or "").encode()).hexdigest() == hashes[x.doc_id][3] or "�" not in (x.text or "") for x in after.collect())
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))
