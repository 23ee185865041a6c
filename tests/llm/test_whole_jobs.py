"""Cases in which operators used to do less than their whole job."""

import string
import unicodedata

import numpy as np
import pytest

from pyspark.sql import functions as F

from moiety.llm import ann, common, embedding_dedup, html_extract, tokens

VOCABULARY = common.env_path("word_bpe_49k.json")


def _split_by_nfc():
    return [c for c in map(chr, range(0x20000)) if c.isalpha() and not unicodedata.normalize("NFC", c).isalpha()]


def test_ids_beside_letters_that_the_normaliser_splits():
    own = tokens.WordEncoder(VOCABULARY)
    odd = _split_by_nfc()
    assert len(odd) > 50
    words = [w for c in odd for w in (c, "hello", c + "a.", "world", "k" + c, "done.", "more")]
    flat, n = own._ask([w.encode() for w in words])
    at = 0
    for w, k in zip(words, n.tolist(), strict=True):
        assert flat[at:at + k].tolist() == own.tokenizer.encode(w, add_special_tokens=False).ids, w
        at += k
    assert at == len(flat)


def test_joined_call_with_other_pieces_is_asked_word_by_word(monkeypatch):
    monkeypatch.setattr(tokens, "_letters", str.isalpha)
    own = tokens.WordEncoder(VOCABULARY)
    words = ["\u0958", "hello", "world"]
    flat, n = own._ask([w.encode() for w in words])
    want = [own.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])


@pytest.mark.parametrize("page, want", [
    ("<head><title>t</title><body><article><p>One.</p></article>", "One."),
    ("<html><head><meta charset=x><noscript><link href=x><title>t</title><article>One.</article>", "One."),
    ("<article>One.<svg /> Two. Three.</article>", "One. Two. Three."),
    ("<article>One.<math/> Two.<object data=x /> Three.<iframe src=x /> Four.</article>", "One. Two. Three. Four."),
    ("<article>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>y</annotation></math>, <object><b>shown</b></object>.</article>", "Let x = 2, shown."),
    ("<div>One.<svg><g><path d=x><title/><style/></svg> Two.<svg><g></div><p>Three.", "One. Two. Three."),
    ("<div>One.<svg><path d=x><p>Two.</div><p>Three.", "One. Two. Three."),
    ("<div>A<svg><svg></svg>no<foreignObject><p>no</p></foreignObject></svg>B<template>no<template>no</template>no</template></div>", "AB"),
    ("<p>A<script>if (a<b) '<p>'</script>B<select><option>no<option>no</select>C<textarea>no</textarea>D<noscript><div>no</div></noscript></p>", "ABCD"),
    ("<body>A<video>B", "AB"),
    ("İ<svg>no</SVG>A<iframe><iframe></iframe>B", "İAB"),
])
def test_no_shown_text_of_a_page_is_lost(page, want):
    assert " ".join(t for _, t, _ in html_extract.blocks(page, {})) == want


def test_neighbours_among_copies_and_repeated_ids(spark):
    r = np.random.RandomState(4)
    base = r.normal(size=(500, 8))
    near = base[1] + 0.01 * r.normal(size=(40, 8))
    rows = [(k + 1000, v.tolist()) for k, v in enumerate(base)] + [(k, base[0].tolist()) for k in range(300)] + [(7000, v.tolist()) for v in near]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, df.where("vec_id in (0, 150, 1000, 1001)"), k=5, lot=10_000).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[150] == got[1000] == [0, 1, 2, 3, 4]
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    best = {}
    for i, v in rows:
        best[i] = max(best.get(i, -1), float(unit(np.array(v)) @ unit(base[1])))
    assert len(got[1001]) == len(set(got[1001])) == 5 and got[1001][0] == 7000
    assert len(set(got[1001]) & set(sorted((i for i in best if i != 1001), key=lambda i: (-round(best[i], 12), i))[:5])) >= 4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_search_reaches_recall(spark, sf):
    """The query with its own settings against brute force over the whole table, in double precision."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding is not None and None not in r.embedding}
    x = {i: v / np.linalg.norm(v) for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids, all_ = np.array(list(x)), np.stack(list(x.values()))
    found = ann.op3(spark, f"/root/testdata/{sf}")
    assert found.columns[:4] == ["query_id", "rank", "vec_id", "score"] and [t for _, t in found.dtypes][:4] == ["bigint", "int", "bigint", "double"]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in x if i % 50 == 0]
    assert set(got) == set(asked)
    hits = 0
    for i in asked:
        score = all_ @ x[i]
        score[ids == i] = -9
        fifth = np.sort(score)[-5]
        assert sorted(got[i]) == [1, 2, 3, 4, 5] and len({v for v, _ in got[i].values()}) == 5
        assert all(abs(s - x[v] @ x[i]) < 1e-12 for v, s in got[i].values())
        hits += sum(s >= fifth - 1e-12 for _, s in got[i].values())
    assert hits >= 0.95 * 5 * len(asked)


def test_windows_are_read_once_and_reach_all():
    """Each entry of an array is counted at most once; without a stop every vector is verified."""
    r = np.random.RandomState(1)
    x = r.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for (found, read), q in zip(ann.nearest(x, x[:20], 32, 0.7, 0.04, 5, np.arange(300)), x[:20], strict=True):
        assert len(found) == len(set(found.tolist())) and read <= 32 * 300
    for found, read in ann.nearest(x, x[:3], 32, 0.7, 2.0, 400, np.arange(300)):
        assert sorted(found.tolist()) == list(range(300)) and read == 32 * 300


def test_neighbours_with_clashing_columns(spark):
    r = np.random.RandomState(8)
    rows = [(k, r.normal(size=6).tolist(), "z", 1, [2], 3, True) for k in range(60)]
    plain = spark.createDataFrame([x[:2] for x in rows], "vec_id long, embedding array<double>")
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string, id int, ids array<int>, lot int, query boolean")
    pick = lambda df: sorted(map(tuple, ann.search(df, df.where("vec_id % 50 = 0")).collect()))
    assert pick(plain) == pick(wide) and len(pick(plain)) == 10


def _linked(rows, cosine=0.98):
    """Brute force over rows (vec_id, vector, label): links of each vec_id, and components."""
    unit = [np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float)) for _, v, _ in rows]
    n, root = {}, {}
    for i, _, _ in rows:
        n[i], root[i] = 0, i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, (a, _, x) in enumerate(rows):
        for k, (b, _, y) in enumerate(rows):
            if a != b and x is not None and x == y and unit[j] @ unit[k] >= cosine:
                n[a] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return n, {i: find(i) for i in root}


@pytest.mark.parametrize("kind, labels", [("bigint", (1, 1 + (1 << 32), 3)), ("string", ("a", "b", "a b")), ("int", (1, 2, 3))])
@pytest.mark.parametrize("piece", [8192, 7])
def test_labels_of_any_type_copies_and_repeated_ids(spark, kind, labels, piece):
    r = np.random.RandomState(11)
    base = r.normal(size=(12, 20))
    rows = []
    for k in range(160):
        v = base[r.randint(12)] + r.normal(size=20) * r.choice([0.0, 0.0, 0.05, 0.15])
        rows.append((int(k if k % 10 else 1000 + k // 40), [float(np.float32(x)) for x in v], None if k % 23 == 5 else labels[r.randint(3)]))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    for c in ("id", "n", "own", "block", "cell", "x", "y", "a", "other"):
        df = df.withColumn(c, F.lit("z"))
    n, root = _linked(rows)
    got = embedding_dedup.near_duplicates(df.repartition(3), piece=piece)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    got = got.collect()
    assert len(got) == len(rows) and max(n.values()) > 3
    assert {x.vec_id: x.n_links for x in got} == n and {x.vec_id: x.component_id for x in got} == root


def test_words_of_texts_beyond_ascii_are_asked_for_once_in_either_case():
    own = tokens.WordEncoder(VOCABULARY)
    texts = ["Élan Der DER der Straße STRASSE strasse", "der élan Élan", "H̱er ẖer T̈ ẗ Å å İ İ der DER", "É <|ENDOFTEXT|> <|endoftext|>Der"]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    flat, n = own.encode([t.encode() for t in texts[:1]])
    assert flat.tolist() == want[0] and set(own.index) == {"Élan".encode(), b"der", "straße".encode(), b"strasse"}
    flat, n = own.encode([t.encode() for t in texts])
    assert flat.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]


def test_lowered_letters_give_the_ids_of_their_capitals_beside_every_mark():
    own = tokens.WordEncoder(VOCABULARY)
    marks = [chr(c) for c in range(0x80, 0x3100) if unicodedata.combining(chr(c))]
    texts = [f"é {' '.join(f'x{c}{m}y' for c in string.ascii_uppercase)}" for m in marks]
    flat, n = own.encode([t.encode() for t in texts])
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])
