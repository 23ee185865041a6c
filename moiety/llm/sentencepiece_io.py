"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protocol buffer, parsed here field by field.  From it a tokenizer is rebuilt: the normaliser
(precompiled character map, extra white space, dummy prefix, spaces as U+2581), the pieces with their scores and byte
fallback.  Models of type unigram become a Unigram model with those scores; models of type BPE (such as
``piece_bpe_32k.model``) a BPE model whose merges follow from the scores, highest first.

Where no piece holds U+2581 after another character, and the normaliser changes nothing but spaces, a text falls apart
into units (spaces and what follows them) that are encoded independently.  Each worker then encodes a distinct unit once,
in multithreaded batches; otherwise whole texts are encoded.  Ids are always those of the tokenizers library, and texts are decoded
by its decoder in batches.  The sentencepiece library only checks: documents whose ids it would give otherwise show parity = false.

Control pieces are special tokens, which no text spells and which decode to nothing; user-defined pieces are found in a text
before all others; the unknown piece decodes to " \u2047 ", as with sentencepiece.

Defined results: null or empty text has no ids.  As with sentencepiece, U+2581 in a text is decoded as a space, so such a
text shows round_trip = false.  Rows that repeat are encoded each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from moiety.llm import common as C
from moiety.llm import tokens

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  #: piece types of the format
UNIGRAM, BPE = 1, 2  #: model types of the format
HIDDEN = "\ufdd0"  #: a code point that stands for no character, before the names of pieces that no text spells


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; lengths and numbers only, no schema."""
    i = 0

    def number():
        nonlocal i
        x = shift = 0
        while True:
            byte = data[i]
            i += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[i:i + n]
        i += n


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for k, v in fields(data):
            if k == 1:
                x = dict(fields(v))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(fields(v))
            elif k == 3:
                norm = dict(fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.by_units = not self.charsmap and not self.trim and self.dummy_prefix and not any(SPACE in p.lstrip(SPACE) or kind == USER for p,
            _, kind in self.pieces)

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        names = [HIDDEN + p if kind in (CONTROL, UNUSED) else p for p, _, kind in self.pieces]
        ids = {p: i for i, p in enumerate(names)}
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, (_, s, _) in zip(names, self.pieces, strict=True)], self.unknown, self.byte_fallback)
        else:
            merges = []
            for p, score, kind in self.pieces:
                if kind == NORMAL and len(p) > 1:
                    merges += [(-score, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            merges.sort(key=lambda m: (m[0], ids[m[2] + m[3]], ids[m[2]], ids[m[3]]))
            model = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if self.trim else []
        steps += [normalizers.Prepend(SPACE)] if self.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        if self.by_units:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
        steps = [decoders.Replace(self.pieces[self.unknown][0], " \u2047 ")] if self.pieces[self.unknown][2] == UNKNOWN else []
        steps += [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        out.add_special_tokens([AddedToken(p, normalized=False, special=True) for p, (_, _, kind) in zip(names, self.pieces, strict=True) if kind == CONTROL])
        out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER])
        out.encode_special_tokens = True
        return out


class _Units(tokens.WordEncoder):
    """Units of texts: spaces and what follows them, without the first space.  ``odd`` marks units where the libraries differ."""

    def __init__(self, model: Model, tokenizer, library):
        self.model, self.tokenizer, self.library = model, tokenizer, library
        self.size = len(model.pieces)
        self.starts = np.array([p.startswith(SPACE) for p, _, _ in model.pieces])
        self.blank = next((i for i, p in enumerate(model.pieces) if p[0] == SPACE), model.unknown)
        self._empty()

    @staticmethod
    def split(text: bytes, runs=re.compile(b" +[^ ]*")) -> list[bytes]:
        text = text.replace(SPACE.encode(), b" ")
        if not text:
            return []
        return [u[1:] for u in runs.findall(b" " + text)] if b"  " in text or text[:1] == b" " else text.split(b" ")

    def _joined(self, texts: list[str], encode, per: int = 500):
        """Ids of units without spaces, many in a text: each starts with a piece that starts with a space."""
        flat = np.concatenate([np.array(x,
            np.uint32) for x in encode([" ".join(texts[i:i + per]) for i in range(0, len(texts), per)])]) if texts else np.zeros(0,
            np.uint32)
        first = np.flatnonzero(self.starts[flat])
        if len(first) != len(texts):
            raise ValueError("a unit did not start with a space's piece")
        return flat, np.diff(np.append(first, len(flat)))

    def _ask(self, words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.array([bool(t) and " " not in t for t in texts])
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ours = lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        theirs = lambda x: self.library.encode(x, num_threads=1)
        easy = [t for t, p in zip(texts, plain, strict=True) if p]
        (a, n_a), (b, n_b) = self._joined(easy, ours), self._joined(easy, theirs)
        if len(a) == len(b) and np.array_equal(n_a, n_b):
            owner = np.repeat(np.arange(len(n_b)), n_b)
            differs = np.bincount(owner[a != b], minlength=len(n_b)) > 0
        else:
            at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            differs = np.array([not np.array_equal(a[i:i + k], b[j:j + m]) for i, k, j, m in zip(at_a, n_a, at_b, n_b, strict=True)])
        hard = [t for t, p in zip(texts, plain, strict=True) if not p]
        pairs = [([self.blank], [self.blank]) if not t else (x, y) for t, x, y in zip(hard, ours(hard), theirs(hard), strict=True)]
        n, odd = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        n[plain], n[~plain] = n_a, [len(x) for x, _ in pairs]
        odd[plain], odd[~plain] = differs, [x != y for x, y in pairs]
        both = np.concatenate([a, np.array([i for x, _ in pairs for i in x], np.uint32)])
        first = np.zeros(len(texts), np.int64)
        first[plain], first[~plain] = np.cumsum(n_a) - n_a, len(a) + np.cumsum(n[~plain]) - n[~plain]
        return both[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n, odd


class Codec:
    """Encodes and decodes lists of UTF-8 texts."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.tokenizer = self.model.tokenizer()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.units = _Units(self.model, self.tokenizer, self.library) if self.model.by_units else None

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each text, and whether both libraries agree on it."""
        if self.units is not None:
            flat, n, odd = self.units.encode_words(texts)
            return flat, n, odd == 0
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        words = [t.decode("utf-8", "replace") for t in texts]
        ours, theirs = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)], self.library.encode(words, num_threads=1)
        return np.array([i for x in ours for i in x], np.uint32), np.array([len(x) for x in ours],
            np.int64), np.array([x == y for x, y in zip(ours, theirs, strict=True)], bool)

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], bool]]:
        """(ids, whether both libraries agree) of each text."""
        flat, n, same = self.encode_flat(texts)
        ends = np.cumsum(n)
        return [(flat[a:b].tolist(), bool(s)) for a, b, s in zip(ends - n, ends, same, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        return self.tokenizer.decode_batch(ids, skip_special_tokens=True)


def codec(path: str) -> Codec:
    """This worker's codec for a model file."""
    cache = C.worker_cache()
    key = ("sentencepiece", path)
    if key not in cache:
        cache[key] = Codec(path)
    return cache[key]


_OUT = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean, ids binary"


def _encode(batches, path, with_ids):
    own = codec(path)
    for batch in batches:
        data, offsets = C.column_bytes(batch.column("text"))
        for i, j in C.text_slices(offsets, 1 << 20):
            texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist(), strict=True)]
            flat, n, same = own.encode_flat(texts)
            view, ends = memoryview(flat.astype("<u4")).cast("B"), 4 * np.cumsum(n)
            raw = [view[b - 4 * k:b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            every, last = flat.tolist(), np.cumsum(n).tolist()
            back = [a.encode() == b for a, b in zip(own.decode([every[b - k:b] for b, k in zip(last, n.tolist(), strict=True)]), texts, strict=True)]
            columns = [pa.array(n, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(back, pa.bool_()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns,
                pa.array([bytes(r) for r in raw] if with_ids else [None] * len(raw), pa.binary())],
                [x.split()[0] for x in _OUT.split(", ")])
    if own.units is not None:
        own.units.rest()


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, parity, ids (little-endian uint32) of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encode(it, path, with_ids), _OUT)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ids (as ``encode`` gives them) as doc_id, text."""
    def run(batches):
        own = codec(path)
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            texts = own.decode([[] if x is None else np.frombuffer(x, "<u4").tolist() for x in raw])
            texts = [None if x is None else t for x, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_sentencepiece``: the whole of ``documents`` encoded, decoded and held against sentencepiece."""
    return encode(C.table(spark, sf_dir, "documents"), C.env_path("piece_bpe_32k.model"), with_ids=False).drop("ids")
