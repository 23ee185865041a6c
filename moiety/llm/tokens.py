"""Token ids of whole texts with the tokenizers library, one call for each distinct word.

For a vocabulary that is lower case and drops white space (``word_bpe_49k.json`` is: its patterns never match any, and its
normaliser composes nothing across it) the ids of a text are those of its words, split at ASCII white space, one after another.
So a worker asks the library once for each distinct word and keeps the answer in a bounded table; tests hold the ids
against those of whole texts.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from moiety.llm import common as C

MOST_WORDS, MOST_IDS = 500_000, 5_000_000  #: of a worker's table, which keeps the words met most often beyond
IDLE_WORDS = 100_000
_STOP = ".,;:!?"


def _letters(word: str) -> bool:
    """Letters alone, also after the vocabulary's normaliser, which splits some letters into letter and mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word):
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordEncoder:
    """Encodes lists of UTF-8 texts to one flat array of ids and the number of ids of each text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a special token's text between words keeps their ids apart in one call
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = min(special) if special else (None, -1)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self):
        self.index, self.pool, self.used = _Index(), np.zeros(1 << 16, np.uint32), 0
        self.at, self.n, self.met, self.odd = (np.zeros(1 << 16, np.int64) for _ in range(4))

    def rest(self, most: int = IDLE_WORDS):
        """Between tasks only the most frequent words are kept: an idle worker's memory counts too."""
        if len(self.index) > most:
            self._shrink(most)
        C.trim()

    def _shrink(self, most: int):
        """Forgets all but the ``most`` frequent words."""
        total = len(self.index)
        keep = np.sort(np.argsort(self.met[:total], kind="stable")[max(0, total - most):])
        if int(self.n[keep].sum()) > MOST_IDS // 2:
            return self._empty()
        words = list(self.index)
        old, at, n, met, odd = self.pool, self.at, self.n, self.met, self.odd
        self._empty()
        for k in keep.tolist():
            self.index[words[k]] = len(self.index)
        flat = old[np.repeat(at[keep] - (np.cumsum(n[keep]) - n[keep]), n[keep]) + np.arange(int(n[keep].sum()))]
        self._store(flat, n[keep], 0)
        self.met[:len(keep)], self.odd[:len(keep)] = met[keep] // 2, odd[keep]

    def _store(self, flat, n, first):
        total = first + len(n)
        while total > len(self.at):
            self.at, self.n, self.met, self.odd = (np.append(x, np.zeros_like(x)) for x in (self.at, self.n, self.met, self.odd))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used:self.used + len(flat)] = flat
        self.n[first:total] = n
        self.at[first:total] = self.used + np.cumsum(n) - n
        self.used += len(flat)

    def _ask(self, words: list[bytes], per: int = 1000):
        """Ids of all words, and how many each has; many words in one call where their ends can be told.

        A word of letters alone is one piece for the vocabulary, a word of letters and one stop two, and the last id of a
        piece is known by its end-of-word mark; a call whose marks are not as many as its pieces is asked again word by word.
        Other words are kept apart by a special token's text."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        pieces = np.zeros(len(texts), np.int64)
        if self.ends.any():
            for k, w in enumerate(texts):
                if _letters(w):
                    pieces[k] = 1
                elif w[-1] in _STOP and _letters(w[:-1]):
                    pieces[k] = 2
        call = self.tokenizer.encode_batch_fast
        told = lambda joined: np.concatenate([np.array(e.ids, np.uint32) for e in call(joined,
            add_special_tokens=False)]) if joined else np.zeros(0, np.uint32)
        easy, hard = np.flatnonzero(pieces), np.flatnonzero(pieces == 0)
        flat, last, used = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for some in (easy[i:i + per] for i in range(0, len(easy), per)):
            got = told([" ".join([texts[k] for k in some])])
            ends = np.flatnonzero(self.ends[got])
            if len(ends) == pieces[some].sum() and ends[-1] == len(got) - 1:
                stop = ends[np.cumsum(pieces[some]) - 1] + 1
            else:  # the pieces are not those expected: each word alone
                ids = [np.array(e.ids, np.uint32) for e in call([texts[k] for k in some], add_special_tokens=False)]
                got, stop = np.concatenate(ids), np.cumsum([len(x) for x in ids])
            flat.append(got)
            last.append(stop + used)
            used += len(got)
        flat, last = np.concatenate(flat), np.concatenate(last)
        if self.mark is None or any("<|" in texts[k] for k in hard):
            ids = [np.array(e.ids, np.uint32) for e in call([texts[k] for k in hard], add_special_tokens=False)]
            rest, n_rest = (np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        else:
            rest = told([self.mark.join(["", *(texts[k] for k in hard[i:i + per])]) for i in range(0, len(hard), per)])
            marks = np.flatnonzero(rest == self.mark_id)
            rest, n_rest = rest[rest != self.mark_id], np.diff(np.append(marks, len(rest))) - 1
        n = np.zeros(len(texts), np.int64)
        n[easy], n[hard] = np.diff(last, prepend=0), n_rest
        both = np.concatenate([flat, rest])
        first = np.zeros(len(texts), np.int64)
        first[easy], first[hard] = last - n[easy], len(flat) + np.cumsum(n_rest) - n_rest
        return both[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _learn(self):
        words, self.index.new = self.index.new, []
        if words:
            flat, n, *odd = self._ask(words)
            first = len(self.index) - len(words)
            self._store(flat, n, first)
            self.odd[first:len(self.index)] = odd[0] if odd else 0

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        # the vocabulary is lower case; A-Z can be lowered here, which leaves fewer words to ask for, unless a mark of U+0300 to U+037F (those
        # that compose with a letter A-Z, and not always alike with its small letter) or a special token's text may follow
        plain = b"<|" not in text and (text.isascii() or b"\xcc" not in text and b"\xcd" not in text)
        return (text.lower() if plain else text).split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, each, _ = self.encode_words(texts)
        return flat, each

    def encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each text, and the sum of its words' marks (``odd``)."""
        if len(self.index) > MOST_WORDS or self.used > MOST_IDS:
            self._shrink(MOST_WORDS // 2)
        found = [np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) for words in map(self.split, texts)]
        self._learn()
        words = np.concatenate(found) if found else np.zeros(0, np.int64)
        n = self.n[words]
        self.met[:len(self.index)] += np.bincount(words, minlength=len(self.index))
        flat = self.pool[np.repeat(self.at[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])
        count = np.cumsum([len(x) for x in found])
        each = np.diff(np.concatenate([[0], ends[count]])) if found else np.zeros(0, np.int64)
        odd = np.concatenate([[0], np.cumsum(self.odd[words])])
        return flat, each, np.diff(np.concatenate([[0], odd[count]])) if found else np.zeros(0, np.int64)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    cache = C.worker_cache()
    key = ("words", path)
    if key not in cache:
        cache[key] = WordEncoder(path)
    return cache[key]


def encoded_rows(batches, path: str, end_id: int, columns: list[str], limit: int = 1 << 21, idle: int = IDLE_WORDS):
    """For lots of rows of about ``limit`` bytes: their columns (lists), ids with ``end_id`` after each document, and lengths.

    ``idle`` words are kept for the worker's next task."""
    words = encoder(path)
    for batch in batches:
        text = batch.column("text")
        data, offsets = C.column_bytes(text)
        kept = {c: batch.column(c).to_pylist() for c in columns}
        for i, j in C.text_slices(offsets, limit):
            flat, n = words.encode([data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist(), strict=True)])
            ids = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
            yield {c: v[i:j] for c, v in kept.items()}, ids, n + 1
    words.rest(idle)
