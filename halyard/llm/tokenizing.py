"""Fast exact encoding of whole texts with a byte-level BPE of ``tokenizers``.

The pre-tokenizer of these vocabularies never lets a piece cross the boundary
before a lone space or around a lone newline. A text whose white space is only
lone spaces and lone newlines between words is therefore the concatenation of
its words' encodings, and each word is encoded once per worker and kept in a
bounded cache. A word of Latin letters alone is one piece, so it goes to the
library's BPE model directly; other words and texts go to the whole tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached words per Python worker, in two halves: when one is full, the other,
#: with the words not met since, is let go. Longer words are not kept, so the
#: cache is bounded in bytes as well (about 100 MB).
CACHE_WORDS = 700_000
KEPT_CHARS = 48
CACHE_TAILS = 10_000
#: Characters whose words are numbered at a time.
CHUNK_CHARS = 4_000_000
#: ASCII punctuation that may end a word; the apostrophe is left out (contractions).
RUNS = ("  ", "\n\n", " \n", "\n ")
#: White space besides space and newline.
OTHER_SPACE = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
STOPS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Letters below this one are in every version of the Unicode tables.
LATIN_END = "ɐ"


def _byte_letters() -> np.ndarray:
    """The vocabulary's letter of each byte: printable Latin-1 characters stand
    for themselves, the other bytes for the letters from U+0100 on, in order.
    The newline is left as it is: it parts words."""
    plain = {b for b in range(33, 256) if b not in (127, 173) and not 127 < b < 161}
    rest = [b for b in range(256) if b not in plain]
    letters = np.arange(256, dtype="<u4")
    letters[rest] = np.arange(256, 256 + len(rest))
    letters[10] = 10
    return letters


class WordCachedEncoder:
    """Keys of the cache: a word stands for itself after a space; a word after a
    newline has the newline in front. Values are serialized ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model behind a plain split: takes pieces that are cut already.
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        lone = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = lone[0] if len(lone) == 1 else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if size <= 65536 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.limit = cache_words

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def _fill(self, words: list[str], ids: np.ndarray, begins) -> None:
        """Deal out the ids of ``words``; ``begins`` marks those that open one."""
        at = np.flatnonzero(begins(ids))
        if len(at) != len(words) or at[0] != 0:
            for w in words:
                self.cache[w] = self.whole(w if w[0] == "\n" else " " + w)
            return
        raw, width = ids.tobytes(), self.dtype.itemsize
        bounds = (at * width).tolist()
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, bounds, [*bounds[1:], len(raw)]))))

    def _ids(self, tokenizer, joined: str) -> np.ndarray:
        # The fast call leaves out character offsets, which nothing here needs.
        return np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _lines(self, words: list[str]) -> str:
        """Words of letters alone as lines in the vocabulary's letters."""
        lines = "\n".join(words)
        return lines if lines.isascii() else self.letters[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-32-le")

    def _learn(self, missing: list[str]) -> None:
        cache = self.cache
        stems = list(map(str.rstrip, missing, repeat(STOPS)))
        # A run of stops after a letter or digit is always a piece of its own.
        ended = [(w, stem, w[len(stem) :]) for w, stem in zip(missing, stems) if w != stem and stem[-1:].isalnum()]
        apart = {stem for _, stem, _ in ended if stem not in cache}
        bare = apart.union(missing).difference(w for w, _, _ in ended)
        plain, latin, first, other, opened = [], [], [], [], []
        for w in bare:
            after_line = w[0] == "\n"
            body = w[1:] if after_line else w
            if body.isalpha() and (body.isascii() or max(body) < LATIN_END):
                (first if after_line else plain if body.isascii() else latin).append(w)
            else:
                (opened if after_line else other).append(w)
        for words in (plain, latin):
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                self._fill(part, self._ids(self.pieces, "Ġ" + self._lines(part).replace("\n", "\nĠ")), self.opens.__getitem__)
        if first and self.newline is not None:
            joined = "Ċ\n" + self._lines([w[1:] for w in first]).replace("\n", "\nĊ\n")
            self._fill(first, self._ids(self.pieces, joined), lambda ids: ids == self.newline)
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            self._fill(part, self._ids(self.tokenizer, " " + " ".join(part)), self.opens.__getitem__)
        if opened:
            self._fill(opened, self._ids(self.tokenizer, "".join(opened)), lambda ids: ids == self.newline)
        if len(self.tails) > CACHE_TAILS:
            self.tails = {}
        for w, stem, tail in ended:
            end = self.tails.get(tail)
            if end is None:
                end = self.whole(tail)
                if len(tail) <= KEPT_CHARS:
                    self.tails[tail] = end
            cache[w] = cache[stem] + end
        for w in apart.difference(missing):
            if len(w) > KEPT_CHARS:
                del cache[w]

    def _regular(self, text: str) -> bool:
        if not text or self.newline is None or text[0] in " \n" or text[-1] in " \n":
            return False
        return not any(s in text for s in (*RUNS, *OTHER_SPACE, *self.special))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache or learnt."""
        if len(self.cache) > self.limit // 2:
            self.older, self.cache = self.cache, {}
        found = list(map(self.cache.get, words))
        if None in found:
            missing = [w for w, raw in zip(words, found) if raw is None]
            known = list(map(self.older.get, missing))
            self.cache.update((w, raw) for w, raw in zip(missing, known) if raw is not None)
            if None in known:
                self._learn([w for w, raw in zip(missing, known) if raw is None])
            found = list(map(self.cache.__getitem__, words))
            for w in missing:
                if len(w) > KEPT_CHARS:
                    del self.cache[w]
        return found

    def _joined(self, keys: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys parted by blanks, and the place where each key begins.

        Words are split and numbered by Arrow, so Python meets each distinct
        word of a chunk once.
        """
        coded = pc.split_pattern(pa.array([keys], pa.large_string()), " ").flatten().dictionary_encode()
        # One string cut by Python: values of an array taken singly cost far more.
        every = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        raws = self._words(pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // self.dtype.itemsize
        flat, at = np.frombuffer(b"".join(raws), dtype=self.dtype), coded.indices.to_numpy()
        n = sizes[at]
        begins = np.cumsum(n) - n
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - begins, n)
        source += np.arange(len(source))
        return flat[source], begins

    def _long(self, keys: str) -> bytes:
        """As ``_joined``, in pieces, for a text beyond a chunk."""
        out, at = [], 0
        while at < len(keys):
            cut = keys.find(" ", at + CHUNK_CHARS)
            cut = len(keys) if cut < 0 else cut
            out.append(self._joined(keys[at:cut])[0].tobytes())
            at = cut + 1
        return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``self.dtype``."""
        out: list[bytes] = [b""] * len(texts)
        chunk: list[tuple[int, str]] = []
        held, width = 0, self.dtype.itemsize

        def flush() -> None:
            ids, begins = self._joined(" ".join(keys for _, keys in chunk))
            words = np.cumsum([0, *(keys.count(" ") + 1 for _, keys in chunk)])
            bounds = np.append(begins, len(ids))[words].tolist()
            # The first key of a text has a newline in front that the text has not.
            for (k, _), lo, hi in zip(chunk, bounds, bounds[1:]):
                out[k] = ids[lo + 1 : hi].tobytes()
            chunk.clear()

        for k, text in enumerate(texts):
            if not self._regular(text):
                out[k] = self.whole(text)
                continue
            keys = "\n" + text.replace("\n", " \n")
            if len(keys) > CHUNK_CHARS:
                out[k] = self._long(keys)[width:]
                continue
            chunk.append((k, keys))
            held += len(keys)
            if held > CHUNK_CHARS:
                flush()
                held = 0
        if chunk:
            flush()
        return out

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype).astype("<u4")


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordCachedEncoder:
    return WordCachedEncoder(path, cache_words)
