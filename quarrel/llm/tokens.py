"""Token ids by the tokenizers library, through a bounded cache of word pieces.

Both vocabularies split a text before any merge, so the ids of a text are the ids of its pieces in order. Pieces repeat, so their ids are
taken from a cache that the library fills. Texts with characters outside a plain Latin set, for which that split is not relied on, and
texts that hold the string of an added token in any case go to the library whole, with its settings as the vocabulary's file has them.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 1_200_000
_ODD = re.compile("[^\t\n\x20-\x7e¡-į]")
_PLAIN = [c for c in map(chr, range(0x20, 0x130)) if not _ODD.match(c)]
_LETTERS = "".join(c for c in _PLAIN if c.isalpha())
_ENDS = "".join(c for c in _PLAIN if re.match(r"[^\w\s]", c))


class Encoder:
    """batch(texts) gives the ids of each whole text as little-endian uint32 bytes.

    words=True: for a vocabulary that lower-cases and drops white space; else for a byte-level one whose pieces may start with one space.
    """

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        lead = os.path.commonprefix(added)
        self.lead = lead if lead.lower() == lead.upper() else ""  # found far faster than the tokens in any case
        self.words = words
        self.sizes = None
        if not words:  # in a byte-level vocabulary a character of a token is a byte
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(_LETTERS)) > 1:
                raise AssertionError("a word of letters was split")
            vocab = self.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.sizes[list(vocab.values())] = list(map(len, vocab))
        self.cache: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str | None) -> str | None:
        """Pieces that can be encoded apart, with a space between them, or None where the library gets the text whole."""
        if not text:
            return ""
        if _ODD.search(text) or (self.lead in text and self.added.search(text)):
            return None
        if self.words:
            return " ".join(text.lower().split())
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text:
            return None
        # A cut before a white-space character that stands between two others never falls inside a piece.
        return "\0" + text.replace("\n", " \n")  # no space before the first

    def _learn(self, missing: set[str]) -> None:
        """Ids of missing pieces. Letters with marks behind them are the letters' ids and the marks'; the rest go to the library one by one."""
        cache, parts = self.cache, []
        todo = {"": set(filter(str.isalpha, missing)), "\0": set()}
        for p in missing - todo[""]:
            mark = p[0] if p[0] in "\n\0" else ""
            word = p.rstrip(_ENDS)[len(mark) :]
            if word.isalpha():
                bare = "\0" if mark and not self.words else ""
                key = bare + word
                if key not in cache:
                    todo[bare].add(word)
                if key != p:
                    parts.append((p, mark, key, p[len(mark) + len(word) :]))
            else:
                cache[p] = self._one(p[1:] if p[0] == "\0" else p if self.words or p[0] == "\n" else " " + p)
        for mark, found in todo.items():  # a word of letters alone is one piece, so many go in one call
            rest = list(found)
            for at in range(0, len(rest), 512):
                part = rest[at : at + 512]
                cache.update(zip([mark + p for p in part] if mark else part, self._words(part) if self.words else self._bytes(part, not mark), strict=True))
        for p, mark, key, end in parts:
            cache[p] = (self._mark("\n") if mark == "\n" and not self.words else b"") + cache[key] + (self._mark(end) if end else b"")

    def _words(self, part: list[str]) -> list[bytes]:
        """Ids of each word of letters, by the library's numbers of words."""
        got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        raw, owner = np.array(got.ids, "<u4").tobytes(), np.array(got.word_ids)
        cuts = [0, *(4 * (np.nonzero(owner[1:] != owner[:-1])[0] + 1)).tolist(), len(raw)]
        if len(cuts) != len(part) + 1:
            raise AssertionError("a word of letters was split")
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _bytes(self, part: list[str], spaced: bool) -> list[bytes]:
        """The same, with a space before each word or without, by the bytes that tokens stand for: the library's call without offsets is faster."""
        text = " " + " ".join(part) if spaced else "\n".join(part)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        size = np.fromiter((len(p.encode()) for p in part), np.int64, len(part)) + spaced
        ends = np.cumsum(size if spaced else size + 1) - (not spaced)
        reached = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        cuts = np.searchsorted(reached, (ends - size, ends))
        if (reached[cuts] != (ends - size, ends)).any():
            raise AssertionError("a word of letters was split")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in (4 * cuts.T).tolist()]

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self._one(text)
        return self.marks[text]

    def _known(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as _split gives them. Distinct pieces are found outside Python, and each is looked up in the cache once."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, pieces))
        missing = {p for p, i in zip(pieces, ids, strict=True) if i is None}
        if missing:
            self._learn(missing)
            ids = [self.cache[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
        pool, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.cumsum(n)
        raw = pool[np.repeat((np.cumsum(size) - size)[codes] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        cuts = [0, *(4 * ends[lists.offsets.to_numpy()[1:] - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            split = [self._split(t) for t in part]
            known = iter(self._known([p for p in split if p]))
            out += [self._one(t) if p is None else next(known) if p else b"" for t, p in zip(part, split, strict=True)]
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.batch([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, words: bool) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path, words)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
