"""Token ids of whole texts as the tokenizer libraries give them, read from public vocabulary files."""

from __future__ import annotations

import json
import os
from functools import cache, cached_property
from itertools import chain

import numpy as np


def byte_table() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library.

    ``ids`` and ``plain_ids`` equal the library's (added tokens found in a text are one id,
    or ordinary text).  Where possible they come from ``tiktoken`` over the same merges,
    which is several times faster: not for texts with added tokens, nor for texts with a
    character that the two libraries take for different classes (tried once per character).
    """

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.path = path
        self.added = [t["content"] for t in described["added_tokens"]]
        vocabulary, table = described["model"]["vocab"], byte_table()
        own = {text: i for text, i in vocabulary.items() if text not in self.added}
        self.bytes = {i: bytes(table[c] for c in text) for text, i in own.items()}
        #: Whether ids always join to the bytes of the text.
        self.lossless = not described["normalizer"] and (described["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.fast = None
        self._same: dict[str, bool] = {}
        first = len(own) - len(described["model"]["merges"])
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in described["model"]["merges"]]
        in_order = all(own.get(m) == first + i for i, m in enumerate(merged))
        split = described["pre_tokenizer"] or {}
        if pattern and in_order and not described["normalizer"] and split.get("type") == "ByteLevel" and not split.get("add_prefix_space"):
            import tiktoken

            ranks = {b: i for i, b in self.bytes.items()}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def _agree(self, text: str) -> bool:
        if self.fast is None:
            return False
        if text.isascii():
            return True
        known = self._same
        for c in set(text):
            if c not in known:
                known[c] = all(
                    self.plain.encode(s, add_special_tokens=False).ids == self.fast.encode_ordinary(s)
                    for s in (f"a{c}!", f" {c}1", f"{c}{c} a")
                )
            if not known[c]:
                return False
        return True

    def plain_ids(self, text: str) -> list[int]:
        """Ids without special tokens; their strings in the text are plain text."""
        return self.fast.encode_ordinary(text) if self._agree(text) else self.plain.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """Ids as the library's default gives them, without added begin and end."""
        if any(t in text for t in self.added) or not self._agree(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A ``sentencepiece`` model.

    Where no piece goes on behind a blank, nothing is ever joined across one: the ids of a
    text are those of its words one by one.  Words are encoded once and remembered, up to
    ``REMEMBERED``; texts with blanks in a row or at an end (or the sign for one) are encoded whole.
    """

    REMEMBERED, LONGEST = 300_000, 40

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [
            bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode()
            for i, t in enumerate(names)
        ]
        prefixed = [self.model.id_to_piece(i) for i in self.model.encode("a b")] == ["▁a", "▁b"]
        self.apart = prefixed and not any("▁" in t.lstrip("▁") for t in names)
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        #: The ids of remembered words as 32-bit numbers.
        self._known: dict[str, bytes] = {}
        #: Remembered words whose pieces do not join to their bytes.
        self._lossy: set[str] = set()

    def joins(self, text: str, ids: list[int]) -> bool:
        """Whether the pieces join to the bytes of blank and *text*."""
        return b"".join(map(self.bytes.__getitem__, ids)) == (" " + text).encode()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids, _ in self.checked(texts)]

    def checked(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """The ids of each text, and whether they join to its bytes."""
        parts = [
            None if not self.apart or "  " in t or "▁" in t or t[:1] == " " or t[-1:] == " " else t.split(" ") for t in texts
        ]
        words = set().union(*filter(None, parts))
        new = list(words.difference(self._known))
        if len(self._known) + len(new) > self.REMEMBERED:
            self._known.clear()
            self._lossy.clear()
            new = list(words)
        self._remember(new)
        get = self._known.__getitem__
        out = []
        for t, split in zip(texts, parts):
            if split and (not self._lossy or self._lossy.isdisjoint(split)):
                out.append((np.frombuffer(b"".join(map(get, split)), np.int32), True))
            else:
                ids = self.whole([t])[0]
                out.append((np.array(ids, np.int32), self.joins(t, ids)))
        for w in new:
            if len(w) > self.LONGEST:
                del self._known[w]
                self._lossy.discard(w)
        return out

    def _remember(self, words: list[str]) -> None:
        found = self.whole(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        held, stops = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        self._known.update(zip(words, [held[a:b] for a, b in zip([0, *stops], stops)]))
        # All at once: equal bytes in a row, of equal lengths word by word.
        raw = [f" {w}".encode() for w in words]
        lengths = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(counts)]
        equal = np.array_equal(lengths, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
        if not equal or b"".join(map(self.bytes.__getitem__, ids.tolist())) != b"".join(raw):
            self._lossy.update(w for w, x in zip(words, found) if not self.joins(w, x))


@cache
def byte_level(path: str, pattern: str | None = None) -> ByteLevel:
    """One per worker process, with what it remembers."""
    return ByteLevel(path, pattern)


def crc_of(ids: list[int]) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    import zlib

    return zlib.crc32(np.array(ids, "<u4").tobytes())
