"""Ids of whole texts by the tokenizers library, with a memo for each word.

A byte-level BPE with the usual splitting pattern never merges across the border before a single space or around
a single line end, so the ids of a text are those of its words in order. Each distinct word is encoded once by the
library; texts with any other white space, special token strings or scripts outside Latin go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

#: Most words that a worker remembers, about 110 MB; those that come once it is full are encoded anew each time.
MEMO_WORDS = 600_000
#: Strings that make a border between words depend on its surroundings.
_ODD = ("  ", "\n\n", " \n", "\n ", "<|")


def _plain(text: str) -> bool:
    """Only single spaces and single line ends between words, and nothing unprintable."""
    return text[0] not in " \n" and text[-1] not in " \n" and text.replace("\n", " ").isprintable() and not any(x in text for x in _ODD)


class _Memo(dict):
    def __init__(self, tokenizer, dtype):
        super().__init__()
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        # Printable Latin-1 stands for itself and the other bytes follow from 256 on: the byte-level alphabet.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        body = word[1:] if word[:1] == " " else word
        if body.isalpha() and (body.isascii() or max(body) < "ɏ"):
            spelt = word.replace(" ", "Ġ") if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            value = np.array([t.id for t in self.model.tokenize(spelt)], self.dtype).tobytes()
        elif body[-1:] in (".", ",", "!", "?") and body[:-1].isalpha():
            value = self[word[:-1]] + self[word[-1]]
            if len(self) >= MEMO_WORDS // 2:
                return value
        else:
            value = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


class Encoder:
    """``encode(text)``: the ids of a text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max:
            raise ValueError(f"{path}: ids do not fit {dtype}")
        pre = self.tokenizer.pre_tokenizer
        self.byte_level = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self.memo = _Memo(self.tokenizer, self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.byte_level or not _plain(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder for each worker process."""
    key = (path, dtype)
    if key not in _encoders:
        _encoders[key] = Encoder(path, dtype)
    return _encoders[key]
