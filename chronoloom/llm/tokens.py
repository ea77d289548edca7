"""Encoding with a public word-level BPE file, with a memo of its pieces.

The file lower-cases, drops white space and cuts a text into pieces (contractions, runs of letters, single
digits, runs of other signs) that are encoded one by one, so ids of a text are the joined ids of its pieces.
Texts of ASCII and Latin-1 letters are cut here and each new piece is given to the library's model once;
any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Characters whose NFC form and lower case are single characters, and whose classes are plain.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the file's own cutting rule, for lower-case plain text.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
#: Pieces remembered by a worker; the memo is emptied beyond that.
MEMO = 700_000


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level BPE files: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in shown else next(rest) for b in range(256)}


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[piece] = self.encode(piece)
        return found


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model, letters, shared = self.whole.model, byte_letters(), list(range(self.whole.get_vocab_size()))
        model._resize_cache(0)  # the memo below is the cache

        def encode(piece: str) -> tuple[int, ...]:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
            return tuple([shared[t.id] for t in model.tokenize(shown)])  # equal ids are one object: a smaller memo

        self.memo = _Memo(encode)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(list(chain.from_iterable(map(self.memo.__getitem__, PIECE.findall(text.lower())))), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, so that its memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
