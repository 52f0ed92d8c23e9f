"""Public tokenizers inside a task: ids of whole texts and the bytes of every token.

Files are named by a path and never trained or changed. A byte-level file is
read as ranks (its ids are the order of its merges), which is exact and about
three times as fast as its own library; the library takes over for texts whose
white space is too long for the pattern.
"""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np


def byte_level_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The visible character that a byte-level file writes for each byte: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenBytes:
    """The bytes of tokens, all in one array."""

    def __init__(self, entries: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.first[ids], self.sizes[ids])


def gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[first:first + sizes]`` one after the other."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(first - (ends - sizes), sizes)
    return flat[at]


class ByteLevel:
    """A byte-level tokenizer file of the tokenizers library; special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        entries = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            entries[i] = token
        self.entries = entries

    @cached_property
    def bytes(self) -> TokenBytes:
        return TokenBytes(self.entries)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # millions of blanks in one run are beyond the pattern's stack
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A piece tokenizer file of the sentencepiece library; it puts a blank before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    @cached_property
    def bytes(self) -> TokenBytes:
        model = self.model
        return TokenBytes([bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
                           else model.id_to_piece(i).replace("▁", " ").encode()
                           for i in range(model.get_piece_size())])

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)
