"""The byte-level BPE vocabulary as an encoder, and its tokens as bytes."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

# Split pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, mapped back to the byte.

    Bytes that print stand for themselves; the others follow, in order, from code point 256.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """Encoder and decoder of one byte-level vocabulary file.

    ``encode`` gives the ids of a text on its own, special strings included as their ids; ``tokens[i]`` are the bytes
    of id i.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in text): i for text, i in spec["model"]["vocab"].items() if text not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        for text, i in special.items():
            self.tokens[i] = text.encode()
        self.decimals = [b"%d" % i for i in range(len(self.tokens))]

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special="all")
        except ValueError:  # a run of white space too long for the encoder's backtracking
            return self.plain().encode(text, add_special_tokens=False).ids

    def encode_array(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.encode(text), dtype=np.uint32)

    def plain(self):
        """The slower library of the vocabulary file, for texts that the fast encoder refuses."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def decode(self, ids) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> ByteVocabulary:
    """One vocabulary per Python worker."""
    return ByteVocabulary(path)
