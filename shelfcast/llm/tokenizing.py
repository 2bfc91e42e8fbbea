"""Token ids of the public byte-level BPE.

The ids are those of the library ``tokenizers`` with its vocabulary file. The library ``tiktoken`` reads the
same vocabulary as ranks and cuts texts by the same pattern, several times as fast, and encodes the
texts whose letters are Latin; texts with a character beyond ``LATIN`` go to ``tokenizers`` itself, since the two
bring Unicode tables of their own. Tests hold the ids of the two against each other.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: The last character of the Latin blocks (basic, Latin-1, extended A and B).
LATIN = "ɏ"
ID = np.dtype("<u4")

_encoders: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids of texts as arrays of ``<u4``; the vocabulary files are given by their paths."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, ID)
        if text.isascii() or max(text) <= LATIN:
            return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32).astype(ID, copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID)


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The worker's encoder of two vocabulary files, by default the public one of 50,257 ids."""
    key = (vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
