"""Byte-level BPE: where a text may be cut, and the ids of whole texts.

Where a character that is not white space is followed by ASCII white space, the
pre-tokeniser of a byte-level BPE always ends a token: its letter, number and symbol
runs hold no white space except one leading blank, and nothing it matches looks back.
A text may be cut there: the ids of the cuts joined are the ids of the text, whatever
stands around. ``stable_cut`` is that proof as a mask over bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .textkernel import byte_view, parts

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PRINTED = np.zeros(256, dtype=bool)
_PRINTED[0x21:0x7F] = True

#: A run without a stable cut that is longer goes to the ``tokenizers`` library,
#: whose merging doesn't grow with the square of the run.
LONG_RUN = 1000


def stable_cut(buf: np.ndarray) -> np.ndarray:
    """True at byte p where a token boundary is certain: ASCII white space after a character
    that is surely not white space (printable ASCII, or a two-byte letter that begins with 0xC3)."""
    cut = np.zeros(len(buf), dtype=bool)
    if len(buf) > 1:
        solid = _PRINTED[buf]
        solid[1:] |= (buf[1:] >= 0x80) & (buf[:-1] == 0xC3)
        cut[1:] = _WHITE[buf[1:]] & solid[:-1]
    return cut


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: itself where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IdEncoder:
    """Ids of texts under a byte-level BPE file of the ``tokenizers`` library.

    The vocabulary and special tokens come from that file. Its ids rise in merge order,
    so ``tiktoken``, handed the same vocabulary as ranks, gives the same ids several
    times faster; tests hold it to the library. Texts with a run of over ``LONG_RUN``
    bytes without a stable cut go to the library itself.
    """

    _shared: dict[str, IdEncoder] = {}

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def library(self):
        """Loaded where a long run needs it; workers keep what they load."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def shared(cls, path: str) -> IdEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, special strings as the library takes them by default; null is empty."""
        for _, some in parts(col):
            buf, bounds = byte_view(some)
            at = np.flatnonzero(stable_cut(buf))
            edges = np.union1d(at, bounds)
            longest = np.zeros(len(some), dtype=np.int64)
            if len(edges) > 1:
                np.maximum.at(longest, np.searchsorted(bounds, edges[:-1], side="right") - 1, np.diff(edges))
            for text, run in zip(some.to_pylist(), longest.tolist()):
                if not text:
                    yield np.zeros(0, np.uint32)
                elif run > LONG_RUN:
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
