"""Token ids of byte-level BPE vocabularies.

``Encoder`` gives exactly the ids of the tokenizers library for its .json file.  Common scripts
go through tiktoken built from the same vocabulary (three times as fast, and its memory is
a few bytes a token); texts with special-token strings, very long white space or characters whose class may differ
between the libraries' Unicode tables go through the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

#: Characters whose letter, number and white-space classes are the same in both libraries' Unicode tables.
_COMMON = re.compile("[^\x00-ȟΑ-ΡΣ-ώЀ-ѿ‐-‧₠-€ぁ-んァ-ヶ一-龥가-힣]")
#: White space at which the fast path's pattern runs out of its backtracking stack, by a wide margin.
_LONG_SPACE = re.compile(r"\s{20000}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character; this is the inverse."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One process's encoder for a byte-level BPE .json vocabulary without added begin or end tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        special_ids = {t["id"] for t in spec["added_tokens"]}
        of = byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special_ids}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(spec["model"]["vocab"].values()) < 1 << 16 else np.dtype("<u4")

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; null is empty."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if not _COMMON.search(text) and not any(s in text for s in self.special) and not (len(text) >= 20_000 and _LONG_SPACE.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def library(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library


class PlainEncoder(Encoder):
    """The same for texts in which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = []

    def library(self):
        super().library().encode_special_tokens = True
        return self._library

    def vocabulary(self) -> dict[str, int]:
        return self.library().get_vocab(with_added_tokens=False)


_encoders: dict[str, Encoder] = {}
_plain: dict[str, PlainEncoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process; workers are reused from task to task, so each builds it once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plain_encoder(path: str) -> PlainEncoder:
    if path not in _plain:
        _plain[path] = PlainEncoder(path)
    return _plain[path]
