"""Token ids of public vocabularies, the same as their tokenizers give."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Characters for which the two libraries' character classes are tested to agree; other texts take the slower one.
_PLAIN = re.compile("[^\x00-ɏ‐-…]")
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with a byte-level BPE vocabulary file of the tokenizers library.

    Where the file of ranks of the same vocabulary lies beside it, plain texts go through tiktoken, which is about four
    times as fast and gives the same ids.  Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        import public_tokenizers

        path = path if os.path.isabs(path) else public_tokenizers.path(path)
        self.path, self.slow, self.fast = path, None, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def tokenizer(self):
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text (uint32); null counts as empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and (text.isascii() or not _PLAIN.search(text)):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except BaseException as e:  # its panics, on some very long runs of one character, are BaseExceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def forget() -> None:
    """Drops all loaded encoders."""
    _loaded.clear()


def piece_starts(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: pieces of ``capacity``, of which the first may be shorter."""
    first = length % capacity
    return ([0] if first else []) + list(range(first, length, capacity))
