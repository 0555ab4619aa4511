"""Token ids of a public byte-level vocabulary, inside Python workers.

The ids are those of the `tokenizers` file; they are made by the faster `tiktoken` from the same vocabulary as ranks.
Texts that hold a special token's string, which `tokenizers` maps to its own id, take the slower library.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

SPECIAL = "<|endoftext|>"
LONG = 1 << 18

#: A blank between two non-blanks starts a new pre-token, whatever stands before or after it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _libraries(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, functools.lru_cache(maxsize=1)(lambda: Tokenizer.from_file(json_path))


def pieces_of(text: str, size: int = LONG) -> list[str]:
    """The text cut at safe blanks into pieces of at least `size` characters; their ids add up to the text's."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(text: str, paths: tuple[str, str]) -> np.ndarray:
    """Ids of a whole text without special tokens added, as unsigned 32-bit numbers."""
    fast, slow = _libraries(*paths)
    if SPECIAL in text:
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array([i for part in pieces_of(text) for i in fast.encode_ordinary(part)], np.uint32)


def count(text: str, paths: tuple[str, str]) -> int:
    """Number of ids of a text of ordinary characters."""
    return len(_libraries(*paths)[0].encode_ordinary(text))
