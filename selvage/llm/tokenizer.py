"""Public byte-level BPE, loaded once a Python worker from a vocabulary file given by path."""

from __future__ import annotations

import base64
import functools

#: Where the box keeps its vocabularies; a parameter of every operator.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of that vocabulary (fixed value, published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """Encoder without special tokens: any text, control strings included, is ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("selvage", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
