"""Sizes of texts in tokens of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from typing import Any

DEFAULT_VOCABULARY = os.environ.get("DOCRISK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = DEFAULT_VOCABULARY) -> Any:
    """A byte-level tokenizer of a rank file; strings of special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
