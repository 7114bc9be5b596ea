"""Fixed public vocabularies, read on the driver and sent to the workers inside the functions that use them."""

from __future__ import annotations

import base64
from functools import lru_cache


@lru_cache(maxsize=8)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a `.tiktoken` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def multi_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def english_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
