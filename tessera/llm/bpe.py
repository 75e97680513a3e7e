"""Byte-level BPE ids of whole texts, by a public vocabulary that is read where the tasks run.

The merges come from the rank file of the same vocabulary, whose encoder takes a
quarter of the time; the ids equal those of the ``tokenizers`` file. The string of a
special token in a text is ordinary text, or with ``special`` that token, as an
unchanged tokenizer takes it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache, partial

#: The file of merge ranks that holds the vocabulary of each tokenizer file.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
#: The tokens a tokenizer file adds to its vocabulary.
ADDED = {"byte_bpe_50k.json": {"<|endoftext|>": 50256}}


@lru_cache(maxsize=4)
def encoder(vocabulary: str = "byte_bpe_50k.json", special: bool = False) -> Callable[[str], list[int]]:
    """The function from a whole text to its ids; a Python worker builds it once."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS[vocabulary]), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED[vocabulary] if special else {})
    return partial(encoding.encode, allowed_special="all") if special else encoding.encode_ordinary
