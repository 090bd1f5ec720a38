"""Byte-level BPE by a public vocabulary. Used inside tasks."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: how the vocabulary's own pre-tokenizer cuts a text (fixed value, part of its format)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: white space as the pattern has it (fixed values: the Unicode property)
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: runs from this length on are cut out before the pattern, which keeps a state per character of them
LONG_RUN = 20_000
_LONG = re.compile(_SPACE + "{%d,}" % LONG_RUN)

#: the vocabulary's special token (fixed value, part of its format); its id follows the ranks
SPECIAL = "<|endoftext|>"


def default_path() -> str:
    """The vocabulary as ranks; the ids equal those of the same vocabulary's tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _load(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = max(ranks.values()) + 1
    sizes = np.zeros(special + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    sizes[special] = len(SPECIAL)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special}), sizes


def _ordinary(by, text: str) -> list[int]:
    """The ids of a text without special tokens, however long its runs of white space.

    The pattern takes all of a run at the end of a text as one part, and all but
    the last character of a run before a word; so a long run is cut out as that
    part, and what follows is encoded by itself.
    """
    ids, at = [], 0
    for run in _LONG.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        ids += by.encode_ordinary(text[at : run.start()])
        ids += by._encode_single_piece(text[run.start() : last])
        at = last
    return ids + by.encode_ordinary(text[at:] if at else text)


def encode(text: str, path: str, special: bool = False) -> np.ndarray:
    """The ids of a whole text.

    With ``special``, the special token's string is that token, as the
    vocabulary's tokenizer file has it; without, it is ordinary text.
    """
    by = _load(path)[0]
    parts = text.split(SPECIAL) if special else [text]
    ids = _ordinary(by, parts[0])
    for part in parts[1:]:
        ids.append(by.eot_token)
        ids += _ordinary(by, part)
    return np.array(ids, dtype=np.uint32)


def byte_sizes(path: str) -> np.ndarray:
    """Bytes of the token of each id."""
    return _load(path)[1]
