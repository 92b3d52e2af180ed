"""Byte-level BPE ids of whole texts, from the JSON file of a public tokenizer.

The ids are those that the file's own library gives (tests compare them on every
code point); the merges run through tiktoken's core, which takes a quarter of
its time. Long runs of white space never meet the splitting pattern, whose
backtracking they would exhaust: the pattern's own rule says where they split.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: The pattern by which byte-level BPE splits texts, and Unicode's white space (fixed values).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WHITE = re.compile(f"[{WHITE}]{{1000,}}")


def encodings(ranks: dict[bytes, int], pattern: str = PATTERN) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """Of texts, and of what is one piece as a whole."""
    return tuple(tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, r"[\s\S]+"))


def encode_ordinary(both: tuple[tiktoken.Encoding, tiktoken.Encoding], text: str) -> list[int]:
    """Ids of ``text``; a run of white space before a word is one piece but for its last character."""
    encoding, whole = both
    runs = list(LONG_WHITE.finditer(text))
    if not runs:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in runs:
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += whole.encode_ordinary(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    table |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return table


class Bpe:
    """Of a tokenizer file's content. Special strings in a text become their ids, as the file says."""

    def __init__(self, content: str):
        spec = json.loads(content)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        rank = [vocabulary[a + b] for a, b in merges]
        shape = spec.get("pre_tokenizer") or {}
        if rank != sorted(rank) or shape.get("type") != "ByteLevel" or shape.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file whose ids follow its merges is needed")
        character = _bytes_of_characters()
        ranks = {bytes(character[c] for c in k): v for k, v in vocabulary.items()}
        self.encodings = encodings(ranks)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, without any that the text doesn't hold."""
        if self.cut is None or not any(s in text for s in self.special):
            return np.array(encode_ordinary(self.encodings, text), np.uint32)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else encode_ordinary(self.encodings, part)
        return np.array(ids, np.uint32)


@lru_cache(maxsize=2)
def load(content: str) -> Bpe:
    """One a worker for each file content."""
    return Bpe(content)
