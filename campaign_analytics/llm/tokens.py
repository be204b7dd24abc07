"""Tokenizer files on executors, and texts cut where the cut cannot change a token."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def tokenizer_json(path: str) -> str:
    """The file's content, read on the driver; a vocabulary file has a few MB whatever the input."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=4)
def load(content: str):
    """The tokenizer, built once per Python worker; Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


# A piece may start at a single space between two characters that are no white space.  Byte-level
# patterns take such a space with what follows it, word patterns drop it, special strings hold
# no space, and normalisation does not reach over it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that start at safe spaces.

    A text without such a space stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def rank_table(content: str):
    """The same vocabulary as a table of ranks, where it is one; else None.

    A byte-level BPE file whose merges make ids in their own order says what a rank table
    says: the pair of the least id is merged first.  Encoding by ranks gives the same ids
    several times faster.
    """
    import public_tokenizers
    import tiktoken

    file = json.loads(content)
    model, splitter = file["model"], file.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if file.get("normalizer") or any(splitter.get(k) != v for k, v in plain.items()) or model.get("type", "BPE") != "BPE":
        return None
    vocab, alphabet = model["vocab"], _byte_alphabet()
    added = {t["content"] for t in file.get("added_tokens", [])}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    first = len(vocab) - len(merged)
    if [vocab.get(m) for m in merged] != list(range(first, len(vocab))):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as the tokenizers library gives them.

    Texts go through the rank table if there is one and both libraries surely agree: Latin-1
    text without the string of an added token, and without a run of white space or of other
    characters so long that merging it pair by pair takes its time.  All others go through
    the library itself.
    """

    LONGEST_RUN = 400

    def __init__(self, content: str):
        self.tokenizer, self.ranks = load(content), rank_table(content)
        self.added = [t["content"] for t in json.loads(content).get("added_tokens", [])]

    def _is_plain(self, text: str) -> bool:
        if self.ranks is None or any(a in text for a in self.added):
            return False
        try:
            data = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return False
        space = data <= 32
        edges = np.flatnonzero(space[1:] != space[:-1])
        return int(np.diff(edges, prepend=-1, append=len(data)).max()) <= self.LONGEST_RUN

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self._is_plain(t) for t in texts]
        others = iter(
            self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        )
        for text, is_plain in zip(texts, plain):
            ids = self.ranks.encode_ordinary(text) if is_plain else next(others).ids
            yield np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    """One encoder per Python worker and file, kept between tasks."""
    return Encoder(content)


# What a plain normaliser does, in order: compose, make each white space run a space, lower-case.
_PLAIN_NORMALIZER = ["NFC", "Replace", "Lowercase"]


class TokenCounter:
    """Numbers of tokens of texts, as the tokenizers library gives them.

    Normalising takes the library a third of its time.  For a plain normaliser before a
    splitter that drops white space, Latin-1 text is lower-cased here and goes to the same
    tokenizer without the normaliser: such text is composed already, its letters are
    lower-cased one by one, and its white space is dropped whatever it is.  Texts in which
    the string of an added token may stand, and all others, go through the library whole.
    """

    def __init__(self, content: str):
        self.tokenizer, self.bare = load(content), None
        file = json.loads(content)
        self.added = [t["content"].lower() for t in file.get("added_tokens", [])]
        steps = (file.get("normalizer") or {}).get("normalizers", [])
        splitter = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = splitter.get("pattern", {}).get("Regex", " ")
        drops = splitter.get("behavior") == "Removed" and splitter.get("invert") and " " not in pattern
        spaces = [s for s in steps if s["type"] == "Replace"] == [
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        ]
        if [s["type"] for s in steps] == _PLAIN_NORMALIZER and spaces and drops:
            self.bare = load(json.dumps(file | {"normalizer": None}))

    def _lowered(self, text: str) -> str | None:
        """The text lower-cased, if that is all there is to normalise."""
        if self.bare is None:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.lower()
        return None if any(a in low for a in self.added) else low

    def count(self, texts: list[str]) -> list[int]:
        lowered = [self._lowered(t) for t in texts]
        plain = [t for t in lowered if t is not None]
        others = [t for t, low in zip(texts, lowered) if low is None]
        bare = iter(self.bare.encode_batch_fast(plain, add_special_tokens=False) if plain else [])
        whole = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else [])
        return [len(next(whole if low is None else bare)) for low in lowered]


@lru_cache(maxsize=2)
def counter(content: str) -> TokenCounter:
    """One counter per Python worker and file, kept between tasks."""
    return TokenCounter(content)
