"""Token ids by the tokenizers library, with distinct slices encoded once.

A byte-level vocabulary cuts text before it merges, and no merge crosses a cut. So the library is
given the distinct slices only; the ids of a text are those of its slices, in order.

`encoder` takes strings of special tokens as ordinary text. `document_encoder` gives the library's own
result: it cuts a text at the tokenizer's added tokens first, and encodes what is between by slices.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

from fieldtally.llm.bpe import SliceEncoder
from fieldtally.llm.pretokenise import class_table


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def size(path: str) -> int:
    """Ids are below this number."""
    return _tokenizer(path).get_vocab_size()


@cache
def _classes() -> np.ndarray:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def matching(name: str, text: str) -> str:
        others = Split(Regex(rf"[^\p{{{name}}}]+"), "removed")
        parts = (text[i : i + 4096] for i in range(0, len(text), 4096))
        return "".join(piece for part in parts for piece, _ in others.pre_tokenize_str(part))

    return class_table(matching)


@cache
def encoder(path: str) -> SliceEncoder:
    """One per worker and file."""
    tokenizer = _tokenizer(path)

    def encode(words: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    return SliceEncoder(_classes(), encode)


@cache
def document_encoder(path: str) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """(ids of all texts, ids per text), as by Tokenizer.encode(text, add_special_tokens=False)."""
    from tokenizers import Tokenizer

    between = encoder(path)
    library = Tokenizer.from_file(path)
    added = {t.content: (i, t) for i, t in library.get_added_tokens_decoder().items()}
    if not added:
        return lambda texts: between(texts)[:2]
    longest_first = sorted(added, key=len, reverse=True)
    places = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
    plain = library.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())

    def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts, owners, ids, after = [], [], [], []
        for i, text in enumerate(texts):
            pieces = places.split(text or "")
            parts += pieces[::2]
            owners += [i] * len(pieces[::2])
            ids += [added[p][0] for p in pieces[1::2]]
            after += range(len(parts) - len(pieces[::2]), len(parts) - 1)
        if not ids:
            return between(texts)[:2]
        found, n = between(parts)[:2]
        counts = np.bincount(owners, weights=n, minlength=len(texts)).astype(np.int64)
        counts += np.bincount(np.array(owners)[after], minlength=len(texts))
        return np.insert(found, np.cumsum(n)[after], ids), counts

    def whole(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids = [np.array(f, dtype="<u4") for f in found]
        return np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.array([len(f) for f in found], dtype=np.int64)

    return cut if plain else whole


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each text and the end of all) with end_id after each text."""
    stops = np.cumsum(counts)
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    bounds[1:] = stops + np.arange(1, len(counts) + 1)
    return np.insert(ids, stops, end_id), bounds
