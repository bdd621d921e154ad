"""Byte-level BPE: encoding by ranks, and decoding.

Text is cut by `pretokenise` (class arrays and transition-function scans, no regular expression);
each distinct slice is merged once and kept in a bounded cache per Python worker; the offset at
which each slice starts is kept beside the ids, so that spans of a text can be decoded alone.

Defined cases: a null text counts as empty and has no ids; repeated rows give repeated rows; an
empty table gives an empty result; an output column replaces an input column of the same name.
Texts are taken whole whatever their length: memory in a task follows the longest single text.
"""

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.pretokenise import boundaries, class_table
from fieldtally.llm.shared import chunks, code_points, lists, mixed, ship, with_text

#: Distinct slices whose ids a worker remembers; beyond, those not used for longest are forgotten.
CACHE = 1 << 20
#: Longer slices (in code points) are not remembered, so that the cache has a bound in bytes.
LONGEST = 64

#: Words of more bytes are merged with a heap.
SHORT = 64
NONE = 1 << 40  # rank of neighbours that never merge

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:], down[1:] = _BASE, _INVERSE
    return np.cumprod(up), np.cumprod(down)


@cache
def _values() -> tuple[np.ndarray, np.ndarray]:
    every = np.arange(1, 0x110001, dtype=np.uint64)
    return mixed(every), mixed(every + np.uint64(1 << 40))


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (sizes[0] of them), first[1], .."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(total)


class SliceCache:
    """Ids by hash of a slice, in arrays: sorted keys, a second hash as check, places of the ids."""

    def __init__(self):
        self.tick = 0
        self._set(*(np.zeros(0, dtype=t) for t in ("u8", "u8", "i8", "i8", "i8", "u4")))

    def _set(self, keys, checks, first, sizes, used, ids):
        self.keys, self.checks, self.first = keys, checks, first
        self.sizes, self.used, self.ids = sizes, used, ids

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of the slices, -1 for those not remembered."""
        self.tick += 1
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.checks[at] == checks)
        self.used[at[hit]] = self.tick
        return np.where(hit, at, -1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key is taken, be it by another slice."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys, checks, sizes, ids) -> None:
        """keys: distinct, ascending, none of them remembered."""
        if len(self.keys) + len(keys) > CACHE:
            keep = np.sort(np.argsort(self.used, kind="stable")[-(CACHE // 2) :])
            kept = self.sizes[keep]
            ids_kept = self.ids[_ragged(self.first[keep], kept)]
            self._set(
                self.keys[keep], self.checks[keep], np.cumsum(kept) - kept, kept,
                self.used[keep], ids_kept,
            )
        at = np.searchsorted(self.keys, keys)
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self._set(
            np.insert(self.keys, at, keys), np.insert(self.checks, at, checks),
            np.insert(self.first, at, first), np.insert(self.sizes, at, sizes),
            np.insert(self.used, at, self.tick), np.concatenate([self.ids, ids]),
        )


class SliceEncoder:
    """Texts to ids: cut, find the distinct slices, and hand those not remembered to `encode`."""

    def __init__(self, classes: np.ndarray, encode: Callable[[list[str]], list[bytes]]):
        self.classes, self.encode, self.known = classes, encode, SliceCache()

    def _distinct(self, points, starts, sizes):
        """(hash, place of one slice of each, which of them each slice is), slices compared whole."""
        value, _ = _values()
        up, down = _powers(1 << max(10, int(len(points) + 1).bit_length()))
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(value[points] * up[: len(points)], out=total[1:])
        hashes = (total[starts + sizes] - total[starts]) * down[starts]
        keys, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = sizes == sizes[place][which]
        if same.all():
            same = points[_ragged(starts, sizes)] == points[_ragged(starts[place][which], sizes)]
        if not same.all():  # two slices with one hash: number them by their own text
            texts = [points[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
            order = {t: i for i, t in reversed(list(enumerate(texts)))}
            place = np.array(sorted(order.values()))
            number = {texts[i]: k for k, i in enumerate(place.tolist())}
            which = np.array([number[t] for t in texts])
            keys = None
        return keys, place, which

    def __call__(self, texts: list[str | None]):
        """(ids of all texts, ids per text, first id of each slice, slices per text)."""
        joined = "".join([(t or "") + "\0" for t in texts])
        points = code_points(joined)
        ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        starts = boundaries(points, ends, self.classes)
        sizes = np.diff(starts, append=len(points))
        text_of = np.searchsorted(ends, starts)
        own = starts != ends[text_of]  # the others are the ends themselves
        starts, sizes, text_of = starts[own], sizes[own], text_of[own]
        if not len(starts):
            none = np.zeros(len(texts), dtype=np.int64)
            return np.zeros(0, dtype="<u4"), none, none[:0], none
        keys, place, which = self._distinct(points, starts, sizes)
        ids, first, n = self._ids(joined, points, keys, starts[place], sizes[place])
        first, n = first[which], n[which]
        flat = ids[_ragged(first, n)]
        n_slices = np.bincount(text_of, minlength=len(texts))
        n_ids = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        before = np.cumsum(n) - n
        return flat, n_ids, before - (np.cumsum(n_ids) - n_ids)[text_of], n_slices

    def _ids(self, joined, points, keys, starts, sizes):
        """(ids, first id, number of ids) of distinct slices."""
        if keys is None:
            found, lengths = self._encoded(joined, starts, sizes)
            return found, np.cumsum(lengths) - lengths, lengths
        _, value = _values()
        flat = _ragged(starts, sizes)
        up, _ = _powers(1 << max(10, int(sizes.max() + 1).bit_length()))
        place = flat - np.repeat(starts, sizes)
        heads = np.cumsum(sizes) - sizes
        checks = np.add.reduceat(value[points[flat]] * up[place], heads)
        checks ^= sizes.astype(np.uint64)
        at = self.known.find(keys, checks)
        new = np.flatnonzero(at < 0)
        found, lengths = self._encoded(joined, starts[new], sizes[new])
        first, n = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        old = at >= 0
        first[old], n[old] = self.known.first[at[old]], self.known.sizes[at[old]]
        ids = np.concatenate([self.known.ids, found])
        own_first = np.cumsum(lengths) - lengths
        first[new], n[new] = own_first + len(self.known.ids), lengths
        short = sizes[new] <= LONGEST
        short &= ~self.known.holds(keys[new])
        if short.any():
            self.known.add(
                keys[new][short], checks[new][short], lengths[short],
                found[_ragged(own_first[short], lengths[short])],
            )
        return ids, first, n

    def _encoded(self, joined: str, starts: np.ndarray, sizes: np.ndarray):
        parts = self.encode(
            [joined[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        )
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        return np.frombuffer(b"".join(parts), dtype="<u4"), lengths


class Ranks:
    """Merges by rank: of all neighbours whose union has a rank, the lowest first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs

    def encode(self, words: list[str]) -> list[bytes]:
        done = []
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                done.append(rank.to_bytes(4, "little"))
            elif len(raw) <= SHORT:
                done.append(self._short(raw))
            else:
                done.append(self._long(raw))
        return done

    def _short(self, word: bytes) -> bytes:
        """A list of ids and one of the ranks of neighbours, both shrinking."""
        pairs, single = self.pairs.get, self.single
        ids = [single[b] for b in word]
        ranks = [pairs(a << 20 | b, NONE) for a, b in pairwise(ids)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs(ids[i - 1] << 20 | best, NONE)
            if i < len(ranks):
                ranks[i] = pairs(best << 20 | ids[i + 1], NONE)
        return array("I", ids).tobytes()

    def _long(self, word: bytes) -> bytes:
        """A long word: neighbours in a heap by (rank, place), so time is n log n."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                rank = self.pairs.get(ids[i] << 20 | ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return array("I", [x for x in ids if x >= 0]).tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


@cache
def _tiktoken_classes() -> np.ndarray:
    import tiktoken

    single = {bytes([i]): i for i in range(256)}

    def matching(name: str, text: str) -> str:
        finder = tiktoken.Encoding(
            f"only-{name}", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={}
        )
        return bytes(finder.encode_ordinary(text)).decode()

    return class_table(matching)


@cache
def rank_encoder(path: str) -> SliceEncoder:
    """One per worker and file."""
    return SliceEncoder(_tiktoken_classes(), Ranks(read_ranks(path)).encode)


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(
    docs: DataFrame,
    ranks_path: str,
    text: str = "text",
    keep: list[str] | None = None,
    ids: str = "ids",
    offsets: str = "id_offsets",
    decoded: str | None = None,
) -> DataFrame:
    """The columns in `keep` (all, if not given) with two or three more.

    ids (array of int): the text's token ids. offsets (array of int): the place in `ids` at which
    each slice of the pre-tokenisation starts. decoded (binary), if it is named: the bytes that the
    ids stand for, decoded in the same pass, so that a round trip takes one Python worker per task.
    No shuffle; each task reads its rows once.
    """
    ship(docs.sparkSession)
    made = [ids, offsets, *([decoded] if decoded else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    frame, fields = with_text(docs, text, kept)
    schema = T.StructType(
        [
            *fields,
            T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
            T.StructField(offsets, T.ArrayType(T.IntegerType(), False)),
            *([T.StructField(decoded, T.BinaryType())] if decoded else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = rank_encoder(ranks_path), _token_bytes(ranks_path)
        for batch in batches:
            for a, b, texts in chunks(batch.column(0)):
                found, n_ids, firsts, n_slices = encoder(texts)
                columns = [batch.column(i + 1).slice(a, b - a) for i in range(len(kept))]
                columns.append(lists(found.astype(np.int32), n_ids, pa.int32()))
                columns.append(lists(firsts.astype(np.int32), n_slices, pa.int32()))
                if decoded:
                    bounds = np.append(0, np.cumsum(n_ids))
                    back = [_join(found[i:j], *table) for i, j in pairwise(bounds.tolist())]
                    columns.append(pa.array(back, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def decoder(ranks_path: str) -> Callable[[Column], Column]:
    """A column function: array of ids to the bytes they stand for (null for null)."""

    @F.pandas_udf(T.BinaryType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blob, starts, sizes = _token_bytes(ranks_path)
        for series in batches:
            yield pd.Series(
                [None if x is None else _join(x, blob, starts, sizes) for x in series],
                index=series.index,
                dtype=object,
            )

    return decoded


def _join(ids, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    ids = np.asarray(ids, dtype=np.int64)
    n = sizes[ids]
    first = np.cumsum(n) - n
    return blob[np.repeat(starts[ids] - first, n) + np.arange(int(n.sum()))].tobytes()
