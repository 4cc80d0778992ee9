"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merging.

Tier one looks a pre-token up in the vocabulary through a minimal perfect hash
(hash, displace and compare: one displacement for each bucket of keys, no slot
left empty), confirmed by comparing the bytes. Tier two merges the bytes of a
miss: a doubly linked list of symbols and a heap of candidate pairs by rank, then
place. A bounded table in front keeps the ids of pre-tokens met before.

Defined cases: a null text counts as empty and has no ids; rows are encoded one
by one, so repeated rows, null ids and other columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.common import text_of

#: Entries of each of a codec's two tables of pre-tokens met before, of about 200 bytes; beside each running task a worker holds both.
MEMO = 200_000
#: Tokens, or characters, from which on results leave the worker, so that it holds those of a few texts whatever a batch has.
SLICE = 1 << 18
GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def fingerprint(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


def spread(h: int, d: int, n: int) -> int:
    h = ((h ^ (d * GOLD)) * 0xFF51AFD7ED558CCD) & MASK
    return (h ^ (h >> 32)) % n


class PerfectHash:
    """A minimal perfect hash of byte strings to slots 0 .. n - 1."""

    def __init__(self, keys: list[bytes], load: int = 2) -> None:
        self.n = max(1, len(keys))
        self.buckets = max(1, len(keys) // load)
        self.shift = np.zeros(self.buckets, np.int64)
        members: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = fingerprint(k)
            members.setdefault(h % self.buckets, []).append((h, i))
        self.key_at = np.full(self.n, -1, np.int64)
        taken = bytearray(self.n)
        free = 0
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:  # the lone keys of their buckets come last and take what is free: the shift names the slot
                while taken[free]:
                    free += 1
                taken[free], self.key_at[free], self.shift[b] = 1, own[0][1], -1 - free
                continue
            d = 0
            while True:
                slots = [spread(h, d, self.n) for h, _ in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, own, strict=True):
                taken[s] = 1
                self.key_at[s] = i
        self.shift_list = self.shift.tolist()

    def slot(self, key: bytes) -> int:
        h = fingerprint(key)
        d = self.shift_list[h % self.buckets]
        return -1 - d if d < 0 else spread(h, d, self.n)


def ranges(name: str) -> str:
    """A Unicode category's code points below 0x10000 as ranges of a character class."""
    import regex

    has = regex.compile(rf"\p{{{name}}}").match
    out, start = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and not 0xD800 <= c < 0xE000 and bool(has(chr(c)))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def splitter(pattern: str):
    """findall of the pattern.

    For texts of code points below 0x10000, where the standard library's engine has a fast character set, categories
    are spelt out; other texts take the engine that knows categories.
    """
    import re

    import regex

    kinds = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "White_Space"}
    spelt = {k: ranges(v) for k, v in kinds.items() if k in pattern or k == r"\s"}
    out, inside, i = [], False, 0
    while i < len(pattern):
        step = next((k for k in (*kinds, r"\S") if pattern.startswith(k, i)), pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        if step in kinds:
            out.append(spelt[step] if inside else f"[{spelt[step]}]")
        elif step == r"\S":
            out.append(f"[^{spelt[chr(92) + 's']}]")
        elif step.startswith(r"\p") or step.startswith(r"\P"):
            raise ValueError(f"category in the pattern isn't known: {pattern[i : i + 8]}")
        else:
            inside = step == "[" or (inside and step != "]")
            out.append(step)
        i += len(step)
    fast = re.compile("".join(out)).findall
    full = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
    return lambda text: (fast if len(text.encode("utf-16-le")) == 2 * len(text) else full)(text)


class Codec:
    """Encodes and decodes by ranks; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_key = [keys[i] if i >= 0 else b"" for i in self.hash.key_at.tolist()]
        self.slot_id = [ranks[k] for k in self.slot_key]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: Two adjacent symbols and what they make together, which is also its rank.
        self.pair = {ranks[k[:i]] << 20 | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.ready()

    def ready(self) -> None:
        self.split = splitter(self.pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def token(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        found = self.older.get(piece)
        if found is None:
            slot = self.hash.slot(raw)
            found = (self.slot_id[slot],) if self.slot_key[slot] == raw else tuple(self.merge(raw))
        if len(self.memo) >= MEMO:  # what hasn't been met since the last turn goes
            self.memo, self.older = {}, self.memo
        if len(raw) <= 64:
            self.memo[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a string outside the vocabulary: lowest rank first, leftmost on a tie.

        Symbols are linked by the places where they start; ``now`` holds the rank of each symbol with the next, so
        that an entry of the heap that is out of date shows.
        """
        n, pair = len(raw), self.pair.get
        symbol = [self.byte_id[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [pair(symbol[i] << 20 | symbol[i + 1], -1) for i in range(n - 1)]
        now.append(-1)
        heap = [r << 40 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFFFF, x >> 40
            if now[i] != r:
                continue
            j = after[i]
            k = after[j]
            symbol[i], now[j], after[i] = r, -2, k
            if k < n:
                before[k] = i
                now[i] = t = pair(r << 20 | symbol[k], -1)
                if t >= 0:
                    push(heap, t << 40 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = t = pair(symbol[h] << 20 | r, -1)
                if t >= 0:
                    push(heap, t << 40 | h)
        return [symbol[i] for i in range(n) if now[i] != -2]

    def encode(self, text: str) -> array:
        token = self.token
        known = self.memo.get  # of the table as it is when the text begins; later pieces of it may be merged twice
        return array("I", chain.from_iterable([known(p) or token(p) for p in self.split(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary file's ranks; read on the driver, for executors may not have the file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(ranks_of(path), pattern)


def shared(df: DataFrame, path: str, pattern: str):
    """The codec as a broadcast: its size is that of the vocabulary, a few MB."""
    return df.sparkSession.sparkContext.broadcast(codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with __ids, the ids of each text (array<bigint>)."""

    held = shared(docs, path, pattern)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = held.value
        for texts in parts:
            yield pd.Series([np.frombuffer(c.encode(t), np.uint32).astype(np.int64) for t in texts])

    return docs.withColumn("__ids", ids(text_of(f"`{text}`")))


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "__ids") -> DataFrame:
    """``coded`` with __bytes, the bytes that the ids stand for."""

    held = shared(coded, path, pattern)

    @F.pandas_udf(T.BinaryType())
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = held.value
        for rows in parts:
            yield pd.Series([c.decode(r) for r in rows])

    return coded.withColumn("__bytes", back(F.col(ids)))


def told(c: Codec, parts: Iterator[pa.Array], with_ids: bool) -> Iterator[pa.Array]:
    """Structs of n_tokens, ids_sha256, decoded_sha256 and ids if asked for; texts are taken one by one and results sent by slices."""
    for texts in parts:
        counts, coded, decoded, every, size = [], [], [], array("I"), 0
        for i, t in enumerate(texts, 1):
            t = t.as_py()
            ids = c.encode(t)
            counts.append(len(ids))
            coded.append(hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            size += max(len(ids), len(t))
            if with_ids:
                every.extend(ids)
            if size >= SLICE or i == len(texts):
                columns = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if with_ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(every, np.uint32).astype(np.int32)))
                yield pa.StructArray.from_arrays(list(columns.values()), list(columns))
                counts, coded, decoded, every, size = [], [], [], array("I"), 0


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens and the digests of ids and decoded bytes, made in one pass so that ids needn't leave the worker."""
    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    held = shared(docs, path, pattern)

    @F.arrow_udf(out)
    def rows(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from told(held.value, parts, with_ids)

    keep = docs.columns if keep is None else keep
    return docs.select(*[f"`{c}`" for c in keep], rows(text_of(f"`{text}`")).alias("__t")).select(*[f"`{c}`" for c in keep], "__t.*")
