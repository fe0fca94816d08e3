"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last one of the prefix's encoding. `PrefixBpe`
stores that token for each prefix: the candidates are the vocabulary's suffixes of the prefix, and one is
valid if it stands unmerged next to the last token of what comes before it. An encoding is read off
backwards. Appending bytes only adds prefixes, and after an edit the stored prefixes before it stay valid
and encoding stops early once it meets the old state again behind the edit.

Nulls are encoded as empty texts, with no tokens. Extra columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folia.llm.arrow import map_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Exact encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._ends: dict = {}  # trie of the reversed tokens; a token's rank stands at -1
        for t, r in ranks.items():
            node = self._ends
            for byte in reversed(t):
                node = node.setdefault(byte, {})
            node[-1] = r
        self._pairs: dict[int, bool] = {}  # left rank << 32 | right rank
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Encoding by its definition: join the neighbours of lowest rank, leftmost first, as long as any joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose join makes a token; None for a byte and for a token that joins never make."""
        if rank not in self._halves:
            token, got = self.tokens[rank], None
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                joins = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not joins or min(joins)[0] >= rank:
                    break
                at = min(joins)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                got = self.ranks[parts[0]], self.ranks[parts[1]]
            self._halves[rank] = got
        return self._halves[rank]

    def _beside(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no join across their border comes before those inside them.

        Goes back in time from the whole tokens, undoing the later join that touches the border.
        """
        ok = self._pairs.get(left << 32 | right)
        if ok is not None:
            return ok
        a, b, before, ok = left, right, 1 << 62, True
        while True:
            r = self.ranks.get(self.tokens[a] + self.tokens[b])
            if r is not None and r < before:
                ok = False
                break
            x, y = self._split(a), self._split(b)
            if x and (a > b or not y):
                before, a = a, x[1]
            elif y:  # of equal joins the left one comes first
                before, b = b + 1, y[0]
            else:
                break
        if len(self._pairs) > 300_000:
            self._pairs.clear()
        self._pairs[left << 32 | right] = ok
        return ok

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Adds to `last` the last token of each longer prefix of `piece`."""
        pairs, ends = self._pairs, self._ends
        for end in range(len(last), len(piece)):
            node, at = ends, end
            while at >= 0:
                node = node.get(piece[at])
                if node is None:
                    at = -1  # no table of ranks lacks single bytes
                    break
                r = node.get(-1)
                if r is not None:
                    if not at:
                        break
                    ok = pairs.get(last[at - 1] << 32 | r)
                    if ok if ok is not None else self._possible(r) and self._beside(last[at - 1], r):
                        break
                at -= 1
            if at < 0:
                raise ValueError("no token can end here")
            last.append(r)
        return last

    def _possible(self, rank: int) -> bool:
        return len(self.tokens[rank]) == 1 or self._split(rank) is not None

    def read(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes stand for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with [start, end) replaced by `new`, and its last tokens, computed only near the edit."""
        changed = piece[:start] + new + piece[end:]
        fresh, shift = last[:start], len(new) - (end - start)
        alike = 0  # behind the edit, prefixes in a row whose last token is as before
        for at in range(start + 1, len(changed) + 1):
            self.extend(changed[:at], fresh)
            old = at - shift
            inside = at - len(self.tokens[fresh[-1]]) >= start + len(new)
            alike = alike + 1 if old > end and inside and fresh[-1] == last[old - 1] else 0
            if alike >= self.longest:  # no later prefix can see further back
                return changed, fresh + last[old:]
        return changed, fresh

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read(self.extend(piece, [])) if piece else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _classes() -> tuple[str, str]:
    """Character classes of letters and of numbers, as ranges for Python's re."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    esc = lambda c: f"\\U{ord(c):08x}"
    return tuple("".join(f"{esc(m[0][0])}-{esc(m[0][-1])}" for m in regex.finditer(p, every)) for p in (r"\p{L}+", r"\p{N}+"))  # runs of neighbouring code points


def compile_pattern(pattern: str) -> re.Pattern:
    r"""A pattern over \p{L}, \p{N} and \s, compiled for Python's own, faster engine.

    White space is Unicode's White_Space, as the tokenizer's library has it.
    """
    letters, numbers = _classes()
    space = r"\t-\r \x85\xa0  -     　"
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", space), (r"\S", "^" + space)):
            if pattern.startswith(name, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(name)
                break
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


class _Pieces(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, bpe: PrefixBpe, limit: int):
        self.bpe, self.limit = bpe, limit

    def learn(self, found: set[str]) -> None:
        """Encodes the pieces not known yet, in byte order: each keeps the prefixes it shares with the one before."""
        if len(self) > self.limit:
            self.clear()
        bpe, before, last = self.bpe, b"", []
        for piece, text in sorted((t.encode(), t) for t in found if t not in self):
            same = 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                same += 1
            del last[same:]
            whole = bpe.ranks.get(piece)
            bpe.extend(piece, last)
            self[text] = pack("<I", whole) if whole is not None else pack(f"<{len(ids)}I", *ids) if (ids := bpe.read(last)) else b""
            before = piece


def slices(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, about `limit` characters at a time."""
    own, size = [], 0
    for t in texts:
        own.append(t or "")
        size += len(own[-1])
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


class Splitter:
    """Finds all matches of a pattern. Texts of plain characters take an equal pattern of built-in classes, which is faster."""

    def __init__(self, pattern: str):
        self.full = compile_pattern(pattern)
        plain = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
        for a, b in plain.items():
            quick = quick.replace(a, b)
        self.quick = re.compile(quick)
        letters, numbers = (re.compile(f"[{c}]") for c in _classes())
        white = set("\t\n\v\f\r \x85\xa0")
        agree = [c for c in map(chr, range(0x250)) if (letters.match(c) is not None, numbers.match(c) is not None, c in white) == (re.match(r"[^\W\d_]", c) is not None, re.match(r"\d", c) is not None, re.match(r"\s", c) is not None)]
        self.odd = re.compile("[^" + "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" for c in agree) + "]")
        self.findall = lambda t: (self.full if self.odd.search(t) else self.quick).findall(t)


_state: dict = {}


def splitter(pattern: str) -> Splitter:
    """One splitter for each Python process and pattern."""
    if _state.get("key") != pattern:
        _state.update(key=pattern, made=Splitter(pattern))
    return _state["made"]


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, cache: int = 250_000) -> DataFrame:
    """Encodes and decodes the whole text of every document.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that decoding the ids gives) and, with keep_ids, ids as array<int>.
    `cache` bounds the pieces of text that a task remembers; they go with it, so that a later stage's workers hold none.
    """
    ranks = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    own: list = []  # each task unpickles a list of its own

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            bpe = PrefixBpe(sent.value)
            own.extend((bpe, splitter(pattern), _Pieces(bpe, cache)))
        bpe, split, known = own
        n, ids_sha, out_sha, ids = [], [], [], []
        for part in slices(b.column("text").to_pylist()):
            cut = [split.findall(t) for t in part]
            known.learn(set().union(*cut))
            for pieces in cut:
                packed = b"".join(map(known.__getitem__, pieces))
                got = np.frombuffer(packed, "<u4")
                n.append(len(got))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(got.tolist())).hexdigest())
                if keep_ids:
                    ids.append(got.astype(np.int32))
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs.select("doc_id", "text"), kernel, schema)
