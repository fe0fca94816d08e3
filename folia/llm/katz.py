"""Scores of texts by a backoff n-gram model with Good-Turing discounts, learnt from part of the same rows.

An n-gram seen r times has the probability d_r r / c(h), where c(h) counts its history and d_r is the
Good-Turing discount (1 above CUTOFF). What the discounts leave of a history goes to the words not seen
after it, in proportion to their probabilities after the history that is one word shorter; the weight is
alpha(h) = (1 - sum of the discounted) / (1 - sum of the shorter history's probabilities of the words seen),
so the probabilities after every history sum to 1. Below the single words stands one symbol for all unknown
ones, which has what their discounts leave. Where nothing would be left, c(h) counts one more; where the
counts of counts give no discount between 0 and 1, it is 1 - 1 / 2r.

How it runs: texts are cut into blocks of some MB, each one row of a table: its words once, and numbers in
place of them. A block asks for each word or n-gram once, in a bucket; the tasks of the buckets add up what
all blocks counted, keep it as a table (a row a bucket), and answer each block in the order in which it
asked. From the answers a block goes on to the next order, and at the end evaluates its tokens, from the
single words up. Words are compared as they are, n-grams by the numbers of their history and word, so
nothing rests on hashes. The n-grams of a frequent history are dealt over many buckets by their words, and
a block adds up what each says of the history.

Null texts are empty: they have the end alone. Rows without doc_id are learnt from. Repeated rows count as
often as they stand. With no row to learn from every token is unknown and has probability 1. Extra columns
are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import textkit as tk
from folia.llm.arrow import shuffle_partitions
from folia.llm.dsir import slices
from folia.llm.shared import drop, written

FOLD = (7, 2)
ORDER, CUTOFF = 2, 5
#: Bytes of text in a block, and tokens a bucket (on average).
BLOCK, BUCKET = 8 << 20, 2_000_000
END, START = 0, -1
#: Parts of a history at most.
_PARTS = 1 << 17


def pack(a: np.ndarray) -> bytes:
    """An array of eight-byte numbers, compressed byte by byte of them."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).reshape(-1)


def _strings(a: pa.Array) -> tuple[bytes, np.ndarray]:
    """All strings in a row and their lengths."""
    return b"".join(a.cast(pa.binary()).to_pylist()), pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def _from_strings(data: bytes, lengths: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


# blocks

_BLOCK = "block long, n_learn long, n_tokens long, doc_id array<long>, learn binary, sizes binary, tokens binary, words binary, lengths binary, counts binary"


def _hashes(data: bytes, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return tk.span_hash(tk.prefix_hash(np.frombuffer(data, np.uint8)), ends - lengths, ends)


def _encode(texts: pa.Array, ids: pa.Array, learn: np.ndarray) -> dict:
    """A block: token 0 is the end, the others are the places of words, plus 1. Words are in the order of hashes, so in that of buckets."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, row = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    coded, row = flat.filter(real).dictionary_encode(), row.filter(real).to_numpy()
    sizes = np.bincount(row, minlength=len(texts)) + 1
    tokens = np.zeros(int(sizes.sum()), np.int64)
    order = np.argsort(_hashes(*_strings(coded.dictionary)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    tokens[np.arange(len(row)) + row] = place[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(tokens[np.repeat(learn, sizes)], minlength=len(order) + 1)
    words, lengths = _strings(coded.dictionary.take(pa.array(order)))
    return {
        "n_learn": int(learn.sum()), "n_tokens": len(tokens), "doc_id": ids.to_pylist(), "learn": pack(learn.astype(np.int64)), "sizes": pack(sizes),
        "tokens": pack(tokens), "words": zstandard.ZstdCompressor(1).compress(words), "lengths": pack(lengths), "counts": pack(counts[1:]),
    }


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def block() -> pa.RecordBatch:
        nonlocal number
        t = pa.Table.from_batches(held).combine_chunks()
        got = _encode(t.column("text").combine_chunks(), t.column("doc_id"), t.column("learn").to_numpy()) | {"block": number}
        number += 1
        return pa.RecordBatch.from_pylist([got], _ARROW)

    for b in batches:
        at = 0
        for part in slices(b.column("text"), limit):
            rows = b.slice(at, len(part)).drop_columns("text").append_column("text", part)
            at, more = at + len(part), pc.sum(pc.binary_length(part)).as_py()
            if held and size + more > limit:
                yield block()
                held, size = [], 0
            held.append(rows)
            size += more
    if held:
        yield block()


_ARROW = pa.schema([("block", pa.int64()), ("n_learn", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("learn", "sizes", "tokens", "words", "lengths", "counts"))])

# what blocks ask and buckets answer: `order` is that of the n-grams; block is null in the row that holds the
# bucket's part of the model, whose `tally` is (n-grams, their counts' sum, how many stand once, twice, ...)

_ASK = "bucket int, block long, body array<binary>"
_ANSWER = "order int, bucket int, block long, tally array<long>, body array<binary>"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.list_(pa.binary()))])
_ANSWERED = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("tally", pa.list_(pa.int64())), ("body", pa.list_(pa.binary()))])


def _tally(n: np.ndarray) -> list[int]:
    n = n[n > 0]
    return [len(n), int(n.sum()), *np.bincount(n[n <= CUTOFF + 1], minlength=CUTOFF + 2)[1:].tolist()]


def _parts(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, from, to) of each that occurs."""
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def _ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, lengths, counts = zstandard.ZstdDecompressor().decompress(r["words"]), unpack(r["lengths"]), unpack(r["counts"])
                bucket = ((_hashes(words, lengths) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                ends = np.append(0, np.cumsum(lengths))
                rows = []
                for k, a, b in _parts(bucket)[1]:
                    body = [zstandard.ZstdCompressor(1).compress(words[ends[a] : ends[b]]), pack(lengths[a:b]), pack(counts[a:b])]
                    rows.append({"bucket": k, "block": r["block"], "body": body})
                yield pa.RecordBatch.from_pylist(rows, _ASKED)

    return blocks.select("block", "words", "lengths", "counts").mapInArrow(run, _ASK)


def _answer_words(asked: DataFrame, buckets: int) -> DataFrame:
    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        words = pa.chunked_array([_from_strings(zstandard.ZstdDecompressor().decompress(r["body"][0]), unpack(r["body"][1])) for r in rows]).combine_chunks().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        counts = [unpack(r["body"][2]) for r in rows]
        n = np.bincount(at, weights=np.concatenate(counts), minlength=len(words.dictionary)).astype(np.int64)
        k, out, a = rows[0]["bucket"], [], 0
        for r, c in zip(rows, counts):
            own = at[a : a + len(c)]
            a += len(c)
            # a word's number is its own over all buckets
            out.append({"order": 1, "bucket": k, "block": r["block"], "tally": None, "body": [pack(n[own]), pack(own.astype(np.int64) * buckets + k + 1)]})
        data, lengths = _strings(words.dictionary)
        out.append({"order": 1, "bucket": k, "block": None, "tally": _tally(n), "body": [zstandard.ZstdCompressor(1).compress(data), pack(lengths), pack(n)]})
        return pa.Table.from_pylist(out, _ANSWERED)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


# the model


def discounts(times: list[int]) -> np.ndarray:
    """d_1 .. d_CUTOFF from the numbers of n-grams seen once, twice, ... CUTOFF + 1 times."""
    out, last = [], (CUTOFF + 1) * times[CUTOFF] / times[0] if times[0] else 1.0
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * times[r] / (r * times[r - 1]) - last) / (1 - last) if times[r - 1] and last != 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - 1 / (2 * r))
    return np.array(out)


def _discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n > CUTOFF, n, n * np.append(d, 1.0)[np.clip(n, 1, CUTOFF + 1) - 1])


def singles(n: np.ndarray, total: int, times: list[int]) -> np.ndarray:
    """Probabilities of tokens seen n times, 0 for an unknown one."""
    if not total:
        return np.ones(len(n))
    d, seen = discounts(times), np.arange(1, CUTOFF + 1)
    left = float((np.array(times[:CUTOFF]) * seen * (1 - d)).sum())
    total = total if left else total + 1
    return np.where(n > 0, _discounted(n, d), left or 1.0) / total


def backoff(total: np.ndarray, low: np.ndarray, times: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, divisor) of histories: their counts, the shorter one's sums over the words seen, and how many of these stand r times."""
    left = times @ (np.arange(1, CUTOFF + 1) * (1 - d))
    divisor = np.where(left > 0, total, total + 1)
    return np.where(total > 0, np.where(left > 0, left, 1.0) / divisor / (1 - low), 1.0), np.maximum(divisor, 1)


class _Tokens:
    """A block's tokens, and for each order that is answered their n-grams' places, numbers, counts and probabilities."""

    def __init__(self, block: dict, n_learn: int):
        self.sizes, self.n_learn = unpack(block["sizes"]), n_learn
        self.learn = np.repeat(unpack(block["learn"]) > 0, self.sizes)
        self.word = unpack(block["tokens"])
        ends = np.cumsum(self.sizes)
        self.first = np.zeros(len(self.word), bool)
        self.first[ends - self.sizes] = True
        self.docs = ends - self.sizes

    def read_words(self, answers: list[dict], tally: list[int]) -> None:
        body = [a["body"] for a in sorted(answers, key=lambda a: a["bucket"])]
        n, number = (np.concatenate([[END], *(unpack(b[i]) for b in body)]).astype(np.int64) for i in range(2))
        n[END] = self.n_learn
        self.wid = number
        self.place, self.number, self.n = self.word, number, n
        self.p = singles(n, tally[1], tally[2:])[self.word]
        self.known = n[self.word]

    def histories(self, buckets: int, heavy: int) -> None:
        """The next order's n-grams, by bucket: what stands before a token, START at the text's beginning, and the token.

        A history with more than `heavy` tokens has several parts, each in a bucket; all are asked for, as each
        knows only its own share of the history.
        """
        before = np.where(self.first, 0, np.roll(self.place, 1) + 1)
        pair, at, self.place = np.unique(before << 32 | self.word, return_index=True, return_inverse=True)
        h, w = pair >> 32, self.wid[pair & 0xFFFFFFFF]
        number, n = np.append(START, self.number), np.append(self.n_learn, self.n)
        many = np.clip(-(-n // heavy), 1, _PARTS)
        used = np.unique(h)
        first = np.zeros(len(number), np.int64)
        first[used] = np.cumsum(many[used]) - many[used]
        owner = np.repeat(used, many[used])
        salt = np.arange(len(owner)) - first[owner]
        mixed = tk.mix(number[owner].astype(np.uint64) * np.uint64(_PARTS) + salt.astype(np.uint64))
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        entry = first[h] + (tk.mix(w.astype(np.uint64)) % many[h].astype(np.uint64)).astype(np.int64)
        self.entries, self.parts = _parts(bucket)
        rank = np.empty(len(owner), np.int64)
        rank[self.entries] = np.arange(len(owner))
        self.grams = np.argsort(rank[entry], kind="stable")
        self.edges = np.searchsorted(rank[entry][self.grams], np.arange(len(owner) + 1))
        self.owner, self.salt, self.gram_w, self.gram_h, self.at = owner, salt, w, h, at
        self.history = number

    def ask(self, block: int, order: int) -> Iterator[dict]:
        """Histories and their parts, and the n-grams of each: words, counts, and what stands for their shorter ones' probabilities."""
        low = self.known if order == 2 else self.p  # a word's count says its probability in fewer bytes
        n = np.bincount(self.place[self.learn], minlength=len(self.gram_w))
        for k, a, b in self.parts:
            e, g = self.entries[a:b], self.grams[self.edges[a] : self.edges[b]]
            body = [self.history[self.owner[e]], self.salt[e], np.diff(self.edges[a : b + 1]), self.gram_w[g], n[g], low[self.at[g]]]
            yield {"bucket": k, "block": block, "body": [pack(x) for x in body]}

    def read(self, answers: list[dict], tally: list[int]) -> None:
        body = {a["bucket"]: a["body"] for a in answers}
        n, number = np.zeros(len(self.gram_w), np.int64), np.zeros(len(self.gram_w), np.int64)
        total, low, times = np.zeros(len(self.history)), np.zeros(len(self.history)), np.zeros((len(self.history), CUTOFF))
        for k, a, b in self.parts:
            e, g, got = self.owner[self.entries[a:b]], self.grams[self.edges[a] : self.edges[b]], body[k]
            n[g], number[g] = unpack(got[0]), unpack(got[1])
            np.add.at(total, e, unpack(got[2]))
            np.add.at(low, e, unpack(got[3], np.float64))
            np.add.at(times, e, unpack(got[4]).reshape(-1, CUTOFF))
        d = discounts(tally[2:])
        alpha, divisor = backoff(total, low, times, d)
        p = np.where(n > 0, _discounted(n, d) / divisor[self.gram_h], alpha[self.gram_h] * self.p[self.at])
        self.p, self.n, self.number = p[self.place], n, number
        del self.entries, self.parts, self.grams, self.edges, self.owner, self.salt, self.gram_w, self.gram_h, self.at, self.history


def _replay(block: dict, answers: list[dict], buckets: int, heavy: int, n_learn: int, tallies: list[list[int]]) -> _Tokens:
    """A block's tokens after all orders answered so far."""
    t = _Tokens(block, n_learn)
    t.read_words([a for a in answers if a["order"] == 1], tallies[0])
    for m, tally in enumerate(tallies[1:], 2):
        t.histories(buckets, heavy)
        t.read([a for a in answers if a["order"] == m], tally)
    return t


def _answer_grams(asked: DataFrame, order: int, buckets: int, last: bool, words: list[int]) -> DataFrame:
    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        bodies = [[*map(unpack, r["body"][:5]), unpack(r["body"][5], np.int64 if order == 2 else np.float64)] for r in rows]
        history, salt, size, word, count, low = (np.concatenate(x) for x in zip(*bodies))
        entry, at = np.unique((history + 1) * _PARTS + salt, return_inverse=True)
        key, first, gram = np.unique(np.repeat(at, size) << 40 | word, return_index=True, return_inverse=True)
        n = np.bincount(gram, weights=count, minlength=len(key)).astype(np.int64)
        seen = n > 0
        e, m = (key >> 40)[seen], n[seen]
        total = np.bincount(e, weights=m, minlength=len(entry)).astype(np.int64)
        low = low[first][seen]
        lows = np.bincount(e, weights=singles(low, words[1], words[2:]) if order == 2 else low, minlength=len(entry))
        rare = m <= CUTOFF
        times = np.bincount(e[rare] * CUTOFF + m[rare] - 1, minlength=len(entry) * CUTOFF).reshape(-1, CUTOFF)
        k, out, a, g = rows[0]["bucket"], [], 0, 0
        for r, body in zip(rows, bodies):
            own, grams = at[a : a + len(body[0])], gram[g : g + len(body[3])]
            a, g = a + len(own), g + len(grams)
            numbers = np.zeros(len(grams), np.int64) if last else grams * buckets + k + 1
            got = [pack(n[grams]), pack(numbers), pack(total[own]), pack(lows[own]), pack(np.ascontiguousarray(times[own]).reshape(-1))]
            out.append({"order": order, "bucket": k, "block": r["block"], "tally": None, "body": got})
        model = [pack(entry // _PARTS - 1), pack(entry % _PARTS), pack(np.bincount(e, minlength=len(entry))), pack((key & (1 << 40) - 1)[seen]), pack(m)]
        out.append({"order": order, "bucket": k, "block": None, "tally": _tally(n), "body": model})
        return pa.Table.from_pylist(out, _ANSWERED)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def _sum(answers: DataFrame) -> list[int]:
    """The tallies of all buckets, added; CUTOFF + 3 numbers reach the driver."""
    columns = [F.coalesce(F.sum(F.get("tally", F.lit(i))), F.lit(0)).cast("long") for i in range(CUTOFF + 3)]
    return list(answers.where(F.col("block").isNull()).agg(*columns).first())


def score(docs: DataFrame, order: int = ORDER, fold: tuple[int, int] = FOLD, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learnt from the rows whose crc32(doc_id as text) doesn't leave fold[1] modulo fold[0]. `base_score` sums
    log10((c + 1) / (N + V + 1)) over the tokens, `score` is the model's log10 probability of the text. Sizes of
    blocks (bytes) and buckets (tokens) don't change the results.
    """
    spark = docs.sparkSession
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~out_of).alias("learn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = written(rows.mapInArrow(lambda b: _blocks(b, block), _BLOCK), "katz-blocks")
    n_learn, n_tokens = (int(x or 0) for x in blocks.agg(F.sum("n_learn"), F.sum("n_tokens")).first())
    buckets = max(shuffle_partitions(spark), -(-n_tokens // bucket))
    heavy = max(1, n_tokens // buckets // 4)

    answers = [written(_answer_words(_ask_words(blocks, buckets), buckets), "katz-1")]
    words = _sum(answers[0])
    words[0], words[1] = words[0] + (n_learn > 0), words[1] + n_learn  # the end
    words[2:] = [t + (n_learn == r) for r, t in enumerate(words[2:], 1)]
    tallies = [words]

    tokens = blocks.select("block", "doc_id", "learn", "sizes", "tokens")

    def joined() -> DataFrame:
        got = answers[0]
        for a in answers[1:]:
            got = got.unionByName(a)
        return got.where(F.col("block").isNotNull()).select("block", "order", "bucket", "body")

    for m in range(2, order + 1):
        known = list(tallies)

        def ask(own: pa.Table, got: pa.Table) -> pa.Table:
            b = own.to_pylist()[0]
            t = _replay(b, got.to_pylist(), buckets, heavy, n_learn, known)
            t.histories(buckets, heavy)
            return pa.Table.from_pylist(list(t.ask(b["block"], m)), _ASKED)

        asked = tokens.groupBy("block").cogroup(joined().groupBy("block")).applyInArrow(ask, _ASK)
        answers.append(written(_answer_grams(asked, m, buckets, m == order, words), f"katz-{m}"))
        tallies.append(_sum(answers[-1]))

    def evaluate(own: pa.Table, got: pa.Table) -> pa.Table:
        b = own.to_pylist()[0]
        t = _replay(b, got.to_pylist(), buckets, heavy, n_learn, tallies)
        base = np.log10((t.known + 1) / (words[1] + words[0] + 1))
        add = lambda x: pa.array(np.add.reduceat(x, t.docs))
        held = ~(unpack(b["learn"]) > 0)
        total = pa.array(np.full(len(held), words[1], np.int64))
        columns = [pa.array(b["doc_id"], pa.int64()), pa.array(held), pa.array(t.sizes), add((t.known > 0).astype(np.int64)), total, add(base), add(np.log10(t.p))]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = written(tokens.groupBy("block").cogroup(joined().groupBy("block")).applyInArrow(evaluate, schema), "katz-scores")
    drop(blocks)
    return scored
