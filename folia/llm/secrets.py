"""Secret scans: three patterns of known shapes, and a battery of randomness tests for the rest.

The patterns (assignments of passwords and tokens, access keys, long hex runs) give the base spans. The
battery looks at every other run of MIN or more characters of the base64 alphabets, cut at base spans. It
infers the encoding of what follows the run's prefix (`key_live_`), the smallest of hex, base32, letters and
digits, base64 that holds all its characters (if none does, the parts between slashes and plus signs are looked
at), and tests the hypothesis that it is as structured as text, against that its characters are drawn at random
from that alphabet:

- chi-squared: how far its letters are from even use of the alphabet's letters. Text is further;
- runs: how often its characters change between words, capitals and digits. Text changes at most at RATE. Where
  the alphabet has few of the letters (hex), it counts as well how rarely text's letters all lie among them, by
  Fisher's rule: which letters, and where classes change, say nothing of each other;
- serial correlation: how much a letter says of the next inside such runs, by the dependence of neighbours in
  the documents' own words. Text has much of it.

Each test gives the probability that text is that close to randomness, so longer runs can give smaller ones.
What text is like is learnt from the words of all documents, and, where its path is given, of a tokenizer's
vocabulary, with the spread between texts; a run has to be unlike each of them. What
isn't evenly drawn from its alphabet either (one letter again and again, the alphabet in order, in whatever
case) doesn't count. The three are combined by
the Cauchy rule, which holds for dependent tests, and the step-up procedure of Benjamini and Hochberg,
weighted by length, bounds the share of text among the spans found in a document by LEVEL. They are spans of the kind
`random`, and never replace or overlap base spans.

A null text counts as empty and has no spans; with no words to learn from there are base spans only. Repeated
rows are scanned each on their own; other columns are passed over by `scan` and kept by `redact`.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from folia.llm import textkit as tk
from folia.llm.arrow import map_batches

# fixed values: the base patterns and their least lengths
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either_case, _WORDS)) + ")" + _ASSIGN_TAIL)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Least length of a run that is tested, and of the parts of one that no alphabet holds.
MIN = 20
#: Share of text among the random spans found in a document, at most.
LEVEL = 0.001
#: Probability below which a run isn't taken for random: one of so many random ones is missed.
EVEN = 1e-4
#: Changes between words, capitals and digits for each character of text, at most.
RATE = 0.2
#: Spread between texts, in bits a pair, at least.
SPREAD = 0.3
#: Letters below which there is no model of text, pairs from which on a document's mean counts, and parts of a bit that means are summed in.
LETTERS, PAIRS, PARTS = 5_000, 100, 1 << 20
#: Bytes whose pairs are looked at at once.
PIECE = 1 << 18
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_PREFIX = re.compile(r"(?:[A-Za-z]{2,10}[_-]){1,2}")
_SEGMENT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_-]+")
_TEXT_WORD = re.compile(r"[A-Za-z]{3,20}")
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a)) for name, a in _ALPHABETS]


@dataclass
class Text:
    """What text is like: letter shares, each pair's dependence in bits, its mean, and its spread over pairs and over documents."""

    share: np.ndarray
    bits: np.ndarray
    mean: float
    pair_sd: float
    text_sd: float


def _letters(word: str) -> np.ndarray:
    return np.frombuffer(word.lower().encode(), np.uint8) - 97


_LETTER = np.zeros(256, np.int8)
_LETTER[65:91] = _LETTER[97:123] = 1


def letter_pairs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 26 * letter + next letter) of all neighbours in words of 3 to 20 letters; what is longer is cut every 20, letters beyond ASCII end a word."""
    s, e, row = tk.runs(_LETTER[buf], offs)
    at = np.repeat(np.arange(len(s)), e - s - 1)
    i = np.arange(len(at)) - np.repeat(np.cumsum(e - s - 1) - (e - s - 1), e - s - 1)
    keep = (i % 20 != 19) & ((e - s)[at] - i // 20 * 20 >= 3)
    at, i = at[keep], s[at[keep]] + i[keep]
    low = tk.LOWER[buf].astype(np.int64) - 97
    return row[at], 26 * low[i] + low[i + 1]


def pair_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.bincount(letter_pairs(buf, offs)[1], minlength=676)


def text_of(counts: np.ndarray) -> Text | None:
    """The model of text of the numbers of all pairs, with the least spread between texts."""
    counts = counts.reshape(26, 26) + 1.0
    if counts.sum() < LETTERS:
        return None
    bits = np.log2(counts / counts.sum(1, keepdims=True) * 26)
    p = counts / counts.sum()
    mean = float((p * bits).sum())
    return Text(counts.sum(0) / counts.sum(), bits, mean, math.sqrt(float((p * (bits - mean) ** 2).sum())), SPREAD)


def spread(buf: np.ndarray, offs: np.ndarray, text: Text) -> tuple[int, int]:
    """(rows of PAIRS pairs or more, sum of the squares by which their means differ beyond what their numbers of pairs explain, in PARTS)."""
    row, pair = letter_pairs(buf, offs)
    n = np.bincount(row, minlength=len(offs) - 1)
    total = np.bincount(row, text.bits.ravel()[pair], len(offs) - 1)
    big = n >= PAIRS
    off = (total[big] / n[big] - text.mean) ** 2 - text.pair_sd**2 / n[big]
    # in whole numbers, whose sum doesn't depend on the order of rows
    return int(big.sum()), int(np.rint(off * PARTS).astype(np.int64).sum())


def with_spread(text: Text, n: int, off: int) -> Text:
    return replace(text, text_sd=max(SPREAD, math.sqrt(max(0.0, off / PARTS / n)))) if n else text


def learn(texts: Iterable[str]) -> Text | None:
    """The model of text from the words of some texts."""
    buf, offs = tk.from_texts([t.encode("utf-8", "replace") for t in texts])
    got = text_of(pair_counts(buf, offs))
    return got and with_spread(got, *spread(buf, offs, got))


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(text: str) -> str | None:
    """Name of the smallest alphabet that holds the text."""
    own = frozenset(text)
    return next((name for name, chars in _SETS if own <= chars), None)


def chi_squared(letters: np.ndarray, size: int, share: np.ndarray) -> float:
    """P(text's letters are as evenly used as these), of the first `size` letters of the alphabet, with the exact mean and variance."""
    n = len(letters)
    if n < 8:
        return 1.0
    p = share[:size] / share[:size].sum()
    counts = np.bincount(letters, minlength=size)
    found = float((counts.astype(float) ** 2).sum())
    s2, s3 = float((p**2).sum()), float((p**3).sum())
    mean = n * (n - 1) * s2 + n
    var = 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)
    return _below((found - mean) / math.sqrt(max(var, 1e-9)))


def runs(n: int, changes: int) -> float:
    """P(text of n characters changes this often or more), a binomial tail."""
    return min(1.0, sum(math.comb(n - 1, k) * RATE**k * (1 - RATE) ** (n - 1 - k) for k in range(changes, n))) if n <= 400 else _below(((n - 1) * RATE + 0.5 - changes) / math.sqrt((n - 1) * RATE * (1 - RATE)))


def serial(pairs: np.ndarray, text: Text) -> float:
    """P(neighbouring letters of text depend on each other as little as these)."""
    if len(pairs) < 4:
        return 1.0
    found = float(text.bits[pairs[:, 0], pairs[:, 1]].mean())
    return _below((found - text.mean) / math.sqrt(text.pair_sd**2 / len(pairs) + text.text_sd**2))


def confined(letters: int, size: int, share: np.ndarray) -> float:
    """P(so many letters of text are all among the first `size`)."""
    return float(share[:size].sum()) ** letters if size < 26 else 1.0


def _both(p: float, q: float) -> float:
    """Fisher's combination of two independent tests; one of 1 changes nothing."""
    if p == 1.0 or q == 1.0:
        return min(p, q)
    pq = max(p * q, 1e-300)
    return min(1.0, pq * (1 - math.log(pq)))


def body(run: str) -> str:
    """The run behind its prefix, if that leaves enough to be tested."""
    m = _PREFIX.match(run)
    return run[m.end() :] if m and len(run) - m.end() >= MIN else run


def battery(run: str, models: tuple[Text, ...]) -> float | None:
    """Probability that text, of the kind that fits best, looks as random as this run; null if no alphabet holds it, 1 if it isn't random either."""
    run = body(run)
    name = encoding(run)
    if name is None:
        return None
    chars = dict(_ALPHABETS)[name]
    if evenness([chars.index(c) for c in run], len(chars)) < EVEN or in_steps(run.lower(), "".join(dict.fromkeys(chars.lower()))) < EVEN:
        return 1.0
    parts = _SEGMENT.findall(run)
    words = [_letters(w) for w in parts if w.isalpha()]
    letters = np.concatenate(words) if words else np.zeros(0, np.uint8)
    pairs = np.concatenate([np.stack([w[:-1], w[1:]], 1) for w in words]) if words else np.zeros((0, 2), np.uint8)
    changed = runs(len(run), len(parts) - 1)
    size = len(set(chars.lower()) - set("0123456789+/-_"))
    return max(_combined(chi_squared(letters, size, m.share), _both(changed, confined(len(letters), size, m.share)), serial(pairs, m)) for m in models)


def _combined(*tests: float) -> float:
    """Cauchy combination; a test that gives 1 says nothing for or against."""
    said = [min(max(p, 1e-15), 0.999999) for p in tests if p < 1.0]
    return 0.5 - math.atan(sum(math.tan((0.5 - p) * math.pi) for p in said) / len(said)) / math.pi if said else 1.0


def evenness(codes: list[int], size: int) -> float:
    """p-value of the hypothesis that the codes are drawn evenly and independently from `size` values: chi-squared, runs around the middle, serial correlation."""
    x = np.asarray(codes)
    n = len(x)
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    # cube-root normal approximation, with the exact mean and variance for few expected counts
    scale = var / (2 * mean)
    df = mean / scale
    p_chi = _above(((chi / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = x >= size // 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n1 or not n0:
        p_runs = 2.0 ** (1 - n)
    else:
        found = 1 + int((high[1:] != high[:-1]).sum())
        expect = 1 + 2 * n1 * n0 / n
        spread = math.sqrt(max(1e-9, (expect - 1) * (expect - 2) / (n - 1)))
        p_runs = min(1.0, 2 * _above(max(0.0, abs(found - expect) - 0.5) / spread))
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    p_serial = min(1.0, 2 * _above(abs(r + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def in_steps(run: str, chars: str) -> float:
    """P(as many neighbours in an even random run lie equally far apart in the alphabet as here), over all distances."""
    codes = np.array([chars.index(c) for c in run])
    n, size = len(codes) - 1, len(chars)
    most = int(np.bincount((codes[1:] - codes[:-1]) % size).max())
    # letters of either case are drawn twice as often as digits: no distance is likelier than twice its even share
    p = 2 / size
    return min(1.0, size * sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most, n + 1))) if n <= 400 else min(1.0, size * _above((most - 0.5 - n * p) / math.sqrt(n * p * (1 - p))))


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs outside `taken` that are long enough, or the parts of those that no alphabet holds."""
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        cuts = sorted((max(a, at), min(z, end)) for a, z in taken if a < end and at < z)
        for a, z in (*cuts, (end, end)):
            if a - at >= MIN:
                whole = text[at:a].rstrip("=")
                if len(whole) >= MIN and encoding(body(whole)) is not None:
                    yield at, a
                else:
                    for part in re.finditer(r"[^+/=]+", text[at:a]):
                        if len(part[0]) >= MIN:
                            yield at + part.start(), at + part.end()
            at = max(at, z)


def random_spans(text: str, taken: list[tuple[int, int]], models: tuple[Text, ...], level: float = LEVEL) -> list[tuple[int, int]]:
    """Spans of runs that text would hardly give, by a step-up procedure whose weights are the lengths over their mean."""
    rows = [(p, a, z) for a, z in candidates(text, taken) if (p := battery(text[a:z].rstrip("="), models)) is not None] if models else []
    if not rows:
        return []
    mean = sum(z - a for _, a, z in rows) / len(rows)
    rows = sorted((p * mean / (z - a), a, z) for p, a, z in rows)
    cut = max((i for i, (p, _, _) in enumerate(rows, 1) if p <= level * i / len(rows)), default=0)
    return sorted((a, z) for _, a, z in rows[:cut])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the known shapes, by start and kind; kinds are places in KINDS."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def spans(text: str, models: tuple[Text, ...]) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + [(a, z, 3) for a, z in random_spans(text, [x[:2] for x in base], models)], key=lambda x: (x[0], x[2]))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in found)


def of_vocabulary(path: str) -> Text | None:
    """The model of text of a tokenizer's ranks file: its pieces are the words of many languages."""
    with open(path, "rb") as f:
        words = _TEXT_WORD.findall(" ".join(base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip()))
    return learn(" ".join(words[i::200]) for i in range(200))


def train(docs: DataFrame, vocabulary: str | None = None) -> tuple[Text, ...]:
    """The kinds of text: of all documents, whose pairs are counted once and held against the counts' model once more, and of a vocabulary."""
    texts = docs.select("text").where("text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(676, np.int64)
        for b in batches:
            for _, _, buf, offs in tk.pieces(b.column(0), PIECE):
                got += pair_counts(buf, offs)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676)), pa.array(got)], ["pair", "n"])

    counts = np.zeros(676)
    for r in texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 676 rows
        counts[r["pair"]] = r["n"]
    own = text_of(counts)
    if own is not None:

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [spread(buf, offs, own) for _, _, buf, offs in tk.pieces(b.column(0), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(2)], ["n", "off"])

        r = texts.mapInArrow(hold, "n long, off long").agg(F.sum("n").alias("n"), F.sum("off").alias("off")).first()
        own = with_spread(own, r["n"] or 0, r["off"] or 0)
    return tuple(m for m in (own, of_vocabulary(vocabulary) if vocabulary else None) if m)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document's whole text."""
    models = train(docs, vocabulary)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in b.column("text"):
            found = spans(text.as_py() or "", models)
            base = [x for x in found if x[2] < 3]
            n = [sum(x[2] == k for x in found) for k in range(4)]
            for c, v in zip(cols, (n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), n[3])):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, vocabulary: str | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their texts replaced by `mark` (spans that touch become one); n_chars, if there, follows."""
    models = train(docs, vocabulary)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for text in b.column("text").to_pylist():
            found = spans(text, models) if text else []
            if found:
                parts, at = [], 0
                for a, z, _ in found:
                    if a > at or not parts and a == 0:
                        parts += [text[at:a], mark]
                    at = max(at, z)
                text = "".join(parts) + text[at:]
            new.append(text)
        cols = list(b.columns)
        cols[b.schema.get_field_index("text")] = pa.array(new, pa.string())
        if (n := b.schema.get_field_index("n_chars")) >= 0:
            cols[n] = pa.array([None if t is None else len(t) for t in new], pa.int64())
        return pa.RecordBatch.from_arrays(cols, b.schema.names)

    schema = StructType([f if f.name != "n_chars" else f.__class__(f.name, LongType()) for f in docs.schema.fields])
    return map_batches(docs, kernel, schema)
