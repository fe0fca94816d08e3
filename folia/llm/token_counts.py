"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that match in a chunk of text; a
Viterbi pass carries only the best score and its number of pieces for each position. Rules are those of
the tokenizers that use such vocabularies: spaces become U+2581 and one more stands before a text that
isn't empty; a character that no piece of its own covers can be unknown, at ten below the lowest score;
matches are tried by start, then by length, and only a strictly better score replaces an earlier one; an
unknown character becomes one token for each of its bytes if the vocabulary has byte pieces, else a run of
them is one token. No piece goes on behind a letter with a space, so chunks that begin at spaces are
counted on their own and remembered; so is a character that no longer piece holds.

The model that the query reads was made by merges: its pieces' scores are their negated merge ranks, and the
counts are those of the best-scored cut by these scores, not of that model's own merging.

Nulls and empty texts have no tokens; other columns are passed over.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from folia.llm.arrow import map_batches

SPACE = "▁"


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a sentencepiece model's ordinary pieces, and whether it has byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not special(i)], any(m.is_byte(i) for i in range(m.get_piece_size()))


class Counter(dict):
    """Chunk of text to its number of tokens; forgets all when full."""

    def __init__(self, vocabulary: list[tuple[str, float]], bytes_for_unknown: bool, limit: int):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary):
            raise ValueError("pieces with a space behind a letter can't be counted by chunks")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece) - 1, score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.by_bytes, self.limit = bytes_for_unknown, limit
        self.known = frozenset(p for p, _ in vocabulary if len(p) == 1)
        # a character that stands in no longer piece is a chunk of its own, unless unknown ones in a row are one token
        joined = {c for p, _ in vocabulary if len(p) > 1 for c in p} - {SPACE}
        some = lambda chars: "".join(map(re.escape, sorted(chars)))
        inner = f"[{some(joined)}]" if bytes_for_unknown and joined else f"[^ {some(self.known - joined - {SPACE})}]"
        self.chunks = re.compile(f" *{inner}+| +|.", re.S)

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and number of tokens of a text with its spaces marked.

        The automaton reports matches by their ends, longest first, so each end's first match opens it and
        only a strictly better one replaces it.
        """
        return self._known(text) if self.known.issuperset(text) else self._mixed(text)

    def _known(self, text: str) -> tuple[float, int]:
        best, count, at = [0.0], [0], 0
        for end, (before, s) in self.automaton.iter(text):
            start = end - before
            x = best[start] + s
            if end == at:
                best.append(x)
                count.append(count[start] + 1)
                at += 1
            elif x > best[at]:
                best[at] = x
                count[at] = count[start] + 1
        return best[at], count[at]

    def _mixed(self, text: str) -> tuple[float, int]:
        """As `_known`, where a character that is no piece can be unknown, behind all other matches of its end."""
        best, count, opened = [0.0], [0], [False]

        def close(end: int) -> None:
            """Opens what no match has opened before `end`, and offers the unknown character at each of these places."""
            for i in range(max(1, len(best) - 1), end + 1):
                fresh = i == len(best)
                if text[i - 1] not in self.known:
                    x = best[i - 1] + self.unknown
                    if fresh or x > best[i]:
                        n = count[i - 1] + (len(text[i - 1].encode()) if self.by_bytes else not opened[i - 1])
                        best[i:], count[i:], opened[i:] = [x], [n], [not self.by_bytes]

        for end, (before, s) in self.automaton.iter(text):
            if len(best) <= end + 1:
                close(end)
            start = end - before
            x = best[start] + s
            if len(best) == end + 1:
                best.append(x)
                count.append(count[start] + 1)
                opened.append(False)
            elif x > best[end + 1]:
                best[end + 1], count[end + 1], opened[end + 1] = x, count[start] + 1, False
        close(len(text))
        return best[-1], count[-1]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[chunk] = self.viterbi(chunk.replace(" ", SPACE))[1]
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.chunks.findall(" " + text.replace(SPACE, " ")))) if text else 0


_state: dict = {}


def count(docs: DataFrame, path: str, cache: int = 400_000) -> DataFrame:
    """doc_id, n_tokens of every document's whole text. `cache` bounds the chunks that a Python process remembers."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # bounded by the vocabulary

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        if _state.get("key") != (path, cache):
            _state.update(key=(path, cache), counter=Counter(*sent.value, cache))
        c = _state["counter"]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.count(t.as_py()) for t in b.column("text")], pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, n_tokens long")
