"""Token counts by a unigram segmentation whose forward scores are shared in a trie.

The distinct pre-tokens (words with their leading mark) of a group of documents are inserted in a trie, one level at a
time, so each distinct prefix is one node. The forward dynamic program runs once per node: the best score of a prefix is
the highest, over the pieces that end there, of the best score where the piece begins plus the piece's own. Pieces are
matched by walking a trie of pieces: a node's open matches are its parent's, each one character longer. A terminal
stores its pre-token's count.

Pieces come from a public vocabulary file that holds no unigram scores, and tokenizers are not trained here, so a piece's
log-probability is that of Zipf's law at its rank in the file. The counts are those of this segmentation, not of the
file's own merge order. A character that no piece covers costs its UTF-8 bytes.

Defined cases: null and empty texts have no token; white space separates pre-tokens and is not counted; repeated rows
count alike; null ids are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import small_batches, text_or_empty

MARK = "▁"
GROUP_BYTES = 2 << 20
#: Pre-tokens of more characters are walked one character at a time, not level by level.
LONG = 200
_CHARACTERS = 21  # bits of a code point
#: Score of a byte of an uncovered character, below that of any piece.
BYTE_SCORE = -30.0


class UnigramTrie:
    """A trie of pieces with scores, and the forward dynamic program along a path of characters."""

    def __init__(self, pieces: list[str]):
        total = sum(1 / (k + 1) for k in range(len(pieces)))
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        self.longest = max(map(len, pieces), default=1)
        self._arrays: tuple | None = None
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                to = self.children[at].get(c)
                if to is None:
                    to = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.score.append(None)
                at = to
            if self.score[at] is None:
                self.score[at] = -math.log((k + 1) * total)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted (node, character) keys, the nodes they lead to, the score of each node or NaN, and the longest piece."""
        if self._arrays is None:
            steps = sorted(((at << _CHARACTERS) | ord(c), to) for at, row in enumerate(self.children) for c, to in row.items())
            keys, to = (np.array(x, dtype=np.int64) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
            self._arrays = keys, to, np.array([np.nan if x is None else x for x in self.score]), self.longest
        return self._arrays

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, in any order, by a trie of the words."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        over = np.flatnonzero(sizes > LONG)
        if len(over):
            order = sorted(over.tolist(), key=lambda k: words[k])
            out[order] = self.walked([words[k] for k in order])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        some = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        keys, to, piece_score, longest = self.arrays()
        node = np.zeros(len(words), dtype=np.int64)
        # Of the nodes of one level: best score and tokens; by characters since, the open match and the values where it began.
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        match, score_at, tokens_at = np.full((1, longest), -1), np.zeros((1, longest)), np.zeros((1, longest), np.int64)
        depth = 0
        while len(some):
            found, at = np.unique((node[some] << _CHARACTERS) | code[begin[some] + depth], return_inverse=True)
            parent, char = found >> _CHARACTERS, found & ((1 << _CHARACTERS) - 1)
            match = np.concatenate([np.zeros((len(found), 1), np.int64), match[parent, :-1]], axis=1)
            score_at = np.concatenate([best[parent, None], score_at[parent, :-1]], axis=1)
            tokens_at = np.concatenate([tokens[parent, None], tokens_at[parent, :-1]], axis=1)
            row, col = np.nonzero(match >= 0)
            wanted = (match[row, col] << _CHARACTERS) | char[row]
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            match[row, col] = np.where(keys[place] == wanted, to[place], -1) if len(keys) else -1
            raw = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            best, tokens = best[parent] + BYTE_SCORE * raw, tokens[parent] + raw
            for k in range(longest):
                value = np.where(match[:, k] >= 0, score_at[:, k] + piece_score[match[:, k]], np.nan)
                # The best score; of equal ones, the fewest tokens.
                better = (value > best) | ((value == best) & (tokens_at[:, k] + 1 < tokens))
                best, tokens = np.where(better, value, best), np.where(better, tokens_at[:, k] + 1, tokens)
            node[some] = at
            depth += 1
            ended = sizes[some] == depth
            out[some[ended]] = tokens[at[ended]]
            some = some[~ended]
        return out

    def walked(self, words: list[str]) -> list[int]:
        """Tokens of each of sorted words, character by character, each from where it leaves the ones before it.

        A state is the best (score, tokens) so far and the open matches, pieces that began earlier and may go on: (node,
        score before, tokens before), no more than the longest piece has characters. States are kept only where a later
        word leaves the path of the current one.
        """
        shared = [len(os.path.commonprefix(pair)) for pair in zip(words, words[1:], strict=False)] + [0]
        less, stack = [len(words)] * len(words), []  # the next place where less is shared
        for i in reversed(range(len(words))):
            while stack and shared[stack[-1]] >= shared[i]:
                stack.pop()
            less[i] = stack[-1] if stack else len(words)
            stack.append(i)
        kept: list[tuple[int, tuple]] = [(0, ((0.0, 0), [(0, 0.0, 0)]))]
        out = []
        for i, word in enumerate(words):
            begin = shared[i - 1] if i else 0
            while kept[-1][0] > begin:
                kept.pop()
            begin, (best, opened) = kept[-1]
            leaves, j = [], i
            while j < len(words) and shared[j] > begin:
                leaves.append(shared[j])
                j = less[j]
            for at, c in enumerate(word[begin:], begin + 1):
                best, opened = self.stepped(best, opened, c)
                if leaves and leaves[-1] == at:
                    kept.append((leaves.pop(), (best, opened)))
            out.append(best[1])
        return out

    def stepped(self, best: tuple[float, int], opened: list[tuple[int, float, int]], c: str) -> tuple[tuple[float, int], list[tuple[int, float, int]]]:
        """The state after one more character."""
        raw = len(c.encode())
        # The best score; of equal ones, the fewest tokens.
        top, going = (best[0] + BYTE_SCORE * raw, -best[1] - raw), []
        for node, score, tokens in opened:
            to = self.children[node].get(c)
            if to is not None:
                going.append((to, score, tokens))
                value = self.score[to]
                if value is not None:
                    top = max(top, (score + value, -tokens - 1))
        best = (top[0], -top[1])
        going.append((0, *best))
        return best, going


_tries: dict[str, UnigramTrie] = {}


def pieces_of(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model file, in their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def trie_of(path: str) -> UnigramTrie:
    if path not in _tries:
        _tries[path] = UnigramTrie(pieces_of(path))
    return _tries[path]


def count(df: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(1))
            for i, j in tc.groups(offsets, GROUP_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, first = tc.word_spans(part, offsets[i : j + 1] - offsets[i])
                one, inverse = tc.distinct_slices(part, starts, ends)
                raw = part.tobytes()
                words = [MARK + raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                sizes = trie_of(vocabulary).counts(words)
                upto = np.concatenate([[0], np.cumsum(sizes[inverse])]) if len(words) else np.zeros(1, np.int64)
                distinct = [len(np.unique(inverse[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(first)), pa.array(distinct, pa.int64()), pa.array(upto[first[1:]] - upto[first[:-1]])], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
