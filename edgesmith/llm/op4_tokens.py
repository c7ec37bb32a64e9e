"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each behind the piece model's word mark. The distinct pre-tokens of a
few megabytes of text that the task has not met before go into a trie, all of one depth at a time. A node
holds the best unigram score of its prefix and how many pieces that takes, so both are computed once for
each shared prefix, from the scores of at most ``longest`` nodes above it. A word's count is read at its
last node and kept for every later occurrence. Words beyond ``LONG`` characters, of which a trie shares
little, go through a trie of their own node by node, with the same result.

Scores: the piece model is a public vocabulary whose file, a parameter, lists pieces by rank and no
probabilities; no tokenizer is trained here. Its pieces get the unigram distribution of Zipf's law on their
ranks: piece r of n has probability 1 / (r + 2) over the sum of these. A model with scores of its own is
given as ``pieces``. A character that is no piece costs one byte piece for each of its UTF-8 bytes, each
below every listed piece. Ties go to fewer pieces.

Words and pieces are looked up by 64-bit hashes. Defined results: null and empty texts, and those without
words, have no tokens. Repeated rows count each. An empty table gives an empty result. A word of any length
is walked, never cut. The input's columns come back in the struct ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A task forgets its words, and a trie of long words its nodes, beyond so many; counts don't depend on it.
MAX_WORDS, MAX_NODES = 2_000_000, 300_000
LONG = 48
CHUNK = 1 << 22
U = np.uint64


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and log-probabilities; special and byte pieces are left out. Bounded by the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    listed = [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(math.fsum(1 / (r + 2) for r in range(len(listed))))
    return {p: -math.log(r + 2) - whole for r, p in enumerate(listed)}


class Trie:
    """Prefixes of the words met so far with their forward scores and piece counts, node by node."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 1.0
        self.tails = {p[i:] for p in pieces for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Pieces of the best segmentation of MARK + word."""
        if len(self.score) > self.max_nodes:
            self.clear()
        text, node, path = MARK + word, 0, [0]
        child, score, count, pieces, tails = self.child, self.score, self.count, self.pieces, self.tails
        for end, char in enumerate(text, 1):
            after = child.get((node, char))
            if after is None:
                n_bytes = len(char.encode())
                best, fewest = score[node] + n_bytes * self.unknown, count[node] + n_bytes
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    piece = text[start:end]
                    if piece not in tails:
                        break
                    if piece in pieces:
                        s, c = score[path[start]] + pieces[piece], count[path[start]] + 1
                        if s > best or (s == best and c < fewest):
                            best, fewest = s, c
                after = child[node, char] = len(score)
                score.append(best)
                count.append(fewest)
            node = after
            path.append(node)
        return count[node]


def _backwards(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer at the front."""
    return kernels.mix(hashes ^ (chars.astype(U) + U(1)))


class Forward:
    """Forward scores over a trie of many words, built and scored one depth at a time."""

    def __init__(self, pieces: dict[str, float]):
        self.trie = Trie(pieces)
        tails = sorted(self.trie.tails) or [""]
        size = np.array([len(t) for t in tails], np.int64)
        chars = np.zeros((len(tails), max(size, default=1)), np.uint32)
        for i, t in enumerate(tails):
            chars[i, : size[i]] = np.frombuffer(t[::-1].encode("utf-32-le"), np.uint32)
        h = np.zeros(len(tails), U)
        for k in range(chars.shape[1]):
            live = size > k
            h[live] = _backwards(h[live], chars[live, k])
        order = np.argsort(h)
        self.tails = h[order]
        self.scores = np.array([pieces.get(t, -np.inf) for t in tails])[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each of the words, which are distinct and hold no line feed."""
        out = np.zeros(len(words), np.int64)
        chars = np.frombuffer(("\n" + b"\n".join(words).decode()).encode("utf-32-le"), np.uint32).copy()
        starts = np.flatnonzero(chars == 10)
        chars[starts] = ord(MARK)
        size = np.diff(np.append(starts, len(chars)))
        for i in np.flatnonzero(size > LONG):
            out[i] = self.trie.tokens(words[i].decode())
        active = np.flatnonzero(size <= LONG)
        node_of = [np.zeros(len(words), np.int64)]
        score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        for depth in range(1, LONG + 1):
            active = active[size[active] >= depth]
            if not len(active):
                break
            char = chars[starts[active] + depth - 1]
            _, first, back = np.unique(node_of[-1][active] << 21 | char.astype(np.int64), return_index=True, return_inverse=True)
            node_of.append(np.zeros(len(words), np.int64))
            node_of[-1][active] = back
            word, char = active[first], char[first]  # one word through each node
            n_bytes = 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)
            best = score[-1][node_of[-2][word]] + n_bytes * self.trie.unknown
            fewest = count[-1][node_of[-2][word]] + n_bytes
            live, h = np.arange(len(word)), np.zeros(len(word), U)
            for k in range(1, min(self.trie.longest, depth) + 1):
                h = _backwards(h, chars[starts[word[live]] + depth - k])
                at = np.minimum(np.searchsorted(self.tails, h), len(self.tails) - 1)
                known = self.tails[at] == h
                live, h, at = live[known], h[known], at[known]
                if not len(live):
                    break
                above = node_of[depth - k][word[live]]
                s, c = score[depth - k][above] + self.scores[at], count[depth - k][above] + 1
                better = (s > best[live]) | ((s == best[live]) & (c < fewest[live]))
                best[live[better]], fewest[live[better]] = s[better], c[better]
            score.append(best)
            count.append(fewest)
            ends = active[size[active] == depth]
            out[ends] = fewest[node_of[-1][ends]]
        return out


def token_counts(docs: DataFrame, text: str = "text", pieces: dict[str, float] | None = None, path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """row (the columns of ``keep``, by default all), n_words and n_tokens for every input row. No
    shuffle: each task keeps words and tries of bounded size."""
    pieces = vocabulary(path) if pieces is None else pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(pieces)
        met, known = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = kernels.buffers(batch.column(1))
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j in kernels.chunks(offsets, CHUNK):
                raw, ofs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = kernels.word_spans(raw, ofs)
                words[i:j] = np.diff(first)
                if not len(starts):
                    continue
                keys, where, back = np.unique(kernels.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                at = np.searchsorted(met, keys)
                old = np.zeros(len(keys), bool)
                old[at < len(met)] = met[at[at < len(met)]] == keys[at < len(met)]
                got = np.empty(len(keys), np.int64)
                got[old] = known[at[old]]
                new = np.flatnonzero(~old)
                if len(new):
                    whole = raw.tobytes()
                    got[new] = forward.counts([whole[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
                    if len(met) > MAX_WORDS:
                        met, known = keys, got
                    else:
                        met, known = np.insert(met, at[new], keys[new]), np.insert(known, at[new], got[new])
                sums = np.concatenate([[0], np.cumsum(got[back])])
                tokens[i:j] = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["row", "n_words", "n_tokens"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in (docs.columns if keep is None else keep))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_words", "n_tokens")
