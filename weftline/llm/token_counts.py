"""Token counts by trie-shared dynamic programming (operator 3).

Pre-tokens are the runs of non-blank characters of a text, each with the word mark in front. The distinct pre-tokens of
a slice are inserted in a trie that a task keeps from slice to slice. Each node holds the forward score of its prefix
(best unigram log probability and its number of tokens), computed once, when the node is made, from the scores of its
ancestors; a pre-token's count is what its terminal node holds. A node looks only at suffixes that some piece ends with.
The trie is begun anew when it has ``NODES`` nodes, and a pre-token's characters beyond ``DEPTH`` are scored without
nodes, so memory is bounded by those and the slice.

The vocabulary is that of a public SentencePiece file. Its own scores are used if it is a unigram model; a BPE file
has merge ranks instead, for which a Zipf law over the rank (log p = -ln(rank + 1) - ln H) stands in (README has
figures). A character that no piece covers costs one token for each of its UTF-8 bytes, at ten below the worst score.
Equal scores go to fewer tokens.

Defined results: null, empty and blank texts have no tokens; very long texts and words are counted whole; ties in score
are settled as above; repeated rows give a row each; null ids and extra columns, whatever their names, are harmless; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

MARK = "▁"
NODES = 1_000_000
DEPTH = 64
SLICE = 8 << 20
_cache: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[dict, frozenset, float]:
    """piece -> log probability, all suffixes of pieces, and the score of an uncovered character."""
    if path not in _cache:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        raw = [sp.get_score(i) for i in ids]
        ranked = len(raw) > 1 and all(a - b == 1 for a, b in zip(raw[:100], raw[1:101], strict=False))
        if ranked:
            h = math.log(sum(1 / (r + 1) for r in range(len(ids))))
            raw = [-math.log(r + 1) - h for r in range(len(ids))]
        scores = {sp.id_to_piece(i): s for i, s in zip(ids, raw, strict=True)}
        ends = frozenset(p[i:] for p in scores for i in range(len(p)))
        _cache[path] = scores, ends, min(raw) - 10
    return _cache[path]


class Trie:
    """Prefixes of pre-tokens with their forward scores."""

    def __init__(self, path: str):
        self.scores, self.ends, self.miss = vocabulary(path)
        self.child: dict[int, int] = {}  # node and character -> node
        self.best, self.tokens = [0.0], [0]

    def _forward(self, word: str, j: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of the first ``j`` characters, from those of all shorter prefixes."""
        char = word[j - 1]
        own = self.scores.get(char)
        # the character alone, by bytes if no piece is it
        top, n = (best[j - 1] + own, tokens[j - 1] + 1) if own is not None else (best[j - 1] + self.miss, tokens[j - 1] + len(char.encode("utf-8", "surrogatepass")))
        for i in range(j - 2, -1, -1):
            piece = word[i:j]
            if piece not in self.ends:
                break
            s = self.scores.get(piece)
            if s is not None:
                s += best[i]
                if s > top or s == top and tokens[i] + 1 < n:
                    top, n = s, tokens[i] + 1
        return top, n

    def count(self, word: str) -> int:
        """Tokens of a pre-token (with mark); makes the nodes that its prefixes lack."""
        child, node, path = self.child, 0, [0]
        for c in word[:DEPTH]:
            node = child.get(node << 21 | ord(c), -1)
            if node < 0:
                break
            path.append(node)
        if len(path) > len(word):
            return self.tokens[path[-1]]
        best, tokens, node = [self.best[x] for x in path], [self.tokens[x] for x in path], path[-1]
        for j in range(len(path), len(word) + 1):
            top, n = self._forward(word, j, best, tokens)
            best.append(top)
            tokens.append(n)
            if j <= DEPTH:
                child[node << 21 | ord(word[j - 1])] = node = len(self.best)
                self.best.append(top)
                self.tokens.append(n)
        return tokens[-1]


def counts_of(words: list[str], trie: Trie) -> list[int]:
    """Tokens of each pre-token (without mark; none for an empty one)."""
    return [trie.count(MARK + w) if w else 0 for w in words]


def counted(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) for each row."""
    path = path or default_path()
    thin = docs.select(id_col, F.col(text_col).alias("_text"))
    schema = thin.drop("_text").schema.add("n_pretokens", "long").add("n_tokens", "long")

    def run(batches):
        trie = Trie(path)
        for batch in batches:
            for part in _base.slices(batch, "_text", SLICE):
                if len(trie.best) > NODES:
                    trie = Trie(path)
                lists = pc.utf8_split_whitespace(pc.fill_null(part.column(1), ""))
                begin, flat = np.asarray(lists.offsets), lists.flatten().dictionary_encode()
                words = flat.dictionary.to_pylist()
                per = np.array(counts_of(words, trie) or [0], np.int64)
                index = np.asarray(flat.indices)
                total = np.append(0, np.cumsum(per[index]))
                real = np.append(0, np.cumsum(np.array([w != "" for w in words] or [False])[index]))
                begin = begin - begin[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(real[begin])), pa.array(np.diff(total[begin]))], names=[id_col, "n_pretokens", "n_tokens"])

    return thin.mapInArrow(run, schema)


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(_base.read(spark, sf_dir, "documents"))


QUERIES = {"op3_trie_token_counts": op3_trie_token_counts}
ORACLES: dict[str, str] = {}
