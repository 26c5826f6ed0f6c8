"""Operator 7: token counts by unigram scores over a shared trie.

A unigram tokenizer splits a pre-token into the vocabulary entries with the highest sum of
scores.  The best score of a prefix does not depend on what follows, so pre-tokens that begin
alike share that work: each distinct pre-token of a task is inserted into a trie whose nodes
hold the best forward score of their prefix, the least number of tokens that reaches it, and
at terminals the pre-token's count is stored.  A document's count is the sum over its
pre-tokens.

Scores are integers (millionths of a nat), so sums are exact and do not depend on the order.
The public vocabulary file carries an order of its entries, not probabilities; entry r of n
gets the logarithm of Zipf's law, -ln(r + 1) - ln(H_n).  A character outside the vocabulary
costs one token for each of its UTF-8 bytes, at a score below that of any entry.  Of several
best splits the one with the fewest tokens counts.

The trie is SHARED characters deep.  A longer pre-token goes on below it by itself, and only the
states that an entry can still reach back to are held, so a text of one long run without white space
takes no more memory than its characters; the counts are the same.

Pre-tokens are the maximal runs without white space, each with the word mark in front.

Edge cases: null, empty and blank texts have 0 pre-tokens and 0 tokens; repeated rows give
repeated results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

MARK = "▁"
#: Trie nodes a task holds; a full trie is begun anew, which costs time only.
TRIE_NODES = 1_500_000
#: Depth of the trie in characters; pre-tokens seldom share more.
SHARED = 256
MICRO = 1_000_000


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Integer log-probabilities of entries given in order of frequency."""
    total = math.log(math.fsum(1 / r for r in range(1, len(pieces) + 1)))
    return {piece: round(MICRO * (-math.log(r) - total)) for r, piece in enumerate(pieces, 1)}


def sentencepiece_pieces(path: str) -> list[str]:
    """Ordinary entries of a sentencepiece model file, in its order."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class TrieCounter:
    """Token counts of pre-tokens; a node is [children, best score, tokens]."""

    def __init__(self, scores: dict[str, int], max_nodes: int = TRIE_NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # the longest entry by its last two characters: longer strings with that end are not looked up
        self.reach: dict[str, int] = {}
        for piece in scores:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.unknown = min(scores.values(), default=0) - 10 * MICRO
        self.max_nodes = max_nodes
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.root: list = [{}, 0, 0]
        self.nodes = 1
        self.counts.clear()

    def insert(self, pre: str) -> int:
        """Token count of a pre-token; only nodes that are not there yet are scored."""
        node, path = self.root, [self.root]
        for i, char in enumerate(pre[:SHARED]):
            child = node[0].get(char)
            if child is None:
                child = node[0][char] = [{}, *self.forward(pre, i + 1, path)]
                self.nodes += 1
            node = child
            path.append(node)
        if len(pre) <= SHARED:
            return node[2]
        held = deque(path, self.longest)
        for end in range(SHARED + 1, len(pre) + 1):
            held.append((None, *self.forward(pre, end, held)))
        return held[-1][2]

    def forward(self, pre: str, end: int, path: list | deque) -> tuple[int, int]:
        """Best score of the prefix that ends at `end`, and the fewest tokens that reach it; `path` ends
        with the state in front of it."""
        scores, best, fewest = self.scores, None, 0
        for start in range(max(0, end - self.reach.get(pre[max(0, end - 2):end], 1)), end):
            score = scores.get(pre[start:end])
            if score is not None:
                _, before, tokens = path[start - end]
                total = before + score
                if best is None or total > best or total == best and tokens + 1 < fewest:
                    best, fewest = total, tokens + 1
        if pre[end - 1] not in scores:
            _, before, tokens = path[-1]
            total, tokens = before + self.unknown, tokens + len(pre[end - 1].encode())
            if best is None or total > best or total == best and tokens < fewest:
                best, fewest = total, tokens
        return best, fewest

    def count(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        words, counts, total = text.split(), self.counts, 0
        for word, times in sorted(Counter(words).items()):
            count = counts.get(word)
            if count is None:
                if self.nodes > self.max_nodes:
                    self.clear()
                count = self.insert(MARK + word)
                if len(word) < SHARED:
                    counts[word] = count
            total += times * count
        return len(words), total


def count_tokens(df: DataFrame, load_scores: Callable[[], dict[str, int]], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, chars_per_token (null without tokens) of every text.
    `load_scores` is called in the task.  A projection of the rows; nothing is shuffled."""
    source = id_and_text(df, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def make():
        counter = TrieCounter(load_scores())

        def row(doc_id, text):
            pre, tokens = counter.count(text or "")
            return [(doc_id, pre, tokens, len(text) / tokens if tokens else None)]
        return row

    return map_batches(source, make, f"doc_id {id_type}, n_pretokens bigint, n_tokens bigint, "
                                     "chars_per_token double")
