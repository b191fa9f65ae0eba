"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word, with the mark of a word's beginning before it. Distinct pre-tokens go into a trie; each node keeps
the best unigram score of all ways to cut its prefix into vocabulary pieces, and how many tokens that way has. The score of
a prefix depends on it alone, so it is computed once, when the node is made, and all words that share the prefix use it;
the count at a word's last node is the word's. A text's count is the sum over its words.

The vocabulary lists its pieces from the commonest; a piece at place r has the log probability of Zipf's law,
-log(r + 1) - log(sum of 1 / (r + 1)). A character that no piece covers costs UNKNOWN and gives a token for each byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, map_rows, require

MARK = "▁"
UNKNOWN = -30.0
#: Nodes of a worker's trie (it starts anew at this number), and words whose counts a worker keeps, twice.
NODES, CACHE = 400_000, 300_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces, given from the commonest."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    scores: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        scores.setdefault(piece, -math.log(r + 1) - total)
    return scores


def load_pieces(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece vocabulary that stand for text, in its order; path: its file on this machine."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    return [p for i in numbers if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i)).strip(MARK)]


class Trie:
    """Pre-tokens with forward scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: All ends of pieces: a cut is lengthened backwards only as long as it's one of these.
        self.ends = {p[i:] for p in scores for i in range(len(p))}
        self._restart()

    def _restart(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.tokens = [0]

    def count(self, word: str) -> int:
        """Tokens of the best way to cut the word; of equally good ones, the one with the shortest last piece."""
        if len(self.best) + len(word) > NODES:
            self._restart()
        node, path = 0, [0]
        child, best, tokens = self.child, self.best, self.tokens
        for at, letter in enumerate(word, 1):
            below = child.get((node, letter))
            if below is None:
                before = path[at - 1]
                high, n = best[before] + UNKNOWN, tokens[before] + len(letter.encode())
                for begin in range(at - 1, -1, -1):
                    piece = word[begin:at]
                    if piece not in self.ends:
                        break
                    own = self.scores.get(piece)
                    if own is not None and best[path[begin]] + own > high:
                        high, n = best[path[begin]] + own, tokens[path[begin]] + 1
                below = child[node, letter] = len(best)
                best.append(high)
                tokens.append(n)
            node = below
            path.append(node)
        return tokens[node]


@cache
def counts_of(vocabulary: str | None) -> Recent:
    """Words to their counts, in this process: later tasks of a worker find the vocabulary read and the cache filled."""
    trie = Trie(zipf_scores(load_pieces(vocabulary)))
    return Recent(lambda word: trie.count(MARK + word), CACHE)


COUNTS = "doc_id long, n_words long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each row's whole text; vocabulary: its file on the executors.

    Words are split at white space. NULL and empty texts have 0 of both. Rows that repeat each give a row; other columns are
    ignored; an empty table gives no rows. A very long word is one path of the trie.
    """
    require(docs, "doc_id", "text")

    def rows():
        known = counts_of(vocabulary)

        def each(columns: dict) -> Iterator[tuple]:
            for doc, text in zip(columns["doc_id"], columns["text"], strict=True):
                words = (text or "").split()
                yield doc, len(words), sum(map(known.__getitem__, words))

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, COUNTS)
