"""Token counts by greedy longest match in one pass over each word.

A trie of the vocabulary gets failure links in the manner of a linear
longest-match automaton: where a node has no child for the next byte, the
matcher drops the tokens that greedy matching would have closed by then and
goes on at the node for what is left.  How many tokens a link drops is worked
out beforehand, so counting never builds a piece and never reads a byte twice.

Words are counted once a slice, however often they occur in it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices, utf8, words

#: Where the query finds its vocabulary, unless the session names another in corvane.vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_WORDS = 200_000


def load_vocabulary(path: str) -> list[bytes]:
    """The byte strings of a vocabulary: base64 lines with ranks, or one token a line, or a JSON object of tokens."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".tiktoken"):
        return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]
    if path.endswith(".json"):
        parsed = json.loads(data)
        return [t.encode() for t in parsed.get("model", parsed).get("vocab", parsed)]
    return [line for line in data.splitlines() if line]


@dataclass
class Automaton:
    """step: (node << 8 | byte) -> node; link and dropped: what a node fails to and how many tokens that closes. Node 0 is the root, link -1 none."""

    step: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=list)
    dropped: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, vocabulary: list[bytes]) -> Automaton:
        step: dict[int, int] = {}
        token = [False]
        for t in vocabulary:
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in step:
                    step[key] = len(token)
                    token.append(False)
                node = step[key]
            token[node] = bool(t)
        link, dropped = [-1] * len(token), [0] * len(token)
        level = [(0, -1, -1)]  # (node, parent, byte), breadth first
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            below = []
            for node, parent, byte in level:
                if parent >= 0:
                    if token[node]:
                        link[node], dropped[node] = 0, 1
                    else:
                        at, count = link[parent], dropped[parent]
                        while at >= 0 and (at << 8 | byte) not in step:
                            count += dropped[at]
                            at = link[at]
                        if at >= 0:
                            link[node], dropped[node] = step[at << 8 | byte], count
                below += [(child, node, b) for b, child in children.get(node, ())]
            level = below
        return cls(step, link, dropped)

    def count(self, word: bytes) -> int:
        """Tokens of a word, or -1 if it can't be split into them."""
        step, link, dropped = self.step, self.link, self.dropped
        node = total = 0
        for b in word:
            while (after := step.get(node << 8 | b)) is None:
                total += dropped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = after
        while node:
            total += dropped[node]
            node = link[node]
            if node < 0:
                return -1
        return total


def counter(get: Callable[[], Automaton], lead: bytes, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = get(), {}
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off, 4 << 20):
                base = int(off[i])
                piece = buf[base : int(off[j])]
                h, s, e = words(piece, off[i + 1 : j] - base, lower=lower)
                _, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
                data, counts = piece.tobytes(), np.empty(len(sample), np.int64)
                if lower:
                    data = data.lower()
                for k, (a, b) in enumerate(zip(s[sample].tolist(), e[sample].tolist(), strict=True)):
                    word = data[a:b]
                    n = cache.get(word)
                    if n is None:
                        n = automaton.count(lead + word)
                        if len(word) <= 64:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            cache[word] = n
                    counts[k] = n
                per = counts[inverse]
                doc = np.searchsorted(off[i : j + 1] - base, s, "right") - 1
                sums = [np.bincount(doc, w, minlength=j - i).astype(np.int64) for w in (np.ones(len(per)), np.where(per < 0, 1, per), per < 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, sums)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary: list[bytes], lead: bytes = b" ", lower: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Words stand between ASCII white space; each is matched with ``lead`` in
    front, as byte-level vocabularies mark where a word begins.  A word that no
    sequence of tokens found greedily makes up counts as one token and as
    unknown.  A null or empty text has none; long texts and words are counted
    whole.  Repeated rows and rows without a doc_id get a row each, an empty
    table gives none; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counter(lambda: shared.value, lead, lower), "doc_id long, n_words long, n_tokens long, n_unknown long")
