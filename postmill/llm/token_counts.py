"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, for pieces that start a word and for
pieces that continue one. A failure link says where matching goes on after the
longest pieces of a node's string are popped, and the node knows how many those
are, so a word's count is read off in one pass over its characters; pieces are
never built. A word that no sequence of pieces spells counts as one token.

Each distinct word of a batch is run once, all words abreast in numpy. Rows are
never shuffled; a worker holds the automaton and one slice of a batch.

Defined results: null or empty text has no words; rows are counted one by one,
so ties and repeated rows don't matter; an empty table gives no rows; other
columns are kept, whatever their names, except the struct `token_counts`.
"""

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.text import as_before, beside_text, slices

START, CONTINUE, NONE = 0, 1, -1
RESULT = "n_words bigint, n_tokens bigint, n_unknown bigint"


def pieces_of(model: str) -> tuple[list[str], list[str]]:
    """Pieces that start a word (without their mark) and that continue one, of a SentencePiece file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [
        m.id_to_piece(i)
        for i in range(m.get_piece_size())
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    ]
    starts = [p[1:] for p in plain if p.startswith("▁")]
    return [p for p in starts if p and "▁" not in p], [p for p in plain if "▁" not in p]


class Automaton:
    """`fail` and `popped` of each node; `count` runs words."""

    def __init__(self, starts: list[str], continues: list[str]):
        letters = sorted({c for p in (*starts, *continues) for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        edges: list[dict[int, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((START, starts), (CONTINUE, continues)):
            for piece in pieces:
                node = root
                for c in piece:
                    c = int(self.letter[ord(c)])
                    if c not in edges[node]:
                        edges[node][c] = len(edges)
                        edges.append({})
                    node = edges[node][c]
                ends.add(node)
        fail, popped = [NONE] * len(edges), [0] * len(edges)
        queue = deque([START, CONTINUE])
        while queue:
            parent = queue.popleft()
            for c, node in edges[parent].items():
                queue.append(node)
                if node in ends:
                    fail[node], popped[node] = CONTINUE, 1
                    continue
                at, count = fail[parent], popped[parent]
                while at != NONE and c not in edges[at]:
                    count += popped[at]
                    at = fail[at]
                if at != NONE:
                    fail[node], popped[node] = edges[at][c], count
        self.fail, self.popped = np.array(fail), np.array(popped)
        keys = np.array([node * self.width + c for node, out in enumerate(edges) for c in out], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array([t for out in edges for t in out.values()], dtype=np.int64)[order]

    def _step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Targets, or NONE."""
        want = nodes * self.width + letters
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.targets[at], NONE)

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each (not empty) word, and whether it is unknown."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        letters = self.letter[points].astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")  # words that are still running come first
        node = np.full(len(words), START, dtype=np.int64)
        tokens = np.zeros(len(words), dtype=np.int64)
        dead = np.zeros(len(words), dtype=bool)

        def pop(rows: np.ndarray) -> np.ndarray:
            """Follow the failure links of the rows; those that have one."""
            links = self.fail[node[rows]]
            dead[rows[links == NONE]] = True
            rows = rows[links != NONE]
            tokens[rows] += self.popped[node[rows]]
            node[rows] = self.fail[node[rows]]
            return rows

        running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        for at, still in enumerate(running):
            rows = order[:still]
            rows = rows[~dead[rows]]
            while len(rows):
                target = self._step(node[rows], letters[begins[rows] + at])
                node[rows[target != NONE]] = target[target != NONE]
                rows = pop(rows[target == NONE])
        rows = np.flatnonzero(~dead)
        while len(rows := rows[node[rows] != CONTINUE]):
            rows = pop(rows)
        return np.where(dead, 1, tokens), dead


@lru_cache(1)
def automaton(model: str) -> Automaton:
    return Automaton(*pieces_of(model))


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """`docs` with the struct `token_counts`: n_words, n_tokens, n_unknown (words)."""
    kept = beside_text(docs, "token_counts")
    out = T.StructType([*kept.schema.fields, T.StructField("token_counts", T.StructType.fromDDL(RESULT))])

    def count_batches(batches):
        machine = automaton(model)
        for whole in batches:
            for batch in slices(whole, "text", 32 << 20):
                split = pc.ascii_split_whitespace(batch.column("text").fill_null(""))
                coded = split.flatten().dictionary_encode()
                spelled = np.array(coded.dictionary.to_pylist(), dtype=object)
                filled = np.array([bool(w) for w in spelled], dtype=bool)
                tokens, unknown = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), bool)
                tokens[filled], unknown[filled] = machine.count(spelled[filled].tolist())
                word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
                sums = [
                    np.diff(np.concatenate([[0], np.cumsum(of[word])])[ends.astype(np.int64)])
                    for of in (filled.astype(np.int64), tokens, unknown.astype(np.int64))
                ]
                struct = pa.StructArray.from_arrays([pa.array(x) for x in sums], ["n_words", "n_tokens", "n_unknown"])
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, "token_counts"])

    return as_before(kept.mapInArrow(count_batches, out), docs, "token_counts")
