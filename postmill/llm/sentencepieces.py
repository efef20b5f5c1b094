"""SentencePiece encoding and decoding by suffix-array matching.

For a model of kind BPE with byte fallback. A text, its blanks as marks and one
mark in front, falls apart before each mark, since no piece has a mark after
another character. The distinct parts of a batch are concatenated and indexed by
a suffix array; every piece is looked up in it by binary search, which gives the
range of its occurrences. Occurrences are edges between positions. They are
sorted by position and relaxed: an edge counts if its start is reached and the
merges of the model leave its piece next to the piece before it. Of each prefix
there is one such encoding, so the relaxed edges lead back from a part's end to
its pieces, the same ones that merging gives.

Characters without a piece become the pieces of their UTF-8 bytes. Runs of marks
merge last, all with equal scores; how a run of a length merges is worked out
once, by a queue.

A worker holds the model, a slice of a batch, and the index of at most
`INDEX_CHARS` characters (or of one longer part). Rows are never shuffled.

Defined results: null or empty text has no pieces and decodes to an empty text;
rows are encoded one by one, so ties and repeated rows don't matter; an empty
table gives no rows; other columns are kept, whatever their names, except the
struct `pieces`. A mark (U+2581) in a text is the same as a blank.
"""

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.text import as_before, beside_text, slices

MARK = "▁"
INDEX_CHARS = 250_000
RESULT = "n_pieces bigint, ids binary, decoded string"
NEVER = np.iinfo(np.int64).max


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Pieces:
    """A model's pieces, the merges behind them, and decoding tables."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(self.size)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.spelled = [b""] * self.size
        plain = []
        for i, name in enumerate(names):
            if m.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.spelled[i] = bytes([int(name[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                plain.append(i)
                self.spelled[i] = name.replace(MARK, " ").encode()
        self.id_of = {names[i]: i for i in plain}
        self.score = {names[i]: m.get_score(i) for i in plain}
        # A piece's rank: 0 merges first. Single characters are there from the start.
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.zeros(self.size, dtype=np.int64)
        self.right = np.zeros(self.size, dtype=np.int64)
        pairs, ranks = [], []
        self.edges = []  # pieces that merging can reach
        in_order = sorted((n for n in self.id_of if len(n) > 1), key=lambda n: -self.score[n])
        self.edges = [n for n in self.id_of if len(n) == 1]
        for rank, name in enumerate(in_order):
            if set(name) == {MARK}:
                continue
            parts, last = self.merge(name)
            if len(parts) == 1:
                i = self.id_of[name]
                self.rank[i], self.left[i], self.right[i] = rank, self.id_of[last[0]], self.id_of[last[1]]
                pairs.append(self.left[i] * self.size + self.right[i])
                ranks.append(rank)
                self.edges.append(name)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.array(pairs, np.int64)[order], np.array(ranks, np.int64)[order]
        self.longest = max(map(len, self.edges))
        self.edge_id = np.array([self.id_of[n] for n in self.edges], dtype=np.int64)
        self.edge_length = np.array([len(n) for n in self.edges], dtype=np.int64)
        self.edge_low = np.array(self.edges, dtype=f"U{self.longest}")
        self.edge_high = np.array([n + "\U0010ffff" * (self.longest - len(n)) for n in self.edges], dtype=f"U{self.longest}")
        self.length = np.ones(self.size, dtype=np.int64)
        self.length[self.edge_id] = self.edge_length
        self.decode_size = np.array([len(b) for b in self.spelled], dtype=np.int64)
        self.decode_start = np.cumsum(self.decode_size) - self.decode_size
        self.decode_bytes = np.frombuffer(b"".join(self.spelled), dtype=np.uint8)
        self.runs: dict[int, np.ndarray] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge the best-scored neighbours, the leftmost first, until none is a piece; the parts and the last merge."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (name := part[a] + part[b]) in self.score:
                heapq.heappush(queue, (-self.score[name], a, name))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        last = None
        while queue:
            _, a, name = heapq.heappop(queue)
            b = after[a]
            if not part[a] or b >= len(part) or part[a] + part[b] != name:
                continue
            last = (part[a], part[b])
            part[a], part[b] = name, ""
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p], last

    def run(self, length: int) -> np.ndarray:
        """Ids of a run of marks."""
        if length not in self.runs:
            self.runs[length] = np.array([self.id_of[p] for p in self.merge(MARK * length)[0]], dtype=np.int64)
        return self.runs[length]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces, NEVER if there is none."""
        want = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.pair_rank[at], NEVER)

    def stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbours as it is.

        Both pieces are taken apart again, latest merge first; nothing across
        the boundary may have merged before the merges that came after.
        """
        apart = np.ones(len(first), dtype=bool)
        rows, a, b = np.arange(len(first)), first, second
        until_a, until_b = np.full(len(first), NEVER), np.full(len(first), NEVER)
        rank = np.concatenate([self.rank, [-1]])  # characters without a piece come last
        while len(rows):
            across = self._pair_rank(a, b)
            joined = (across < until_a) & (across <= until_b)
            joined &= across != NEVER
            apart[rows[joined]] = False
            rank_a, rank_b = rank[np.minimum(a, self.size)], rank[np.minimum(b, self.size)]
            going = ~joined & ((rank_a >= 0) | (rank_b >= 0))
            rows, a, b, until_a, until_b, rank_a, rank_b = (x[going] for x in (rows, a, b, until_a, until_b, rank_a, rank_b))
            undo_a = rank_a > rank_b
            until_a, until_b = np.where(undo_a, rank_a, until_a), np.where(undo_a, until_b, rank_b)
            a = np.where(undo_a, self.right[np.minimum(a, self.size - 1)], a)
            b = np.where(undo_a, b, self.left[np.minimum(b, self.size - 1)])
        return apart

    def _index(self, words: list[str]):
        """Edges (position, piece) of all pieces in the concatenated words; a zero ends a word."""
        text = "\0".join(words) + "\0" * (self.longest + 1)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n = len(points) - self.longest
        windows = np.lib.stride_tricks.sliding_window_view(points, self.longest)[:n]
        # Suffixes are sorted as far as the longest piece, by doubling.
        order_of = np.unique(points, return_inverse=True)[1].astype(np.int64)
        reach = 1
        while reach < self.longest:
            ahead = np.zeros_like(order_of)
            ahead[:-reach] = order_of[reach:] + 1
            order_of = np.unique(order_of * (len(points) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        suffixes = np.argsort(order_of[:n], kind="stable")
        sorted_text = np.ascontiguousarray(windows[suffixes]).view(f"U{self.longest}").reshape(-1)
        low = np.searchsorted(sorted_text, self.edge_low, side="left")
        high = np.searchsorted(sorted_text, self.edge_high, side="right")
        counts = high - low
        return points, suffixes[ragged(low, counts)], np.repeat(self.edge_id, counts)

    def relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts `MARK + word`, concatenated, and their numbers; characters without a piece as size + code point."""
        parts = [MARK + w for w in words]
        points, position, piece = self._index(parts)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        begins = np.cumsum(lengths + 1) - lengths - 1
        inside = np.arange(begins[-1] + lengths[-1] + 1) - np.repeat(begins, lengths + 1)
        known = np.zeros(len(inside), dtype=bool)
        single = self.length[piece] == 1
        known[position[single]] = True
        bare = np.flatnonzero(~known & (inside < np.repeat(lengths, lengths + 1)))
        position = np.concatenate([position, bare])
        piece = np.concatenate([piece, self.size + points[bare].astype(np.int64)])
        offset = inside[position]
        order = np.argsort(offset, kind="stable")
        position, piece, offset = position[order], piece[order], offset[order]
        last = np.full(len(inside), -1, dtype=np.int64)
        cuts = np.searchsorted(offset, np.arange(offset[-1] + 2)) if len(offset) else np.zeros(1, np.int64)
        for k in range(len(cuts) - 1):
            at, of = position[cuts[k] : cuts[k + 1]], piece[cuts[k] : cuts[k + 1]]
            if k:
                before = last[at]
                good = before >= 0
                good[good] = self.stay_apart(before[good], of[good])
                at, of = at[good], of[good]
            last[at + self._width(of)] = of
        # Back from the ends, all words abreast.
        steps = []
        rows, at = np.arange(len(parts)), begins + lengths
        while len(rows):
            of = last[at]
            steps.append((rows, of))
            at = at - self._width(of)
            going = at > begins[rows]
            rows, at = rows[going], at[going]
        counts = np.zeros(len(parts), dtype=np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        ids = np.zeros(int(counts.sum()), dtype=np.int64)
        ends = np.cumsum(counts)
        for back, (rows, of) in enumerate(steps):
            ids[ends[rows] - 1 - back] = of
        return ids, counts

    def _width(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.size, self.length[np.minimum(ids, self.size - 1)], 1)

    def spell_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece replaced by their bytes' pieces."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, counts
        spelled = [chr(c).encode() for c in (ids[odd] - self.size).tolist()]
        widths = np.ones(len(ids), dtype=np.int64)
        widths[odd] = [len(b) for b in spelled]
        out = np.repeat(ids, widths)
        starts = np.cumsum(widths) - widths
        out[ragged(starts[odd], widths[odd])] = self.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        sums = np.concatenate([[0], np.cumsum(widths)])
        ends = np.cumsum(counts)
        return out, sums[ends] - sums[ends - counts]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `MARK + word` for each word, indexed piece by piece."""
        ids, counts, start, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for k, word in enumerate([*words, None]):
            if k > start and (word is None or held + len(word) > INDEX_CHARS):
                some, each = self.spell_bytes(*self.relax(words[start:k]))
                ids.append(some)
                counts.append(each)
                start, held = k, 0
            held += len(word or "") + 2
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and their numbers."""
        texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
        split = pc.split_pattern(texts, " ")
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        per_doc = np.where(some, pc.list_value_length(split).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flat = pc.list_flatten(split.filter(pa.array(some)))
        coded = flat.dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        full = np.array([bool(w) for w in spelled], dtype=bool)
        number = np.cumsum(full) - 1  # of the parts that aren't empty
        ids, counts = self.encode_words([w for w in spelled if w])
        starts = np.cumsum(counts) - counts
        # Empty parts are marks before the next part, or at the text's end.
        n, is_full = len(part), full[part]
        index = np.arange(n)
        ends = np.cumsum(per_doc)
        seen = np.maximum.accumulate(np.where(is_full, index, -1)) if n else index
        before = np.maximum(np.concatenate([[-1], seen[:-1]])[:n], np.repeat(ends - per_doc, per_doc) - 1)
        empties = index - before - 1
        at_end = np.zeros(n, dtype=bool)
        at_end[ends[per_doc > 0] - 1] = True
        take = is_full | at_end
        marks = np.where(is_full, empties, empties + 1)[take]
        code = np.where(is_full, number[part], -1)[take]
        owner = doc[take]
        plain = marks == 0
        kinds, kind = np.unique(np.stack([marks, code])[:, ~plain], axis=1, return_inverse=True)
        extra = [self._with_marks(int(m), int(c), ids, starts, counts) for m, c in kinds.T]
        pool = np.concatenate([ids, *extra])
        extra_sizes = np.array([len(x) for x in extra], dtype=np.int64)
        all_counts = np.concatenate([counts, extra_sizes])
        all_starts = np.cumsum(all_counts) - all_counts
        which = np.where(plain, code, 0)
        which[~plain] = len(counts) + kind.reshape(-1)
        sizes = all_counts[which]
        out = pool[ragged(all_starts[which], sizes)]
        return out, np.bincount(owner, weights=sizes, minlength=len(per_doc)).astype(np.int64)

    def _with_marks(self, marks: int, code: int, ids, starts, counts) -> np.ndarray:
        """A part with `marks` more marks before it; code -1: marks only."""
        if code < 0:
            return self.run(marks)
        own = ids[starts[code] : starts[code] + counts[code]]
        if own[0] == self.id_of[MARK]:  # the part's own mark is free to merge with the others
            return np.concatenate([self.run(marks + 1), own[1:]])
        return np.concatenate([self.run(marks), own])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of concatenated ids; the mark in front is dropped."""
        data = self.decode_bytes[ragged(self.decode_start[ids], self.decode_size[ids])].tobytes()
        sums = np.concatenate([[0], np.cumsum(self.decode_size[ids])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = sums[ends].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(at, at[1:])]


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """`docs` with the struct `pieces`: n_pieces, ids (uint32 little-endian), decoded (the text of the ids)."""
    kept = beside_text(docs, "pieces")
    out = T.StructType([*kept.schema.fields, T.StructField("pieces", T.StructType.fromDDL(RESULT))])

    def encode_batches(batches):
        machine = pieces(model)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                ids, counts = machine.encode(batch.column("text"))
                ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                struct = pa.StructArray.from_arrays(
                    [
                        pa.array(counts),
                        pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), data]),
                        pa.array(machine.decode(ids, counts), pa.string()),
                    ],
                    ["n_pieces", "ids", "decoded"],
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, "pieces"])

    return as_before(kept.mapInArrow(encode_batches, out), docs, "pieces")
