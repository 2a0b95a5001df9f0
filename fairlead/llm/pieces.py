r"""SentencePiece encoding and decoding by a forward pass that common prefixes share.

Texts are cut into marked words (runs of the space mark and what follows up to
the next mark; no piece crosses such a border, which is checked when a model is
loaded). The distinct new words of a batch are sorted and walked depth-first as
in a trie: the forward state of every character of the last word is on a stack,
a word keeps the states of the prefix it shares and only adds the rest. A state
holds the matches that run through it and the best way to end there.

Unigram models: the state has the best score, as in any Viterbi search. Merge
(BPE) models, as the public model is: the pieces of a prefix are a prefix of
pieces only up to its end, so summed scores would give other ids than the model
defines. Their state holds the last piece of the prefix's own segmentation; of
all pieces that end there exactly one goes with the piece before it, and whether
two neighbours go together follows from the order of merges. Both kinds share
the walk, and the ids are those of the public library.

Defined results: an empty text has no ids, a null text has null. A text that
holds the space mark itself (U+2581) decodes to spaces there. Characters without
a piece become their bytes, or the unknown id where the model has no bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, table
from fairlead.llm.tokens import list_array, small_batches

MARK = "▁"
#: Words (and neighbouring pieces) a Python worker remembers before it starts anew, and those it
#: keeps for its next task; they bound memory, not results.
REMEMBERED = 200_000
KEPT = 50_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NO_RANK = -1.0
_END = ""


@dataclass
class Vocabulary:
    """Pieces with scores; ``kinds``: n(ormal), b(yte), u(nknown), c(ontrol)."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    merges: bool
    dummy_prefix: bool = True
    trie: dict = field(default=None, repr=False)

    def __getstate__(self):
        return (self.pieces, self.scores, self.kinds, self.merges, self.dummy_prefix)

    def __setstate__(self, state):
        self.pieces, self.scores, self.kinds, self.merges, self.dummy_prefix = state
        self.trie = None

    def prepare(self) -> "Vocabulary":
        """Tables of the walk, built once per worker."""
        if self.trie is not None:
            return self
        normal = [i for i, k in enumerate(self.kinds) if k == "n"]
        self.ids = {self.pieces[i]: i for i in normal}
        self.trie = {}
        for i in normal:
            node = self.trie
            for c in self.pieces[i]:
                node = node.setdefault(c, {})
            node[_END] = i
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == "b"}
        self.unknown = self.kinds.find("u")
        self.surface = [b""] * len(self.pieces)
        for i in normal:
            self.surface[i] = self.pieces[i].replace(MARK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.plain_lines = self.dummy_prefix and not any("\n" in self.pieces[i] for i in normal)
        self.floor = min((self.scores[i] for i in normal), default=0.0) - 10
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        if self.merges:
            self.rank = [_NO_RANK] * len(self.pieces)
            self.halves: list[tuple[int, int] | None] = [None] * len(self.pieces)
            self.whole = [False] * len(self.pieces)
            for i in normal:
                if len(self.pieces[i]) == 1:
                    self.whole[i] = True
                    continue
                self.rank[i] = -self.scores[i]
                ends, last = self._merge(self.pieces[i])
                self.whole[i] = len(ends) == 1
                if self.whole[i]:
                    self.halves[i] = tuple(self.ids[h] for h in last)
        return self

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Segmentation by merging the best neighbours, leftmost first; the last merge too."""
        parts: list[str | None] = list(word)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            last = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None], last

    def _go_together(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when their joined text is merged.

        Merges are undone at the border, the latest first; a merge across the
        border that would have come before the undone one joins them.
        """
        key = a << 20 | b
        found = self.fits.get(key)
        if found is not None:
            return found
        limit, at_left = float("inf"), False
        result = None
        while result is None:
            joined = self.ids.get(self.pieces[a] + self.pieces[b])
            if joined is not None:
                r = -self.scores[joined]
                # Of equal ranks the left one is merged first.
                if r < limit or (r == limit and not at_left):
                    result = False
                    break
            if self.halves[a] is None and self.halves[b] is None:
                result = True
            elif self.halves[b] is None or (self.halves[a] is not None and self.rank[a] > self.rank[b]):
                limit, at_left, a = self.rank[a], True, self.halves[a][1]
            else:
                limit, at_left, b = self.rank[b], False, self.halves[b][0]
        self.fits[key] = result
        return result

    def _spelled(self, c: str) -> list[int]:
        if self.byte_ids:
            return [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
        return [self.unknown]

    def learn(self, words: set[str]) -> None:
        """Ids of new distinct words, in one depth-first walk."""
        walk = self._last_pieces() if self.merges else self._best_sums()
        for word in sorted(words):
            if self.merges and word.startswith(MARK + MARK):
                # Runs of marks have pieces of equal rank, where only the order of merging decides.
                parts = self._merge(word)[0]
                ids = [i for p in parts for i in ([self.ids[p]] if p in self.ids else self._spelled(p))]
            else:
                ids = walk(word)
            self.known[word] = array("i", ids).tobytes()

    @staticmethod
    def _shared(word: str, previous: str) -> int:
        """Length of the common prefix; near the end for most neighbours in order."""
        n = min(len(word), len(previous))
        if n > 64:
            return next((i for i in range(n) if word[i] != previous[i]), n)
        while word[:n] != previous[:n]:
            n -= 1
        return n

    def _back(self, word: str, begins: list[int], pieces: list[int]) -> list[int]:
        ids: list[int] = []
        at = len(word)
        while at:
            begin, piece = begins[at], pieces[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed(self._spelled(word[begin:at]))
            at = begin
        ids.reverse()
        return ids

    def _last_pieces(self) -> Callable[[str], list[int]]:
        """Walk of a merge model; the state of a prefix is its last piece (-1: a bare character)."""
        root, whole, fits, go_together = self.trie, self.whole, self.fits, self._go_together
        previous = ""
        # By depth: matches that run on, and where the last piece begins.
        running: list[list] = [[]]
        begins, last = [0], [-1]

        def walk(word: str) -> list[int]:
            nonlocal previous
            shared = self._shared(word, previous)
            previous = word
            del running[shared + 1 :], begins[shared + 1 :], last[shared + 1 :]
            for at in range(shared, len(word)):
                c = word[at]
                now, best, best_begin = [], -1, at
                for begin, node in (*running[at], (at, root)):
                    node = node.get(c)
                    if node is None:
                        continue
                    now.append((begin, node))
                    # Exactly one piece goes with the one before it.
                    if best < 0 and (piece := node.get(_END)) is not None and whole[piece]:
                        before = last[begin]
                        if before >= 0:
                            fit = fits.get(before << 20 | piece)
                            if not (go_together(before, piece) if fit is None else fit):
                                continue
                        best, best_begin = piece, begin
                running.append(now)
                begins.append(best_begin)
                last.append(best)
            return self._back(word, begins, last)

        return walk

    def _best_sums(self) -> Callable[[str], list[int]]:
        """Walk of a unigram model; the state of a prefix is its best sum of scores."""
        root, scores, floor = self.trie, self.scores, self.floor
        previous = ""
        running: list[list] = [[]]
        begins, last, sums = [0], [-1], [0.0]

        def walk(word: str) -> list[int]:
            nonlocal previous
            shared = self._shared(word, previous)
            previous = word
            del running[shared + 1 :], begins[shared + 1 :], last[shared + 1 :], sums[shared + 1 :]
            for at in range(shared, len(word)):
                c = word[at]
                now, best, best_begin, best_sum = [], -1, at, float("-inf")
                for begin, node in (*running[at], (at, root)):
                    node = node.get(c)
                    if node is None:
                        continue
                    now.append((begin, node))
                    piece = node.get(_END)
                    if piece is not None and sums[begin] + scores[piece] > best_sum:
                        best, best_begin, best_sum = piece, begin, sums[begin] + scores[piece]
                if _END not in root.get(c, ()) and sums[at] + floor > best_sum:
                    best, best_begin, best_sum = -1, at, sums[at] + floor
                running.append(now)
                begins.append(best_begin)
                last.append(best)
                sums.append(best_sum)
            return self._back(word, begins, last)

        return walk

    def rest(self) -> None:
        """Forget all but the first words, which are the common ones, as the worker may turn to other work."""
        self.known = dict(islice(self.known.items(), KEPT))
        if len(self.fits) > REMEMBERED:
            self.fits = dict(islice(self.fits.items(), KEPT))

    def words(self, text: str) -> list[str]:
        """The marked words of a text; one blank between words is the common case.

        No piece holds a line feed, so it is a word of its own there.
        """
        if self.plain_lines and MARK not in text and "  " not in text and text[0] != " ":
            out: list[str] = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                if out:
                    out.append("\n")
                    if first:
                        out.append(first)
                else:
                    out.append(MARK + first)
                out += [MARK + w for w in rest]
            return out
        return _WORD.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; None and empty texts have none."""
        out = []
        for at in range(0, len(texts), 256):
            cut = [self.words(t) if t else [] for t in texts[at : at + 256]]
            new = set().union(*cut).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.rest()
                new = set().union(*cut).difference(self.known)
            self.learn(new)
            known = self.known
            out += [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]
        return out

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(model_path: str | None = None) -> Vocabulary:
    """Vocabulary of a model file, by default the installed public one."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    if model_path is None:
        import public_tokenizers

        model_path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as source:
        model.ParseFromString(source.read())
    names = {1: "n", 2: "u", 3: "c", 4: "n", 5: "c", 6: "b"}
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    if model.trainer_spec.model_type not in (1, 2) or not plain or any(p.type == 4 for p in model.pieces):
        raise ValueError("only unigram and merge models without text normalization are supported")
    if any(p.type == 1 and re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces):
        raise ValueError("a piece crosses a word border")
    return Vocabulary(
        [p.piece for p in model.pieces],
        [p.score for p in model.pieces],
        "".join(names[p.type] for p in model.pieces),
        model.trainer_spec.model_type == 2,
        rules.add_dummy_prefix,
    )


def _tokens_array(texts: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    lists = list_array(ids, pa.int32())
    if not texts.null_count:
        return lists
    import pyarrow.compute as pc

    return pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False
) -> DataFrame:
    """Rows id, tokens; with ``check`` also round_trip: whether decoding gives the text back (null for null)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        for batch in small_batches(batches):
            texts = batch.column(1)
            given = texts.to_pylist()
            ids = words.encode(given)
            columns, names = [batch.column(0), _tokens_array(texts, ids)], ["id", "tokens"]
            if check:
                same = [None if t is None else words.decode(i) == t for t, i in zip(given, ids)]
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)
        words.rest()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, tokens array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Rows id, text; null tokens give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        for batch in batches:
            texts = [None if t is None else words.decode(np.array(t, np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{tokens_col}`").alias("tokens"))
    return rows.mapInArrow(run, "id bigint, text string")


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), load(), check=True)
    n = F.coalesce(F.size("tokens"), F.lit(0)).cast("bigint")
    return encoded.select(F.col("id").alias("doc_id"), n.alias("n_tokens"), "tokens", "round_trip")
