"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

A text is split where no vocabulary piece can cross (before a run of the
space mark and around line breaks). Inside a stretch, all adjacent pairs that
form a piece wait in a heap by rank; the lowest-rank, leftmost live pair is
merged in a doubly linked list and its new neighbours join the heap. A stretch
falls into parts where two neighbouring characters stand together in no piece:
no merge crosses there. The count is initial symbols minus merges, plus the extra bytes of symbols that the
vocabulary lacks; no identifiers are made. Counts of stretches and parts are
cached in tables of bounded size.
"""

from __future__ import annotations

import heapq
import re

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, map_rows

SPACE = "▁"
#: Texts whose count is compared with the library's when a model is loaded.
PROBES = ("", " ", "  a  b ", "The quick\n\nbrown\tfox", "naïve 你好 \U0001f600 x", "Å ﬁ 　y")


class PieceCounter:
    """Counts the tokens of texts for a sentencepiece BPE model.

    Supports what the model file must be for this: BPE, identity normaliser,
    a space mark before the text, byte fallback. Another kind of model raises
    ValueError (its counts of ``PROBES`` differ from the library's).
    """

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ranks):
            raise ValueError("a piece crosses a word or line start")
        self.joined = {p[i:i + 2] for p in ranks for i in range(len(p) - 1)}
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.cache = WordCache(self.count_stretch, 400_000)
        self.parts = WordCache(self.merge, 300_000)

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        ids.sort(key=lambda i: (-lib.get_score(i), i))
        counter = cls({lib.id_to_piece(i): r for r, i in enumerate(ids)})
        for text in PROBES:
            if counter.count(text) != len(lib.encode(text)):
                raise ValueError(f"{path}: not a byte-fallback BPE model without normaliser")
        return counter

    def __reduce__(self):
        return PieceCounter, (self.ranks,)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, self.stretch(SPACE + text.replace(" ", SPACE))))

    def count_stretch(self, stretch: str) -> int:
        """Sum over the parts between neighbours that no piece holds together."""
        joined, start, total = self.joined, 0, 0
        for i in range(1, len(stretch)):
            if stretch[i - 1:i + 1] not in joined:
                total += self.parts[stretch[start:i]]
                start = i
        return total + self.parts[stretch[start:]]

    def merge(self, part: str) -> int:
        rank, n = self.ranks.get, len(part)
        sym = list(part)
        live = [rank(part[i:i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts at each place
        live.append(-1)
        heap = [r << 32 | i for i, r in enumerate(live) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            least = pop(heap)
            i = least & 0xFFFFFFFF
            if live[i] != least >> 32:
                continue  # one of the two was merged meanwhile
            j = after[i]
            whole = sym[i] = sym[i] + sym[j]
            live[j], sym[j] = -1, ""
            merges += 1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                live[i] = r = rank(whole + sym[k], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                live[i] = -1
            if p >= 0:
                live[p] = r = rank(sym[p] + whole, -1)
                if r >= 0:
                    push(heap, r << 32 | p)
        return n - merges + sum(len(s.encode()) - 1 for s in sym if s and s not in self.ranks)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    Null texts count as empty: 0 bytes, 0 tokens. Null or repeated ids and
    repeated rows give one row each; other columns are ignored; an empty table
    gives an empty result. No shuffle: each task counts its own rows, and the
    vocabulary (as large as the model file) goes out as one broadcast.
    """
    counter = docs.sparkSession.sparkContext.broadcast(PieceCounter.load(model_path))

    def rows(source):
        count = counter.value.count
        for key, text, size in source:
            yield key, size, count(text)

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")),
                    rows, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
