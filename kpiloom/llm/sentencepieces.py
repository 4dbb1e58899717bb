"""SentencePiece encoding and decoding with a score-ordered agenda (operator 12).

A text is a chain of symbols. Every adjacent pair whose join is a piece of the
vocabulary waits in an agenda ordered by score, then by place from the left;
the best live pair is joined, and the pairs that the join makes with its
neighbours enter the agenda. When it is empty the symbols are the pieces; a
symbol that is no piece falls back to its bytes. No join crosses the start of
a word, so the texts of a batch are parted into words, each different word is
looked up or joined once, and the agendas of new short words are worked off
side by side, one join a word and step. Every text is encoded and decoded by
the sentencepiece library as well, and every row tells whether both agree.
"""

from __future__ import annotations

import codecs
import heapq
from array import array
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, small_batches

SPACE = "▁"
#: Texts on which a model must agree with the library when it is loaded.
PROBES = ("", " ", "  a  b ", "The quick\n\nbrown\tfox", "naïve 你好 \U0001f600 x", "Å ﬁ 　y", "▁ ▁a")
#: Symbols up to which agendas are worked off side by side, and the place of a pair that is no piece.
SHORT, NONE = 24, (1 << 31) - 1
#: Words whose agendas are worked off together.
SIDE_BY_SIDE = 4096
#: Words that are kept (twice, see ``PieceCodec._known``), and the bytes of the longest.
WORDS, LONGEST = 400_000, 64
#: Characters of text that are encoded together; bounds the ids that a task holds.
BATCH_CHARS = 2_000_000
#: Characters of long or strange words that are parted together.
PART_CHARS = 100_000

# one replacement character for each byte that is no part of a character
codecs.register_error("kpiloom.bytewise", lambda e: ("�" * (e.end - e.start), e.end))


class PairTable:
    """Piece that two pieces make side by side, for arrays of them at a time; -1 for none."""

    def __init__(self, pairs: dict[tuple[int, int], int], n: int):
        self.n = n
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.pieces = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        pieces, slot = np.array([*pairs.values()], np.int32), self._slot(keys)
        while len(keys):  # of pairs that want a slot one gets it, the others try the next
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            got = self.keys[slot] == keys
            self.pieces[slot[got]] = pieces[got]
            keys, pieces, slot = keys[~got], pieces[~got], slot[~got] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n + right
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.pieces[slot], np.int32(-1))
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):  # slots of other pairs are passed
            slot[todo] = slot[todo] + 1 & self.mask
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.pieces[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class PieceCodec:
    """Encoder and decoder of a merge-type (BPE) sentencepiece model.

    The model must leave texts as they are but for a space mark before them,
    and have byte fallback; another kind raises ValueError, told by ``PROBES``.
    """

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self._prepare(lib)
        for text in PROBES:
            want = lib.encode(text)
            if self.encode(text).tolist() != want or self.decode(want) != lib.decode(want):
                raise ValueError(f"{path}: not a byte-fallback BPE model without normaliser")

    def _prepare(self, lib) -> None:
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        scores = sorted({lib.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: piece -> place of its score (equal scores share one) and id
        self.order = {lib.id_to_piece(i): place[lib.get_score(i)] for i in plain}
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        values = {i: b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else None for i in range(n)}
        for b, i in self.byte.items():
            values[i] = bytes([b])
        for p, i in self.ids.items():
            values[i] = p.replace(SPACE, " ").encode()
        self.values = [values[i] for i in range(n)]
        self.controls = {i for i in range(n) if lib.is_control(i)}
        self.marked = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        # a join never crosses the start of a word or line unless a piece does
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        #: neighbours within a piece -> place of the two as a piece
        self.joined = {p[i:i + 2]: self.order.get(p[i:i + 2], NONE) for p in self.ids for i in range(len(p) - 1)}
        #: piece -> id in the bytes that ids are kept in
        self.packed = {p: array("i", (i,)).tobytes() for p, i in self.ids.items()}
        #: piece of a character, -1 for none; place of a piece; the piece of two
        self.letter = np.full(0x110000, -1, np.int32)
        self.place = np.full(n, NONE, np.int32)
        for p, i in self.ids.items():
            self.place[i] = self.order[p]
            if len(p) == 1:
                self.letter[ord(p)] = i
        halves = ((p[:k], p[k:], i) for p, i in self.ids.items() for k in range(1, len(p)))
        self.pairs = PairTable({(self.ids[a], self.ids[b]): i for a, b, i in halves if a in self.ids and b in self.ids}, n + 1)
        self.texts = pa.array(self.values, pa.large_binary())
        self.is_control, self.is_marked = (np.isin(np.arange(n), list(x)) for x in (self.controls, self.marked))
        self.held, self.older = {}, {}

    def __getstate__(self):
        return self.library.serialized_model_proto()

    def __setstate__(self, proto):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._prepare(self.library)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends in them."""
        marked = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
        ends, whole = np.cumsum([*map(len, marked)], dtype=np.int64), b"".join(marked)
        if not whole:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(whole, np.uint8)
        starts = np.zeros(len(data) + 1, bool)
        starts[0] = starts[ends] = True
        if self.by_words:  # a word starts at its first space mark, a line feed stands alone
            space, feed = data == 32, data == 10
            starts[1:-1] |= space[1:] > space[:-1]
            starts[:-1] |= feed
            starts[1:] |= feed
        starts = np.flatnonzero(starts)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(whole)]).dictionary_encode()
        taken = pa.array(self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
        return np.frombuffer(taken.buffers()[2], np.int32, at[-1]), at[np.searchsorted(starts, ends)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, in which spaces stand for space marks.

        Two generations of words are kept; when the young one is full the old one goes, so frequent words stay.
        """
        out = list(map(self.held.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        absent = [words[k] for k in missing]
        told = dict(zip(absent, map(self.older.get, absent), strict=True))
        new = [w for w, ids in told.items() if ids is None]
        told.update(zip(new, self._new(new), strict=True))
        for k, w in zip(missing, absent, strict=True):
            out[k] = ids = told[w]
            if len(w) <= LONGEST:
                self.held[w] = ids
        if len(self.held) >= WORDS:
            self.held, self.older = {}, self.held
        return out

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: the short ones of known characters side by side, others part by part."""
        texts = [w.decode().replace(" ", SPACE) for w in words]
        out: list[bytes | None] = [None] * len(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        letters = self.letter[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        start = np.cumsum(size) - size
        unknown = np.concatenate(([0], np.cumsum(letters < 0)))
        short = np.flatnonzero((size <= SHORT) & (unknown[start + size] == unknown[start]))
        short = short[np.argsort(size[short], kind="stable")]
        for a in range(0, len(short), SIDE_BY_SIDE):
            some = short[a:a + SIDE_BY_SIDE]
            self._agendas(letters, start[some], size[some], some, out)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for a, b in _slices([texts[k] for k in rest], PART_CHARS):
            parts = [self._parts(texts[k]) for k in rest[a:b]]
            known = iter(self._known([p.replace(SPACE, " ").encode() for some in parts if len(some) > 1 for p in some]))
            for k, some in zip(rest[a:b], parts, strict=True):
                out[k] = b"".join(islice(known, len(some))) if len(some) > 1 else self._agenda(some[0])
        return out

    def _agendas(self, letters, start, size, rows, out) -> None:
        """Joins the characters of short words side by side: in each step the best pair of every word, leftmost first."""
        end, width = len(self.place), int(size.max())
        inside = np.arange(width) < size[:, None]
        symbol = np.full((len(size), width + 1), end, np.int32)  # behind each word a symbol that joins with nothing
        symbol[:, :-1][inside] = letters[(start[:, None] + np.arange(width))[inside]]
        whole = self.pairs(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(len(size), width)
        place = np.where(whole >= 0, self.place[whole], NONE)
        while True:
            i = place.argmin(1)
            every = np.arange(len(i))
            live = place[every, i] < NONE
            if not live.all():
                done = ~live
                ids, n = symbol[done], size[done]
                packed, step = ids.tobytes(), 4 * ids.shape[1]
                for k, (row, m) in enumerate(zip(rows[done].tolist(), n.tolist(), strict=True)):
                    out[row] = packed[k * step:k * step + 4 * m]
                if done.all():
                    return
                symbol, whole, place, size, rows, i = symbol[live], whole[live], place[live], size[live], rows[live], i[live]
                every = np.arange(len(i))
            symbol[every, i] = whole[every, i]
            # the right half and the joined pair go from every row, so that rows stay equally long
            keep = np.ones(symbol.shape, bool)
            keep[every, i + 1] = False
            symbol = symbol[keep].reshape(len(i), -1)
            keep[every, i + 1], keep[every, i] = True, False
            whole, place = whole[keep[:, :-1]].reshape(len(i), -1), place[keep[:, :-1]].reshape(len(i), -1)
            size = size - 1
            inner = i > 0
            row, k = np.concatenate((every[inner], every)), np.concatenate((i[inner] - 1, i))
            whole[row, k] = made = self.pairs(symbol[row, k], symbol[row, k + 1])
            place[row, k] = np.where(made >= 0, self.place[made], NONE)

    def _parts(self, word: str) -> list[str]:
        """A word, parted between neighbours that no piece holds together."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in joined]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _agenda(self, part: str) -> bytes:
        """Ids of a long or strange part; its agenda is a heap."""
        place_of, n = self.order.get, len(part)
        symbol = list(part)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # waiting[i]: place of the pair that starts at i, -1 for none; an entry of the agenda that differs is out of date
        waiting = [place_of(part[i:i + 2], -1) for i in range(n - 1)]
        waiting.append(-1)
        agenda = [place << 32 | i for i, place in enumerate(waiting) if place >= 0]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            best = pop(agenda)
            i = best & 0xFFFFFFFF
            if waiting[i] != best >> 32:
                continue
            j = right[i]
            whole = symbol[i] = symbol[i] + symbol[j]
            symbol[j], waiting[j] = "", -1
            right[i] = k = right[j]
            place = -1
            if k < n:
                left[k] = i
                place = place_of(whole + symbol[k], -1)
                if place >= 0:
                    push(agenda, place << 32 | i)
            waiting[i] = place
            h = left[i]
            if h >= 0:
                waiting[h] = place = place_of(symbol[h] + whole, -1)
                if place >= 0:
                    push(agenda, place << 32 | h)
        return self._out(filter(None, symbol))

    def _out(self, symbols) -> bytes:
        """Ids of symbols; one that is no piece falls back to its bytes."""
        symbols = list(symbols)
        try:
            return b"".join(map(self.packed.__getitem__, symbols))
        except KeyError:
            pass
        out, known = [], self.ids
        for s in symbols:
            if s in known:
                out.append(known[s])
            else:
                out += [self.byte[b] for b in s.encode()]
        return array("i", out).tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, the space mark before the text taken off, stray bytes replaced.

        Control pieces have no text, but bytes on both sides of one do not make a character.
        """
        told, start, spans = ids, 0, []
        for i in [k for k, x in enumerate(told) if x in self.controls] if self.controls.intersection(told) else ():
            spans.append(told[start:i])
            start = i + 1
        spans.append(told[start:])
        first = next((k for k, span in enumerate(spans) if span), None)
        if first is None:
            return ""
        texts = [b"".join(map(self.values.__getitem__, span)).decode("utf-8", "kpiloom.bytewise") for span in spans]
        if texts[first][:1] == " " and spans[first][0] in self.marked:
            texts[first] = texts[first][1:]
        return "".join(texts)


    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other, each up to its end."""
        taken = self.texts.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        data = memoryview(taken.buffers()[2] or b"")
        control = self.is_control[ids]
        out, start = [], 0
        for end in ends.tolist():
            if control[start:end].any():
                out.append(self.decode(ids[start:end].tolist()))
            else:
                text = str(data[at[start]:at[end]], "utf-8", "kpiloom.bytewise")
                out.append(text[1:] if start < end and self.is_marked[ids[start]] and text[:1] == " " else text)
            start = end
        return out


def _slices(texts: list[str], most: int | None = None):
    """Ranges of rows with about ``most`` characters (``BATCH_CHARS``) each."""
    most = most or BATCH_CHARS
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array<int>), ``decoded`` and ``agrees`` of every row's whole text.

    ``agrees`` tells whether the library gives the same ids and the same
    decoded text. Null and empty texts give no ids and an empty text. Null or
    repeated ids and repeated rows give one row each; other columns are
    ignored, whatever their names; an empty table gives an empty result. No
    shuffle; the model (as large as its file) goes out as one broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    codec = spark.sparkContext.broadcast(PieceCodec(model_path))
    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, ids array<int>, decoded string, agrees boolean"

    def run(batches):
        c = codec.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                part = texts[a:b]
                ids, ends = c.encode_all(part)
                decoded = c.decode_all(ids, ends)
                told = np.split(ids, ends[:-1])
                # a text at a time is quicker than the library's batches, which start threads
                want = [c.library.encode(t, return_type="numpy") for t in part]
                back = list(map(c.library.decode, told))
                agrees = [x.tobytes() == w.tobytes() and d == t for x, w, d, t in zip(told, want, decoded, back, strict=True)]
                lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists, pa.array(decoded, pa.string()), pa.array(agrees)],
                    names=[id_col, "ids", "decoded", "agrees"])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col), text).mapInArrow(run, schema)
