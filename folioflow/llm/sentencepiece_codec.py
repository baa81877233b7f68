"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text follows the automaton; at each position the output links list
every piece that ends there, and each relaxes the best segmentation of the prefix:

* in a unigram model by score (Viterbi): best[end] = max of best[end - length] + score;
* in a BPE model scores are merge ranks, whose sum means nothing; there the last piece of
  a prefix is the longest one that merging leaves intact next to the last piece of the
  rest, which gives the same pieces as merging the whole text.

No piece holds a character followed by the space mark, so texts are cut there and each
distinct stretch is encoded once as long as a worker remembers it; the ids of a slice of
texts are then gathered by the numbers of their stretches.  Decoding joins what stretches
decode to, so a round trip is verified on stretches, and by their lengths on whole texts.

Models of the formats of ``*.model`` files are read here: identity normalisation only (any
other is refused), with dummy prefix, byte fallback and user-defined symbols as the model
says.  The file is read once, on the driver, and its bytes are sent to the tasks.

Defined cases: null and empty texts give no ids and decode to empty strings; characters
that no piece covers become bytes (or the unknown id, which decodes to " ⁇ "); a text
that itself contains the space mark decodes with spaces there; repeated rows give
equal rows; further columns pass through, ``ids`` and ``n_tokens`` are replaced.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ._arrow import map_slices
from ._common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Steps between automaton nodes and pairs of pieces that a worker remembers.
CACHE = 60_000
#: Stretches, and ids of stretches, that a worker remembers before it forgets them all; longer ones it never remembers.
STRETCHES, STRETCH_IDS, LONG = 300_000, 3_000_000, 200
#: Characters of the texts whose ids are held at a time (a longer text is held by itself).
SLICE = 250_000
#: Texts decoded at a time.
DECODED = 500
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: The rank of what is no piece.
UNRANKED = 1 << 30


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, 4- or 8-byte blocks, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class Codec:
    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normalizer.get(2):
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED)}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        codes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes = [codes[b] for b in range(256)] if len(codes) == 256 and trainer.get(35, 0) else None
        normal = [self.scores[i] for i in self.ids.values()]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        show = {CONTROL: "", UNKNOWN: " ⁇ "}
        self._texts = [show.get(k, p.replace(SPACE, " ")) for p, k in zip(self.pieces, self.kinds)]
        self._byte = {i: b for b, i in enumerate(self.bytes or ())}
        places = {score: at for at, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        #: The order of merges in a BPE model, and the two parts of each piece that has been asked for.
        self.rank = {p: places[self.scores[i]] for p, i in self.ids.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self._build()
        self._cutter()
        self.forget()
        self.steps = 0
        self.pairs: dict[int, bool] = {}

    def _build(self) -> None:
        """Goto, failure and output links; a node's output is the piece it spells, if any."""
        self.next: list[dict[str, int]] = [{}]
        self.output: list[str | None] = [None]
        for piece in self.ids:
            node = 0
            for c in piece:
                step = self.next[node].get(c)
                if step is None:
                    step = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.output.append(None)
                node = step
            self.output[node] = piece
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                queue.append(child)
            back = self.fail[node]  # a shorter suffix, so its own links are known
            self.link[node] = back if self.output[back] is not None else self.link[back]

        self.outputs: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.next)

    def _cutter(self) -> None:
        """How texts are cut into stretches that no piece crosses."""
        self.symbols = {p for p, i in self.ids.items() if self.kinds[i] == USER_DEFINED}
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        stop = re.escape(SPACE + alone)
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        cut = rf"[\s\S]+" if joined else rf"{SPACE}*[^{stop}]+|{SPACE}+" + (f"|[{re.escape(alone)}]" if alone else "")
        self.cut = re.compile(cut)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.symbols, key=len, reverse=True))) + ")") if self.symbols else None

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece's characters joins, if merging (best score first, then
        leftmost) gives the piece at all."""
        if piece in self.halves:
            return self.halves[piece]
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            ranks = [rank.get(a + b, UNRANKED) for a, b in zip(parts, parts[1:])]
            at = ranks.index(min(ranks))
            if ranks[at] == UNRANKED:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = self.halves[piece] = tuple(parts) if len(parts) == 2 else None
        return found

    def _outputs(self, node: int) -> tuple[tuple[int, int], ...]:
        """(id, length) of the pieces that end at a node, longest first, by its output links."""
        out = []
        at = node if self.output[node] is not None else self.link[node]
        while at:
            piece = self.output[at]
            # in a BPE model, a piece that merging its own characters does not give never occurs
            if self.kind == UNIGRAM or len(piece) == 1 or self._halves(piece):
                out.append((self.ids[piece], len(piece)))
            at = self.link[at]
        self.outputs[node] = tuple(out)
        return self.outputs[node]

    def _segment(self, text: str) -> list[int]:
        """Ids of the pieces of a stretch in one pass, read off backwards; -1 - code point where none fits."""
        return self._by_score(text) if self.kind == UNIGRAM else self._by_merges(text)

    def _by_score(self, text: str) -> list[int]:
        # single precision, as models are scored elsewhere: it decides between sums that are equal but for rounding
        best, last, node = [np.float32(0)], [(0, 0)], 0
        for end, c in enumerate(text, 1):
            step = self.next[node].get(c)
            node = self._step(node, c) if step is None else step
            outputs = self.outputs[node]
            top, choice = None, None
            for i, size in self._outputs(node) if outputs is None else outputs:
                score = best[end - size] + np.float32(self.scores[i])
                if top is None or score > top:
                    top, choice = score, (i, size)
            if top is None or choice[1] > 1 and c not in self.ids and best[end - 1] + np.float32(self.unknown_score) > top:
                top, choice = best[end - 1] + np.float32(self.unknown_score), (-1 - ord(c), 1)
            best.append(top)
            last.append(choice)
        return self._read_off(last)

    def _step(self, node: int, c: str) -> int:
        """The node after a character that leaves the trie: along failure links, remembered for the next time."""
        back = node
        while back and c not in self.next[back]:
            back = self.fail[back]
        step = self.next[back].get(c, 0)
        if self.steps < CACHE:
            self.steps += 1
            self.next[node][c] = step
        return step

    def _by_merges(self, text: str) -> list[int]:
        following, every, pairs = self.next, self.outputs, self.pairs
        ids, sizes = [0], [0]
        node = end = 0
        for c in text:
            end += 1
            step = following[node].get(c)
            node = self._step(node, c) if step is None else step
            outputs = every[node]
            for i, size in self._outputs(node) if outputs is None else outputs:
                if size == end:
                    break
                left = ids[end - size]
                intact = pairs.get((left << 24) + i)
                if intact is None:
                    intact = self._intact(left, i)
                if intact:
                    break
            else:
                # single characters are whole by themselves, whatever is before them
                i, size = self.ids.get(c, -1 - ord(c)), 1
            ids.append(i)
            sizes.append(size)
        out = []
        while end:
            out.append(ids[end])
            end -= sizes[end]
        out.reverse()
        return out

    def _intact(self, left: int, right: int) -> bool:
        """Whether merging two pieces' characters gives the two pieces.

        The merges are undone from the last one back: a merge across the border spoils the pieces if it comes
        before the merge undone last (of equal ones the leftmost comes first)."""
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        a, b, limit = self.pieces[left] if left >= 0 else chr(-1 - left), self.pieces[right], UNRANKED
        rank = self.rank
        while True:
            if rank.get(a + b, UNRANKED) < limit:
                intact = False
                break
            of_a, of_b = rank[a] if len(a) > 1 else -1, rank[b] if len(b) > 1 else -1
            if of_a > of_b:
                a, limit = self._halves(a)[1], of_a
            elif of_b >= 0:
                b, limit = self._halves(b)[0], of_b + 1
            else:
                intact = True
                break
        self.pairs[(left << 24) + right] = intact
        return intact

    @staticmethod
    def _read_off(last: list[tuple[int, int]]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            i, size = last[end]
            out.append(i)
            end -= size
        return out[::-1]

    def forget(self) -> None:
        """The number of each remembered stretch; by number: first place and count of its ids, whether they decode to it."""
        self.number: dict[str, int] = {}
        self.first, self.count, self.whole = array("q"), array("q"), array("b")
        self.ids_of = array("i")

    def _numbers(self, stretch: str) -> list[int]:
        if stretch in self.symbols:
            return [self.ids[stretch]]
        found = self._segment(stretch)
        if not found or min(found) >= 0:
            return found
        out: list[int] = []
        for i in found:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _new(self, stretch: str) -> int:
        ids = self._numbers(stretch)
        number = len(self.first)
        self.first.append(len(self.ids_of))
        self.count.append(len(ids))
        self.whole.append(self._joined(ids) == stretch.replace(SPACE, " "))
        self.ids_of.extend(ids)
        if len(stretch) < LONG:
            self.number[stretch] = number
        return number

    def _stretches(self, text: str | None) -> tuple[list[str], bool]:
        """The stretches of a text, and whether they are the whole text."""
        if not text:
            return [], True
        whole = SPACE not in text
        if self.squeeze:
            squeezed = re.sub(" +", " ", text.strip(" "))
            text, whole = squeezed, whole and squeezed == text
            if not text:
                return [], whole
        text = (" " + text if self.dummy_prefix else text).replace(" ", SPACE)
        if not self.split:
            parts = self.cut.findall(text)
        else:
            parts = []
            for part in self.split.split(text):
                parts += [part] if part in self.symbols else self.cut.findall(part)
        return parts, whole and sum(map(len, parts)) == len(text)

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, the place where each text's ids end, and whether they decode to it."""
        if len(self.number) > STRETCHES or len(self.ids_of) > STRETCH_IDS:
            self.forget()
        stretches: list[str] = []
        ends, whole = [], []
        for t in texts:
            parts, same = self._stretches(t)
            stretches += parts
            ends.append(len(stretches))
            whole.append(same)
        numbers = list(map(self.number.get, stretches))
        for at, n in enumerate(numbers):
            if n is None:
                n = self.number.get(stretches[at])
                numbers[at] = self._new(stretches[at]) if n is None else n
        of = np.array(numbers, np.int64)
        count = np.array(self.count, np.int64)[of]
        stop = np.cumsum(count)
        place = np.repeat(np.array(self.first, np.int64)[of] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
        ids = np.array(self.ids_of, np.int32)[place]
        wrong = np.r_[0, np.cumsum(np.array(self.whole, np.int8)[of] == 0)]
        ends = np.array(ends, np.int64)
        same = np.array(whole, bool) & (wrong[ends] == wrong[np.r_[0, ends[:-1]]])
        return ids, np.r_[0, stop][ends], same

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def _joined(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        held = bytearray()
        texts, byte = self._texts, self._byte
        for i in ids:
            if i in byte:
                held.append(byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(texts[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        text = self._joined(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_codecs: dict[bytes, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The codec of a model; built once in each worker."""
    if raw not in _codecs:
        _codecs.clear()
        _codecs[raw] = Codec(raw)
        gc.freeze()  # the automaton stays: the collector need not walk it again and again
    return _codecs[raw]


def encode(docs: DataFrame, model_path: str = MODEL_PATH, column: str = "text", verify: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens of the whole text; with ``verify`` also round_trip, whether the
    ids decode to the text (in the same Python worker, so that no second one holds another automaton)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = codec(model.value)
        for part in parts:
            ids, ends, same = own.encode_all(part.column(column).to_pylist())
            made = {"ids": pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))}
            yield made | ({"round_trip": pa.array(same, pa.bool_())} if verify else {})
        own.forget()  # the worker lives on and does other work

    added = StructType().add("ids", ArrayType(IntegerType()))
    out = map_slices(docs, column, encoded, added.add("round_trip", "boolean") if verify else added, SLICE)
    return out.withColumn("n_tokens", F.size("ids"))


def decode(rows: DataFrame, model_path: str = MODEL_PATH, column: str = "ids") -> DataFrame:
    """rows with decoded, the text of the ids."""
    with open(model_path, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model.value)
        for b in batches:
            for at in range(0, len(b), DECODED):
                yield pd.Series([None if x is None else own.decode(x.tolist()) for x in b.iloc[at : at + DECODED]], dtype=object)

    return rows.withColumn("decoded", text(F.col(column)))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return docs.select("doc_id", "n_tokens", "ids", "round_trip")
